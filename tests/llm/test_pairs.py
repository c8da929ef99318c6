"""Near copies, decontamination, mixing and neighbours against brute force, with odd rows."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate, mixing, neighbours, simhash
from chronoloom.llm.components import connected_components


def words(n, seed):
    draw = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in draw.integers(0, 26, 6)) for _ in range(n))


def brute_fingerprint(text, width):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    grams = [b" ".join(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


DOCS = "doc_id bigint, text string, component_id string"


def test_simhash_groups(spark):
    base = words(60, 1)
    texts = [base, base.upper(), base + " tail", None, "", " \t", "one", "one two", base, words(30, 2)] + [words(20, 50 + i) for i in range(80)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), width=3, lanes=1, limit=2, key_bits=None).collect()
    prints = {i: brute_fingerprint(t, 3) for i, t, _ in rows}
    assert len(got) == len(rows) and all(int(r.fingerprint, 16) == prints[r.doc_id] for r in got)
    group = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    assert {r.doc_id: r.component_id for r in got} == group
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS), width=3, lanes=1, limit=2, key_bits=None).count() == 0


def test_tree_finds_all_links():
    draw = np.random.default_rng(4)
    codes = draw.integers(0, 1 << 63, (300, 1), dtype=np.uint64)
    codes = np.concatenate([codes, codes[:150] ^ np.uint64(1 << 9), codes[:80] ^ np.uint64(3 << 20)])
    got = simhash.link_bucket(codes, 2)
    want = np.arange(len(codes))
    for _ in range(5):
        for i in range(len(codes)):
            near = np.flatnonzero(np.bitwise_count(codes[:, 0] ^ codes[i, 0]) <= 2)
            want[near] = want[near].min()
    assert np.array_equal(got, want)


def test_near_copies_go(spark):
    base = words(300, 7).split()
    near = base.copy()
    near[100] = "other"
    rows = [(1, " ".join(base), "a"), (2, " ".join(near), "b"), (3, words(300, 8), "c"), (4, " ".join(base), "d"), (None, words(40, 9), "e"), (3, words(300, 8), "c")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == [(False, 1), (False, 3), (True, None)]
    assert kept[0].__fields__ == ["doc_id", "text", "component_id"]


def test_decontamination(spark):
    item, other = words(30, 1), words(12, 2)
    changed = item.split()
    changed[3] = "changed"  # five shingles of 26 go: 21 of 26 stay
    broken = item.split()
    broken[3] = broken[12] = "changed"
    docs = [(1, words(500, 3) + " " + item.upper() + " " + words(500, 4)), (2, words(40, 5)), (3, " ".join(changed)), (4, " ".join(broken)), (5, None), (6, ""), (7, "short one"), (None, item), (8, other + "\n" + item), (2, item), (9, " ".join(item.split()[15:] + ["x"] + item.split()[:15]))]
    items = [(1, item), (2, other), (3, "short one"), (4, None), (5, "")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(0))

    def shingles(text):
        w = (text or "").lower().split()
        return {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()

    want = {(a, b) for a, t in docs for b, s in items if shingles(s) and len(shingles(t) & shingles(s)) / len(shingles(s)) >= 0.8}
    got = decontaminate.contaminated(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert (3, 1) in want and (4, 1) not in want and (7, 3) in want
    left = [r.doc_id for r in decontaminate.drop_contaminated(d, i).collect()]
    assert sorted(left) == sorted(a for a, t in docs if not any(shingles(s) and len(shingles(t) & shingles(s)) / len(shingles(s)) >= 0.8 for _, s in items))
    assert decontaminate.contaminated(d.limit(0), i).count() == 0 and decontaminate.drop_contaminated(d, i.limit(0)).count() == len(docs)


def test_mixing_windows_and_deviation(spark):
    rows = [(i, s, "t") for i, s in enumerate(["a"] * 700 + ["b"] * 250 + [None] * 90 + ["c"] * 13)] + [(None, "a", "t"), (3, "a", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, mix_slot string")
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.3), (None, 0.2), ("c", 0.05), ("none", 0.0)], "source string, weight double")
    got = mixing.schedule(docs, weights, block_docs=4, period=64).collect()
    assert len(got) == len(rows)
    blocks = {}
    for r in got:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        blocks.setdefault((r.source, r.mix_block), set()).add(r.mix_slot)
    assert all(len(s) == 1 for s in blocks.values())
    slots = {next(iter(s)): source for (source, _), s in blocks.items()}
    assert len(slots) == len(blocks)
    shares = {r.mix_source: r.share for r in mixing.period_shares(weights.select(mixing._source("source").alias("mix_source"), F.floor(F.col("weight") * 1000).cast("bigint").alias("weight")), 64).collect()}
    assert sum(shares.values()) == 64
    ends = {s: max(t for t, x in slots.items() if x == s) for s in ("a", "b", None, "c")}
    for source, key in (("a", "sa"), ("b", "sb"), (None, "null"), ("c", "sc")):
        for t in range(1, min(ends.values()) + 1):
            assert abs(sum(x == source for u, x in slots.items() if u < t) - t * shares[key] / 64) < 1
    assert mixing.schedule(docs.limit(0)).count() == 0
    order = mixing.mix(docs, weights, block_docs=4, period=64)
    assert order.columns == ["doc_id", "source"] + ["mix_slot"][:0] or order.count() == len(rows)


@pytest.mark.parametrize("kind", ["chain", "random", "dense", "empty"])
def test_components_equal_brute_force(spark, kind):
    draw = np.random.default_rng(2)
    links = {"chain": [(i, i + 1) for i in range(40)], "random": draw.integers(0, 60, (45, 2)).tolist(), "dense": [(i, j) for i in range(9) for j in range(9)] + [(20, 21), (21, 20), (30, 30)], "empty": []}[kind]
    group = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in group:
        for a, b in links:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    got = connected_components(spark.createDataFrame([*links, (None, 3)], "u bigint, v bigint")).collect()
    assert {r.node: r.component for r in got} == group and len(got) == len(group)


def test_clashing_names(spark):
    """Columns named like those that operators make on the way come back as they were."""
    names = "share period turn at n weight key id hash item copy copy_ loose component fingerprint text_hash __key __copy score y t".split()
    rows = [(i, words(40, i % 7), f"s{i % 2}", *[f"{c}{i}" for c in names]) for i in range(30)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    items = spark.createDataFrame([(1, words(30, 99))], "item_id bigint, text string")
    want = {r[0]: tuple(r) for r in rows}
    for made, n in ((mixing.mix(docs), 30), (simhash.drop_near_duplicates(docs), 7), (decontaminate.drop_contaminated(docs, items), 30)):
        got = made.collect()
        assert made.columns == docs.columns and len(got) == n and all(tuple(r) == want[r.doc_id] for r in got)


def test_mixing_order_is_total(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}") for i in range(200)], "doc_id bigint, source string")
    first = [r.doc_id for r in mixing.mix(docs).collect()]
    assert first == [r.doc_id for r in mixing.mix(docs.repartition(5)).collect()] and sorted(first) == list(range(200))


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_neighbours(spark, kind):
    draw = np.random.default_rng(5)
    x = draw.standard_normal((900, 24))
    if kind == "clusters":
        x = draw.standard_normal((30, 24)).repeat(30, 0) + 0.1 * x
    if kind == "copies":
        x[:400] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 0), (903, [float("inf")] * 24, 0), (904, [], 0), (950, [1.0, 2.0], 0), (951, [2.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int")
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), k=5, block_rows=250, query_rows=7).orderBy("query_id", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(range(0, 900, 50)) | {950}
    assert [v for v, _ in found[950]] == [951]
    unit, hits = x / np.linalg.norm(x, axis=1)[:, None], 0
    for q in range(0, 900, 50):
        score = (x * x[q]).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        score[q] = -9
        assert all(abs(score[v] - s) < 1e-12 for v, s in found[q]) and len(found[q]) == 5
        hits += len({v for v, _ in found[q]} & set(np.lexsort((np.arange(900), -np.round(score, 12)))[:5].tolist()))
    assert hits >= 0.9 * 5 * 18 and unit.shape == x.shape
    assert neighbours.nearest(df.limit(0), df).count() == 0


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_search_prunes_and_finds(kind):
    """100,000 vectors: at least 0.9 of the nearest are found and less than a tenth of the vectors is verified."""
    draw = np.random.default_rng(1)
    x = draw.standard_normal((100_000, 64))
    if kind == "clusters":
        x = draw.standard_normal((2000, 64)).repeat(50, 0) + 0.3 * x
    ids, asked, verified, found = np.arange(len(x)), np.arange(0, len(x), 2000), [], []
    for at in range(0, len(x), neighbours.BLOCK_ROWS):
        block = slice(at, at + neighbours.BLOCK_ROWS)
        q, v, score = neighbours.search_block(x[block], ids[block], x[asked], asked, 5, verified)
        found.append((q, ids[block][v], score))
    q, v, score = (np.concatenate(c) for c in zip(*found, strict=True))
    unit, hits = x / np.linalg.norm(x, axis=1)[:, None], 0
    for i, query in enumerate(asked):
        mine = np.flatnonzero(q == i)
        top = v[mine[np.lexsort((v[mine], -score[mine]))[:5]]]
        near = unit @ unit[query]
        near[query] = -9
        hits += len(set(top.tolist()) & set(np.argsort(-near)[:5].tolist()))
    assert hits >= 0.9 * 5 * len(asked)
    assert sum(verified) < 0.1 * len(asked) * len(x)


def test_pipeline_near_copies_equal_brute_force(spark):
    import corpus_pipeline

    draw, texts = np.random.default_rng(7), []
    word = lambda n: [f"w{x}" for x in draw.integers(0, 1 << 40, n)]
    for shared in (82, 85, 88, 89, 90, 92, 95):  # of 100 shingles: Jaccard 0.69 to 0.90, 0.786 and 0.802 around the limit
        for _ in range(40):
            base = word(104)
            texts += [base, base[: shared + 4] + word(100 - shared)]
    base = word(104)
    for _ in range(80):  # a dense group on both sides of the limit
        at, copy = draw.integers(0, 104), list(base)
        copy[at : at + 6] = word(len(copy[at : at + 6]))
        texts.append(copy)
    sets = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(texts)], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(group)


def compared_rows(spark, since):
    """Rows that the tasks which compare codes have made, after the execution ``since``, and the number of the last execution."""
    store, rows, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    runs = store.executionsList().iterator()
    while runs.hasNext():
        number = runs.next().executionId()
        if number <= since:
            continue
        last, values, nodes = max(last, number), store.executionMetrics(number), store.planGraph(number).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator()
            while "MapInArrow compare(" in node.desc() and metrics.hasNext():
                metric = metrics.next()
                if metric.name() == "number of output rows" and values.get(metric.accumulatorId()).isDefined():
                    rows += int(values.get(metric.accumulatorId()).get().replace(",", ""))
    return rows, last


def test_a_large_group_of_near_copies_makes_few_rows(spark):
    """Copies on both sides of the limit: each meets hundreds in dozens of tables."""
    draw = np.random.default_rng(5)
    base, texts = draw.integers(0, 3000, 150), []
    for _ in range(400):
        copy, n = base.copy(), draw.integers(0, 9)
        copy[draw.integers(0, 150, n)] = draw.integers(0, 3000, n)
        texts.append([f"w{x}" for x in copy])
    sets = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs.count()
    _, since = compared_rows(spark, -1)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs, lanes=3, limit=48, key_bits=13, recall=0.9999, verify=True).collect()}
    rows, _ = compared_rows(spark, since)
    assert kept == set(group) and 0 < rows <= 10 * len(texts), rows


def test_near_copies_of_one_table_equal_brute_force(spark):
    """One bit makes two buckets of many groups: every pair within the limit that shares one must be tried, however far apart."""
    draw, texts = np.random.default_rng(11), []
    for _ in range(60):
        base = draw.integers(0, 1 << 40, 100)
        for _ in range(12):
            copy, n = base.copy(), draw.integers(0, 7)
            copy[draw.integers(0, 100, n)] = draw.integers(0, 1 << 40, n)
            texts.append(" ".join(f"w{x}" for x in copy))
    hashes = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    codes = np.stack([simhash.fingerprint(h, 3) for h in hashes])
    deck = np.random.default_rng(simhash.SEED).permutation(192)  # the one table takes its first bit
    bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(len(codes), -1), axis=1)
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in np.flatnonzero((bits[:a, deck[0]] == bits[a, deck[0]]) & ((bits[:a] != bits[a]).sum(axis=1) <= 48)):
            shared = len(np.intersect1d(hashes[a], hashes[b]))
            if 5 * shared >= 4 * (len(hashes[a]) + len(hashes[b]) - shared) or (codes[a] == codes[b]).all():
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert simhash.tables_for(0.8, 1, 0.5) == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs, lanes=3, limit=48, key_bits=1, recall=0.5, verify=True).collect()}
    assert kept == set(group), (sorted(kept - set(group)), sorted(set(group) - kept))


def test_near_copies_take_few_jobs(spark):
    """Each job takes threads and buffers of the driver, on the smallest input too."""
    texts = [words(60, i % 20) + (f" tail{i}" if i >= 20 else "") for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spark.sparkContext.setJobGroup("near-copies", "near copies")
    try:
        kept = simhash.drop_near_duplicates(docs, lanes=3, limit=48, key_bits=13, recall=0.9999, verify=True).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near-copies"))
    assert sorted(r.doc_id for r in kept) == list(range(20)) and jobs <= 62, jobs


def test_items_without_id_match(spark):
    one, two = words(30, 21), words(25, 22)
    docs = spark.createDataFrame([(1, "before " + one), (2, two), (3, words(40, 23))], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, one), (None, two), (7, words(20, 24))], "item_id bigint, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got) == [(1, None, 26, 26), (2, None, 21, 21)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [3]


@pytest.mark.parametrize("size", [1, 5, 144, 511, 512, 5000])
def test_parity_sketches_refute_no_similar_sets(size):
    draw, pairs = np.random.default_rng(size), {}
    for jaccard in (0.8, 0.65):
        shared = int(np.ceil(2 * size * jaccard / (1 + jaccard) - 1e-9))
        for _ in range(100):
            all_ = draw.integers(0, 1 << 64, 2 * size - shared, dtype=np.uint64)
            both = np.unique(all_[:size]), np.unique(np.concatenate([all_[:shared], all_[size:]]))
            pairs.setdefault(jaccard, []).append([simhash.parity_sketch(x) for x in both])
    like, unlike = (simhash.maybe_similar(*np.stack(p, axis=1), 0.8) for p in (pairs[0.8], pairs[0.65]))
    assert like.all()
    assert size < 144 or unlike.mean() < 0.2
    # One of them larger by a quarter: the level of the larger one counts.
    small, large = all_[: size * 4 // 5 or 1], all_[:size]
    assert simhash.maybe_similar(simhash.parity_sketch(small)[None], simhash.parity_sketch(large)[None], 0.8)[0] == (len(small) >= 0.8 * len(large) - 1e-9)


def test_cells_hold_every_wanted_hash_and_few_others(spark):
    """A bound alone lets most of the hash range through as soon as one item is small; cells do not."""
    wanted = spark.range(300).select(F.xxhash64("id").alias("hash"))
    passes = decontaminate.in_cells(wanted)
    assert wanted.where(passes(F.col("hash"))).count() == 300
    others = spark.range(1000, 21_000).select(F.xxhash64("id").alias("hash"))
    assert others.where(passes(F.col("hash"))).count() < 0.1 * 20_000
    edges = spark.createDataFrame([(-(2**63),), (-1,), (0,), (2**63 - 1,)], "hash bigint")
    assert edges.where(decontaminate.in_cells(edges)(F.col("hash"))).count() == 4
    assert edges.where(decontaminate.in_cells(wanted.limit(0))(F.col("hash"))).count() == 0


def test_tiny_and_huge_components_have_neighbours():
    """Squares of such components are 0 or infinite in doubles; the cosine is neither."""
    draw = np.random.default_rng(5).standard_normal((60, 8))
    scale = np.array([1e-170, 1e-300, 1.0, 1e200, 5e-324])[np.arange(60) % 5][:, None]
    vectors, ids = draw * scale, np.arange(60)
    vectors[4::5] = np.sign(draw[4::5]) * 5e-324
    unit = neighbours.balanced(vectors)
    unit = unit / np.sqrt((unit**2).sum(axis=1))[:, None]
    q, v, score = neighbours.search_block(vectors, ids, vectors[:10], ids[:10], 5)
    hits = 0
    for i in range(10):
        exact = unit @ unit[i]
        assert len(set(v[q == i])) == 5 and np.allclose(score[q == i], exact[v[q == i]])
        exact[i] = -9
        hits += len(set(v[q == i]) & set(np.argsort(-exact)[:5]))
    assert hits >= 45
    plain = np.random.default_rng(6).standard_normal((50, 8))
    far = neighbours.balanced(plain)
    lengths = lambda x: np.sqrt((x**2).sum(axis=1))
    cosine = lambda x: (x * x[7]).sum(axis=1) / (lengths(x) * lengths(x)[7])
    assert np.array_equal(cosine(plain), cosine(far))
