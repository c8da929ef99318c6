"""Language labels: learned accuracy, spans of mixed texts, odd rows, Viterbi against all labellings."""

import itertools
import random
import zlib

import numpy as np
import pytest

from chronoloom.llm import languages

WORDS = {
    "xa": "the and of to in that was with for have this from they which would there their".split(),
    "xb": "der die und nicht ein eine mit auch sich werden über für schön möchte zwischen".split(),
    "xc": "это как что был она они только может когда уже если будет время".split(),
    "xd": "ово није само када људи које ћемо нешто још увек ђак љубав".split(),
}
SCHEMA = "doc_id bigint, text string, lang string, score string, id int"


def sentence(draw, lang, n):
    return " ".join(draw.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def learned(spark):
    draw = random.Random(5)
    rows = [(i, sentence(draw, lang, 30), lang, None, 0) for i, lang in enumerate(sorted(WORDS) * 50)]
    return rows, languages.fit(spark.createDataFrame(rows, SCHEMA))


def test_held_out_rows_teach_nothing(spark, learned):
    rows, model = learned
    seen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert model.languages == sorted(WORDS) and np.allclose(np.exp(model.prior), [sum(r[2] == lang for r in seen) / len(seen) for lang in model.languages])
    scripts = [[languages.NAMES[s] for s in np.flatnonzero(model.candidates[:, k])] for k in range(4)]
    assert scripts == [["latin"], ["latin"], ["cyrillic"], ["cyrillic"]]
    got = {r.doc_id: r for r in languages.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[r[0]].lang_pred == r[2] and got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    poisoned = [r if zlib.crc32(str(r[0]).encode()) % 4 != 2 else (*r[:2], "xz", *r[3:]) for r in rows]
    again = languages.identify(spark.createDataFrame(poisoned, SCHEMA))
    assert {r.doc_id: (r.lang_pred, r.score) for r in again.collect()} == {k: (r.lang_pred, r.score) for k, r in got.items()}


def test_spans_of_mixed_texts(spark, learned):
    draw = random.Random(6)
    parts = [("xa", 40), ("xb", 12), ("xc", 20), ("xa", 15)]
    texts = [sentence(draw, lang, n) for lang, n in parts]
    row = languages.label(spark.createDataFrame([(1, ". ".join(texts), "?", "kept?", 3)], SCHEMA), learned[1]).first()
    assert [s.lang for s in row.spans] == [lang for lang, _ in parts] and row.lang_pred == "xa" and row.id == 3
    at = 0
    for text, span in zip(texts, row.spans, strict=True):
        assert abs(span.start - at) <= 8 and abs(span.end - at - len(text)) <= 8
        at += len(text) + 2
    assert 0.4 < row.score < 0.8


def test_odd_rows(spark, learned):
    odd = [None, "", " \t\n", "12 + 34 = 46 !", "́̂", "\U0001f600", "北京是一个城市", "the" * 100_000, "the and of " * 30_000, "Ñ", "the\0and"]
    rows = [(i if i else None, t, "xa", "s", i) for i, t in enumerate(odd)] + [(5, "der die und", None, None, None)] * 3
    got = languages.label(spark.createDataFrame(rows, SCHEMA), learned[1]).collect()
    by = {r.id: r for r in got if r.id is not None}
    assert len(got) == len(rows) and all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].spans == [] for i in range(6))
    assert by[6].lang_pred in WORDS and by[7].lang_pred == by[8].lang_pred == by[10].lang_pred == "xa" and by[8].spans[0].end == 330_000 - 1
    assert all(0 <= r.score <= 1 for r in got) and [r.lang_pred for r in got if r.id is None] == ["xb"] * 3


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "words", None, None, 1), (None, "words", "xa", None, 1), (3, None, "xa", None, 1)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in languages.identify(rows).collect()] == [("und", 0.0)] * 3
    assert languages.identify(rows.where("false")).collect() == []


def test_viterbi_is_the_best_labelling():
    draw = np.random.default_rng(3)
    for _ in range(40):
        counts = draw.integers(1, 6, 3)
        begin, scores, prior = np.concatenate([[0], np.cumsum(counts)[:-1]]), draw.normal(size=(counts.sum(), 3)), draw.normal(size=3)
        got = languages.viterbi(scores, begin, counts, prior, 0.7)
        worth = lambda b, path: prior[path[0]] + sum(scores[b + i, k] for i, k in enumerate(path)) - 0.7 * sum(x != y for x, y in itertools.pairwise(path))  # noqa: E731, B023
        for b, n in zip(begin, counts, strict=True):
            best = max(worth(b, p) for p in itertools.product(range(3), repeat=int(n)))
            assert abs(worth(b, got[b : b + n]) - best) < 1e-9
