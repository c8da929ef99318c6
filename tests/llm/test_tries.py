"""Prefix trie of conversations against a plain one, with long conversations, ties and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from chronoloom.llm import tries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, k1 string"


def digest(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t for *_, t in sorted(v, key=lambda x: (x[:2], digest(x[2])))] for c, v in own.items()}
    walks = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        walks[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    members = defaultdict(list)
    for c, walk in sorted(walks.items()):
        for d in range(len(walk) + 1):
            members[walk[:d]].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    out, sums = [], {}
    for key in sorted(members, key=len, reverse=True):
        n = len(members[key])
        below = [sums[k] for k in children[key]]
        sums[key] = (sum(b[0] for b in below) if below else 1, sum(b[1] for b in below) + (n - 1) * (len(key[-1][1].encode()) if key else 0))
        ends = ",".join(str(c) for c in members[key] if len(walks[c]) == len(key))
        out.append((members[key][0], len(key), members[key[:-1]][0] if key else None, n, len(children[key]), *sums[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows):
    got = tries.prefix_trie(*tries.rebuilt(tries.ordered_turns(spark.createDataFrame(rows, SCHEMA))))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed, blocks", [(1, 12), (2, 2)])
def test_equal_to_a_plain_trie(spark, monkeypatch, seed, blocks):
    """With blocks of four places every longer conversation and path crosses several of them."""
    monkeypatch.setattr(tries, "BLOCK_BITS", blocks)
    draw, rows = random.Random(seed), []
    for c in [*range(60), *range(-12, 0), 3000, 3001, 2**62]:
        length = draw.choice([0, 1, 3, 9, 14, 40]) if c % 7 else 30
        for t in range(length):
            rows.append((c, t, draw.choice(["user", None, "assistant"]), draw.choice(["", "ä€", None, "hello", "x"] if t > 1 else ["hi"]), t, "x"))
    rows += [(4, None, "user", "early", 0, "x"), (4, None, None, None, 0, "x"), (4, 2, "a", "tie", 0, "x"), (4, 2, "a", "tie", 0, "x"), (None, 1, "a", "b", 0, "x"), (9, 1, None, None, None, None)]
    draw.shuffle(rows)
    assert made(spark, rows) == plain(rows)


def test_copies_one_long_path_and_many_branches(spark, monkeypatch):
    monkeypatch.setattr(tries, "BLOCK_BITS", 4)
    rows = [(c, t, "u", f"common {t}", 0, "") for c in range(0, 300, 5) for t in range(12)]
    rows += [(5000, t, "u", f"common {t}", 0, "") for t in range(700)] + [(c, 0, "u", f"own {c}", 0, "") for c in range(6000, 6400, 5)]
    assert made(spark, rows) == plain(rows)


def test_turnless_and_empty(spark):
    lone = next(c for c in range(1, 2000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    assert made(spark, [(lone, 0, "u", "gone", 0, "")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert made(spark, [(None, 0, "u", "x", 0, "")]) == []
