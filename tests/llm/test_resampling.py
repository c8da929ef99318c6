"""Importance resampling against a plain computation, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from chronoloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, score int, made int"


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=5):
    s, t = Counter(), Counter()
    for row in docs:
        s.update(features(row[1])[1])
    for (text,) in target:
        t.update(features(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text, *_ in docs:
        w, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= 20])
    drawn = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for place, row in enumerate(drawn[: percent * len(drawn) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_equal_to_plain_computation(spark, percent):
    docs = [(i, " ".join(f"w{(i * k) % 97} Été{k % 5}" for k in range(i % 60)), i, 1) for i in range(240)]
    docs += [(1000, None, 0, 0), (1001, "", 0, 0), (1002, "!!! ... \t\n", 0, 0), (1003, "İstanbul 北京 ÀB A_b" * 9, 0, 0), (None, "w1 w2 " * 30, 0, 0), (1004, "w1 " * 20000, None, None)]
    target = [("w3 été1 w6 été2 w9",), (None,), ("w1 w1 w1",)]
    got = resampling.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(target, "text string"), percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, percent)


def test_repeated_rows_take_a_place_each(spark):
    docs = [(7, "a b c " * 10, 0, 0)] * 30 + [(i, "a b d " * 10, 0, 0) for i in range(10)]
    got = resampling.resample(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([("a b c",)], "text string"), percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 21)) and len(got) == 40


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b", 0, 0)], SCHEMA), spark.createDataFrame([], "text string")
    assert resampling.resample(docs, none).collect()[0].asDict() | {"score": 0} == {"doc_id": 1, "n_features": 3, "weight": -2079, "score": 0, "rank": None}
    assert resampling.resample(docs.where("false"), none).collect() == []
