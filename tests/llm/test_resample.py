"""Importance resampling against plain Python, and its defined results."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from casegraph.llm import resample
from casegraph.llm import text as tx

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(t):
    return WORD.findall((t or "").encode().translate(LOWER))


def buckets(t, n=10_000):
    w = words(t)
    return [zlib.crc32(b" ".join(w[i : i + k])) % n for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, percent=5, min_words=20):
    s, t = Counter(b for _, x in rows for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_t * 0 + big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for i, x in rows:
        f = buckets(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    live = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(live[: len(live) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def made(seed, n, longest=60):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "straße", "x" * 90, "42", "é", "de", "the"] + [f"w{k}" for k in range(40)]
    return [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, longest)))) for k in range(n)]


def run(spark, rows, target, **how):
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, score string, n_words double")
    out = resample.resample(docs.repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), **how)
    return sorted((tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_resample_equals_brute_force(spark, percent):
    rows = made(1, 200) + [(500, None), (501, ""), (502, "!?"), (None, " ".join(["w1"] * 30)), (503, "one")]
    target = [t for _, t in made(2, 20)] + [None, ""]
    assert run(spark, rows, target, percent=percent) == brute(rows, target, percent)


def test_ranges_and_brackets(spark, monkeypatch):
    """Many ranges, a coarse sketch and many equal scores: the cutoff and the ranks stay exact."""
    monkeypatch.setattr(resample, "RANGE_ROWS", 16)
    rows = made(3, 150) + [(7, " ".join(["w3"] * 25))] * 90  # one document many times: equal score and id
    target = [t for _, t in made(4, 9)]
    assert run(spark, rows, target, percent=30) == brute(rows, target, 30)
    scores = spark.createDataFrame([(k % 3, k) for k in range(1000)], "score long, id long")
    for k in (1, 333, 334, 500, 1000):
        lo, hi, above = resample.bracket(scores, k, 1000, 10)
        want = sorted((r[0] for r in scores.collect()), reverse=True)
        assert lo <= want[k - 1] <= hi and above == sum(x > hi for x in want) < k


def test_features_across_parts():
    """Parts of a long text lose no n-gram, wherever the cuts fall."""
    text = " ".join(t for _, t in made(5, 60)) + " " + "y" * 500
    data = np.frombuffer(text.encode(), np.uint8)
    for limit in (5, 64, 1000, 1 << 20):
        got = sorted(int(b) for _, _, bucket in resample.features(data, np.array([0, len(data)]), limit=limit) for b in bucket)
        assert got == sorted(buckets(text)), limit


def test_crcs_of_many_rows():
    texts = [t for _, t in made(6, 80)] + [None, "", "a b c", "Z"]
    data, at = tx.buffers(pa.array(texts))
    got = [[] for _ in texts]
    for word_row, row, bucket in resample.features(data[at[0] : at[-1]], at - at[0]):
        for r, b in zip(row.tolist(), bucket.tolist()):
            got[r].append(b)
        assert np.bincount(word_row, minlength=len(texts)).tolist() == [len(words(t)) for t in texts]
    assert [sorted(g) for g in got] == [sorted(buckets(t)) for t in texts]


def test_very_long_text_and_empty_tables(spark):
    rows = [(1, " ".join(f"w{k % 977}" for k in range(900_000))), *made(7, 30)]
    assert run(spark, rows, ["w1 w2 w3"], percent=50) == brute(rows, ["w1 w2 w3"], 50)
    assert run(spark, [], ["w1"]) == []
    assert run(spark, made(8, 30), []) == brute(made(8, 30), [])
    docs = spark.createDataFrame(made(9, 20), "doc_id long, text string")
    out = resample.resample(docs, docs.select("text"))
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and out.count() == 20
