"""Periodic runs held against a search of all stretches."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from torrentia.llm import periodic_runs as R


def brute_runs(words):
    """Every period, every maximal stretch, and the least period of each."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)  # periods ascend, so the first is the least
            i = max(j, i + 1)
    return sorted((s, n_, q) for (s, n_), q in out.items())


def brute_row(doc_id, text):
    words, x = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [x] if x else []
            x = ""
        else:
            x += c
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    stays = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(stays))


def test_runs_equal_brute_force():
    r = random.Random(3)
    for trial in range(3000):
        k, n = r.choice([1, 2, 2, 3, 5, 9]), r.randrange(0, 90)
        words = [str(r.randrange(k)) for _ in range(n)]
        for _ in range(r.randrange(4)):  # runs, next to each other, nested, of a period that a run has inside
            unit = [str(r.randrange(k + 2)) for _ in range(r.randrange(1, 9))]
            if r.random() < 0.4:
                unit = [unit[0]] * r.randrange(5, 9) + unit
            at = r.randrange(len(words) + 1)
            words[at:at] = (unit * r.randrange(2, 8))[: r.randrange(4, 60)]
        assert R.find_runs(words) == brute_runs(words), (trial, words)


def test_segments_keep_every_run_and_are_stable():
    r = random.Random(8)
    for _ in range(500):
        codes = np.array([min(r.randrange(12), r.randrange(12)) for _ in range(r.randrange(1, 120))])
        cut = R.segments(codes)
        for a, b in cut:
            assert b - a >= R.LEAST_WORDS and np.unique(codes[a:b], return_counts=True)[1].min() >= R.LEAST_TIMES
        for s, n, _ in brute_runs(codes.tolist()):
            assert any(a <= s and s + n <= b for a, b in cut)


def test_long_texts_take_little_work():
    """One word, a long period, and a period in a period, a million words in all."""
    one = ["x"] * 300_000
    assert R.find_runs(one) == [(0, 300_000, 1)]
    unit = [f"w{i}" for i in range(9_000)]
    inner = [*(["a", "b"] * 20), *(f"v{i}" for i in range(50))]
    words = unit * 40 + ["|"] + inner * 3_000
    found = R.find_runs(words)
    assert (0, 360_000, 9_000) in found and (360_001, 270_000, 90) in found
    assert sum(q == 2 for _, _, q in found) == 3_000 and len(found) == 3_002


def test_query_equals_brute_force_on_whole_table(spark):
    d = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = R.op12_periodic_runs(spark, d)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_row(*r) for r in texts)
    assert got.where("n_runs > 0").count() > 5


def test_odd_inputs(spark):
    rows = [(1, "a b " * 9, "x"), (1, "a b " * 9, "y"), (2, None, None), (None, "", "z"), (3, "q r " * 8, "u"), (4, "once only", "v"), (10**12, "z\x1c " * 7, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shorter string").withColumn("a.b", F.lit(7))
    want = sorted((r[0], s, n, q) for r in rows for s, n, q in brute_runs((r[1] or "").split(" ")[:-1]))
    got = R.runs(docs).collect()
    assert sorted((r.doc_id, r.start, r.length, r.period) for r in got) == want and {r.unit for r in got} == {"a b", "q r", "z\x1c"}
    out = R.collapsed(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r.shorter, r["a.b"]) for r in out.collect()} == {(1, "a b", "x", 7), (1, "a b", "y", 7), (2, None, None, 7), (None, "", "z", 7), (3, "q r", "u", 7), (4, "once only", "v", 7), (10**12, "z\x1c", "w", 7)}
    for f in (R.runs, R.collapsed, R.summaries, lambda x: R.summaries(R.planted(x))):
        assert f(docs.limit(0)).count() == 0
    assert R.summaries(docs).where("doc_id is null").first().n_runs == 0
