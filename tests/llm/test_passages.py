"""Substring dedup against a brute-force search of repeated passages, on tables read, shuffled and of odd rows."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from torrentia.llm import substring_dedup

DOCS = "/root/testdata/sf0.01/documents.parquet"
WORDS = 51


def passages(rows):
    """Of each row, the maximal byte ranges in which every run of WORDS words stands in another row too."""
    at, seen = [], collections.Counter()
    for _, text in rows:
        raw = (text or "").encode()
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        runs = [hash(raw[words[i][0] : words[i + WORDS - 1][1]]) for i in range(len(words) - WORDS + 1)]
        seen.update(set(runs))
        at.append((words, runs))
    out = []
    for n, (words, runs) in enumerate(at):
        last = None
        for i, h in enumerate(runs):
            if seen[h] < 2:
                continue
            if last is not None and i == last + 1:
                out[-1][2] = words[i + WORDS - 1][1]
            else:
                out.append([n, words[i][0], words[i + WORDS - 1][1]])
            last = i
    return out


def test_recall_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(DOCS).select("doc_id", "text").collect()]
    found = collections.defaultdict(list)
    for r in substring_dedup.repeats(spark.read.parquet(DOCS)).collect():
        found[r.doc_id].append((r.start, r.end))
    want = passages(rows)
    hit = sum(any(a < e and s < b for a, b in found[rows[n][0]]) for n, s, e in want)
    assert len(want) > 100 and hit >= 0.95 * len(want)


def test_same_spans_from_a_shuffled_table(spark):
    docs = spark.read.parquet(DOCS)
    spans = lambda df: sorted((r.doc_id, r.start, r.end, r.n_words, r.n_chunks, r.n_copies) for r in substring_dedup.repeats(df).collect())
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        shuffled = spans(docs.repartition("doc_id").withColumn("start", F.lit("clash")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert shuffled == spans(docs) and len(shuffled) > 300


def test_columns_stay_and_odd_rows(spark):
    prose = " ".join(f"word{i * 7919 % 997}" for i in range(300))
    rows = [(1, prose, "a"), (1, prose, "b"), (None, prose, "c"), (4, None, "d"), (5, "", "e"), (6, "x" * 3_000_000, "f"), (7, "z " * 200_000, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string").withColumn("digest", F.lit(1))
    out = {r.rid: r for r in substring_dedup.deduplicate(df).collect()}
    assert substring_dedup.deduplicate(df).columns == df.columns and len(out) == len(rows)
    assert sum(len(out[k].text) for k in "abc") < len(prose) + 200  # one of the three stays
    assert out["d"].text is None and out["e"].text == "" and len(out["f"].text) == 3_000_000  # one word
    assert len(out["g"].text) < 2_000
    got = substring_dedup.repeats(df).collect()
    assert {r.doc_id for r in got if r.n_words > 250} >= {1, None} and len({r.first_doc_id for r in got if r.doc_id in (1, None)}) == 1
    assert substring_dedup.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [substring_dedup.PIECE - 1, substring_dedup.PIECE + 40])
def test_cuts_are_the_same_in_pieces(monkeypatch, size):
    import numpy as np

    data = np.random.default_rng(3).integers(97, 123, size, dtype=np.uint8)
    whole = substring_dedup.cuts(data)
    monkeypatch.setattr(substring_dedup, "PIECE", 1 << 16)
    assert substring_dedup.cuts(data) == whole
