"""Exact dedup: two-pass Bloom filtering, so that only possibly repeated hashes shuffle.

Pass one hashes each normalised text (white space deleted); a hash sets two filter positions. Each task adds up its own, so that what shuffles are two planes
for each segment of the filter (the positions set once, and those set twice or more), not rows; planes of a segment are merged,
and a position set twice or more is kept in the filter. Pass two tests each hash:
only rows whose both positions are kept can have an equal, and only they shuffle, by their SHA-256.
All the others pass straight through as unique. False positives merely shuffle; results are exact.

The filter has 8 bits a row, to the next power of two, up to `MAX_FILTER_BYTES`, which is the proven
bound of what is broadcast. Beyond 256 million rows it fills up, so more rows shuffle; results don't change.

Null text counts as empty. Of equal texts, the row with the most code points in the original text, then
the smallest doc_id (null last) stays; of rows that also agree in these, one. An empty table gives an
empty result. `exact_groups` ignores extra columns; `deduplicate` returns the input's columns as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torrentia.llm.common import SPACE, col, discard, materialise, renamed

MAX_FILTER_BYTES = 256 << 20
HELD = 1 << 20  # hashes whose positions a task adds up at once
SEGMENT_BITS = 1 << 19


def _normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), SPACE + "+", "")


def _places(h: np.ndarray, mask: int) -> np.ndarray:
    """The two filter positions of each hash, a row each."""
    v = h.astype(np.int64).view(np.uint64)
    return np.stack([v & np.uint64(mask), (v >> np.uint64(32)) & np.uint64(mask)])


def repeated_filter(hashes: DataFrame, n_rows: int, max_bytes: int = MAX_FILTER_BYTES) -> np.ndarray:
    """The filter of positions that two hashes or more (column h) set, as bytes."""
    bits = min(max(1 << 16, 1 << (8 * max(n_rows, 1) - 1).bit_length()), 8 * max_bytes)
    seg = min(SEGMENT_BITS, bits)

    def planes(batches):
        """Of so many hashes at once, for each segment the places set once and those set twice or more, as sorted numbers."""
        held, size = [], 0

        def rows() -> pd.DataFrame:
            place, times = np.unique(np.concatenate([p.ravel() for p in held]), return_counts=True)
            number = place // seg
            cut = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            place = (place % seg).astype(np.uint32)
            parts = [(p[t == 1].tobytes(), p[t > 1].tobytes()) for p, t in zip(np.split(place, cut[1:]), np.split(times, cut[1:]), strict=True)]
            return pd.DataFrame({"seg": number[cut].astype(np.int64), "once": [a for a, _ in parts], "twice": [b for _, b in parts]})

        for pdf in batches:
            held.append(_places(pdf["h"].to_numpy(), bits - 1))
            size += len(pdf)
            if size >= HELD:
                yield rows()
                held, size = [], 0
        if size:
            yield rows()

    def bitmap(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        once, on = np.zeros(seg, bool), np.zeros(seg, bool)
        for a, b in zip(pdf["once"], pdf["twice"], strict=True):
            a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
            on[a[once[a]]] = True
            on[b] = True
            once[a] = True
            once[b] = True
        return pd.DataFrame({"seg": [key[0]], "data": [np.packbits(on.view(np.uint8), bitorder="little").tobytes()]})

    set_ = hashes.select("h").mapInPandas(planes, "seg long, once binary, twice binary")
    segments = set_.groupBy("seg").applyInPandas(bitmap, "seg long, data binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in segments.collect():  # at most max_bytes in all
        out[row.seg * seg // 8 : (row.seg + 1) * seg // 8] = np.frombuffer(row.data, np.uint8)
    return out


def maybe_repeated(df: DataFrame, h: str, bloom: np.ndarray) -> Column:
    """Whether the filter has both positions of column h."""
    shared, mask = df.sparkSession.sparkContext.broadcast(bloom), len(bloom) * 8 - 1

    @F.pandas_udf("boolean")
    def test(x: pd.Series) -> pd.Series:
        found = np.ones(len(x), bool)
        for p in _places(x.to_numpy(), mask):
            found &= (shared.value[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return pd.Series(found)

    return test(F.col(h))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    own = docs.select(col(doc_id).alias("doc_id"), F.length(F.coalesce(col(text), F.lit(""))).alias("cp"), F.unhex(F.sha2(_normalised(text), 256)).alias("sha"))
    own = materialise(own.withColumn("h", F.xxhash64("sha")).withColumn("rid", F.monotonically_increasing_id()))
    bloom = repeated_filter(own.select("h"), own.count())
    marked = own.withColumn("maybe", maybe_repeated(own, "h", bloom))
    maybe, single = marked.where("maybe"), marked.where("not maybe")
    best = F.max(F.struct("cp", (-F.col("doc_id")).alias("neg"), (-F.col("rid")).alias("nrid"))).alias("best")
    groups = materialise(maybe.groupBy("sha").agg(best, F.count(F.lit(1)).alias("size")))  # as a table, so that a hot text's rows can be split in the join
    joined = maybe.join(groups.withColumnRenamed("sha", "g_sha"), F.col("sha") == F.col("g_sha"))
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    return joined.select("doc_id", (-F.col("best.neg")).alias("keep_id"), F.col("size").alias("group_size"), (F.col("rid") == -F.col("best.nrid")).alias("kept"), hexed).union(
        single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed)
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with their own columns. Of a repeated text, partial aggregation keeps one row in each task before the shuffle."""
    own, (doc_id, text) = renamed(docs, doc_id, text)
    hashed = own.withColumn("__x_sha", F.unhex(F.sha2(_normalised(text), 256))).withColumn("__x_h", F.xxhash64("__x_sha"))
    hashes = materialise(hashed.select(F.col("__x_h").alias("h")))
    bloom = repeated_filter(hashes, hashes.count())
    discard(hashes)
    marked = hashed.withColumn("__x_maybe", maybe_repeated(hashed, "__x_h", bloom))
    order = F.struct(F.length(F.coalesce(F.col(text), F.lit(""))), -F.col(doc_id), F.col(text))
    best = marked.where("__x_maybe").groupBy("__x_sha").agg(F.max_by(F.struct(*own.columns), order).alias("__x_row"))
    return marked.where("not __x_maybe").select(*own.columns).union(best.select("__x_row.*")).toDF(*docs.columns)


def op9_exact_dedup(spark, sf_dir):
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
h AS (SELECT doc_id, rid, length(text) AS cp, sha256(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM t)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, rid = first_value(rid) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id NULLS LAST, rid)"""
