"""Substring dedup by content-defined chunking.

A gear hash rolls over the text's bytes: h = 2h + gear[byte], modulo 2**16, so it depends on the last 16
bytes only. A chunk ends where the top bits of h are zero; so equal passages are cut alike wherever they
stand, and an insertion moves the cuts near it only. Chunks have MIN_CHUNK bytes at least (a nearer cut is
passed over) and about MAX_CHUNK at most: where no cut comes by then, as in a run of one word, the first place of the least h so far is one,
which stands alike in all runs of that word. A cut inside a character moves to its end. A digest
(128 bits) covers a chunk and the one after it, since a lone chunk of a few common words repeats by chance. Where
a digest occurs twice or more, the first one, by the row's place in the table as it comes and the start, stays.

`repeats` returns, for each document, the maximal runs of neighbouring repeated chunks that have
MIN_SPAN_WORDS words or more together, with the doc_id of the earliest row that has part of them. With these sizes a
few in a hundred repeated passages of 51 words, and fewer of longer ones, fall short of a run. `deduplicate` removes from
each text the chunks, in such runs, that aren't first occurrences, and keeps all other columns as they are.

Rows are numbered once, and the numbers are written with what is derived from them, so a table that comes out of a
shuffle gives the same spans as one that is read. Null and empty texts have no chunks and stay as they are. Repeated rows
are documents of their own, so a copy of a row repeats it. Very long texts are hashed in pieces of PIECE bytes. An empty
table gives an empty result; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from torrentia.llm.common import col, discard, materialise, mix64, renamed

MASK_BITS = 5
MIN_CHUNK = 16
SPAN = 16
MAX_CHUNK = 128
MIN_SPAN_WORDS = 12
PIECE = 1 << 22
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the span that it covers: 1, 2, 4, 8, 16 bytes."""
    h, span = GEAR[data], 1
    while span < SPAN:
        wider = h.copy()
        wider[span:] += h[:-span] << np.uint16(span)
        h, span = wider, 2 * span
    return h


def cuts(data: np.ndarray) -> list[int]:
    """The chunk ends."""
    n, marks = len(data), []
    for i in range(0, n, PIECE):  # bounded memory for very long texts
        back = max(0, i - SPAN + 1)
        h = gear_hashes(data[back : i + PIECE])[i - back :]
        marks.append(np.flatnonzero(h < np.uint16(1 << (16 - MASK_BITS))) + i + 1)
    found = np.concatenate(marks) if marks else np.empty(0, np.int64)
    for _ in range(3):
        found = found + ((found < n) & ((data[np.minimum(found, n - 1)] & 0xC0) == 0x80))
    out, last = [], 0
    for m in [*found.tolist(), n] if n else []:
        first, h = last, np.empty(0, np.uint16)
        while m - last > MAX_CHUNK:
            if last + MAX_CHUNK > first + len(h):
                back = max(0, last - SPAN + 1)
                first, h = last, gear_hashes(data[back : min(m, last + PIECE)])[last - back :]
            last += MIN_CHUNK + int(h[last + MIN_CHUNK - 1 - first : last + MAX_CHUNK - first].argmin())
            while last < m and data[last] & 0xC0 == 0x80:
                last += 1
            out.append(last)
        if m - last >= MIN_CHUNK or (m == n and m > last):
            out.append(m)
            last = m
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """rid, doc_id and text to one row a chunk: rid, doc_id, start (byte), word (words that begin before it), meta, digest.

    meta and digest are of the chunk with its successor: seq, words that begin in them, bytes (32 + 16 + 16 bits).
    """

    def run(batches):
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                rids, ids, starts_, words_, metas, digests = [], [], [], [], [], []
                for rid, doc_id, text in pdf.iloc[k : k + 256][["rid", "doc_id", "text"]].astype({"doc_id": "Int64"}).itertuples(index=False):
                    if not text:
                        continue
                    raw = text.encode("utf-8")
                    data = np.frombuffer(raw, np.uint8)
                    ends = np.array(cuts(data))
                    starts = np.concatenate([[0], ends[:-1]])[: max(1, len(ends) - 1)]
                    ends = ends[-len(starts) :]
                    space = (data == 32) | ((data >= 9) & (data <= 13))
                    before = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))])
                    rids.append(np.full(len(ends), rid))
                    ids += [doc_id] * len(ends)
                    words_.append(before[starts])
                    starts_.append(starts)
                    metas.append((np.arange(len(ends)) << 32) | ((before[ends] - before[starts]) << 16) | (ends - starts))
                    digests += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                if digests:
                    yield pd.DataFrame({"rid": np.concatenate(rids), "doc_id": pd.array(ids, "Int64"), "start": np.concatenate(starts_), "word": np.concatenate(words_), "meta": np.concatenate(metas), "digest": digests})

    return docs.select("rid", "doc_id", "text").mapInPandas(run, "rid long, doc_id long, start long, word long, meta long, digest binary")


def repeated_chunks(every: DataFrame) -> DataFrame:
    """Of written chunks, those that occur twice or more, with first (rid, start of the first occurrence) and n."""
    twice = every.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "start")).alias("first")).where("n > 1")
    twice = materialise(twice.withColumnRenamed("digest", "d"))  # as a table, so that a hot chunk's rows can be split in the join
    found = every.drop("doc_id").join(twice, F.col("digest") == F.col("d"))
    return found.select("rid", "start", "word", F.expr("meta >> 32").alias("seq"), F.expr("(meta >> 16) & 65535").alias("n_words"), F.expr("meta & 65535").alias("size"), "n", "first")


def _later():
    return (F.col("rid") != F.col("first.rid")) | (F.col("start") != F.col("first.start"))


def spans(repeated: DataFrame) -> DataFrame:
    """The runs of neighbouring repeated chunks of a document, long enough to count."""
    runs = repeated.withColumn("run", F.col("seq") - F.row_number().over(W.partitionBy("rid").orderBy("seq")))
    out = runs.groupBy("rid", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), (F.max(F.col("word") + F.col("n_words")) - F.min("word")).alias("n_words"),
        F.count(F.lit(1)).alias("n_chunks"), F.max("n").alias("n_copies"), F.min("first.rid").alias("first_rid"), F.bool_or(_later()).alias("has_later"),
    )
    return out.where(F.col("n_words") >= MIN_SPAN_WORDS).drop("run")


def _own(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Only for one job that writes what it derives: the plan numbers its rows anew each time it runs."""
    return docs.select(col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), col(text).alias("text"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a repeated passage of a document: doc_id, start and end (bytes), n_words, n_chunks, n_copies, first_doc_id, has_later (some of it was seen before)."""
    every = materialise(chunks(_own(docs, doc_id, text)))
    ids = every.where("meta >> 32 = 0").select("rid", "doc_id")  # each document's first chunk
    found = spans(repeated_chunks(every)).join(ids, "rid")
    found = found.join(ids.select(F.col("rid").alias("first_rid"), F.col("doc_id").alias("first_doc_id")), "first_rid")
    return found.select("doc_id", "start", "end", "n_words", "n_chunks", "n_copies", "first_doc_id", "has_later")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated chunks that aren't first occurrences cut out of the text."""
    safe, (doc_id, text) = renamed(docs, doc_id, text)
    rows = materialise(safe.withColumn("__s_rid", F.monotonically_increasing_id()))
    every = materialise(chunks(rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("__s_rid").alias("rid"), F.col(text).alias("text"))))
    repeated = materialise(repeated_chunks(every))
    discard(every)
    long_enough = spans(repeated).select(F.col("rid").alias("s_rid"), F.col("start").alias("s_start"), "end")
    gone = repeated.where(_later()).join(long_enough, (F.col("rid") == F.col("s_rid")) & (F.col("start") >= F.col("s_start")) & (F.col("start") < F.col("end")))
    gone = gone.groupBy(F.col("rid").alias("__s_of")).agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("__s_gone"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, where: pd.Series) -> pd.Series:
        out = []
        for t, spans_ in zip(texts, where, strict=True):
            if spans_ is None or not len(spans_):
                out.append(t)
                continue
            raw, last, parts = t.encode("utf-8"), 0, []
            for s in spans_:
                parts.append(raw[last : s["start"]])
                last = max(last, s["start"] + s["size"])
            out.append(b"".join([*parts, raw[last:]]).decode("utf-8"))
        return pd.Series(out)

    joined = rows.join(gone, F.col("__s_rid") == F.col("__s_of"), "left")
    return joined.withColumn(text, cut(F.col(text), F.col("__s_gone"))).select(*safe.columns).toDF(*docs.columns)


def op5_substring_dedup(spark, sf_dir):
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
