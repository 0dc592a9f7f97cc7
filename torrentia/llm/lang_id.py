"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; runs of anything but letters become one space. Each 1-, 2- and 3-gram is hashed into
one of `BUCKETS` buckets. Training adds bucket counts by language over all training documents: each task
sums its own documents into a matrix and emits its rows, which are then summed by language and bucket; so
no group is collected. The log-probability matrix is broadcast in parts of GROUP languages, each of which has a bounded
size (BUCKETS x GROUP x 4 bytes, 8 MB); any number of languages is learned. Scoring is sparse: a
text's distinct buckets and their counts times the matrix rows, in numpy; the parts' posteriors are then put together.

A text is null or has no letter: `und`, score 0. Otherwise the prediction is the language with the highest
posterior (the first by name on ties) and the score its probability. Without any training document every
prediction is `und`. Repeated rows are predicted alike; texts of any length are read whole, in pieces. An empty table gives an
empty result; extra columns stay, but for `lang_pred` and `score`, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torrentia.llm.common import col, discard, materialise, unused, without

BUCKETS = 1 << 15
GROUP = 64
SMOOTHING = 0.5
PIECE = 1 << 20
_OTHER = regex.compile(r"[^\p{L}]+")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by three."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def buckets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the text's n-grams and their counts."""
    plain = _OTHER.sub(" ", text or "").lower().strip()
    if not plain:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer(f" {plain} ".encode("utf-32-le"), np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(c), PIECE):  # bounded memory for very long texts
        p = c[max(0, i - 2) : i + PIECE]
        new = i - max(0, i - 2)
        with np.errstate(over="ignore"):
            one = p * np.uint32(0x9E3779B1)
            two = (one[:-1] ^ (p[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
            three = (two[:-1] ^ (p[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for k, h in enumerate((one, two, three)):
            total += np.bincount(h[max(0, new - k) :] >> np.uint32(17), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[list[str], np.ndarray]]:
    """The languages in parts, by name: names and the matrix of log probabilities, a row for each bucket; the last row has the log priors."""
    own = docs.where(col(lang).isNotNull()).select(col(lang).alias("lang"), col(text).alias("text"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, t in zip(pdf["lang"], pdf["text"], strict=True):
                at, n = buckets(t)
                if len(at):
                    row = sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    row[at] += n
                    row[BUCKETS] += 1
            if len(sums) > GROUP:
                yield from tables(sums)
                sums = {}
        yield from tables(sums)

    def tables(sums):
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": row[at]})

    counts = materialise(own.mapInPandas(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    priors = {r.lang: r.n for r in counts.where(F.col("bucket") == BUCKETS).select("lang", "n").collect()}  # a row a language
    names, every, model = sorted(priors), max(1, sum(priors.values())), []
    for i in range(0, len(names), GROUP):
        part = names[i : i + GROUP]
        grams = np.full((BUCKETS, len(part)), SMOOTHING)
        rows = counts.where(F.col("lang").isin(part) & (F.col("bucket") < BUCKETS)).groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n"))
        for r in rows.toLocalIterator():  # a row a language, BUCKETS entries at most
            grams[np.array(r.at), part.index(r.lang)] += np.array(r.n)
        prior = np.log(np.array([priors[n] for n in part]) / every)
        model.append((part, np.vstack([np.log(grams / grams.sum(axis=0)), prior[None, :]]).astype(np.float32)))
    discard(counts)
    return model


def predict(docs: DataFrame, model: list[tuple[list[str], np.ndarray]], text: str = "text") -> DataFrame:
    """docs with lang_pred and score (which replace columns of those names)."""
    shared = [docs.sparkSession.sparkContext.broadcast(part) for part in model]

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        grams = [buckets(t) for t in texts]
        best = [("und", float("-inf"))] * len(grams)  # name, log score
        total = [0.0] * len(grams)  # sum of all scores over the best one
        for part in shared:
            labels, matrix = part.value
            for i, (at, n) in enumerate(grams):
                if not len(at):
                    continue
                s = n @ matrix[at].astype(np.float64) + matrix[-1]
                k = int(np.argmax(s))
                top = max(best[i][1], s[k])
                total[i] = total[i] * np.exp(best[i][1] - top) + np.exp(s - top).sum()
                if s[k] > best[i][1]:
                    best[i] = (labels[k], s[k])
        out = [(name, float(1 / t) if t else 0.0) for (name, _), t in zip(best, total, strict=True)]
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    rest = without(docs, "lang_pred", "score")
    (new,) = unused(docs.columns, "found")
    return docs.select(*rest, run(col(text)).alias(new)).select(*rest, F.col(f"{new}.lang_pred"), F.col(f"{new}.score"))


def op4_lang_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(own, model).select("doc_id", "held_out", "lang_pred", "score")
