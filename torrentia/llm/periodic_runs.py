"""Periodic run detection: recursive frequency splitting, then a scan over lags.

A run is a stretch of words with a smallest period q (words q apart are identical) that has 4 q words or more, and 6 at
least, and that no neighbouring word extends. Each of its words occurs LEAST_TIMES or more in it. So a word that occurs fewer times in
a segment of the text is in none of its runs and splits it; the parts are counted anew, until no word of a segment
is too rare. Of plain prose nothing survives, a run always does, whole.

The surviving segments are scanned at each lag q up to a quarter of their length. A run's words equal those q further on over 3 q places, so three
neighbours of every q-th place are among them; only where every q-th word repeats three times the stretch is measured word by word. That is
m log m comparisons for m words. A stretch at lag q that has a smaller period is a run found before, at a divisor of q; it is passed over whole.

`runs` has a row for each run, `collapsed` the documents with only the first period of each run, `summaries` both in digests.

Words are maximal stretches of characters other than the six ASCII white-space ones, told apart exactly. Null and empty texts have no words and no runs.
Repeated rows are documents of their own; runs may overlap, and a word goes if any of them has it after its first period. Very long texts are
taken whole (about 150 bytes a word). An empty table gives an empty result; extra columns stay as they are in `collapsed`, whatever their names.
There is no shuffle: a document's runs depend on its text alone.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torrentia.llm.common import WORD, col, unused

REPEATS = 4  # periods in a run at least
LEAST_WORDS = 6
LEAST_TIMES = 4  # a word of a run occurs once in each whole period
_WORD = re.compile(WORD)


def segments(codes: np.ndarray) -> list[tuple[int, int]]:
    """The maximal stretches [start, end) in which each word occurs LEAST_TIMES or more, however often the parts have to be counted anew."""
    at, out = np.flatnonzero(np.bincount(codes)[codes] >= LEAST_TIMES), []
    changed = np.ones(len(at), bool)
    while len(at):
        first = np.concatenate([[True], np.diff(at) != 1])
        number = np.cumsum(first) - 1  # of the segment
        sizes = np.bincount(number)
        if not changed.all():  # segments that lost no word in the last round are stable
            stable = np.bincount(number, weights=changed) == 0
            starts = at[first]
            out += [(int(starts[k]), int(starts[k] + sizes[k])) for k in np.flatnonzero(stable & (sizes >= LEAST_WORDS))]
            stays = ~stable[number]
        else:
            stays = np.ones(len(at), bool)
        stays &= (sizes >= LEAST_WORDS)[number]
        at, number = at[stays], number[stays]
        if not len(at):
            break
        _, kind, times = np.unique(number * (int(codes.max()) + 1) + codes[at], return_inverse=True, return_counts=True)
        rare = times[kind] < LEAST_TIMES
        lost = np.bincount(number, weights=rare) > 0
        at, changed = at[~rare], lost[number][~rare]
        if len(at) and not changed.any():
            cut = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1, [True]]))
            out += [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            break
    return sorted(out)


def _agree(w: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many places from i on (step 1) or down from i (step -1) hold the word that stands `lag` further on."""
    limit, done, size = (len(w) - lag - i) if step > 0 else i + 1, 0, 64
    while done < limit:
        n = min(size, limit - done)
        lo = i + done if step > 0 else i - done - n + 1
        apart = w[lo : lo + n] != w[lo + lag : lo + lag + n]
        apart = apart if step > 0 else apart[::-1]
        if apart.any():
            return done + int(apart.argmax())
        done, size = done + n, 2 * size
    return limit


def _scan(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of one segment."""
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    longest, owner = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)  # of the runs over each place, the longest
    for q in range(1, len(w) // REPEATS + 1):
        every = w[::q]
        hit = every[1:] == every[:-1]
        three = np.flatnonzero(hit[:-2] & hit[1:-1] & hit[2:])
        k = 0
        while k < len(three):
            place = int(three[k]) * q
            _, end, period = found[owner[place]] if longest[place] >= REPEATS * q else (0, 0, 1)
            after = end - q
            if place >= after or q % period:  # else it is in a run found before, whose period divides q
                low, after = place - (_agree(w, place - 1, q, -1) if place else 0), place + _agree(w, place, q, 1)
                size = after - low + q
                if size >= max(LEAST_WORDS, REPEATS * q) and (low, low + size) not in known:
                    known.add((low, low + size))
                    longer = longest[low : low + size] < size
                    longest[low : low + size][longer], owner[low : low + size][longer] = size, len(found)
                    found.append((low, low + size, q))
            k = max(k + 1, int(np.searchsorted(three, -(-after // q))))
    return found


def find_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of the words, by start, then period."""
    if len(words) < LEAST_WORDS:
        return []
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(words) - len(number) < LEAST_TIMES - 1:
        return []
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return sorted((a + s, e - s, q) for a, b in segments(codes) for s, e, q in _scan(codes[a:b]))


def kept_words(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words but those that a run has after its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(depth[:-1]).tolist(), strict=True) if d == 0]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, exactly; of equals the first, then that of the smallest period."""
    best = None
    for run in found:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a run: doc_id, start (word number), length, period, exponent_milli and unit (the words of its first period)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"].astype(object), pdf["text"], strict=True):
                words = _WORD.findall(t or "")
                rows += [(None if pd.isna(i) else i, s, n, q, 1000 * n // q, " ".join(words[s : s + q])) for s, n, q in find_runs(words)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "period", "exponent_milli", "unit"])

    own = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    return own.mapInPandas(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, start long, length long, period long, exponent_milli long, unit string")


def collapsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with only the first period of each run left in the text; a text without runs stays as it is."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            words = _WORD.findall(t or "")
            found = find_runs(words)
            return " ".join(kept_words(words, found)) if found else t

        return texts.map(one)

    (new,) = unused(docs.columns, "shorter")
    wide = docs.withColumn(new, run(col(text)))
    return wide.select(*[col(new).alias(c) if c == text else col(c) for c in docs.columns])


def summaries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_runs, start, length, period and exponent_milli of the strongest run, and digests of all runs and of the words that stay."""

    @F.pandas_udf("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = _WORD.findall(t or "")
            found = find_runs(words)
            start, length, period = strongest(found) or (None, None, None)
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
            stays = " ".join(kept_words(words, found))
            rows.append((len(found), start, length, period, 1000 * length // period if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(stays.encode("utf-8")).hexdigest()))
        names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        return pd.DataFrame(rows, columns=names).astype(dict.fromkeys(names[:5], "Int64"))

    return docs.select(col(doc_id).alias("doc_id"), run(col(text)).alias("r")).select("doc_id", "r.*")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; where the hash h of the id is a multiple of ten, the words from a on repeat with a period p.

    g = h div 10, a = g mod n for n words, p = 1 + (n - a) div (3 + g mod 8): a word i from a on becomes word a + (i - a) mod p.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    d = docs.select("doc_id", "text", h.alias("h")).withColumn("words", words).withColumn("n", F.size("words"))
    d = d.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    changed: Column = F.expr("array_join(transform(words, (w, i) -> if(i >= a, get(words, int(a + (i - a) % p)), w)), ' ')")
    return d.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    return summaries(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
