"""What several text operators share: scratch tables in the shared folder (from the library), and text pieces.

Words are maximal runs of characters other than the six ASCII white-space ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torrentia.scratch import discard
from torrentia.scratch import written as materialise

__all__ = ["Memo", "SPACE", "WORD", "col", "discard", "materialise", "mix64", "n_words", "quoted", "renamed", "shingle_hashes", "span_hashes", "unused", "without", "word_hashes"]

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

def n_words(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(k: int, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[k]) < n:
        with np.errstate(over="ignore"):
            _powers[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16) - 1, base, np.uint64)]), dtype=np.uint64)
    return _powers[k][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans by one prefix sum of a polynomial; equal bytes give equal hashes."""
    n = len(data)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _grown(0, _BASE, n), dtype=np.uint64)])
        return mix64((prefix[ends] - prefix[starts]) * _grown(1, _INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """One 64-bit hash for each word of the text, in order."""
    if not text:
        return np.empty(0, np.uint64)
    data = np.frombuffer((text.lower() if lower else text).encode("utf-8", "surrogatepass"), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    if not len(edge):
        return np.empty(0, np.uint64)
    return span_hashes(data, edge[0::2], edge[1::2])


def shingle_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` tokens; a shorter sequence is one run."""
    if len(tokens) == 0:
        return tokens
    width = min(width, len(tokens))
    n = len(tokens) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(width), np.uint64)
        for k in range(width):
            out = mix64(out * np.uint64(0x100000001B3) + tokens[k : k + n])
    return out


def quoted(name: str) -> str:
    """A column's name for expressions, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added until none equals a column's name, capitals or not, or one of the others."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def renamed(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns named c0, c1 and so on, which clash with nothing and need no quotes, and the new names of those asked for.

    The result of what is done there gets the old names back by toDF(*docs.columns).
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    alike = {c.lower(): v for c, v in at.items()}
    return docs.toDF(*at.values()), [at[n] if n in at else alike[n.lower()] for n in names]


def without(docs: DataFrame, *names: str) -> list[Column]:
    """The columns of docs but those of the names, capitals or not."""
    gone = {n.lower() for n in names}
    return [col(c) for c in docs.columns if c.lower() not in gone]


class Memo(dict):
    """Makes what is asked for and keeps it among the last entries: a full generation becomes the old one, and what is asked for again moves on.

    Keys are texts or pairs of bytes; longer ones than `longest` aren't kept.
    """

    def __init__(self, make, longest: int, entries: int):
        self.make, self.longest, self.entries, self.old = make, longest, entries, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
            if (len(key) if isinstance(key, str) else len(key[0]) + len(key[1])) > self.longest:
                return out
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out
