"""Alignment of two tokenizers' tokens over each text: groups of tokens that cover the same bytes, and counts of linked ids.

Texts are tokenised whole by both: a space and the text by the byte-level vocabulary A, the text by the piece vocabulary B, which adds
the space itself. A place where both have a space-marked token is an anchor if the tokens before it end at the same byte, which is
verified. So is, within a word, a place between letters and a sign after them that neither vocabulary joins with letters. Anchors split a text into windows of token ids. A window's
alignment depends on its ids alone, and these on its text alone (no two texts have the same ids), by which it is memoised: its groups (the least stretches of tokens that end together)
and its links (the last A token and the last B token of each group).

An id pair's count is the number of links in the corpus that have it. The links of each document are written once; their counts come from one
aggregation, in which each task adds up its own first. Back to the documents go the most frequent pairs as a broadcast table of HOT_PAIRS rows at most, and the rest by a
shuffled join: what is left is rare pairs, so no key of it is hot. Both are exact, whatever the number of pairs.

Null and empty texts have no tokens, nor have texts whose joined tokens of either vocabulary differ from the space and the text (say, with the marker character itself); their
counts are 0. Ties: all A ids of a B id's highest count are best. Repeated rows are documents of their own. Very long texts are aligned whole (some 200 bytes
a token while they are tokenised). An empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torrentia.llm import piece_codec
from torrentia.llm.bpe_codec import _byte_alphabet
from torrentia.llm.common import Memo, col, materialise

HOT_PAIRS = 1 << 18  # rows of a broadcast table, some 20 MB
WORDS, WINDOWS = 40_000, 100_000  # entries of a generation of the memos
MEMO_CHARS = 64  # of the longest word that is kept
ROWS = 512  # documents at once
_MARKED = re.compile(r"(?<=\S) (?=\S)")
_LATIN = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
_LETTERS = re.compile(_LATIN + "+")
_PARTS = re.compile("(?<=" + _LATIN + r")(?=[!-/:-@\[-`{-~\n])")


class ByteLevel:
    """The byte-level vocabulary: ids of a text by the tokenizers library, words with a space before them being tokenised once.

    Words of Latin letters, which are one piece of the vocabulary's pattern, take a shorter way to the same ids: merges by the ids' order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in enumerate(_byte_alphabet())}
        texts = [b""] * (max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for t, i in spec["model"]["vocab"].items():
            texts[i] = bytes(to_byte.get(c, 63) for c in t)
        self.texts = texts
        ranks = {texts[i]: i for i in spec["model"]["vocab"].values() if i != next(iter(t["id"] for t in spec["added_tokens"]), None)}
        self.merges = tiktoken.Encoding("letters", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.marked, self.plain = Memo(lambda w: self.cut(w, " "), 64, WORDS), Memo(lambda w: self.cut(w, ""), 64, WORDS // 4)

    def cut(self, word: str, before: str) -> bytes:
        """The ids of a word that isn't kept. Letters are never in one token with the punctuation or line end after them, so what stands before and after is looked up alone."""
        head, *rest = _PARTS.split(word)
        if rest:
            return (self.marked if before else self.plain)[head] + b"".join(map(self.plain.__getitem__, rest))
        if _LETTERS.fullmatch(word):  # one piece of the vocabulary's pattern: its merges alone
            ids = self.merges.encode_ordinary(before + word)
        else:
            ids = self.tokenizer.encode(before + word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_marked(self, word: str) -> bytes:
        """The ids of a space and the word, as little-endian unsigned 32-bit integers."""
        return self.marked[word]


class LatinPieces:
    """The pieces of words of Latin letters by the merges of the piece vocabulary, on bytes: those of two-byte characters come first, the others by their scores. The marker is a space."""

    def __init__(self, c: piece_codec.PieceCodec):
        import tiktoken

        as_bytes = {t: t.replace(piece_codec.MARK, " ").encode("utf-8") for t in c.ids if all(x < "\u0800" or x == piece_codec.MARK for x in t)}
        letters = [t for t, b in as_bytes.items() if len(t) == 1 and len(b) == 2]
        pieces = sorted((t for t in as_bytes if len(t) > 1), key=c.rank.__getitem__)
        ranks = {b: n for n, b in enumerate([*map(as_bytes.get, letters), *[bytes([b]) for b in range(256)], *map(as_bytes.get, pieces)])}
        single = [c.ids.get(piece_codec.MARK if b == 32 else chr(b), c.byte_ids[b]) if b < 128 else c.byte_ids[b] for b in range(256)]
        self.ids = [*[c.ids[t] for t in letters], *single, *[c.ids[t] for t in pieces]]
        self.usable = piece_codec.MARK in c.ids
        self.merges = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def encode(self, word: str) -> bytes | None:
        """The ids of a word of Latin letters, with a space before it or not; None where it may be one piece, which the merges needn't come to."""
        found = self.merges.encode_ordinary(word)
        return array("I", [self.ids[n] for n in found]).tobytes() if len(found) > 1 and self.usable else None


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), piece_codec.codec(path_b)
        c = self.b
        self.latin = LatinPieces(c)
        self.texts_b = [c.buffer[s : s + n].tobytes() for s, n in zip(c.starts.tolist(), c.lengths.tolist(), strict=True)]
        self.sizes_a, self.sizes_b = [len(t) for t in self.a.texts], [len(t) for t in self.texts_b]
        self.names = [str(i) for i in range(max(len(self.sizes_a), len(self.sizes_b)))]
        self.more = ["," + n for n in self.names]
        kin, ends = c.kin, [x for x in map(chr, range(128)) if _PARTS.search("a" + x) and x not in c.kin]
        letters = [x for x in map(chr, range(0x250)) if x in kin and _LETTERS.fullmatch(x)]
        #: Between letters that B joins and what follows of signs that it doesn't join with them: an anchor within a word.
        self.parts_at = re.compile(f"(?<=[{re.escape(''.join(letters))}])(?=[{re.escape(''.join(ends))}])")
        self.words, self.parts = Memo(lambda w: self._aligned(w, " "), MEMO_CHARS, WINDOWS), Memo(lambda w: self._aligned(w, ""), MEMO_CHARS, WINDOWS)
        self.heads = Memo(lambda w: self._whole(w, " "), MEMO_CHARS, WINDOWS)

    def _aligned(self, word: str, before: str) -> tuple[str, bytes, int, int] | None:
        """The windows of a word, one after the other, that begins with a space or not; None where the bytes of either's tokens differ from it."""
        head, *rest = self.parts_at.split(word) if len(word) <= MEMO_CHARS else [word]
        if not rest:
            return self.heads[word] if before else self._whole(word, before)
        found = [self.heads[head] if before else self.parts[head], *map(self.parts.__getitem__, rest)]
        if None in found:
            return None
        return ";".join([f[0] for f in found]), b"".join([f[1] for f in found]), sum([f[2] for f in found]), sum([f[3] for f in found])

    def _whole(self, word: str, before: str) -> tuple[str, bytes, int, int] | None:
        """The window of a word without an anchor in it."""
        raw_a, raw_b = self.a.cut(word, before), self.latin.encode(before + word) if len(word) <= MEMO_CHARS and _LETTERS.fullmatch(word) else None
        if raw_b is None:
            raw_b = self.b.encode_each(word) if before else self.b.encode_chunks(word)
        data = (before + word).encode("utf-8", "surrogatepass")
        for raw, texts in ((raw_a, self.a.texts), (raw_b, self.texts_b)):
            if b"".join([texts[i] for i in memoryview(raw).cast("I")]) != data:
                return None
        return self._window((raw_a, raw_b))

    def _window(self, key: tuple[bytes, bytes]) -> tuple[str, bytes, int, int]:
        """The groups as text, the links (A id * 2**32 + B id) and the numbers of A and B ids."""
        b = memoryview(key[1]).cast("I").tolist()
        size_a, size_b, names, more = self.sizes_a, self.sizes_b, self.names, self.more
        parts, links = [], array("q")
        y, j, end_a, group_a = b[0], 0, 0, ""
        end_b, group_b = size_b[y], names[y]
        for x in memoryview(key[0]).cast("I"):
            end_a += size_a[x]
            group_a = group_a + more[x] if group_a else names[x]
            while end_b < end_a:
                j += 1
                y = b[j]
                end_b += size_b[y]
                group_b += more[y]
            if end_b == end_a:
                links.append(x << 32 | y)
                parts.append(f"{group_a}|{group_b}")
                group_a, j = "", j + 1
                if j < len(b):
                    y = b[j]
                    end_b += size_b[y]
                    group_b = names[y]
        return ";".join(parts), links.tobytes(), len(key[0]) // 4, len(b)

    def align(self, text: str) -> tuple[int, int, str, bytes] | None:
        """n_a, n_b, the groups as text and the links of a text; None where it counts as without tokens.

        A space between two characters that aren't white space begins a token in both vocabularies, and no token crosses it: the ids of the whole text
        are those of its marked words, one after the other. It is an anchor, as the bytes before it are verified to be the same.
        """
        if piece_codec.MARK in text:  # which B takes for a space
            return None
        found = list(map(self.words.__getitem__, _MARKED.split(text)))
        if None in found:
            return None
        return sum([f[2] for f in found]), sum([f[3] for f in found]), ";".join([f[0] for f in found]), b"".join([f[1] for f in found])


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of files and Python worker."""
    return Aligner(path_a, path_b)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def alignments(docs: DataFrame, paths: tuple[str, str], doc_id: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, groups_sha256, links (one long a link: A id * 2**32 + B id), and the groups as text if wanted."""
    names = ["n_a", "n_b", "n_groups", "groups_sha256", "links"] + ["groups"] * with_groups

    def run(batches):
        c = aligner(*paths)
        for pdf in batches:
            for k in range(0, len(pdf), ROWS):
                part, rows = pdf.iloc[k : k + ROWS], []
                for t in part["text"]:
                    n_a, n_b, groups, links = (c.align(t) if t else None) or (0, 0, "", b"")
                    sha = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                    rows.append((n_a, n_b, len(links) // 8, sha, np.frombuffer(links, np.int64), groups)[: len(names)])
                yield pd.concat([part[["doc_id"]], pd.DataFrame(rows, columns=names, index=part.index)], axis=1)

    own = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    return own.mapInPandas(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>" + ", groups string" * with_groups)


def pair_counts(links: DataFrame) -> DataFrame:
    """The links (array column) of all documents to pair, n (links that have it) and best (whether n is the B id's highest)."""
    n = materialise(links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = n.groupBy(b.alias("b")).agg(F.max("n").alias("top"))  # a row for each B id at most
    return n.join(F.broadcast(top), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))


def _hot(pairs: DataFrame, most: int) -> int:
    """The least n that `most` pairs at most have or exceed, to the next power of two."""
    upto = 0
    sizes = pairs.groupBy(F.expr("int(log2(n))").alias("k")).count().orderBy(F.desc("k")).collect()  # 64 rows at most
    for r in sizes:
        upto += r["count"]
        if upto > most:
            return 2 ** (r.k + 1)
    return 1


def scored(rows: DataFrame, pairs: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """rows (rid, links) and all pairs to rid, n_best (links whose count is their B id's highest) and count_sum (over links); rows without links have none."""
    least = _hot(pairs, hot_pairs)
    each = rows.select("rid", F.explode("links").alias("pair"))
    hot, rare = (pairs.where(w).withColumnRenamed("pair", "p") for w in (F.col("n") >= least, F.col("n") < least))
    sums = [F.sum("best").alias("n_best"), F.sum("n").alias("count_sum")]
    met = each.join(F.broadcast(hot), F.col("pair") == F.col("p"), "left")
    out = met.where("p is not null").groupBy("rid").agg(*sums)
    if least > 1:
        rest = met.where("p is null").groupBy("rid", "pair").agg(F.count(F.lit(1)).alias("k"))
        rest = rest.join(rare, F.col("pair") == F.col("p")).groupBy("rid").agg(F.sum(F.col("k") * F.col("best")).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
        out = out.unionByName(rest).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out


def summaries(docs: DataFrame, paths: tuple[str, str], doc_id: str = "doc_id", text: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = materialise(alignments(docs, paths, doc_id, text).withColumn("rid", F.monotonically_increasing_id()))
    pairs = materialise(pair_counts(rows))
    sums = scored(rows, pairs, hot_pairs).withColumnRenamed("rid", "r")
    out = rows.drop("links").join(sums, F.col("rid") == F.col("r"), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *zero, "groups_sha256")


def op11_token_alignment(spark, sf_dir):
    return summaries(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabularies())
