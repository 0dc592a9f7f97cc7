"""BPE encoding and decoding with a public vocabulary file.

Encoding: an Aho-Corasick automaton finds all tokens in a word; from the left, the longest token that is
compatible with the one before it is taken, and a dead end is left by going back to a shorter one. Two
neighbours are compatible when merging their joint text leaves the boundary between them; a table keeps
the answers. A prefix has one encoding only, so a position that failed once fails for good and the work
is linear in the word. The result equals that of applying the merges in order.

Decoding: the tokens' texts lie in one buffer with an offset table; ids gather their spans.

Texts are cut at special tokens, then at white space, and the ids of each piece are cached (bounded).
A null text counts as empty and has no ids; repeated rows are encoded alike; an empty table gives an empty result; extra columns
stay, but for those of the new columns' names. The vocabulary's path is a parameter. Letters and digits are those of Unicode 16, as
the tokenizers library has them: what the regex module knows beyond counts as other characters. Texts are composed (NFC) with the combining marks of Unicode 9, as that library does.
A word of any length is encoded in pieces of WINDOW characters of matches, so memory is a few bytes a character.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torrentia.llm.common import Memo, col, renamed, without

CACHE_ENTRIES = 100_000  # of a generation of the memos
MEMO_CHARS = 64  # of the longest piece that is kept
ROWS = 256  # whose ids are held at once
STRETCH = 1 << 17  # tokens decoded at once
WINDOW = 1 << 14  # characters whose matches are held at once in long words
#: Characters that str.split() drops and the vocabulary's pattern for white space doesn't.
_CONTROL = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


# Fixed values of Unicode 16: its letters and digits that version 15.1 (Python's) doesn't have, first and last of each range.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D),
    (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
# Fixed values of Unicode 16 and 17: first and last capital, and the first small letter.
LOWER_17 = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB),
    (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
_LOWER = {a + k: small + k for a, b, small in LOWER_17 for k in range(b - a + 1)}
_LOWER[0x3A3] = 0x3C3  # no final sigma: letter by letter


# First and last of each range of the combining marks that Unicode got after version 9, and the letter and marks of its one new composition.
LATER_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27),
    (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x11935, 0x11935),
    (0x11938, 0x11938), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97),
    (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
_LATER_MARK = regex.compile("([" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in LATER_MARKS) + "])")


@lru_cache(maxsize=1)
def _later_scripts() -> str:
    """The regex module's letters and digits that Unicode 16 hasn't assigned, as ranges for a character class."""
    known = {c for a, b in LETTERS_16 for c in range(a, b + 1)}
    free = "".join(chr(c) for c in range(0x110000) if c not in known and unicodedata.category(chr(c)) == "Cn")
    out: list[list[int]] = []
    for c in map(ord, regex.findall(r"[\p{L}\p{N}]", free)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class _Window:
    """The automaton's matches at the places of a long text, for a stretch of it at a time."""

    def __init__(self, automaton, text: str, longest: int):
        self.automaton, self.text, self.longest = automaton, text, longest
        self.low, self.at = 0, []

    def __getitem__(self, pos: int) -> list[tuple[int, int]]:
        if not self.low <= pos < self.low + len(self.at):
            self.low = max(0, pos - WINDOW // 2)  # a dead end may go back a little
            high = min(len(self.text), self.low + WINDOW)
            self.at = [[] for _ in range(high - self.low)]
            for end, (token, length) in self.automaton.iter(self.text, self.low, min(len(self.text), high + self.longest)):
                if self.low <= end + 1 - length < high:
                    self.at[end + 1 - length - self.low].append((token, length))
        return self.at[pos - self.low]


def _composed(text: str) -> str:
    """NFC as the library has it, to which later marks are letters like others."""
    return "".join([p if k % 2 else unicodedata.normalize("NFC", p) for k, p in enumerate(_LATER_MARK.split(text))])


class Codec:
    """Encoder and decoder for a word-level BPE vocabulary: lower case, with an end-of-word mark."""

    END = "\0"  # stands for the mark inside this class; no byte maps to it

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        mark, vocab = model["end_of_word_suffix"], model["vocab"]
        inner = {t: (t[: -len(mark)] + self.END if t.endswith(mark) and t != mark else t) for t in vocab}
        self.special = added
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = pattern.replace(r"\s", _SPACES.pattern[1:-2])
        self.ascii_pattern = regex.compile("(?V1)" + pattern.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"))  # the same on ASCII
        if later := _later_scripts():
            pattern = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{later}]]").replace(r"\p{N}", rf"[\p{{N}}--[{later}]]")
        self.pattern = regex.compile("(?V1)" + pattern)
        self.bytes = _byte_alphabet()

        size = max([*vocab.values(), *added.values()]) + 1
        self.rank, self.parts, self.merge = [-1] * size, [None] * size, {}
        for r, (a, b) in enumerate(model["merges"]):
            whole = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = r
            self.rank[whole], self.parts[whole] = r, (vocab[a], vocab[b])
        self.compatible: dict[tuple[int, int], bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if self.parts[i] is None or self._stays_apart(*self.parts[i], joined=True):
                self.automaton.add_word(inner[t], (i, len(inner[t])))
        self.automaton.make_automaton()
        self.longest = max(len(t) for t in inner.values())
        self.sizes, self.shorter = [0] * size, [-1] * size  # of each token, the longest one that it begins with
        for t, (i, n) in self.automaton.items():
            self.sizes[i] = n
            self.shorter[i] = next((self.automaton.get(t[:k])[0] for k in range(n - 1, 0, -1) if t[:k] in self.automaton), -1)

        texts = [b""] * size
        for t, i in [*vocab.items(), *added.items()]:
            texts[i] = t.encode("utf-8") + b" "
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)
        self.lengths = np.array([len(t) for t in texts])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.pieces, self.words = Memo(self._piece, MEMO_CHARS, CACHE_ENTRIES), Memo(self._word, MEMO_CHARS, CACHE_ENTRIES)

    def _spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The tokens that stood at one end while `token` was built: (token, rank that made it, rank that used it up)."""
        out = self.spines[side].get(token)
        if out is None:
            part, used = self.parts[token], self.rank[token]
            rest = self._spine(part[side], side) if part else []
            rest = [(part[side], rest[0][1], used), *rest[1:]] if rest else []
            out = self.spines[side][token] = [(token, used, float("inf")), *rest]
        return out

    def _stays_apart(self, left: int, right: int, joined: bool = False) -> bool:
        """Whether no merge crosses the boundary of left and right; with joined, none before their own."""
        ends = self._spine(left, 1)
        for b, b_made, b_used in self._spine(right, 0):
            for a, a_made, a_used in ends:
                r = self.merge.get((a, b))
                # of equal ranks, the pair further to the left is merged first
                if r is not None and r < a_used and r <= b_used and a_made < b_used and b_made < a_used and not (joined and a == left and b == right):
                    return False
        return True

    def _fits(self, left: int, right: int) -> bool:
        key = (left, right)
        out = self.compatible.get(key)
        if out is None:
            if len(self.compatible) >= 2 * CACHE_ENTRIES:
                self.compatible.clear()
            out = self.compatible[key] = self._stays_apart(left, right)
        return out

    def _descent(self, text: str) -> list[int] | None:
        """The ids of a word, by its longest matches from the left and, where one doesn't fit, by the shorter ones that it begins with; None where that finds none.

        Tokens of which each two neighbours are compatible are the word's only encoding, so it doesn't matter how they were found.
        """
        n, matches, known, sizes, shorter = len(text), self.automaton.iter_long, self.compatible, self.sizes, self.shorter
        ids, pos, left, dead = [], 0, -1, set()
        while True:
            token = -1
            for end, (token, length) in matches(text, pos):
                if end + 1 - length != pos:
                    token = -1
                    break
                if pos + length not in dead and (left < 0 or (known[left, token] if (left, token) in known else self._fits(left, token))):
                    ids.append(token)
                    left, pos, token = token, pos + length, -1
                else:
                    break
            if pos == n:
                return ids
            while True:  # the match at pos doesn't fit, or there is none
                while token >= 0 and (pos + sizes[token] in dead or left >= 0 and not self._fits(left, token)):
                    token = shorter[token]
                if token >= 0:
                    break
                if not ids:
                    return None
                dead.add(pos)
                token = ids.pop()
                pos, left = pos - sizes[token], ids[-1] if ids else -1
                token = shorter[token]
            ids.append(token)
            left, pos = token, pos + sizes[token]

    def _word(self, word: str) -> bytes:
        text = "".join([self.bytes[b] for b in word.encode("utf-8")]) + self.END
        n = len(text)
        if n <= WINDOW and (ids := self._descent(text)) is not None:
            return struct.pack(f"<{len(ids)}I", *ids)
        return self._searched(text)

    def _searched(self, text: str) -> bytes:
        """The ids of a word of any length, from all matches at each place."""
        n = len(text)
        if n > WINDOW:
            at, ids, taken_at, taken_k = _Window(self.automaton, text, self.longest), array("I"), array("q"), array("i")
        else:
            at, ids, taken_at, taken_k = [[] for _ in range(n)], [], [], []
            for end, (token, length) in self.automaton.iter(text):
                at[end + 1 - length].append((token, length))  # ascending in length for each start
        dead, pos = bytearray(n + 1), 0
        k = len(at[0]) - 1
        while pos < n:
            options = at[pos]
            while k >= 0:
                token, length = options[k]
                if not dead[pos + length] and (not ids or self._fits(ids[-1], token)):
                    break
                k -= 1
            if k >= 0:
                ids.append(token)
                taken_at.append(pos)
                taken_k.append(k)
                pos += length
                k = len(at[pos]) - 1 if pos < n else -1
            else:
                dead[pos] = 1
                ids.pop()
                pos, k = taken_at.pop(), taken_k.pop() - 1
        return np.array(ids, "<u4").tobytes() if n > WINDOW else struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        text = piece.lower() if piece.isascii() else _composed(piece).translate(_LOWER).lower()
        if text.isascii():
            if text.isalpha():
                return self.words[text]
            return b"".join([self.words[w] for w in self.ascii_pattern.findall(text)])
        return b"".join([self.words[w] for w in self.pattern.findall(text)])

    def _plain(self, text: str) -> bytes:
        pieces = _SPACES.split(text) if _CONTROL.search(text) else text.split()
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return self._plain(text)
        parts = self.special_at.split(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in parts)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The tokens' texts with a space between, in UTF-8."""
        if len(ids) == 0:
            return b""
        lengths = self.lengths[ids]
        out = []
        for i in range(0, len(ids), STRETCH):
            some, n = self.starts[ids[i : i + STRETCH]], lengths[i : i + STRETCH]
            upto = np.cumsum(n)
            out.append(self.buffer[np.arange(upto[-1]) + np.repeat(some - (upto - n), n)].tobytes())
        return b"".join(out)[:-1]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One for each file and Python worker."""
    return Codec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of the text, array<int>, in column ids (which replaces one of that name)."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([c.encode(t).astype(np.int32) for t in texts])

    return docs.select(*without(docs, ids), run(col(text)).alias(ids))


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with the decoded text of the ids in column text."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([c.decode_bytes(np.asarray(r, np.int64) if r is not None else np.empty(0, np.int64)).decode("utf-8") for r in rows])

    return tokens.select(*without(tokens, text), run(col(ids)).alias(text))


def encoded(docs: DataFrame, path: str, text: str = "text", with_ids: bool = True, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs, less the columns to drop, with n_tokens, the ids (if wanted), and SHA-256 of the ids and of the decoded text, of one encoding and decoding.

    Rows come back ROWS at a time, so that no more ids are held; other columns pass as Arrow data, whatever their types.
    """
    names = [c for c in ("n_tokens", "ids", "ids_sha256", "decoded_sha256") if with_ids or c != "ids"]
    gone = {c.lower() for c in (*names, *drop)}
    safe, (text,) = renamed(docs, text)
    rest = [k for k, c in enumerate(docs.columns) if c.lower() not in gone]
    at, kept = safe.columns.index(text), [safe.columns[i] for i in rest]

    def run(batches):
        c = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                raws = [c.encode_bytes(t) for t in part.column(at).to_pylist()]
                ids = [np.frombuffer(r, "<u4") for r in raws]
                columns = {
                    "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                    "ids": pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), np.frombuffer(b"".join(raws), "<i4")),
                    "ids_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in raws]),
                    "decoded_sha256": pa.array([hashlib.sha256(c.decode_bytes(i)).hexdigest() for i in ids]),
                }
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in rest], *[columns[n] for n in names]], [*kept, *names])

    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType())}
    schema = T.StructType([*[T.StructField(safe.columns[i], safe.schema[i].dataType) for i in rest], *[T.StructField(n, kinds.get(n, T.StringType())) for n in names]])
    return safe.mapInArrow(run, schema).toDF(*[docs.columns[i] for i in rest], *names)


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    own = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    return encoded(own, path, with_ids=False, drop=("text",))


def op6_bpe_codec(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
