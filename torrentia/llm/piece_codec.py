"""SentencePiece encoding and decoding with a public BPE model file, by tables of distinct chunks.

No piece has a white-space marker after another character, so no merge crosses the place before a marker that
follows one: texts are cut there into chunks (marked words). They are cut also between letters and other characters that no chain of pieces
connects with them, and at line ends, if no piece has them. Of the chunks of a group of texts each distinct one is segmented once, and their ids are joined back to the texts by position, as a gather
from one flat array. A bounded table keeps the ids of chunks seen before in the Python worker.

A chunk is segmented as the library does: its characters are symbols, and of the neighbours whose joint text is a piece
the ones of the best score are joined, the first on ties, until none is left. A symbol that isn't a piece becomes the pieces of its bytes.

Decoding: the pieces' bytes lie in one buffer with an offset table; ids gather their spans. Of the first text's leading
marker nothing stays, begin and end ids have no text, and byte pieces that aren't UTF-8 decode to U+FFFD.

The model's path is a parameter. Models of another kind (unigram, a normaliser that changes characters, user-defined or unused pieces, no byte
pieces, pieces that cross markers) are refused. A null text counts as empty, which has the begin and end ids only; repeated rows are encoded alike;
an empty table gives an empty result; extra columns stay, but for those of the new columns' names (capitals or not). Long texts are
encoded in stretches of STRETCH characters, so what is held is their ids and one stretch; a chunk takes some 200 bytes a character.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torrentia.llm.common import Memo, col, unused, without

MARK = "▁"
STRETCH = 1 << 19  # characters whose chunks are held at once
TABLE_ENTRIES = 120_000  # of a generation; twice as many are kept
TABLE_CHUNK = 64  # characters of the longest chunk that the table keeps
BRIEF = 24  # symbols that are searched through for each merge
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in the file


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class PieceCodec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        pieces = []
        for raw in (v for k, v in fields if k == 1):
            p = dict(_fields(raw))
            pieces.append((p[1].decode("utf-8"), struct.unpack("<f", p.get(2, b"\0" * 4))[0], p.get(3, NORMAL)))
        trainer, normaliser = (dict(_fields(next(v for k, v in fields if k == n))) for n in (2, 3))
        plain = [(t, i, s) for i, (t, s, kind) in enumerate(pieces) if kind == NORMAL]
        crossing = any(MARK in t.lstrip(MARK) for t, _, _ in plain)
        other = trainer.get(3, 1) != 2 or not trainer.get(35) or normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1)
        if other or crossing or any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):
            raise ValueError("not a byte-fallback BPE model whose characters stay as they are and whose pieces keep to marked words")
        self.ids = {t: i for t, i, _ in plain}
        places = {s: r for r, s in enumerate(sorted({s for _, _, s in plain}, reverse=True))}
        self.rank = {t: places[s] for t, _, s in plain}
        self.byte_ids = [0] * 256
        self.begin, self.end = (next(i for i, (t, _, kind) in enumerate(pieces) if kind == CONTROL and t == name) for name in ("<s>", "</s>"))
        texts = []
        for i, (t, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(t[3:-1], 16)] = i
                texts.append(bytes([int(t[3:-1], 16)]))
            else:
                texts.append({NORMAL: t.replace(MARK, " "), UNKNOWN: " ⁇ ", CONTROL: ""}[kind].encode("utf-8"))
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)
        self.lengths = np.array([len(t) for t in texts])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        space, line = f"[ {MARK}]", "" if any("\n" in t for t in self.ids) else "\n"
        self.kin = self._kin()
        kin = re.escape("".join(sorted(self.kin)))
        same, other = f"[{kin}]", f"[^ {MARK}{line}{kin}]"
        self.chunk_at = re.compile(f"{space}+(?:{same}+|{other}*)|{same}+|{other}+" + "|\n+" * bool(line))
        self.cut_at = re.compile(f"(?<!{space}){space}")
        self.table = Memo(self._segmented, TABLE_CHUNK, TABLE_ENTRIES)

    def _kin(self) -> set[str]:
        """The letter a and all characters that stand next to each other in pieces, next to those, and so on: the others never join with them."""
        near: dict[str, set[str]] = {}
        for t in self.ids:
            for a, b in pairwise(t.lstrip(MARK)):
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        found, front = {"a"}, {"a"}
        while front:
            front = set().union(*[near.get(c, set()) for c in front]) - found
            found |= front
        return found

    def _segmented(self, chunk: str) -> bytes:
        chunk = chunk.replace(" ", MARK)
        parts = self._merged(list(chunk)) if len(chunk) <= BRIEF else self._merged_long(chunk)
        out = []
        for p in parts:
            i = self.ids.get(p)
            out += [self.byte_ids[b] for b in p.encode("utf-8")] if i is None else [i]
        return struct.pack(f"<{len(out)}I", *out)

    def _merged(self, parts: list[str]) -> list[str]:
        rank, none = self.rank.get, len(self.rank)
        pairs = [rank(a + b, none) for a, b in pairwise(parts)]  # the place of each pair's score
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            whole = parts[at] + parts[at + 1]
            parts[at : at + 2] = [whole]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + whole, none)
            if at < len(pairs):
                pairs[at] = rank(whole + parts[at + 1], none)
        return parts

    def _merged_long(self, chunk: str) -> list[str]:
        """The same with a queue of the pairs; a pair is stale once either of its symbols has grown or gone."""
        rank, n = self.rank, len(chunk)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that starts here; end 0: gone
        queue = [(r, k, k + 2) for k in range(n - 1) if (r := rank.get(chunk[k : k + 2])) is not None]
        heapify(queue)
        while queue:
            _, left, stop = heappop(queue)
            right = end[left]
            if right == 0 or right >= n or end[right] != stop:
                continue
            end[left], end[right] = stop, 0
            if stop < n:
                before[stop] = left
                r = rank.get(chunk[left : end[stop]])
                if r is not None:
                    heappush(queue, (r, left, end[stop]))
            if left:
                r = rank.get(chunk[before[left] : stop])
                if r is not None:
                    heappush(queue, (r, before[left], stop))
        parts, at = [], 0
        while at < n:
            parts.append(chunk[at : end[at]])
            at = end[at]
        return parts

    def _stretches(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > STRETCH and (cut := self.cut_at.search(text, at + STRETCH)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _joined(self, stretches: list[str]) -> list[np.ndarray]:
        """The ids of each stretch: distinct chunks are segmented, and their ids joined back by position."""
        chunks, ends = [], []
        for s in stretches:
            chunks += self.chunk_at.findall(s)
            ends.append(len(chunks))
        number = {c: k for k, c in enumerate(dict.fromkeys(chunks))}
        codes = np.fromiter(map(number.__getitem__, chunks), np.int64, len(chunks))
        parts = [self.table[c] for c in number]
        sizes = np.array([len(p) // 4 for p in parts])
        flat, first = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[codes]
        upto = np.cumsum(n)
        ids = flat[np.arange(upto[-1]) + np.repeat(first[codes] - (upto - n), n)]
        return np.split(ids, upto[np.array(ends[:-1], np.int64) - 1]) if len(ends) > 1 else [ids]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, without begin and end ids, as little-endian unsigned 32-bit integers."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        group, owners, size = [], [], 0

        def flush() -> None:
            nonlocal size
            if group:
                for k, ids in zip(owners, self._joined(group), strict=True):
                    out[k].append(ids)
            group.clear()
            owners.clear()
            size = 0

        for k, text in enumerate(texts):
            if text:
                for s in self._stretches(" " + text):
                    if size + len(s) > STRETCH:
                        flush()
                    group.append(s)
                    owners.append(k)
                    size += len(s)
        flush()
        none = np.empty(0, "<u4")
        return [none if not x else x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def encode_each(self, text: str | None) -> bytes:
        """The ids of one text as bytes, chunk by chunk: shorter where the table has most chunks."""
        stretches = self._stretches(" " + text) if text else ()
        return b"".join(map(self.encode_chunks, stretches))

    def encode_chunks(self, text: str) -> bytes:
        """The ids of a text without the space that is put before whole ones, say of what follows the end of a chunk."""
        return b"".join(map(self.table.__getitem__, self.chunk_at.findall(text)))

    def enclosed(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([[self.begin], ids, [self.end]]).astype("<u4")

    def joined_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the pieces, markers as spaces."""
        out = []
        for i in range(0, len(ids), 1 << 17):
            some = ids[i : i + (1 << 17)]
            n = self.lengths[some]
            upto = np.cumsum(n)
            out.append(self.buffer[np.arange(upto[-1]) + np.repeat(self.starts[some] - (upto - n), n)].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids, in UTF-8."""
        raw = self.joined_bytes(ids)
        raw = raw[1:] if raw[:1] == b" " else raw
        return raw.decode("utf-8", "replace").encode("utf-8")


@lru_cache(maxsize=4)
def codec(path: str) -> PieceCodec:
    """One for each file and Python worker."""
    return PieceCodec(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with the decoded text of the ids in column text; null ids count as none."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([c.decode(np.asarray([] if r is None else r, np.int64)).decode("utf-8") for r in rows])

    return tokens.select(*without(tokens, text), run(col(ids)).alias(text))


def encoded(docs: DataFrame, path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """docs with n_tokens (all ids), the ids (if wanted), and SHA-256 of the ids and of the decoded text, of one encoding and decoding."""
    names = [c for c in ("n_tokens", "ids", "ids_sha256", "decoded_sha256") if with_ids or c != "ids"]
    kinds = {"n_tokens": "long", "ids": "array<int>"}

    @F.pandas_udf(", ".join(f"{c} {kinds.get(c, 'string')}" for c in names))
    def run(texts: pd.Series) -> pd.DataFrame:
        c, rows = codec(path), []
        for ids in map(c.enclosed, c.encode(texts.tolist())):
            whole = (len(ids), ids.astype(np.int32), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest())
            rows.append(whole if with_ids else (whole[0], *whole[2:]))
        return pd.DataFrame(rows, columns=names)

    rest = without(docs, *names)
    (new,) = unused(docs.columns, "codes")
    return docs.select(*rest, run(col(text)).alias(new)).select(*rest, *[F.col(f"{new}.{c}") for c in names])


def op13_piece_codec(spark, sf_dir):
    """n_tokens, ids_sha256 and decoded_sha256 of each document, with begin and end ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, default_model(), with_ids=False).drop("text")
