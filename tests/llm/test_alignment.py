"""Alignment of tokens held against a plain reading of both libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from torrentia.llm import token_alignment as A
from torrentia.llm.bpe_codec import _byte_alphabet

PATHS = A.default_vocabularies()
BITS = ["a", "b", " ", "  ", "\n", "\t", "é", "ñ", "中", "🙂", "́", "<s>", "<|endoftext|>", "<0x41>", "the", "ing", " The", "123", "\x1c", "\x85", "　", "ﷺ", "'s", "don't", "http://", "x.", "▁"]


@pytest.fixture(scope="module")
def plain():
    """A reading of a text: tokens (id, start, end) of both, or none."""
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    to_byte = {c: k for k, c in enumerate(_byte_alphabet())}

    def piece(i):
        t = b.id_to_piece(i)
        return bytes([int(t[3:-1], 16)]) if b.is_byte(i) else t.replace("▁", " ").encode()

    def read(text):
        if not text:
            return [], []
        both = []
        for ids, of in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(to_byte[c] for c in a.id_to_token(i))), (b.encode(text), piece)):
            at, out, whole = 0, [], b""
            for i in ids:
                t = of(i)
                out.append((i, at, at + len(t)))
                at, whole = at + len(t), whole + t
            if whole != (" " + text).encode():
                return [], []
            both.append(out)
        return both

    return read


def brute(plain, texts):
    """Rows without doc_id, by the definition."""
    rows, counts, read = [], Counter(), [plain(t) for t in texts]
    links = [[(i, j) for i, _, e in a for j, _, f in b if e == f] if len(a) < 400 else [(i, j) for i, _, e in a if (j := {f: j for j, _, f in b}.get(e)) is not None] for a, b in read]
    for x in links:
        counts.update(x)
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    for (a, b), x in zip(read, links, strict=True):
        shared, groups, i, j = {e for _, _, e in a} & {f for _, _, f in b}, [], [], []
        rest = list(b)
        for t, _, e in a:
            i.append(t)
            if e in shared:
                while rest and rest[0][2] <= e:
                    j.append(rest.pop(0)[0])
                groups.append(",".join(map(str, i)) + "|" + ",".join(map(str, j)))
                i, j = [], []
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(groups), len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), sha))
    return rows


@pytest.mark.parametrize("hot", [A.HOT_PAIRS, 40])
def test_random_texts_equal_the_plain_reading(spark, plain, hot):
    r = random.Random(hot)
    texts = ["".join(r.choice(BITS[:-1] if r.random() < 0.9 else BITS) for _ in range(r.randrange(40))) for _ in range(400)] + [None, "", " ", "the the", "x" * 3000, "a b " * 900]
    docs = spark.createDataFrame([(k, t, "e") for k, t in enumerate(texts)], "doc_id long, text string, rid string").repartition(3)
    got = {x.doc_id: tuple(x)[1:] for x in A.summaries(docs, PATHS, hot_pairs=hot).collect()}
    want = brute(plain, texts)
    for k, t in enumerate(texts):
        assert got[k] == want[k], repr(t)


def test_query_equals_the_plain_reading_on_the_whole_table(spark, plain):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = A.op11_token_alignment(spark, d)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted((x.doc_id, *w) for x, w in zip(docs, brute(plain, [x.text for x in docs]), strict=True))


def test_odd_inputs(spark, plain):
    rows = [(1, "a cat"), (1, "a cat"), (None, "a dog"), (2, None), (3, "▁")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, `links.n` int")
    want = [(i, *w) for (i, _), w in zip(rows, brute(plain, [t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, A.summaries(docs, PATHS).collect()), key=str) == sorted(want, key=str)
    assert A.summaries(docs.limit(0), PATHS).count() == 0
    groups = A.alignments(docs, PATHS, with_groups=True).where("doc_id = 2").first()
    assert groups.groups == "" and groups.links == []
