"""SentencePiece codec held against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from torrentia.llm import piece_codec as P

BITS = ["a", "b", " ", "  ", "▁", "\n", "\t", "é", "ñ", "中", "文", "🙂", "́", "<s>", "</s>", "<unk>", "<0x41>", "the", "ing", " The", "123", "_", "\x00", "　", "ﷺ", "…", "http://", "xx", "."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


def expected(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    return len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_random_texts_equal_the_library(library, monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice(BITS) for _ in range(r.randrange(60))) for _ in range(4000)]
    texts += ["".join(chr(r.choice([r.randrange(1, 0xD800), r.randrange(32, 127)])) for _ in range(40)) for _ in range(1000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 3000, "aaaa b" * 1000, "", None, "\n" * 100 + "x", "▁", "▁▁x", " ", "hello" * 999, "the end. " * 500]
    monkeypatch.setattr(P, "STRETCH", 200)  # long texts are cut many times
    monkeypatch.setattr(P, "TABLE_ENTRIES", 500)
    c = P.PieceCodec(P.default_model())
    for text, ids in zip(texts, c.encode(texts), strict=True):
        want = library.encode(text or "")
        assert ids.tolist() == want, text
        assert c.decode(c.enclosed(ids)).decode() == library.decode([1, *want, 2]), text


def test_query_equals_the_library_on_whole_tables(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = P.op13_piece_codec(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, texts[r.doc_id])


def test_odd_inputs(spark, library):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (None, "", "y"), (3, "é " * 9000, "z")], "doc_id long, text string, `IDS` string").withColumn("a.b", F.lit(7)).withColumn("codes", F.lit(1))
    rows = P.encoded(docs, P.default_model()).collect()
    assert sorted(rows[0].asDict()) == sorted(["doc_id", "text", "a.b", "codes", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, r.text) and r["a.b"] == 7
    assert P.encoded(docs.limit(0), P.default_model()).count() == 0
    back = P.decode(spark.createDataFrame([([1, 263, 2],), (None,), ([],)], "ids array<int>"), P.default_model()).collect()
    assert [r.decoded for r in back] == [library.decode([1, 263, 2]), "", ""]


def test_other_models_are_refused(tmp_path):
    """A unigram model without a normaliser that changes characters."""
    f = tmp_path / "m.model"
    f.write_bytes(b"\x0a\x05\x0a\x03<s>" + b"\x12\x02\x18\x01" + b"\x1a\x04\x18\x01\x20\x00")
    with pytest.raises(ValueError):
        P.PieceCodec(str(f))
