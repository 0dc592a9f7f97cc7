"""Columns with clashing, dotted and other odd names go through every stage as they are."""

import random

import pytest
from pyspark.sql import functions as F

from torrentia.llm import bpe_codec, exact_dedup, lang_id, near_dedup, periodic_runs, piece_codec, quality_rules, source_mix, substring_dedup

NAMES = [
    "plain", "a.b", "with `ticks`", "a b", "c0", "C1", "RID", "rid", "Label", "__x_maybe", "__x_sha", "__x_h", "__x_row", "__n_id", "__n_hash", "__n_th", "__m_rid", "__m_key", "__m_times", "__m_copy", "__s_rid", "__s_gone", "__s_of",
    "__b", "__l", "__q_words", "__q_m", "__q_kept", "__t_lang", "codes", "found", "shorter", "node", "key", "n", "h", "sha", "size", "start", "cp", "maybe",
]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(6)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7))) for _ in range(70)) + "."
    texts = [text() for _ in range(6)]
    return [(i, texts[i % 6] if i < 9 else text(), r.choice(["en", None]), r.choice(["s", "t", None])) for i in range(20)] + [(None, None, "en", None)]


STAGES = {
    "quality": quality_rules.filter_quality,
    "exact": exact_dedup.deduplicate,
    "near": near_dedup.deduplicate,
    "mixing": source_mix.mixed_documents,
    "passages": substring_dedup.deduplicate,
    "runs": periodic_runs.collapsed,
    "bpe": lambda d: bpe_codec.encoded(d, bpe_codec.default_vocabulary()),
    "pieces": lambda d: piece_codec.encoded(d, piece_codec.default_model()),
    "language": lambda d: lang_id.predict(d, [(["en", "de"], __import__("numpy").zeros((lang_id.BUCKETS + 1, 2), "float32"))]),
}


@pytest.mark.parametrize("stage", list(STAGES))
def test_names_stay(spark, rows, stage):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = [n for n in NAMES if n != "rid"]  # one of two names that differ in capitals only
    wide = docs.select("*", *[F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(f" {n}")).alias(n) for n in extra])
    want, got = STAGES[stage](docs), STAGES[stage](wide)
    added = [c for c in want.columns if c not in docs.columns]
    assert got.columns == [*docs.columns, *extra, *added]
    seen = got.collect()
    for r in seen:
        assert all(r[n] == f"{'-' if r.doc_id is None else r.doc_id} {n}" for n in extra)
    key = lambda r: str([r[c] for c in want.columns])
    assert sorted(map(key, seen)) == sorted(map(key, want.collect())) and len(seen) > 5
