"""The pipeline's stages against versions that don't share their code: SQL, plain Python, all pairs, the tokenizers library."""

import collections
import hashlib
import re

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from torrentia.llm import bpe_codec, near_dedup, quality_rules, source_mix
from torrentia.llm.common import materialise, word_hashes

DIR = "/root/testdata/sf0.001"


def by_sql(sql, docs, tmp_path, name):
    """The SQL's rows over the stage's input, which is written as one table."""
    path = str(tmp_path / name)
    docs.write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/*.parquet'")
    return con.sql(sql).df()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, DIR))
        seen[name] = (before, docs)
        if name != "encoding":
            assert docs.columns == columns

    before, after = seen["quality"]
    verdict = by_sql(quality_rules.ORACLE_SQL, before, tmp_path, "quality")
    kept = set(verdict[verdict.kept].doc_id)
    assert {r.doc_id for r in after.collect()} == kept and len(kept) < before.count()

    before, after = (x.collect() for x in seen["exact"])
    best = {}
    for r in before:
        k = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[k] = min(best.get(k, (0, 10**18)), (-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in after} == {b[1] for b in best.values()}

    before, after = (x.collect() for x in seen["near"])
    par = {r.doc_id: r.doc_id for r in before}
    find = lambda x: x if par[x] == x else find(par[x])
    k = [(r.doc_id, word_hashes(r.text).tolist()) for r in before]
    for i, (a, x) in enumerate(k):
        for b, y in k[:i]:
            common = sum((collections.Counter(x) & collections.Counter(y)).values())
            if common >= 0.8 * (len(x) + len(y) - common) and near_dedup.similarity(*(word_hashes(" ".join(map(str, t))) for t in (x, y))) > 0:
                lo, hi = sorted((find(a), find(b)))
                par[hi] = lo
    assert {r.doc_id for r in after} == {find(r.doc_id) for r in before}

    before, after = seen["mixing"]
    taken = by_sql(source_mix.ORACLE_SQL, before, tmp_path, "mixing")
    times = {int(r.doc_id): int(r.taken / r.size + 0.5) for r in taken.itertuples() if r.size}
    assert collections.Counter(r.doc_id for r in after.collect()) == {i: n for i, n in times.items() if n}

    before, after = seen["encoding"]
    tokenizer = Tokenizer.from_file(bpe_codec.default_vocabulary())
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 0


def test_odd_tables_pass_all_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (90001, "", "en", None, 0), (90002, " \n", None, "s", 2), (90003, "word " * 200_000, "en", "s", 1)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(5))
    names = ["symbols_pm", "other_pm", "measure", "kept", "keep_id", "class_id", "size", "rid", "label", "slot", "block"]
    for n in names:
        docs = docs.withColumn(n, F.lit("clash"))
    for table in (docs, docs.limit(0)):
        now, columns = table, table.columns
        for name, stage in corpus_pipeline.STAGES:
            now = materialise(stage(spark, now, DIR))
            assert set(now.columns) >= set(names) and (name == "encoding" or now.columns == columns)
        rows = now.collect()
        assert bool(rows) == (table is docs) and all(r.kept == "clash" for r in rows)
        assert not {r.doc_id for r in rows} & {None, 90001, 90002, 90003}
