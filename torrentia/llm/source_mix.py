"""Mixing sources to target weights by a low-discrepancy schedule. [native]

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the corpus's words.
No target exceeds MAX_EPOCHS times its source's words; the excess is shared again by weight, which is
water-filling: sort sources by the level that fills them, then one running sum.

Schedule: point i of the van der Corput sequence is i with its binary digits in reverse. Of the first 2**b points, the least such
number not below the slots, those below the slots are taken, in order; so each whole number below the slots comes up
once. Each source owns a stretch of these numbers as long as its quota, and a point belongs to the source whose stretch
holds it: every stretch of the schedule has the sources near their shares, each source gets exactly its quota, and
all is whole numbers. Slots are ranked within their source:
counts of (chunk, source) first, their running sum next, then ranks inside chunks of a bounded size.

Blocks: a source's documents, in the order of a seeded hash, form one run of words, cut in blocks of
equal size (to one word). The slot ranked r takes block r mod blocks. A document's taken words are its words in blocks times the slots that take them.

Where a document stands in its source's run comes from running sums over hash ranges (two levels) and
then inside a range, so no task gets a source whole. Documents that share a doc_id and a size (repeated rows, or null ids) stand
together; they are dealt to CELLS places by their row, with the places' sums run first. Null text has size 0; nothing is taken of it.
Repeated rows are documents of their own. Sources are told apart by their text alone, so there are no ties among them.
An empty table gives an empty result; extra columns play no part in `mix`, and `mixed_documents` returns the input's columns as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from torrentia.llm.common import col, materialise, n_words, renamed

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK = 256
CHUNK = 8192
CELLS = 1024
RANGE_ROWS = 1024
SEED = "mix-1"


def source_targets(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a source: words, target, its number of blocks, its quota of slots, and its interval of [0, 1)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("words"))
    every = W.partitionBy()
    order = W.orderBy(F.col("source").isNull(), "source")  # sources only: a row each
    n = len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    s = per.withColumn("weight", weight.cast("long"))
    cap = F.col("words") * MAX_EPOCHS
    filling = W.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("words").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", rest / weights).withColumn("full", cap / F.col("weight") <= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    s = s.withColumn("target", F.round(F.when(F.col("full"), cap.cast("double")).otherwise(level * F.col("weight")), 6))
    s = s.withColumn("blocks", F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block))).otherwise(0).cast("long"))
    quota = F.when(F.col("words") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("words") + 0.5)).otherwise(0).cast("long")
    s = s.withColumn("quota", quota).withColumn("slots", F.sum("quota").over(every))
    upto = F.sum("quota").over(order)
    return s.select("source", "words", "target", "blocks", "quota", "slots", (upto - F.col("quota")).alias("lo"), upto.alias("hi"))


def schedule(targets: DataFrame, n_slots: int) -> DataFrame:
    """The slots in use: slot, source, rank in the source (from 0), and the block taken."""
    spark = targets.sparkSession
    bits, width = max(0, n_slots - 1).bit_length(), -(-n_slots // CELLS) or 1
    points = spark.range(0, (1 << bits) if n_slots else 0).withColumnRenamed("id", "slot")
    points = points.withColumn("x", F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")).where(F.col("x") < n_slots)
    points = points.withColumn("cell", F.expr(f"x div {width}")).withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    own = targets.where("quota > 0").withColumn("t_cell", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    placed = points.join(own, (F.col("cell") == F.col("t_cell")) & (F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi")))
    placed = placed.select("slot", "chunk", "source", "blocks")
    counts = placed.groupBy("chunk", "source").agg(F.count(F.lit(1)).alias("c"))
    earlier = F.coalesce(F.sum("c").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("chunk").alias("p_chunk"), F.col("source").alias("p_source"), earlier.alias("earlier"))
    ranked = placed.join(counts, (F.col("chunk") == F.col("p_chunk")) & F.col("source").eqNullSafe(F.col("p_source")))
    rank = F.col("earlier") + F.row_number().over(W.partitionBy("chunk", "source").orderBy("slot")) - 1
    return ranked.withColumn("rank", rank).select("slot", "source", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def _placed(sizes: DataFrame, n_rows: int) -> DataFrame:
    """sizes with at: the words of the source that come before the document, in hash order."""
    bits = max(0, (max(n_rows, 1) // RANGE_ROWS).bit_length())
    low = bits // 2
    sizes = sizes.withColumn("part", F.expr(f"cast(conv(substr(key, 1, 8), 16, 10) as bigint) >> {32 - bits}") if bits else F.lit(0).cast("long"))
    sizes = sizes.withColumn("upper", F.expr(f"part >> {low}"))
    before = lambda by, order: F.coalesce(F.sum("size").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("source", "upper", "part").agg(F.sum("size").alias("size"))
    uppers = parts.groupBy("source", "upper").agg(F.sum("size").alias("size"))
    uppers = uppers.select(F.col("source").alias("u_source"), F.col("upper").alias("u_upper"), before(["source"], ["upper"]).alias("at_upper"))
    parts = parts.withColumn("at_part", before(["source", "upper"], ["part"])).drop("size")
    parts = parts.join(uppers, F.col("source").eqNullSafe(F.col("u_source")) & (F.col("upper") == F.col("u_upper")))
    parts = parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), (F.col("at_part") + F.col("at_upper")).alias("at_range"))
    sizes = sizes.withColumn("place", F.pmod(F.xxhash64("rid"), F.lit(CELLS)))
    alike = ["source", "part", "key", "doc_id", "size", "place"]
    cells = sizes.groupBy(*alike).agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("rows"))
    cells = cells.withColumn("at_cell", F.coalesce(F.sum("sum").over(W.partitionBy("source", "part").orderBy("key", "doc_id", "size", "place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.select(*[F.col(c).alias(f"k_{c}") for c in alike], "at_cell", "rows")
    on = F.lit(True)
    for c in alike:
        on = on & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    inside = sizes.join(cells, on)
    nth = F.row_number().over(W.partitionBy(*alike).orderBy("rid")) - 1
    inside = inside.withColumn("inside", F.col("at_cell") + F.col("size") * nth)
    return inside.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part"))).withColumn("at", F.col("at_range") + F.col("inside"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, row_id: str | None = None) -> DataFrame:
    """One row a document: rid (the column row_id of docs, or else the row's place), doc_id, size, source_size, target, taken."""
    key = F.md5(F.concat(F.coalesce(col(doc_id).cast("string"), F.lit("")), F.lit(SEED)))
    sizes = docs.select(col(doc_id).alias("doc_id"), col(source).alias("source"), n_words(col(text)).alias("size"), key.alias("key"), (col(row_id) if row_id else F.monotonically_increasing_id()).alias("rid"))
    sizes = materialise(sizes)
    targets = materialise(source_targets(sizes, block))
    slots = schedule(targets, (targets.agg(F.max("slots")).first()[0] or 0))
    uses = slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses"))
    uses = uses.withColumnsRenamed({"source": "b_source", "block": "b_block"})

    shares = targets.withColumnRenamed("source", "t_source")
    d = _placed(sizes, sizes.count()).join(shares, F.col("source").eqNullSafe(F.col("t_source")))
    # the first `longer` blocks have a word more
    d = d.withColumns({"each": F.expr("if(blocks > 0, words div blocks, 0)"), "longer": F.expr("if(blocks > 0, words % blocks, 0)")})
    block_of = lambda p: F.expr(f"if({p} < longer * (each + 1), {p} div (each + 1), longer + ({p} - longer * (each + 1)) div each)")
    span = F.when(F.col("size") > 0, F.sequence(block_of("at"), block_of("(at + size - 1)")))
    pieces = d.select("rid", "doc_id", "source", "size", "words", "target", "at", "each", "longer", F.explode_outer(span).alias("block"))
    start = lambda b: F.col("each") * b + F.least(b, F.col("longer"))
    inside = F.least(F.col("at") + F.col("size"), start(F.col("block") + 1)) - F.greatest(F.col("at"), start(F.col("block")))
    pieces = pieces.withColumn("inside", inside)
    pieces = pieces.join(uses, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")), "left")
    taken = F.sum(F.coalesce(F.col("inside") * F.col("uses"), F.lit(0)))
    return pieces.groupBy("rid", "doc_id", "size", F.col("words").alias("source_size"), "target").agg(taken.alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs as the mix takes them: each document as many times as taken / size rounds to, with its own columns."""
    safe, (doc_id, text, source) = renamed(docs, doc_id, text, source)
    own = materialise(safe.withColumn("__m_rid", F.monotonically_increasing_id()))
    counted = mix(own, doc_id, text, source, row_id="__m_rid").where("size > 0")
    times = counted.select(F.col("rid").alias("__m_key"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("__m_times")).where("__m_times > 0")
    return own.join(times, F.col("__m_rid") == F.col("__m_key")).withColumn("__m_copy", F.explode(F.sequence(F.lit(1), F.col("__m_times")))).select(*safe.columns).toDF(*docs.columns)


def op8_source_mix(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid")


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '{SEED}') AS key, row_number() OVER () AS rid FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source),
w AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} + 1] AS BIGINT) AS weight FROM p),
l AS (SELECT *, (sum(words) OVER () - coalesce(sum({MAX_EPOCHS} * words) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lev FROM w
    WINDOW b AS (ORDER BY {MAX_EPOCHS} * words / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, round(CASE WHEN {MAX_EPOCHS} * words / weight <= lev THEN CAST({MAX_EPOCHS} * words AS DOUBLE)
    ELSE max(lev) FILTER (WHERE {MAX_EPOCHS} * words / weight > lev) OVER () * weight END, 6) AS target,
    CASE WHEN words > 0 THEN CAST(greatest(1, round(words / {BLOCK})) AS BIGINT) ELSE 0 END AS blocks FROM l),
q AS (SELECT *, CASE WHEN words > 0 THEN CAST(floor(target * blocks / words + 0.5) AS BIGINT) ELSE 0 END AS quota FROM g),
s AS (SELECT *, CAST(sum(quota) OVER () AS BIGINT) AS slots, CAST(sum(quota) OVER (ORDER BY source IS NULL, source) AS BIGINT) AS upto FROM q),
n0 AS (SELECT CAST(max(slots) AS BIGINT) AS slots, CASE WHEN max(slots) > 1 THEN length(bin(CAST(max(slots) - 1 AS BIGINT))) ELSE 0 END AS bits FROM s),
x AS (SELECT i AS slot, list_sum(list_transform(range(bits), lambda k: ((i >> k) & 1) << (bits - 1 - k))) AS x FROM (SELECT unnest(range(CASE WHEN slots > 0 THEN 1 << bits ELSE 0 END)) AS i, bits FROM n0)),
r AS (SELECT source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM x JOIN s ON coalesce(x, 0) >= upto - quota AND coalesce(x, 0) < upto),
u AS (SELECT source, rank % blocks AS block, count(*) AS uses FROM r GROUP BY ALL),
o AS (SELECT d.*, words, target, blocks, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos,
    words // nullif(blocks, 0) AS each, words % nullif(blocks, 0) AS longer FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
n AS (SELECT *, CASE WHEN pos < longer * (each + 1) THEN pos // (each + 1) ELSE longer + (pos - longer * (each + 1)) // each END AS b0,
    CASE WHEN pos + size - 1 < longer * (each + 1) THEN (pos + size - 1) // (each + 1) ELSE longer + (pos + size - 1 - longer * (each + 1)) // each END AS b1 FROM o),
k AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(b0, b1 + 1) ELSE [NULL] END) AS block FROM n)
SELECT doc_id, size, words AS source_size, target, CAST(sum(coalesce((least(pos + size, each * (k.block + 1) + least(k.block + 1, longer)) - greatest(pos, each * k.block + least(k.block, longer))) * uses, 0)) AS BIGINT) AS taken
FROM k LEFT JOIN u ON k.source IS NOT DISTINCT FROM u.source AND k.block = u.block GROUP BY k.rid, doc_id, size, words, target"""
