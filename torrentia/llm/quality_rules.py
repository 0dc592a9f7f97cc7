"""Quality rules with adaptive thresholds from mergeable quantile sketches. [native]

Every document gets integer measures. A log-bucket histogram of each measure, kept for each
language and source, is the quantile sketch: it has a bounded number of buckets, a relative error of
1/64, and sketches merge by adding counts, so a language's or the whole corpus's sketch is the sum of
the finer ones. A group's sketch is smoothed towards its language's, and that towards the corpus's: the
parent's distribution is added with the weight of PRIOR documents, so a small group leans on its
parent, a large one hardly, and nothing switches at a size. The weights are whole numbers, so SQL can
repeat them exactly.

Thresholds are read off the smoothed sketches and nothing else. Measures that spread in any prose (share of
characters that aren't letters, share of capitals, word length) have Tukey fences,
REACH times the distance of the quartiles beyond them. Measures that are zero in most prose
(repeated lines, repeated words) have their TAIL percentile. They are joined back to the documents, which are
then filtered. No cutoff but the base rule's is fixed.

Null text has no words. Null language or source form groups of their own. A document that fails the
base rule (too few words, or mostly repeated words) feeds no sketch and isn't kept. Repeated rows count
and are judged each for itself; a value equal to its threshold is kept. Very long texts are measured whole. An empty table
gives an empty result; extra columns of the input play no part in the report and stay as they are in `filter_quality`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from torrentia.llm.common import SPACE, WORD, col, discard, materialise, renamed

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Measure -> (lower percentile, upper percentile, REACH or 0): outliers lie beyond a percentile by REACH times the quartiles' distance.
REACH, TAIL = 4, 99
FENCES = {
    "other_pm": (None, 75, REACH),
    "upper_pm": (None, 75, REACH),
    "word_len10": (25, 75, REACH),
    "dup_lines_pm": (None, TAIL, 0),
    "repeat_pm": (None, TAIL, 0),
}
PRIOR = 200
OTHER = r"[\x21-\x40\x5B-\x60\x7B-\x7E]"


def _share(part: Column, whole: Column, by: int = 1000) -> Column:
    return F.when(whole > 0, F.floor(part * F.lit(by) / whole)).otherwise(F.lit(0)).cast("long")


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, from the sorted window hashes."""
    second = F.zip_with(hashes, F.slice(hashes, 2, 2_000_000_000), lambda a, b: F.xxhash64(a, b))
    return F.slice(F.zip_with(second, F.slice(hashes, 3, 2_000_000_000), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(hashes) - 2, F.lit(0)))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the word counts and measures of the text, each in a column named __q_*."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE + "+", "")) > 0)
    out = docs.withColumns(
        {
            "__q_words": F.regexp_count(t, F.lit(WORD)).cast("long"),
            "__q_chars": (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long"),
            "__q_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "__q_other": F.regexp_count(t, F.lit(OTHER)).cast("long"),
            "__q_upper": F.regexp_count(t, F.lit(r"[A-Z]")).cast("long"),
            "__q_lines": lines,
            "__q_hashes": F.transform(F.filter(F.split(t, SPACE + "+"), lambda w: w != ""), lambda w: F.xxhash64(w)),
        }
    )
    out = out.withColumn("__q_windows", _repeat_words(F.col("__q_hashes")))
    out = out.withColumns(
        {
            "__q_n_lines": F.size("__q_lines").cast("long"),
            "__q_dup_lines": (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"),
            # sorting is left out where no window repeats
            "__q_sorted": F.when(
                F.size("__q_windows") > F.size(F.array_distinct("__q_windows")),
                F.sort_array(F.transform("__q_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
            ),
        }
    )
    s = F.col("__q_sorted")
    after = F.zip_with(s, F.slice(s, 2, 2_000_000_000), lambda a, b: F.struct(a["x"].alias("x"), a["i"].alias("i"), b["x"].alias("n")))
    none = F.array(F.struct(F.lit(None).cast("long").alias("x"), F.lit(None).cast("int").alias("i")))
    at = F.zip_with(after, F.concat(none, s), lambda a, p: F.when((a["x"] == a["n"]) | (a["x"] == p["x"]), a["i"]))
    out = out.withColumn("__q_at", F.sort_array(F.filter(at, lambda x: x.isNotNull())))
    at = F.col("__q_at")
    gaps = F.zip_with(at, F.concat(F.array(F.lit(-3)), at), lambda a, b: F.when(a.isNull(), 0).otherwise(F.least(F.lit(3), a - b)))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    out = out.withColumn("__q_repeat", F.coalesce(covered, F.lit(0)).cast("long"))
    n, c = F.col("__q_words"), F.col("__q_chars")
    out = out.withColumns(
        {
            "__q_base_failed": (n < MIN_WORDS) | (F.col("__q_repeat") * 100 > n * MAX_REPEAT_PERCENT),
            "__q_m": F.struct(
                _share(F.col("__q_other"), c).alias("other_pm"),
                _share(F.col("__q_upper"), c).alias("upper_pm"),
                _share(c, n, 10).alias("word_len10"),
                _share(F.col("__q_dup_lines"), F.col("__q_n_lines")).alias("dup_lines_pm"),
                _share(F.col("__q_repeat"), n).alias("repeat_pm"),
            ),
        }
    )
    return out.drop("__q_lines", "__q_hashes", "__q_windows", "__q_sorted", "__q_at")


def _bucket(v: Column) -> Column:
    """The log bucket of a whole number: 64 for each doubling, so the first 128 numbers have their own."""
    e = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return (e * 64 + F.floor(v / F.pow(F.lit(2.0), e))).cast("long")


def _floor_of(b: Column) -> Column:
    """The least number of a bucket."""
    e = F.greatest(F.floor(b / 64) - 1, F.lit(0))
    return F.when(b < 128, b).otherwise(F.floor((b - e * 64) * F.pow(F.lit(2.0), e))).cast("long")


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """The quantile sketches of each language and source: one row a measure and bucket, with its count."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), _bucket(F.col(f"__q_m.{m}")).alias("bucket")) for m in FENCES])
    # the condition stands inside the generator: a filter would be pushed below the measures and have them made twice
    cells = F.explode_outer(F.when(~F.col("__q_base_failed"), cells))
    rows = measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), cells.alias("c")).where("c is not null")
    return rows.groupBy("lang", "source", "c.measure", "c.bucket").agg(F.count(F.lit(1)).alias("n"))


def smoothed(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The sketch of each language and source with its parents' weight: lang, source, measure, bucket, w (a whole number)."""
    whole = lambda c: c.cast("decimal(38,0)")
    measure = sketch.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    total = sketch.groupBy("measure").agg(F.sum("n").alias("all_n")).withColumnRenamed("measure", "a_measure")
    top = measure.join(total, F.col("measure") == F.col("a_measure")).select(F.col("measure").alias("c_measure"), F.col("bucket").alias("c_bucket"), F.col("n").alias("c_n"), "all_n")

    def under(counts: DataFrame, by: list[str], parent: DataFrame, on: Column) -> DataFrame:
        """w = own count * the parent's weight in all + prior * the parent's weight, for every bucket of the parent."""
        own = counts.groupBy(*by, "measure").agg(F.sum("n").alias("own_n")).join(parent, on)
        b = {c: f"b_{c}" for c in [*by, "measure", "bucket", "n"]}
        same = F.col("measure") == F.col("b_measure")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
        joined = own.join(counts.withColumnsRenamed(b), same & (F.col("p_bucket") == F.col("b_bucket")), "left")
        w = whole(F.coalesce(F.col("b_n"), F.lit(0))) * F.col("p_all") + whole(F.lit(prior)) * F.col("p_w")
        return joined.select(*by, "measure", F.col("p_bucket").alias("bucket"), whole(w).alias("w"), whole((whole(F.col("own_n")) + prior) * F.col("p_all")).alias("w_all"))

    root = top.select(F.col("c_measure").alias("p_measure"), F.col("c_bucket").alias("p_bucket"), whole(F.col("c_n")).alias("p_w"), whole(F.col("all_n")).alias("p_all"))
    by_lang = under(sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")), ["lang"], root, F.col("measure") == F.col("p_measure"))
    mid = by_lang.select(F.col("lang").alias("p_lang"), F.col("measure").alias("p_measure"), F.col("bucket").alias("p_bucket"), F.col("w").alias("p_w"), F.col("w_all").alias("p_all"))
    return under(sketch, ["lang", "source"], mid, F.col("lang").eqNullSafe(F.col("p_lang")) & (F.col("measure") == F.col("p_measure"))).drop("w_all")


def thresholds(sketch: DataFrame, prior: int = PRIOR, fences: dict = FENCES) -> DataFrame:
    """One row a language and source, with lo and hi of each measure where it has such a fence."""
    key = W.partitionBy("lang", "source", "measure")
    s = smoothed(sketch, prior).withColumns({"upto": F.sum("w").over(key.orderBy("bucket")), "all": F.sum("w").over(key)})

    def at(q: int) -> Column:  # a lower percentile is its bucket's least number, an upper one its largest
        bucket = F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("bucket")))
        return _floor_of(bucket) if q < 50 else _floor_of(bucket + 1) - 1

    marks = sorted({q for lo, hi, reach in fences.values() for q in (lo, hi, 25 if reach else None, 75 if reach else None) if q})
    out = s.groupBy("lang", "source", "measure").agg(*[at(q).alias(f"q{q}") for q in marks])
    span = lambda reach: (F.col("q75") - F.col("q25")) * reach if reach else F.lit(0)
    of = lambda m, v: F.max(F.when(F.col("measure") == m, v))
    return out.groupBy("lang", "source").agg(
        *[of(m, F.col(f"q{hi}") + span(reach)).alias(f"hi_{m}") for m, (_, hi, reach) in fences.items() if hi],
        *[of(m, F.col(f"q{lo}") - span(reach)).alias(f"lo_{m}") for m, (lo, _, reach) in fences.items() if lo],
    )


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """measured with __q_kept, by the thresholds joined on language and source."""
    limits = limits.withColumnsRenamed({c: f"__t_{c}" for c in limits.columns})
    on = F.col(lang).eqNullSafe(F.col("__t_lang")) & F.col(source).eqNullSafe(F.col("__t_source"))
    passed = F.lit(True)
    for c in limits.columns[2:]:
        side, m = c[len("__t_") :].split("_", 1)
        passed = passed & ((F.col(f"__q_m.{m}") <= F.col(c)) if side == "hi" else (F.col(f"__q_m.{m}") >= F.col(c)))
    # a group without thresholds has no document that passes the base rule
    kept = F.when(F.col("__q_base_failed"), False).otherwise(F.coalesce(passed, F.lit(False)))  # one piece, which stays above the join
    return measured.join(limits, on, "left").withColumn("__q_kept", kept).drop(*limits.columns)


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row a document: its counts, whether the base rule failed, and the verdict."""
    own = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), col(lang).alias("lang"), col(source).alias("source"))
    measured = materialise(measures(own).drop("text"))
    judged = judge(measured, materialise(thresholds(sketches(measured))))
    return judged.select(
        "doc_id", F.col("__q_words").alias("n_words"), F.col("__q_chars").alias("word_chars"), F.col("__q_symbols").alias("n_symbols"),
        F.col("__q_dup_lines").alias("n_dup_lines"), F.col("__q_repeat").alias("n_repeat_words"), F.col("__q_base_failed").alias("base_failed"), F.col("__q_kept").alias("kept"),
    )


def filter_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that the rules keep, with their own columns. The measures are made once, and written beside the documents."""
    own, (text, lang, source) = renamed(docs, text, lang, source)
    measured = measures(own, text)
    measured = materialise(measured.select(*own.columns, "__q_base_failed", "__q_m"))
    return judge(measured, materialise(thresholds(sketches(measured, lang, source))), lang, source).where("__q_kept").select(*own.columns).toDF(*docs.columns)


def op7_quality_rules(spark, sf_dir):
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    share = lambda part, whole, by=1000: f"CASE WHEN {whole} > 0 THEN {part} * {by} // {whole} ELSE 0 END"
    m = {
        "other_pm": share("n_other", "word_chars"),
        "upper_pm": share("n_upper", "word_chars"),
        "word_len10": share("word_chars", "n_words", 10),
        "dup_lines_pm": share("n_dup_lines", "n_lines"),
        "repeat_pm": share("n_repeat_words", "n_words"),
    }
    cells = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, CAST({v} AS BIGINT) AS v FROM base WHERE NOT base_failed" for k, v in m.items())
    floor_of = "CASE WHEN {b} < 128 THEN {b} ELSE ({b} - ({b} // 64 - 1) * 64) * CAST(pow(2, {b} // 64 - 1) AS BIGINT) END"
    least = "(min(bucket) FILTER (WHERE upto * 100 >= total * {q}) + {k})"
    at = lambda q: floor_of.format(b=least.format(q=q, k=0)) if q < 50 else floor_of.format(b=least.format(q=q, k=1)) + " - 1"
    marks = ", ".join(f"{at(q)} AS q{q}" for q in (25, 75, TAIL))
    verdict = []
    for k, (lo, hi, reach) in FENCES.items():
        parts = [f"{m[k]} <= q{hi} + {reach} * (q75 - q25)"] * bool(hi) + [f"{m[k]} >= q{lo} - {reach} * (q75 - q25)"] * bool(lo)
        verdict.append(f"coalesce(bool_and({' AND '.join(parts)}) FILTER (WHERE l.measure = '{k}'), false)")
    return rf"""
    WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
    g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
    g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
    r AS (SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE n >= 2) GROUP BY rid),
    c AS (SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^\x21-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS BIGINT) AS n_other,
        CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (rid)),
    base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
    raw AS ({cells}),
    cells AS (SELECT lang, source, measure, greatest(length(bin(v)) - 7, 0) * 64 + v // CAST(pow(2, greatest(length(bin(v)) - 7, 0)) AS BIGINT) AS bucket FROM raw),
    fine AS (SELECT lang, source, measure, bucket, count(*)::HUGEINT AS n FROM cells GROUP BY ALL),
    mid AS (SELECT lang, measure, bucket, sum(n)::HUGEINT AS n FROM fine GROUP BY ALL),
    corpus AS (SELECT measure, bucket, sum(n)::HUGEINT AS w, (sum(sum(n)) OVER (PARTITION BY measure))::HUGEINT AS w_all FROM fine GROUP BY measure, bucket),
    mid_w AS (SELECT o.lang, o.measure, p.bucket, coalesce(mid.n, 0) * p.w_all + {PRIOR} * p.w AS w, (o.n + {PRIOR}) * p.w_all AS w_all
        FROM (SELECT lang, measure, sum(n)::HUGEINT AS n FROM mid GROUP BY ALL) o JOIN corpus p ON o.measure = p.measure
        LEFT JOIN mid ON mid.lang IS NOT DISTINCT FROM o.lang AND mid.measure = o.measure AND mid.bucket = p.bucket),
    fine_w AS (SELECT o.lang, o.source, o.measure, p.bucket, coalesce(fine.n, 0) * p.w_all + {PRIOR} * p.w AS w
        FROM (SELECT DISTINCT lang, source, measure FROM fine) o JOIN mid_w p ON o.lang IS NOT DISTINCT FROM p.lang AND o.measure = p.measure
        LEFT JOIN fine ON fine.lang IS NOT DISTINCT FROM o.lang AND fine.source IS NOT DISTINCT FROM o.source AND fine.measure = o.measure AND fine.bucket = p.bucket),
    l AS (SELECT lang, source, measure, {marks} FROM (SELECT *, (sum(w) OVER (PARTITION BY lang, source, measure ORDER BY bucket))::HUGEINT AS upto,
        (sum(w) OVER (PARTITION BY lang, source, measure))::HUGEINT AS total FROM fine_w) GROUP BY lang, source, measure)
    SELECT any_value(doc_id) AS doc_id, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols, any_value(n_dup_lines) AS n_dup_lines,
        any_value(n_repeat_words) AS n_repeat_words, any_value(base_failed) AS base_failed, NOT any_value(base_failed) AND {" AND ".join(verdict)} AS kept
    FROM base LEFT JOIN l ON base.lang IS NOT DISTINCT FROM l.lang AND base.source IS NOT DISTINCT FROM l.source GROUP BY rid"""


ORACLE_SQL = _sql()
