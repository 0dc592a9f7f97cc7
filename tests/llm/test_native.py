"""Quality rules, source mix, exact dedup and licence scan: brute force, and odd inputs."""

import collections
import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from torrentia.llm import exact_dedup, licence_scan, quality_rules, source_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 3), (4, "word " * 60, "en", "a", 5), (5, "x y z", None, "b", 5), (6, "x y\nz", "de", "b", 5),
    (6, "x y\nz", "de", "b", 5), (None, "xyz", "de", "b", 3), (7, "w" * 20000, "en", "a", 1), (8, " ".join(f"w{i}" for i in range(30000)), "en", "c", 1), (9, "x  y z ", "en", "c", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"keep_id": F.lit("clash"), "size": F.lit(1), "kept": F.lit("clash"), "measure": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_counts(odd):
    want = []
    for i, t, *_ in ODD:
        w = words(t)
        seen = {}
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        rep = {p + d for v in seen.values() if len(v) > 1 for p in v for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((i, len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_report(odd).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r.doc_id for r in quality_rules.filter_quality(odd).collect()} == {8}
    assert quality_rules.filter_quality(odd).columns == odd.columns


def prose(rnd, n, mark, rate):
    """n invented words, a share of which ends with the mark."""
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) + (mark if rnd.random() < rate else "") for _ in range(n))


def test_quality_fences_follow_their_group(spark):
    rnd = random.Random(6)
    plain = [(i, prose(rnd, 80, ".", 0.1), "en", "s", 0) for i in range(400)]
    junk = [(1000 + i, prose(rnd, 80, "%%%", 1), "en", "s", 0) for i in range(20)]
    # where symbols are the rule, they are no outliers
    code = [(2000 + i, prose(rnd, 80, "<>", 1), "en", "code", 0) for i in range(400)]
    kept = {r.doc_id for r in quality_rules.quality_report(spark.createDataFrame(plain + junk + code, SCHEMA)).where("kept").collect()}
    assert not kept & {r[0] for r in junk} and len(kept) >= 0.97 * 800


def test_quality_thresholds_come_from_the_sketches(spark):
    """Groups that differ have different fences, one document is judged by its group, and the quartiles' distance decides."""
    rnd = random.Random(3)
    rows = [(i, prose(rnd, 120, ".", 0.1), "en", "news", 0) for i in range(400)] + [(1000 + i, prose(rnd, 120, ";", 0.9), "en", "code", 0) for i in range(400)]
    same = prose(rnd, 120, ";", 0.9)
    rows += [(5000, same, "en", "news", 0), (5001, same, "en", "code", 0)]
    measured = quality_rules.measures(spark.createDataFrame(rows, SCHEMA))
    sketch = quality_rules.sketches(measured)
    limits = {r.source: r for r in quality_rules.thresholds(sketch).collect()}
    for m in ("other_pm", "repeat_pm", "word_len10"):
        assert limits["news"][f"hi_{m}"] is not None
    assert limits["code"].hi_other_pm > 1.5 * limits["news"].hi_other_pm
    kept = {r.doc_id for r in quality_rules.judge(measured, quality_rules.thresholds(sketch)).where("__q_kept").collect()}
    assert 5001 in kept and 5000 not in kept and len(kept) > 760
    narrow = {m: (lo, hi, 0) for m, (lo, hi, _) in quality_rules.FENCES.items()}
    fewer = quality_rules.judge(measured, quality_rules.thresholds(sketch, fences=narrow)).where("__q_kept").count()
    assert fewer < 0.8 * len(kept)


def test_quality_smoothing_by_weight(spark):
    """A group of one document has its parent's fences; a large one hardly moves. Checked against sums in plain Python."""
    rnd = random.Random(4)
    rows = [(i, prose(rnd, 60 + i % 40, ".", rnd.random() / 3), "en" if i % 3 else "de", f"s{i % 2}", 0) for i in range(300)] + [(900, prose(rnd, 80, "!", 0.9), "fr", "tiny", 0)]
    sketch = quality_rules.sketches(quality_rules.measures(spark.createDataFrame(rows, SCHEMA)))
    cells = [tuple(r) for r in sketch.collect()]
    for prior in (1, 200, 10**6):
        got = {(r.lang, r.source): r for r in quality_rules.thresholds(sketch, prior).collect()}
        for lang, source in {(c[0], c[1]) for c in cells}:
            for m, (lo, hi, reach) in quality_rules.FENCES.items():
                of = [c for c in cells if c[2] == m]
                corpus, n_all = collections.Counter(), sum(c[4] for c in of)
                for c in of:
                    corpus[c[3]] += Fraction(c[4], n_all)
                dist = corpus
                for group in ([c for c in of if c[0] == lang], [c for c in of if c[:2] == (lang, source)]):
                    n, own = sum(c[4] for c in group), collections.Counter()
                    for c in group:
                        own[c[3]] += c[4]
                    dist = {b: (own[b] + prior * dist[b]) / (n + prior) for b in dist}

                def at(q):
                    total = Fraction(0)
                    for b in sorted(dist):
                        total += dist[b]
                        if total * 100 >= q:
                            b += q > 50
                            e = max(0, b // 64 - 1)
                            return (b if b < 128 else (b - e * 64) << e) - (q > 50)

                span = (at(75) - at(25)) * reach
                assert hi is None or got[lang, source][f"hi_{m}"] == at(hi) + span
                assert lo is None or got[lang, source][f"lo_{m}"] == at(lo) - span


def test_quality_clashing_names_ties_and_repeats(spark):
    rnd = random.Random(5)
    rows = [(i, prose(rnd, 80, ".", 0.2), None if i % 4 == 0 else "en", None if i % 5 == 0 else "s", 0) for i in range(60)]
    rows += rows[:5] + [(70, prose(rnd, 150_000, ".", 0.2), "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df
    for m in [*quality_rules.FENCES, "measure", "bucket", "n", "w", "hi_upper_pm", "c", "symbols_pm", "base_failed"]:
        clash = clash.withColumn(m, F.lit("clash"))
    key = lambda r: tuple(map(str, r))
    assert sorted(quality_rules.quality_report(clash).collect(), key=key) == sorted(quality_rules.quality_report(df).collect(), key=key)
    out = quality_rules.filter_quality(clash)
    assert out.columns == clash.columns and out.count() == quality_rules.quality_report(df).where("kept").count() > 50
    same = spark.createDataFrame([(i, rows[1][1], "en", "s", 0) for i in range(30)], SCHEMA)  # all at their fences
    assert quality_rules.filter_quality(same).count() == 30


def test_empty_tables(empty):
    assert quality_rules.quality_report(empty).count() == 0 and quality_rules.filter_quality(empty).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0
    assert source_mix.mix(empty).count() == 0 and source_mix.mixed_documents(empty).count() == 0
    assert licence_scan.scan(empty, licence_scan.templates(empty.sparkSession)).count() == 0


def test_exact_groups(odd):
    rows = exact_dedup.exact_groups(odd).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    by = {}
    for i, t, *_ in ODD:
        by.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append((-len(t or ""), i is None, i or 0))
    assert len(rows) == len(ODD)
    for r in rows:
        g = by[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == min(g)[2]
    assert sum(r.kept for r in rows) == len(by)
    out = exact_dedup.deduplicate(odd)
    assert out.columns == odd.columns and out.count() == len(by)
    assert {r.doc_id for r in out.collect()} == {r.keep_id for r in rows}


def test_filter_that_is_full_changes_nothing(odd, monkeypatch):
    whole = sorted(map(str, exact_dedup.exact_groups(odd).collect()))
    monkeypatch.setattr(exact_dedup, "repeated_filter", lambda h, n: __import__("numpy").full(8192, 255, "uint8"))
    assert sorted(map(str, exact_dedup.exact_groups(odd).collect())) == whole


def test_mix_reaches_targets(spark):
    rows = [(i, "w " * (20 + i % 37 * 3), "en", None if i % 11 == 0 else f"s{i % 3 if i % 5 else 0}", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = source_mix.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    per = {}
    for r in got:
        s = per.setdefault((r.source_size, r.target), [0, 0])
        s[0] += r.size
        s[1] += r.taken
    total = sum(r.size for r in got)
    assert abs(sum(k[1] for k in per) - total) < 1
    for (size, target), (own, taken) in per.items():
        assert own == size and target <= 3 * size and abs(taken - target) <= 2 * source_mix.BLOCK
    again = source_mix.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    copies = source_mix.mixed_documents(df).groupBy("doc_id").count().collect()
    want = {r.doc_id: int(r.taken / r.size + 0.5) for r in got if r.taken / r.size >= 0.5}
    assert {r.doc_id: r[1] for r in copies} == want


def test_mix_of_odd_rows(odd):
    got = source_mix.mix(odd).collect()
    assert len(got) == len(ODD) and {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}


def test_schedule_is_spread_evenly(spark):
    targets = spark.createDataFrame([("a", 6, 600, 1000, 0, 600), ("b", 4, 399, 1000, 600, 999), (None, 1, 1, 1000, 999, 1000)], "source string, blocks long, quota long, slots long, lo long, hi long")
    slots = sorted((r.slot, r.source or "", r.block) for r in source_mix.schedule(targets, 1000).collect())
    assert collections.Counter(s for _, s, _ in slots) == {"a": 600, "b": 399, "": 1}  # exactly the quotas
    for k in range(0, 900, 100):
        assert 55 <= sum(s == "a" for _, s, _ in slots[k : k + 100]) <= 65
    back = lambda i, bits: int(format(i, f"0{bits}b")[::-1], 2)
    want = [x for x in (back(i, 10) for i in range(1024)) if x < 1000]
    assert [s for _, s, _ in slots] == ["a" if x < 600 else "b" if x < 999 else "" for x in want]


def test_mix_of_tiny_sources_beside_a_large_one_and_of_hot_rows(spark):
    rows = [(i, "w " * 60, "en", "big", 0) for i in range(2000)] + [(5000 + k, "w " * (30 + k), "en", f"tiny{k:02}", 0) for k in range(12)]
    rows += [(None, "w " * (10 + i % 3), "en", "hot", 0) for i in range(900)] + [(7, "w w w", "en", "hot", 0)] * 600
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("clash"), "key": F.lit(1), "place": F.lit(2)})
    got = source_mix.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    for r in got:
        if r.doc_id and r.doc_id >= 5000:
            assert abs(r.taken - r.target) <= 0.5 * r.size + 1
    again = source_mix.mix(df.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def dice(a, b):
    bi = lambda t: {tuple(x) for w in [re.findall(r"[^\W_]+", t.lower())] for x in zip(w, w[1:])}
    x, y = bi(a), bi(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def test_licences(spark):
    mit = next(b for n, b in licence_scan.TEMPLATES if n == "MIT" and len(b) > 200)
    texts = ["Some prose.\nReleased under the MIT License.\nMore.", mit.replace(", ", ",\n").replace("charge", "fee"), "licensed under nothing at all", None, "", "Released under the MIT License (see below) and others too"]
    got = {(r.doc_id, r.licence): r.score for r in licence_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licence_scan.templates(spark)).collect()}
    want = {}
    for i, t in enumerate(texts):
        for seg in [*(t or "").split("\n"), *[p for p in re.split(r"\n\s*\n", t or "") if "\n" in p]]:
            for n, b in licence_scan.TEMPLATES:
                if (d := dice(seg, b)) >= 0.8:
                    want[i, n] = max(want.get((i, n), 0), round(d, 6))
    assert got == want and (0, "MIT") in got and (1, "MIT") in got
