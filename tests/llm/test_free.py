"""Chat formatting, near and substring dedup, language ID, BPE and HTML extraction: brute force, round trips, odd inputs."""

import collections
import itertools
import math
import random
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from torrentia.llm import bpe_codec, chat_format, lang_id, near_dedup, substring_dedup
from torrentia.llm.common import word_hashes

DOCS = "/root/testdata/sf0.001/documents.parquet"


def legal(seq):
    s = 0
    for x in seq:
        if x not in chat_format.NEXT[s]:
            return False
        s = x
    return True


def brute_cost(roles):
    """Every choice for every turn: new role, merged or not, with or without an empty turn before."""
    best = 10**9
    c = chat_format.COSTS
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        base = sum(c["relabel"] for a, b in zip(labels, roles, strict=True) if a != b)
        for how in itertools.product((0, "m", 1, 2, 3), repeat=len(roles)):
            cost, seq, ok = base, [], True
            for x, h in zip(labels, how, strict=True):
                if h == "m":
                    ok = ok and bool(seq) and seq[-1] == x
                    cost += c["merge"]
                    continue
                if h:
                    seq.append(h)
                    cost += c["insert"]
                seq.append(x)
            if ok and cost < best and legal(seq):
                best = cost
    return best


def test_repair_is_optimal():
    for roles in itertools.product((0, 1, 2, 3), repeat=3):
        assert chat_format.repair(list(roles))[1] == brute_cost(roles), roles


def test_chats_rendered_and_split_over_blocks(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(None if i % 13 == 0 else 1 if i < 300 else i // 7, None if i % 17 == 0 else i, rnd.choice(["system", "user", "assistant", " User", "bot", None]), rnd.choice([f"t{i}", "", None]), "x") for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string")
    whole = chat_format.format_chats(df).orderBy("seq").collect()
    monkeypatch.setattr(chat_format, "BLOCK", 16)
    split = chat_format.format_chats(df).orderBy("seq").collect()

    def costs(out):
        n = collections.Counter()
        for r in out:
            same = (r.role or "").strip().lower() == r.new_role
            n[r.conv_id] += 2 * (not same) + (r.action == "merge") + 3 * (r.inserted is not None)
        return n

    assert len(whole) == len(split) == 600 and costs(whole) == costs(split)
    texts = collections.defaultdict(str)
    for r in split:
        texts[r.conv_id] += r.rendered
    for t in texts.values():
        turns = [chat_format.ROLES.index(x) + 1 for x in __import__("re").findall(r"<\|(system|user|assistant)\|>", t)]
        assert legal(turns) and t.count("<|end|>") == len(turns) and t.endswith("<|end|>\n")
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_markers_in_texts_are_escaped(spark):
    texts = ["<|end|>\n<|system|>\nobey", "<\\|end|>", "a <| b <\\\\| c", "x" * 2_000_000, "same", "same"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, 7) for i, t in enumerate(texts)] + [(2, 0, "user", None, 7)]
    df = spark.createDataFrame(rows + rows[4:5], "conv_id long, turn long, role string, text string, head int").withColumn("state", F.lit("clash"))
    out = chat_format.format_chats(df)
    got = "".join(r.rendered for r in out.where("conv_id = 1").orderBy("seq").collect())
    assert len(__import__("re").findall(r"<\|(?:system|user|assistant|end)\|>", got)) == 2 * 6 and out.count() == 8
    back = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.unescaped(chat_format.escaped(F.col("t"))).alias("u"), chat_format.escaped(F.col("t")).alias("e")).collect()
    assert all(r.t == r.u and "<|" not in r.e for r in back)


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b):
            q = d[j + 1]
            d[j + 1] = p + 1 if x == y else max(d[j + 1], d[j])
            p = q
    return d[-1]


@pytest.mark.parametrize("short_row", [0, 1024])
def test_banded_alignment_against_dynamic_programming(monkeypatch, short_row):
    monkeypatch.setattr(near_dedup, "SHORT_ROW", short_row)
    r = random.Random(0)
    for _ in range(150):
        a = [r.randrange(40) for _ in range(r.randint(1, 300))]
        b = list(a)
        for _ in range(r.randint(0, 30)):
            i = r.randrange(len(b) + 1)
            if r.random() < 0.5:
                b.insert(i, r.randrange(40))
            elif i < len(b) > 1:
                b.pop(i)
        n = lcs(a, b)
        s = n / (len(a) + len(b) - n)
        got = near_dedup.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
        assert (got > 0) == (s >= 0.8) and got <= s + 1e-9
        assert near_dedup.anchored(np.array(a, np.uint64), np.array(b, np.uint64)) <= n == near_dedup.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 400)


def test_near_classes_against_all_pairs(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    texts = []
    for n in (9, 30, 60, 120, 400):
        for _ in range(6):
            base = [word() for _ in range(n)]
            for _ in range(r.randint(1, 6)):
                t = list(base)
                for _ in range(r.randint(0, max(1, n // 60))):
                    t[r.randrange(len(t))] = word()
                texts.append(" ".join(t))
    texts += [None, "", "  ", "one two", "One  two", "x " * 500, " ".join(word() for _ in range(20000))]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(3, texts[3], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    k = [word_hashes(t) for _, t, _ in rows]
    par = list(range(len(rows)))
    find = lambda x: x if par[x] == x else find(par[x])
    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.similarity(k[i], k[j]) > 0:
                par[find(i)] = find(j)
    want = collections.defaultdict(list)
    for i, row in enumerate(rows):
        want[find(i)].append(row[0])
    got = collections.defaultdict(list)
    found = near_dedup.classes(df).collect()
    for x in found:
        got[x.class_id].append(x.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert sum(x.kept for x in found) == len(got) and all(x.class_size == len(got[x.class_id]) for x in found)
    out = near_dedup.deduplicate(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(got)
    assert near_dedup.classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2, 10_000])
def test_small_families_under_a_shared_header(spark, monkeypatch, hot):
    """Pairs whose shared groups are all large: in such a group every pair across components counts, not only those of pivots; by rare pairs of words too."""
    monkeypatch.setattr(near_dedup, "HOT", hot)
    monkeypatch.setattr(near_dedup, "CELL", 16)
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    header = " ".join(word() for _ in range(29))
    texts = []
    for _ in range(60):
        body = [word() for _ in range(6)]
        texts += [" ".join([header, *body]), " ".join([header, *body[:4], *[word() for _ in range(2)]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    k = [word_hashes(t) for t in texts]
    assert all((near_dedup.similarity(k[i], k[j]) > 0) == (i // 2 == j // 2) for j in range(120) for i in range(j))
    got = {x.doc_id: (x.class_id, x.class_size) for x in near_dedup.classes(df).collect()}
    assert got == {i: (i // 2 * 2, 2) for i in range(120)}


def test_pairs_of_a_hot_group_grow_with_its_texts(spark, monkeypatch):
    """Texts of one long header and words of their own: few pairs are tried, and the near copies among them are found."""
    tried, whole = [], near_dedup._hot_pairs
    monkeypatch.setattr(near_dedup, "_hot_pairs", lambda *a: tried.append(near_dedup.materialise(whole(*a))) or tried[-1])
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    header, texts = [word() for _ in range(150)], []
    for i in range(400):
        texts.append([*header, *[word() for _ in range(80)]])
        if i % 40 == 39:
            texts[-1] = [*texts[-2][:-10], *texts[-1][-10:]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = near_dedup.classes(df).collect()
    assert {x.doc_id: x.class_id for x in found} == {i: i - (i % 40 == 39) for i in range(400)}
    assert len(tried) == 1 and 10 <= tried[0].count() < 2000  # of 79,800


def test_rare_pairs_lose_no_similar_pair():
    """However pairs of words are ranked, the shorter of two similar texts has one of its first in the longer one's."""
    r = random.Random(9)
    met = 0
    for _ in range(600):
        a = [r.randrange(1, 25) for _ in range(r.randint(2, 90))]
        b = list(a)
        for _ in range(r.randint(0, len(a) // 4)):
            i = r.randrange(len(b) + 1)
            if r.random() < 0.6 and len(b) < len(a) * 1.25:
                b.insert(i, r.randrange(1, 25))
            elif i < len(b) > 2:
                b.pop(i)
        a, b = sorted((a, b), key=len)
        n = lcs(a, b)
        if n >= 0.8 * (len(a) + len(b) - n):
            counts = np.array([r.randrange(9) for _ in range(64)])
            (x, early), (y, _) = (near_dedup.rare_pairs(near_dedup.mix64(np.array(t, np.uint64)), counts) for t in (a, b))
            met += 1
            assert np.isin(x[:early], y).any()
    assert met > 200


def test_labels_of_first_occurrences_agree():
    once, twice = np.array([5, 6, 7], np.uint64), np.array([5, 6, 5, 7], np.uint64)
    assert near_dedup._labelled(once).tolist() == near_dedup._labelled(twice)[[0, 1, 3]].tolist()


def test_parities_rule_out_no_similar_pair():
    r = random.Random(6)
    for _ in range(400):
        a = [r.randrange(30) for _ in range(r.randint(2, 120))]
        b = list(a)
        for _ in range(r.randint(0, len(a) // 8)):
            i = r.randrange(len(b) + 1)
            if r.random() < 0.5:
                b.insert(i, r.randrange(30))
            elif i < len(b) > 1:
                b.pop(i)
        n = lcs(a, b)
        x, y = (near_dedup.mix64(np.array(t, np.uint64)) for t in (a, b))
        bits = np.bitwise_count(near_dedup.parities(x).view(np.uint64) ^ near_dedup.parities(y).view(np.uint64))
        odd = len(a) + len(b) - 2 * n
        assert bits[:8].sum() <= odd and bits[8:].sum() <= 3 * odd


def test_near_recall_by_words(spark):
    """Pairs of the given documents whose words align to 0.8 or more, by all pairs, against the classes."""
    rows = spark.read.parquet(DOCS.replace("sf0.001", "sf0.01")).collect()
    cls = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows)).collect()}
    w = [word_hashes(r.text) for r in rows]
    bits = np.array([near_dedup.parities(x) for x in w]).view(np.uint64)
    size = np.array([len(x) for x in w])
    n = found = 0
    for i in range(len(rows)):
        near = np.flatnonzero((np.minimum(size, size[i]) >= 0.8 * np.maximum(size, size[i])) & (np.bitwise_count(bits ^ bits[i])[:, :8].sum(1) <= (size + size[i]) / 9 + 1e-9))
        for j in near[near < i]:
            if near_dedup.similarity(w[i], w[j]) > 0:
                n += 1
                found += cls[rows[i].doc_id] == cls[rows[j].doc_id]
    assert n > 150 and found >= 0.95 * n


def test_near_odd_rows(spark):
    long = " ".join(f"w{i * 7919 % 99991}" for i in range(150_000))
    rows = [(None, "a b c d e f g h", 1), (None, "a b c d e f g h", 1), (5, "a b c d e f g h", 2), (7, long, 3), (8, long.replace("w5 ", "changed "), 3), (9, None, 4), (9, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest long").withColumns({"n": F.lit("clash"), "keys": F.lit(1), "label": F.lit(2)})
    found = near_dedup.classes(df).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.class_size, r.kept) for r in found if r.doc_id in (None, 5))[-1][2] == 3
    assert {r.class_id for r in found if r.doc_id in (7, 8)} == {7} and sum(r.kept for r in found) == 3
    out = near_dedup.deduplicate(df)
    assert out.columns == df.columns and out.count() == 3


def test_repeated_passages(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(80) for _ in range(10)]
    rows = [(i, f"{prose(50)}\n{shared[i % 10]}é\n{prose(40)}", "x") for i in range(40)] + [(100 + i, prose(150), "x") for i in range(40)] + [(200, None, "x"), (201, "", "x"), (202, "short", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = substring_dedup.repeats(df).collect()
    assert {x.doc_id for x in got} == set(range(40)) and all(x.first_doc_id == x.doc_id % 10 for x in got)
    clean = {x.doc_id: x.text for x in substring_dedup.deduplicate(df).collect()}
    for i, t, _ in rows:
        if i < 10 or i >= 100:
            assert clean[i] == t
        else:
            assert len(clean[i]) < len(t) - 150 and clean[i][:100] == t[:100]
    assert substring_dedup.repeats(df.limit(0)).count() == 0


def test_cuts_resist_shifts_and_cover():
    r = random.Random(1)
    raw = bytes(r.randrange(97, 123) for _ in range(20000))
    a, b = (substring_dedup.cuts(np.frombuffer(x, np.uint8)) for x in (raw, b"inserted" + raw))
    assert a[-1] == 20000 and len(set(x + 8 for x in a) & set(b)) > 0.95 * len(a)
    assert substring_dedup.cuts(np.zeros(5000, np.uint8))[-1] == 5000
    text = "日本語" * 3000
    for c in substring_dedup.cuts(np.frombuffer(text.encode(), np.uint8)):
        text.encode()[:c].decode()


def grams_by_hand(text):
    """Bucket counts of 1-, 2- and 3-grams, one character after the other in plain integers."""
    out, mask = collections.Counter(), (1 << 32) - 1
    plain = "".join(c.lower() if unicodedata.category(c).startswith("L") else " " for c in text or "")
    plain = " ".join(plain.split())
    c = [ord(x) for x in f" {plain} "] if plain else []
    for i in range(len(c)):
        one = c[i] * 0x9E3779B1 & mask
        out[one >> 17] += 1
        if i + 1 < len(c):
            two = (one ^ (c[i + 1] * 0x85EBCA77 & mask)) * 0xC2B2AE3D & mask
            out[two >> 17] += 1
        if i + 2 < len(c):
            out[((two ^ (c[i + 2] * 0x27D4EB2F & mask)) * 0x165667B1 & mask) >> 17] += 1
    return out


@pytest.mark.parametrize("group", [1, 64])
def test_language_against_brute_force(spark, monkeypatch, group):
    """Counts, posteriors and predictions in plain Python; with the languages in one part and in many."""
    monkeypatch.setattr(lang_id, "GROUP", group)
    docs = spark.read.parquet(DOCS)
    rows = docs.select("doc_id", "lang", "text").collect()
    counts, priors = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and (g := grams_by_hand(r.text)):
            counts[r.lang].update(g)
            priors[r.lang] += 1
    total = {n: sum(c.values()) + lang_id.SMOOTHING * lang_id.BUCKETS for n, c in counts.items()}
    model = lang_id.train(docs.where(~lang_id.held_out(F.col("doc_id"))))
    assert [n for names, _ in model for n in names] == sorted(counts) and all(len(names) <= group for names, _ in model)
    got = {r.doc_id: r for r in lang_id.predict(docs.withColumn("score", F.lit("clash")).unionByName(docs.limit(3).withColumn("score", F.lit("x"))), model).collect()}
    right = seen = 0
    for r in rows:
        g = grams_by_hand(r.text)
        if not g:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        s = {n: math.log(priors[n] / sum(priors.values())) + sum(k * math.log((counts[n][b] + lang_id.SMOOTHING) / total[n]) for b, k in g.items()) for n in counts}
        best = max(sorted(s), key=s.get)
        assert got[r.doc_id].lang_pred == best
        assert abs(got[r.doc_id].score - 1 / sum(math.exp(v - s[best]) for v in s.values())) < 1e-3
        if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.lang is not None:
            seen, right = seen + 1, right + (best == r.lang)
    assert seen > 30 and right >= 0.97 * seen


def test_language_of_odd_texts(spark):
    docs = spark.read.parquet(DOCS)
    model = lang_id.train(docs)
    names = model[0][0]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %%"), (4, "the and of"), (5, "é" * 3_000_000), (5, "the")], "doc_id long, text string")
    got = {(r.doc_id, (r.text or "")[:3]): (r.lang_pred, r.score) for r in lang_id.predict(odd, model).collect()}
    assert got[1, ""] == got[2, ""] == got[3, "12 "] == ("und", 0.0) and all(got[k][0] in names and 0 <= got[k][1] <= 1 for k in ((4, "the"), (5, "ééé"), (5, "the")))
    nothing = lang_id.train(docs.limit(0))
    assert {r.lang_pred for r in lang_id.predict(odd, nothing).collect()} == {"und"} and lang_id.predict(odd.limit(0), model).count() == 0
    twins = spark.createDataFrame([("b", "same words"), ("a", "same words")], "lang string, text string")  # a tie: the first by name
    assert {(r.lang_pred, r.score) for r in lang_id.predict(odd.where("doc_id = 4"), lang_id.train(twins)).collect()} == {("a", 0.5)}


def test_grams_of_long_texts_in_pieces(monkeypatch):
    text = "déjà vu the quick brown fox " * 400
    whole = lang_id.buckets(text)
    monkeypatch.setattr(lang_id, "PIECE", 97)
    assert all((a == b).all() for a, b in zip(whole, lang_id.buckets(text), strict=True))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_codec.default_vocabulary())


def test_bpe_as_the_library(spark, tokenizer):
    r = random.Random(1)
    texts = [x.text for x in spark.read.parquet(DOCS).select("text").collect()]
    texts += ["", "   ", "Ω ΣΑΣ ΟΔΥΣΣΕΥΣ", "İstanbul", "foo<|endoftext|>bar <|startoftext|><|endoftext|>", "a\x1cb \x1f\x85 x\xa0y", "it's we'll I'VE ''s", "aaaa" * 400, "日本語 🎉🎉 naïve", "!!!??..--==" * 30, "\0 \0a", "ſK ǅ ß ẞ"]
    texts += ["".join(r.choice("aabbeerstnniohél ł'’.,!1Σσ́日\n") for _ in range(r.randint(1, 60))) for _ in range(800)]
    texts += ["".join(r.choice("abcdetnisr") for _ in range(r.randint(10, 80))) for _ in range(800)]
    c = bpe_codec.codec(bpe_codec.default_vocabulary())
    for t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert c.encode(t).tolist() == ids, t
        assert c.decode_bytes(np.array(ids, np.int64)).decode() == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_on_characters_that_unicode_has_not_assigned(tokenizer):
    c = bpe_codec.codec(bpe_codec.default_vocabulary())
    free = [chr(x) for x in range(0x40000) if unicodedata.category(chr(x)) == "Cn"]
    texts = ["".join(f"a{x}b1{x} " for x in free[i : i + 997]) for i in range(0, len(free), 997)]
    for t, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert c.encode(t).tolist() == want.ids


def test_bpe_of_very_long_words(tokenizer, monkeypatch):
    """Words longer than the window of matches, with little memory; the same ids whatever the window."""
    c = bpe_codec.codec(bpe_codec.default_vocabulary())
    r = random.Random(3)
    word = "".join(r.choice(["ther", "ing", "a", "tion", "qz", "s", "un"]) for _ in range(12_000))
    want = tokenizer.encode(word, add_special_tokens=False).ids
    for window in (64, 1 << 14):
        monkeypatch.setattr(bpe_codec, "WINDOW", window)
        c.words.clear()
        assert np.frombuffer(c._word(word), "<u4").tolist() == want
    tracemalloc.start()
    ids = np.frombuffer(c._word("abcdefgh" * 40_000), "<u4")
    text = c.decode_bytes(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 320_000 and peak < 25e6


def test_bpe_columns(spark, tokenizer):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello, World", "x"), (3, "Hello, World", "x")], "doc_id long, text string, n_tokens string")
    p = bpe_codec.default_vocabulary()
    got = {r.doc_id: r for r in bpe_codec.decode(bpe_codec.encode(df, p), p).collect()}
    ids = tokenizer.encode("Hello, World", add_special_tokens=False).ids
    assert got[1].ids == [] == got[2].ids and got[3].ids == ids and got[3].decoded == tokenizer.decode(ids, skip_special_tokens=False) and got[1].decoded == ""
    assert sorted(r.n_tokens for r in bpe_codec.digests(df, p).collect()) == sorted([0, 0, len(ids), len(ids)])
    assert bpe_codec.digests(df.limit(0), p).count() == 0


def test_bpe_on_combining_marks(tokenizer):
    """Every combining mark beside ones of four classes and beside marks of later versions, in both orders; random texts of marks and letters."""
    codec = bpe_codec.codec(bpe_codec.default_vocabulary())
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    beside = ["̴", "̣", "̀", "ͅ", "࣒", "\U00011839", "᜕", "᷶"]
    texts = [f"q{x}{y}" for m in marks for b in beside for x, y in ((m, b), (b, m))]
    rnd = random.Random(3)
    texts += ["".join(rnd.choice(marks) if rnd.random() < 0.7 else rnd.choice("aeé가\U00011935\U00011930") for _ in range(8)) for _ in range(5000)]
    for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert codec.encode(t).tolist() == e.ids, ascii(t)
