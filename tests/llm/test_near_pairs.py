"""How many pairs of texts near_dedup aligns, and how many texts it sends through a shuffle for that."""

import random

import numpy as np

from torrentia.llm import near_dedup


def test_many_near_copies_cost_few_pairs_and_other_texts_stay(spark, monkeypatch):
    """Each copy has edits of its own, so its groups have many pivots; one alignment each joins nearly all."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    copies = [" ".join(w if r.random() > 0.05 else f"x{r.random()}" for w in words) for _ in range(150)]
    alone = [" ".join(f"y{k}-{j}" for j in range(100)) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(copies + alone)), "doc_id long, text string")
    pairs, texts = [], []
    verified, read = near_dedup._verified, near_dedup._texts

    def count(p, *rest):
        pairs.append(p.count())
        return verified(p, *rest)

    def seen(*args):
        texts.append(args[0].where(near_dedup.maybe_repeated(args[0], "th", near_dedup.repeated_filter(args[1].select("h").union(args[1].select("h")), args[1].count()))).count())
        return read(*args)

    monkeypatch.setattr(near_dedup, "_verified", count)
    monkeypatch.setattr(near_dedup, "_texts", seen)
    found = {x.doc_id: x.class_size for x in near_dedup.classes(docs).collect()}
    assert all(found[k] == 150 for k in range(150)) and all(found[k] == 1 for k in range(150, 450))
    assert sum(pairs) <= 300
    assert max(texts) <= 200


def test_far_copies_of_one_text_are_not_tried_pair_by_pair(spark, monkeypatch):
    """Copies with a sixth of their words changed are no near copies of each other, though most of what they have is one text's; near ones among them are found."""
    monkeypatch.setattr(near_dedup, "HOT", 4)
    tried, whole = [], near_dedup._hot_pairs
    monkeypatch.setattr(near_dedup, "_hot_pairs", lambda *a: tried.append(near_dedup.materialise(whole(*a))) or tried[-1])
    r = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    texts = [[w if r.random() > 0.17 else f"x{r.randrange(2000)}" for w in words] for _ in range(200)]
    for i in range(0, 200, 20):
        texts[i + 1] = [w if r.random() > 0.05 else f"x{r.randrange(2000)}" for w in texts[i]]
    found = near_dedup.classes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {x.doc_id: x.class_id for x in found} == {i: i - (i % 20 == 1) for i in range(200)}
    assert len(tried) == 1 and tried[0].count() < 2000  # of 19,900


def test_similar_texts_share_a_rare_difference_from_any_centre():
    """Of the words in which two similar texts differ from a third, the rarest of either are among the other's rarest, unless both have few or go by pairs of words."""
    r = random.Random(12)
    as_words = lambda t: near_dedup.mix64(np.array(t, np.uint64))
    met, by_pairs = 0, 0
    for _ in range(1500):
        centre = [r.randrange(1, 40) for _ in range(r.randint(10, 90))]
        changed = lambda t, most: [x if r.random() > most else r.randrange(1, 60) for x in t if r.random() > most / 3]
        a = changed(centre, r.choice([0.1, 0.3, 0.6]))
        b = changed(a, r.choice([0.02, 0.06, 0.1]))
        wa, wb, wc = map(as_words, (a, b, centre))
        if not a or not b or not near_dedup.similarity(wa, wb):
            continue
        (sa, da, pa), (sb, db, pb) = (near_dedup._marks(-5, x, wc) for x in (wa, wb))
        n, m = len(a), len(b)
        assert len(np.setxor1d(near_dedup._labelled(wa), near_dedup._labelled(wb))) * 9 <= n + m
        if 2 * sa > n and 2 * sb > m or 9 * (sa + sb) <= n + m:
            by_pairs += 1
            assert len(pa) and len(pb) and 9 * abs(sa - sb) <= n + m
            continue
        met += 1
        assert len(da) == sa and len(db) == sb
        order = {x: (r.randrange(9), x) for x in [*da.tolist(), *db.tolist()]}
        first = [sorted(d.tolist(), key=order.get)[: k // 4 + 1] for d, k in ((da, n), (db, m))]
        at = [{x: i for i, x in enumerate(f) if 18 * i <= 9 * (s - t) + n + m} for f, s, t in zip(first, (sa, sb), (sb, sa), strict=True)]
        low, size = (at[0], n) if sa <= sb else (at[1], m)
        assert any(i <= size // 8 and x in at[0] and x in at[1] for x, i in low.items())
    assert met > 200 and by_pairs > 50
