"""MinHash near-dedup with Order MinHash and banded alignment.

Words are lower-cased; k-mers are runs of five words (of two in short texts), labelled with their occurrence number. Each of
the sketches takes the `pick` labelled k-mers with the least hashes and keeps them in text order; two
texts are candidates when they share a sketch, so the order of what they share counts, as in edit
similarity. Candidates are verified by a banded alignment of their words: the texts are linked
when aligned / (n + m - aligned) >= 0.8, which needs no cell outside a band around the diagonal.

An edited word breaks as many k-mers as it is in, so sketches are many and short. Texts of 48 words and more get 40 sketches of 3
five-word k-mers, those of up to 60 get 16 sketches of 3 two-word ones. Sizes of linked texts differ by at most 60 : 48, so one regime has
both. Where edits are scattered singly, a pair at exactly 0.8 is found with a probability of about 0.9, at 0.85 of 0.99 and at 0.9 of
0.9999; where they stand together, of nearly 1.

Texts equal in words are one class first. Each text is aligned with the most central one (whose groups are largest in sum, so a large
group's original rather than a copy) of all groups of texts that share a sketch with it, so n copies cost n alignments. In groups whose texts are of several components then, all are aligned with
those of two pivots, the most central text and the first by a hash, that are of other components. Then all pairs of a group's texts that are still in different components are
aligned, whatever the group's size, but for those that can't reach 0.8. In a group of more than HOT texts these are
found by marks. A mark of a text near its group's most central one (the centre) is a word that one of the two has and the other hasn't. Such differences of two texts differ
from each other just as the texts do, in (n + m) / 9 words at most at 0.8, so one of the rarest is in both (`_hot_pairs`), and copies of one text with changes of their own don't meet by what they kept. Texts far from
the centre, such as those that share a header, meet by their rarest pairs of neighbouring words: texts at 0.8 have one of the rarest third (shorter text) and two fifths (longer text) in common, since fewer are broken
(`rare_pairs`). What a whole group shares is frequent and comes last, so such a group isn't compared pair by pair, and no similar pair is lost. Which order marks have doesn't matter to
that, as all texts have the same; it follows a table of counts of fixed size. Where the rarest reach into what many share, pairs of those are tried by size.
Others are ruled out by size, or as their words differ in too many
places. Of PARITY bits each is the parity of a text's words that hash to it; a word that doesn't align changes one
bit, so at 0.8 at most (n + m) / 9 bits differ; and as it breaks three pairs of neighbouring words at most (two of its own text's and
one of the other's), at most (n + m) / 3 of as many bits for pairs. Pairs with pivots are ruled out alike. So no candidate pair across components is left unchecked.
Classes are connected components.

Null text counts as empty; texts without words are equal to each other. Repeated rows are in one class.
Of a class the row with the least doc_id stays (null first), of rows that share it one. Very long texts are sketched and aligned whole.
An empty table gives an empty result; extra columns play no part in `classes`, and `deduplicate`
returns the input's columns as they are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torrentia.llm.common import col, discard, materialise, mix64, renamed, shingle_hashes, word_hashes
from torrentia.llm.exact_dedup import maybe_repeated, repeated_filter
from torrentia.operators.graph import components

SIMILARITY = 0.8
SHORT = (2, 16, 3)  # words of a k-mer, sketches, k-mers in each
LONG = (5, 40, 3)
SHORT_MOST, LONG_LEAST = 60, 48  # words
PARITY = 512  # bits
HOT = 128  # texts of a group whose pairs are all tried
CELL = 512
SLOTS, SLOT_BLOCK = 1 << 20, 1 << 14  # counts of marks: 4 MB
HELD = 1 << 18  # rare marks in one piece of a task's output
SHORT_ROW = 1024  # words that are aligned in one window


def _labelled(kmers: np.ndarray) -> np.ndarray:
    """The k-mers, each mixed with the number of equal ones before it; the first of equal ones as it is."""
    order = np.argsort(kmers, kind="stable")
    same = np.concatenate([[False], kmers[order][1:] == kmers[order][:-1]])
    if not same.any():
        return kmers
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(kmers))))
    out = kmers.copy()
    nth = (np.arange(len(kmers)) - first).astype(np.uint64)
    with np.errstate(over="ignore"):
        out[order] = np.where(same, mix64(kmers[order] + nth * np.uint64(0x9E3779B97F4A7C15)), kmers[order])
    return out


def _sketches(labelled: np.ndarray, count: int, pick: int, tag: int) -> np.ndarray:
    """One key for each sketch."""
    n = len(labelled)
    pick = min(pick, n)
    factors = mix64(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(tag << 32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        rows = np.empty((count, pick), np.int64)
        if n <= 4096:
            rows[:] = np.argpartition(labelled[None, :] * factors[:, None], pick - 1, axis=1)[:, :pick]
        else:
            bound = np.uint64((1 << 64) // n * 4 * pick)  # about four times as many as are picked
            for t in range(count):
                hashed = labelled * factors[t]
                near = np.flatnonzero(hashed < bound)
                near = near if len(near) >= pick else np.arange(n)
                rows[t] = near[np.argpartition(hashed[near], pick - 1)[:pick]]
        rows.sort(axis=1)
        key = factors + np.uint64(pick)
        for k in range(pick):
            key = mix64(key * np.uint64(0x100000001B3) + labelled[rows[:, k]])
    return key


def sketch_keys(words: np.ndarray) -> np.ndarray:
    """The candidate keys of a text's words, in the regimes that its size belongs to."""
    n, keys = len(words), [np.empty(0, np.uint64)]
    for tag, (width, count, pick), fits in ((1, SHORT, 0 < n <= SHORT_MOST), (2, LONG, n >= LONG_LEAST)):
        if fits:
            keys.append(_sketches(_labelled(shingle_hashes(words, width)), count, pick, tag))
    return np.concatenate(keys)


def parities(words: np.ndarray) -> np.ndarray:
    """PARITY bits, each the parity of the number of words that hash to it, and as many of the pairs of neighbouring words.

    Two texts differ in at least as many words, or pairs, as bits.
    """
    odd = [np.bincount((x % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1 for x in (words, shingle_hashes(words, 2))]
    return np.packbits(np.concatenate(odd).astype(np.uint8)).view(np.int64)


def _may_link(n: tuple[Column, Column], parity: tuple[list[Column], list[Column]]) -> Column:
    """Whether sizes and parities leave it open that two texts are similar."""
    half, total = PARITY // 64, n[0] + n[1]
    most = (1 - SIMILARITY) / (1 + SIMILARITY) * total + 1e-9  # words that don't align
    differ = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(*parity, strict=True)]
    words, pairs = (sum(d[1:], d[0]) for d in (differ[:half], differ[half:]))
    return (F.least(*n) >= SIMILARITY * F.greatest(*n)) & (words <= most) & (pairs <= 3 * most)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest common subsequence of a and b whose matches lie near the diagonal: at least all within `band` of it count.

    Bit-parallel over a window of a that moves with b, a block at a time: a bit of `row` is 0 where the length grows.
    A block's tokens have one mask each of their places in the window.
    """
    n, m, block = len(a), len(b), 256
    if n <= SHORT_ROW:  # one window
        masks: dict[int, int] = {}
        for i, x in enumerate(a.tolist()):
            masks[x] = masks.get(x, 0) | 1 << i
        row = full = (1 << n) - 1
        for x in b.tolist():
            if x in masks:
                hit = row & masks[x]
                row = ((row + hit) | (row - hit)) & full
        return n - row.bit_count()
    at: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        at.setdefault(x, []).append(i)
    low, high, row, done = 0, 0, 0, 0
    for start in range(0, m, block):
        new_low, new_high = min(n, max(low, start - band)), min(n, start + block + band)
        if new_low > low:
            gone = new_low - low
            done += gone - (row & ((1 << gone) - 1)).bit_count()
            row >>= gone
            low = new_low
        if new_high > high:
            row |= ((1 << (new_high - max(high, low))) - 1) << (max(high, low) - low)
            high = new_high
        full = (1 << (high - low)) - 1
        masks = {}
        for x in b[start : start + block].tolist():
            mask = masks.get(x)
            if mask is None:
                places, mask = at.get(x, ()), 0
                if len(places) > 64:  # a frequent word: its places in the window at once
                    inside = np.array(places[bisect_left(places, low) : bisect_left(places, high)], np.int64) - low
                    on = np.zeros(high - low, np.uint8)
                    on[inside] = 1
                    mask = int.from_bytes(np.packbits(on, bitorder="little").tobytes(), "little")
                else:
                    for i in places:
                        if low <= i < high:
                            mask |= 1 << (i - low)
                masks[x] = mask
            if mask:
                hit = row & mask
                row = ((row + hit) | (row & ~mask)) & full
    return done + (high - low) - row.bit_count()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many words the two have in common, in whatever order: of the sorted words of both, those next to an equal one of the other."""
    word = np.concatenate([x, y])
    order = np.argsort(word, kind="stable")  # x's before y's
    word = word[order]
    edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]]))
    of_x = np.concatenate([[0], np.cumsum(order < len(x))])[edge]
    from_x, every = np.diff(of_x), np.diff(edge)
    return int(np.minimum(from_x, every - from_x).sum())


def anchored(x: np.ndarray, y: np.ndarray, width: int = 4) -> int:
    """A number of words that surely align: those of runs of `width` words that each of the two has once, the longest chain in the order of both."""
    if min(len(x), len(y)) < width:
        return 0
    once = []
    for t in (x, y):
        kind, at, n = np.unique(shingle_hashes(t, width), return_index=True, return_counts=True)
        once.append((kind[n == 1], at[n == 1]))
    (kx, ax), (ky, ay) = once
    _, ix, iy = np.intersect1d(kx, ky, assume_unique=True, return_indices=True)
    i, j = ax[ix], ay[iy]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if len(i) == 0:
        return 0
    if (np.diff(j) <= 0).any():
        tops, top_at, before = [], [], np.full(len(j), -1)
        for k, v in enumerate(j.tolist()):
            p = bisect_left(tops, v)
            tops[p : p + 1], top_at[p : p + 1] = [v], [k]
            before[k] = top_at[p - 1] if p else -1
        chain, k = [], top_at[-1]
        while k >= 0:
            chain.append(k)
            k = before[k]
        i, j = i[chain[::-1]], j[chain[::-1]]
    return width + int(np.minimum(np.minimum(np.diff(i), np.diff(j)), width).sum())


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """aligned / (n + m - aligned) of two sequences of words (a lower bound of it, where that suffices), or 0.0 where it can't reach `least`."""
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return float(n == m)
    if min(n, m) < least * max(n, m):
        return 0.0
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(differ[0]) if len(differ) else short - head
    x, y = a[head : n - tail], b[head : m - tail]
    need = least * (n + m) / (1 + least) - head - tail  # least number aligned
    if len(x) and len(y):
        if _common(x, y) < need - 1e-9:
            return 0.0
        sure = anchored(x, y) if len(x) > SHORT_ROW else 0
        both = head + tail + (sure if sure >= need else aligned(x, y, max(1, int(len(x) + len(y) - 2 * need) + 1)))
    else:
        both = head + tail
    out = both / (n + m - both)
    return out if out >= least - 1e-12 else 0.0


def _features(docs: DataFrame) -> DataFrame:
    """rid, doc_id, th (hash of the text as it is), digest of the words, n (words), keys, parity."""

    def run(batches):
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                w = word_hashes(t)
                rows.append((hashlib.blake2b(w.tobytes(), digest_size=16).digest(), len(w), sketch_keys(w).view(np.int64), parities(w)))
            out = pd.DataFrame(rows, columns=["digest", "n", "keys", "parity"], index=pdf.index)
            yield pd.concat([pdf[["doc_id", "th"]], out], axis=1)

    found = docs.mapInPandas(run, "doc_id long, th long, digest binary, n long, keys array<long>, parity array<long>")
    return materialise(found.withColumn("rid", F.monotonically_increasing_id()))


def rare_pairs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The rarest of a text's labelled pairs of neighbouring words: so many that it has one in common with every similar text, and how many of them suffice against a longer text.

    Of texts of n <= m words that align in L at least, with 9 L >= 4 (n + m), at most 2 (n - L) + (m - L) pairs of the shorter are broken,
    that is n / 3, and 2 (m - L) + (n - L), or 0.4 m, of the longer. All texts rank pairs alike, so of one pair more each, one is in both.
    """
    pairs, n = _labelled(shingle_hashes(words, 2)), len(words)
    order = np.lexsort((pairs, counts[(pairs % np.uint64(len(counts))).astype(np.int64)]))
    return pairs[order[: 2 * n // 5 + 1]], n // 3 + 1


def differences(words: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The labelled words that one of the two has and the other hasn't. Two texts' differences to one centre differ from each other just as the texts do."""
    return np.setxor1d(_labelled(words), _labelled(centre))


def _marks(centre: int, words: np.ndarray, of_centre: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """How many words the text and its centre differ in, and what it is to be met by in that centre's group: those words, and its pairs of neighbouring words (empty where that way isn't taken).

    Similar texts of n and m words differ in (n + m) / 9 words at most, n / 4 that is, and their numbers of words that differ from the centre by no more.
    So pairs with a text of n / 2 differences at most are among texts of 7 n / 8.
    """
    differ, n = differences(words, of_centre), len(words)
    s, salt = len(differ), mix64(np.array([centre], np.int64).view(np.uint64))
    none = np.empty(0, np.uint64)
    return s, mix64(differ ^ salt) if 8 * s <= 7 * n else none, _labelled(shingle_hashes(words, 2)) if 2 * s > n or 4 * s <= n else none


def _mark_counts(texts: DataFrame) -> np.ndarray:
    """How many marks of the texts fall to each of SLOTS: a table of fixed size, added up in tasks and then by blocks."""

    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        for pdf in batches:
            for c, t, centre in zip(pdf["c"], pdf["text"], pdf["text_c"], strict=True):
                _, *marks = _marks(c, word_hashes(t), word_hashes(centre))
                at, n = np.unique(np.concatenate(marks) % np.uint64(SLOTS), return_counts=True)
                counts[at.astype(np.int64)] += n
        for block, part in enumerate(counts.reshape(-1, SLOT_BLOCK)):
            at = np.flatnonzero(part)
            if len(at):
                yield pd.DataFrame({"block": [block], "at": [at.astype(np.uint32).tobytes()], "n": [part[at].tobytes()]})

    def total(pdf):
        out = np.zeros(SLOT_BLOCK, np.int64)
        for at, n in zip(pdf["at"], pdf["n"], strict=True):
            out[np.frombuffer(at, np.uint32)] += np.frombuffer(n, np.int64)
        return pd.DataFrame({"block": pdf["block"][:1], "counts": [np.minimum(out, 2**31 - 1).astype(np.int32).tobytes()]})

    out = np.zeros((SLOTS // SLOT_BLOCK, SLOT_BLOCK), np.int32)
    for row in texts.mapInPandas(run, "block long, at binary, n binary").groupBy("block").applyInPandas(total, "block long, counts binary").collect():
        out[row.block] = np.frombuffer(row.counts, np.int32)
    return out.ravel()


def _rare_members(hot: DataFrame, slim: DataFrame, docs: DataFrame) -> DataFrame:
    """hot (c, rid, label) to (key, rid, label, n, s, i, early, by_word): the rare words in which each text and its centre c differ, the i-th rarest of s, or its rare pairs, less those that no other text can have."""
    of = slim.select(F.col("rid").alias("r"), F.col("doc_id").alias("d"), F.col("th").alias("h"))
    asked = hot.select("rid").union(hot.select("c")).distinct()
    asked = materialise(asked.join(of, F.col("rid") == F.col("r")).select("rid", "d", "h"))  # as a table, so that few of them are broadcast
    own = _texts(docs, asked, "rid")
    texts = materialise(hot.join(own, "rid").join(own.select(F.col("rid").alias("c"), F.col("text").alias("text_c")), "c").select("c", "rid", "label", "text", "text_c"))
    counts = docs.sparkSession.sparkContext.broadcast(_mark_counts(texts))

    def run(batches):
        for pdf in batches:
            held, size = [], 0
            for c, rid, label, t, centre in pdf.itertuples(index=False, name=None):
                words = word_hashes(t)
                n = len(words)
                s, differ, pairs = _marks(c, words, word_hashes(centre))
                found = [(differ[np.lexsort((differ, counts.value[(differ % np.uint64(SLOTS)).astype(np.int64)]))][: n // 4 + 1], n // 8 + 1, True)]
                if len(pairs):
                    found.append((*rare_pairs(words, counts.value), False))
                for key, early, by_word in found:
                    met = counts.value[(key % np.uint64(SLOTS)).astype(np.int64)] > 1
                    if met.any():
                        key = key if by_word else mix64(key + np.uint64(c))
                        at = np.arange(len(key))
                        held.append(pd.DataFrame({"key": key.view(np.int64), "rid": rid, "label": label, "n": n, "s": s, "i": at, "early": at < early, "by_word": by_word})[met])
                        size += int(met.sum())
                if size > HELD:
                    yield pd.concat(held)
                    held, size = [], 0
            if held:
                yield pd.concat(held)

    out = materialise(texts.mapInPandas(run, "key long, rid long, label long, n long, s long, i long, early boolean, by_word boolean"))
    for x in (asked, own, texts):
        discard(x)
    return out


def _mixed(members: DataFrame, *more: Column, where: str = "true") -> DataFrame:
    """Keys (k) whose members are of several components, how many members they have, and what more is asked of them."""
    found = members.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1"), *more)
    return materialise(found.where("l0 <> l1").where(where).drop("l0", "l1"))


def _hot_pairs(hot: DataFrame, slim: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of hot texts across components that sizes and rare marks leave open: all similar ones are among them.

    Where one of two texts is near their centre they meet by the words in which they differ from it. Of x's s_x and y's s_y such words all but
    (n + m) / 9 are the same, so of either's rarest (s_x - s_y + (n + m) / 9) / 2 and one more, one is in both; unless both have so few that they need
    none in common. Those and pairs far from the centre meet by pairs of neighbouring words.
    A mark with more than CELL texts is dealt into cells, and each text goes to the pairs of cells that its own is in.
    """
    members = _rare_members(hot, slim, docs)
    sizes = _mixed(members, F.max("early").alias("some_early"), where="some_early")  # of two texts that meet one has the mark early
    at = members.join(sizes, F.col("key") == F.col("k")).withColumn("parts", F.expr(f"(size + {CELL - 1}) div {CELL}")).withColumn("cell", F.pmod(F.xxhash64("rid"), "parts"))
    at = materialise(at)
    own = ["rid", "label", "n", "s", "i", "early", "by_word"]
    many = at.where("parts > 1").select("key", *own, "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    at = at.where("parts = 1").select("key", *own, "cell", F.col("cell").alias("other")).union(many)
    at = materialise(at.select("key", F.least("cell", "other").alias("i_cell"), F.greatest("cell", "other").alias("j_cell"), "cell", *own))
    x, y = at.where("early").alias("x"), at.alias("y")
    same = F.expr("x.key = y.key and x.i_cell = y.i_cell and x.j_cell = y.j_cell and x.by_word = y.by_word and x.label <> y.label and (x.i_cell = x.j_cell or x.cell <> y.cell)")
    fits = F.expr("5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)")
    words = F.expr("(x.s < y.s or x.s = y.s and x.rid < y.rid) and 18 * x.i <= 9 * (x.s - y.s) + x.n + y.n and 18 * y.i <= 9 * (y.s - x.s) + x.n + y.n and (2 * x.s <= x.n or 2 * y.s <= y.n) and 9 * (x.s + y.s) > x.n + y.n")
    pairs = F.expr("x.n <= y.n and 9 * abs(x.s - y.s) <= x.n + y.n and (2 * x.s > x.n and 2 * y.s > y.n or 9 * (x.s + y.s) <= x.n + y.n)")
    met = x.join(y, same & fits & F.when(F.col("x.by_word"), words).otherwise(pairs))
    return met.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).distinct()


def _unchecked(members: DataFrame, nodes: DataFrame, docs: DataFrame, label: DataFrame, done: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) across components that aren't done, less those that sizes, parities or rare marks rule out.

    In a group of at most HOT members all pairs are tried. Members of larger ones meet where they share a rare mark.
    """
    at = members.select("key", "rid", "score").join(label, F.col("rid") == F.col("node"), "left").select("key", "rid", "score", F.coalesce("label", "rid").alias("label"))
    at = materialise(at)
    groups = _mixed(at, F.max(F.struct("score", "rid")).alias("centre"))
    at = materialise(at.join(groups, F.col("key") == F.col("k")).select("key", "rid", "label", "size", F.col("centre.rid").alias("c")))
    sides = nodes.select(F.col("rid").alias("r"), "n", "parity")
    bits = [f"w{w}" for w in range(2 * PARITY // 64)]
    few = at.where(F.col("size") <= HOT).join(sides, F.col("rid") == F.col("r")).select("key", "rid", "label", "n", *[F.col("parity")[w].alias(b) for w, b in enumerate(bits)])
    x, y = few.alias("x"), few.alias("y")
    near = _may_link((F.col("x.n"), F.col("y.n")), tuple([F.col(f"{t}.{b}") for b in bits] for t in "xy"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rid") < F.col("y.rid")) & (F.col("x.label") != F.col("y.label")) & near)
    pairs = pairs.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()
    hot = materialise(at.where(F.col("size") > HOT).select("c", "rid", "label").distinct())
    if hot.limit(1).count():
        pairs = pairs.union(_hot_pairs(hot, nodes, docs)).distinct()
    return materialise(pairs.join(done, ["a", "b"], "left_anti"))


def _texts(docs: DataFrame, asked: DataFrame, *columns: str) -> DataFrame:
    """The columns and the text of the documents that are asked for (d, h: doc_id and hash of the text), as a written table. A Bloom filter of the hashes keeps most others out of the shuffle."""
    twice = asked.select("h").union(asked.select("h"))  # the filter has what is there twice
    near = docs.where(maybe_repeated(docs, "th", repeated_filter(twice, asked.count())))
    return materialise(near.join(asked, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))).select(*columns, "text"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar."""

    def run(batches):
        last, last_w = None, None
        for pdf in batches:
            keep = []
            for ta, tb in zip(pdf["text_a"], pdf["text_b"], strict=True):
                if tb != last:
                    last, last_w = tb, word_hashes(tb)
                keep.append(similarity(word_hashes(ta), last_w) > 0)
            yield pdf.loc[keep, ["a", "b"]]

    of = lambda x: nodes.select(F.col("rid").alias(x), *[F.col(c).alias(f"{t}_{x}") for c, t in (("doc_id", "id"), ("th", "th"), ("n", "n"), ("parity", "p"))])
    bits = tuple([F.col(f"p_{x}")[w] for w in range(2 * PARITY // 64)] for x in "ab")
    named = pairs.join(of("a"), "a").join(of("b"), "b").where(_may_link((F.col("n_a"), F.col("n_b")), bits)).drop("p_a", "p_b")
    named = materialise(named)  # as a table, so that the pairs of a hot text can be split in the joins
    asked = [named.select(F.col(x).alias("rid"), F.col(f"id_{x}").alias("d"), F.col(f"th_{x}").alias("h")) for x in "ab"]
    asked = materialise(asked[0].union(asked[1]).distinct())
    texts = _texts(docs, asked, "rid")  # those of the pairs, read once
    side = lambda x: texts.select(F.col("rid").alias(x), F.col("text").alias(f"text_{x}"))
    two = named.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    found = materialise(two.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long"))
    for x in (named, asked, texts):
        discard(x)
    return found


def _own(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(col(text), F.lit(""))
    return docs.select(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("text"))


def _pairs(met: DataFrame) -> DataFrame:
    """Pairs of texts (rid, p) as (a, b), each once."""
    return met.select(F.least("rid", "p").alias("a"), F.greatest("rid", "p").alias("b")).distinct()


def _central(scored: DataFrame) -> DataFrame:
    """scored (key, rid, score) to (rid, p): each text with the most central one of all its groups."""
    best = scored.groupBy("key").agg(F.max(F.struct("score", "rid")).alias("a")).withColumnRenamed("key", "k")
    return scored.join(best, F.col("key") == F.col("k")).groupBy("rid").agg(F.max("a")["rid"].alias("p")).where("rid <> p")


def _open(scored: DataFrame, label: DataFrame) -> DataFrame:
    """key, rid, score, label of the groups whose texts are of several components, with pivots: the group's most central text and its first by a hash, each with its label."""
    at = materialise(scored.join(label, F.col("rid") == F.col("node"), "left").select("key", "rid", "score", F.coalesce("label", "rid").alias("label")))
    a, b = F.max(F.struct("score", "rid", "label")), F.min(F.struct(F.xxhash64("rid").alias("h"), F.col("rid"), F.col("label")))
    groups = _mixed(at, a.alias("a"), b.alias("b"))
    pivots = F.array(*[F.struct(f"{x}.rid", f"{x}.label") for x in "ab"]).alias("pivots")
    out = materialise(at.join(groups, F.col("key") == F.col("k")).select("key", "rid", "score", "label", pivots))
    discard(at)
    return out


def _with_pivots(open_: DataFrame) -> DataFrame:
    """(rid, p): each text with those of its group's pivots that are of other components."""
    met = open_.select("rid", F.explode(F.filter(F.array_distinct("pivots"), lambda p: p["label"] != F.col("label"))).alias("p"))
    return met.select("rid", F.col("p.rid").alias("p"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: rid, doc_id, th, class_id (the least doc_id of its class), class_size, kept (one row of each class)."""
    own = _own(docs, doc_id, text)
    rows = _features(own)
    first = F.min(F.struct("doc_id", "th", "rid")).alias("f")
    nodes = materialise(rows.groupBy("digest").agg(first, F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("parity").alias("parity"), F.count(F.lit(1)).alias("size")).select("digest", "f.doc_id", "f.th", "f.rid", "n", "keys", "parity", "size"))
    keyed = nodes.select("rid", F.explode("keys").alias("key"))
    shared = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumnRenamed("key", "k"))
    members = materialise(keyed.join(shared, F.col("key") == F.col("k")).select("key", "rid", "size"))
    slim = nodes.select("rid", "doc_id", "th", "n", "parity")
    central = members.groupBy("rid").agg(F.sum("size").alias("score")).withColumnRenamed("rid", "c")
    scored = materialise(members.join(central, F.col("rid") == F.col("c")).select("key", "rid", "score"))
    done = materialise(_pairs(_central(scored)))
    links = _verified(done, slim, own)
    label = materialise(components(links))

    open_ = _open(scored, label)
    found = materialise(_pairs(_with_pivots(open_)).join(done, ["a", "b"], "left_anti"))
    links = _verified(found, slim, own)
    label = materialise(components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links)))

    more = _verified(_unchecked(open_, nodes, own, label, done.union(found)), slim, own)
    if more.count():
        label = materialise(components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more)))
    lab = nodes.join(label, F.col("rid") == F.col("node"), "left").select("digest", "doc_id", "th", "rid", "size", F.coalesce("label", "rid").alias("label"))
    lab = materialise(lab)
    best = materialise(lab.groupBy("label").agg(F.min(F.struct("doc_id", "rid")).alias("best"), F.sum("size").alias("class_size")).withColumnRenamed("label", "c"))
    whole = materialise(lab.join(best, F.col("label") == F.col("c")).select(F.col("digest").alias("d"), F.col("best.doc_id").alias("class_id"), F.col("best.rid").alias("keep"), "class_size"))
    return rows.select("rid", "doc_id", "th", "digest").join(whole, F.col("digest") == F.col("d")).select("rid", "doc_id", "th", "class_id", "class_size", (F.col("rid") == F.col("keep")).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with its own columns."""
    kept = materialise(classes(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("__n_id"), F.col("th").alias("__n_th")))
    own, (own_id, own_text) = renamed(docs, doc_id, text)
    here = own.withColumn("__n_hash", F.xxhash64(F.coalesce(F.col(own_text), F.lit(""))))
    on = F.col(own_id).cast("long").eqNullSafe(F.col("__n_id")) & (F.col("__n_hash") == F.col("__n_th"))
    return here.join(kept, on).dropDuplicates([own_id, "__n_hash"]).select(*own.columns).toDF(*docs.columns)


def op2_near_dedup(spark, sf_dir):
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size", "kept")
