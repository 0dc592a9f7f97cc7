"""Graphs by joins: connected components, and functional graphs by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torrentia.scratch import dealt, discard, large, written


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, label), the label being the component's least node. Alternates large and small stars until nothing changes."""
    star = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    sign = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = sign(star)
    while True:
        # dealt by u once, for the least neighbours and the join with them alike
        both = large(dealt(star.union(star.select("v", "u")), "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        up = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = large(dealt(up, "u").distinct())
        least = up.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = up.join(least, F.col("u") == F.col("k"))  # m is one of u's v, so u meets it in that row
        after = written(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        discard(star)
        star = after
        now = sign(star)
        if now == seen:
            return star.select(F.col("u").alias("node"), F.col("v").alias("label")).union(star.select("v", "v").distinct())
        seen = now


MAX_ROUNDS = 64  # of doubling: ways of up to 2**64 steps; a longer one runs in a circle


def roots(pointers: DataFrame) -> DataFrame:
    """pointers (cell, next or NULL) to (cell, root): the last cell of the way, by pointer doubling."""
    at = written(pointers.select("cell", F.coalesce("next", "cell").alias("to")))
    for _ in range(MAX_ROUNDS):
        ahead = at.select(F.col("cell").alias("j"), F.col("to").alias("then"))
        after = written(at.join(ahead, F.col("to") == F.col("j")).select("cell", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("moved")))
        discard(at)
        if not after.where("moved").limit(1).count():
            return after.select("cell", F.col("to").alias("root"))
        at = after.drop("moved")
        at._scratch = after._scratch
    raise ValueError("the pointers run in a circle")


def paths(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (start) to (start, step, cell): all cells on the way down from each start, by pointer doubling."""
    jump = written(pointers.where("next is not null").select("cell", "next"))
    way = starts.select("start", F.lit(0).cast("long").alias("step"), F.col("start").alias("cell"))
    for k in range(MAX_ROUNDS):
        if not jump.limit(1).count():
            return way
        far = way.join(jump.select(F.col("cell").alias("j"), "next"), F.col("cell") == F.col("j"))
        way = written(way.unionByName(far.select("start", (F.col("step") + 2**k).alias("step"), F.col("next").alias("cell"))))
        twice = jump.join(jump.select(F.col("cell").alias("j"), F.col("next").alias("then")), F.col("next") == F.col("j"))
        jump = written(twice.select("cell", F.col("then").alias("next")))
    raise ValueError("the pointers run in a circle")


def spread(shares: DataFrame, weights: DataFrame, doublings: int = 4) -> DataFrame:
    """shares (cell, to, share) and weights (cell, weight) to (cell, total): each cell passes what it has and gets on by its shares.

    The shares of 2, 4, ... 2**doublings steps are products of the table with itself; then rounds of so many steps add what still arrives.
    """
    step, total = written(shares.where("share > 0")), written(weights.select("cell", F.col("weight").cast("double").alias("total")))

    def onward(have: DataFrame) -> DataFrame:
        moved = have.join(step.select(F.col("cell").alias("j"), "to", "share"), F.col("cell") == F.col("j"))
        return moved.groupBy(F.col("to").alias("cell")).agg(F.sum(F.col("total") * F.col("share")).alias("total"))

    for _ in range(doublings):
        after = written(total.unionByName(onward(total)).groupBy("cell").agg(F.sum("total").alias("total")))
        b = step.select(F.col("cell").alias("j"), F.col("to").alias("then"), F.col("share").alias("then_share"))
        twice = step.join(b, F.col("to") == F.col("j")).groupBy("cell", F.col("then").alias("to")).agg(F.sum(F.col("share") * F.col("then_share")).alias("share"))
        twice = written(twice)
        discard(total)
        discard(step)
        step, total = twice, after
    delta = total
    while True:
        delta = written(onward(delta))
        if not delta.limit(1).count():
            return total
        total = written(total.unionByName(delta).groupBy("cell").agg(F.sum("total").alias("total")))


def accumulate(pointers: DataFrame) -> DataFrame:
    """pointers (cell, next or NULL, weight) to (cell, total): the weight of all cells that flow into a cell, and its own.

    Pointer doubling: after k rounds a cell has what lies within 2**k - 1 steps above it; rounds end when no pointer is left.
    """
    state = written(pointers.select("cell", "next", F.col("weight").cast("double").alias("total")))
    rounds = 0
    while state.where("next is not null").limit(1).count():
        rounds += 1
        if rounds > MAX_ROUNDS:
            raise ValueError("the pointers run in a circle")
        before = state
        into = state.where("next is not null").groupBy(F.col("next").alias("k")).agg(F.sum("total").alias("more"))
        onward = state.select(F.col("cell").alias("j"), F.col("next").alias("then"))
        state = state.join(into, F.col("cell") == F.col("k"), "left").join(onward, F.col("next") == F.col("j"), "left")
        after = written(state.select("cell", F.col("then").alias("next"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total")))
        discard(before)
        state = after
    return state.select("cell", "total")


def follow(pointers: DataFrame, stops: DataFrame) -> DataFrame:
    """pointers (cell, next, length) and stops (cell) to (cell, stop or NULL, length of the way): the first stop on the way down."""
    marks = stops.select(F.col("cell").alias("s")).distinct()
    at = pointers.join(large(marks), F.col("cell") == F.col("s"), "left")
    at = written(at.select("cell", F.when(F.col("s").isNotNull(), F.col("cell")).otherwise(F.col("next")).alias("to"), F.when(F.col("s").isNotNull(), 0.0).otherwise(F.col("length")).alias("way"), F.col("s").isNotNull().alias("is_stop")))
    for rounds in range(MAX_ROUNDS + 1):
        if rounds == MAX_ROUNDS:
            raise ValueError("the pointers run in a circle")
        ahead = at.select(F.col("cell").alias("j"), F.col("to").alias("then"), F.col("way").alias("more"), F.col("is_stop").alias("done"))
        joined = at.join(ahead, F.col("to") == F.col("j"), "left")
        moved = joined.agg(F.count_if(F.col("j").isNotNull() & ~F.col("done") & ~F.col("is_stop"))).first()[0]
        if not moved:
            break
        go = F.col("j").isNotNull() & ~F.col("done") & ~F.col("is_stop")
        after = written(joined.select("cell", F.when(go, F.col("then")).otherwise(F.col("to")).alias("to"), F.when(go, F.col("way") + F.col("more")).otherwise(F.col("way")).alias("way"), "is_stop"))
        discard(at)
        at = after
    ends = large(marks.withColumnRenamed("s", "e"))
    out = at.join(ends, F.col("to") == F.col("e"), "left")
    return out.select("cell", F.col("e").alias("stop"), F.when(F.col("e").isNotNull(), F.col("way")).alias("length"))


def chains(links: DataFrame) -> DataFrame:
    """links (cell, next or NULL, length), in which a cell is next to one other at most, to (cell, chain, closed, seq, before, length, total).

    A chain runs from a first cell to a last, or is a circle, which is opened before its least cell. seq counts from 0, before is the length
    of the cells before. Pointer doubling: a cell knows how many follow within 2**k steps, how long they are and which is the
    least of them; in an open chain fewer cells have an onward pointer each round, in a circle the least settles.
    """
    base = written(links.select("cell", "next", F.col("length").cast("double").alias("length")))

    def doubled(of: DataFrame) -> DataFrame:
        onward = of.select(F.col("cell").alias("j"), F.col("length").alias("then"))
        at = of.join(onward, F.col("next") == F.col("j"), "left")
        at = at.select("cell", F.col("next").alias("to"), F.col("cell").alias("tail"), F.col("cell").alias("least"), F.col("next").isNotNull().cast("long").alias("hops"), F.coalesce("then", F.lit(0.0)).alias("after"), F.lit(True).alias("new"))
        at, before = written(at), None
        for _ in range(2 * MAX_ROUNDS):
            going = at.where("to is not null").agg(F.count(F.lit(1)), F.count_if("new")).first()
            if going[0] == 0 or (going[0] == before and going[1] == 0):
                return at
            before = going[0]
            ahead = at.select(F.col("cell").alias("j"), F.col("to").alias("to_"), F.col("tail").alias("tail_"), F.col("least").alias("least_"), F.col("hops").alias("hops_"), F.col("after").alias("after_"))
            moved = at.where("to is not null").join(ahead, F.col("to") == F.col("j"))
            moved = moved.select("cell", F.col("to_").alias("to"), F.col("tail_").alias("tail"), F.least("least", "least_").alias("least"), (F.col("hops") + F.col("hops_")).alias("hops"), (F.col("after") + F.col("after_")).alias("after"), (F.col("least_") < F.col("least")).alias("new"))
            after = written(moved.unionByName(at.where("to is null")))
            discard(at)
            at = after
        raise ValueError("a cell is next to several others")

    found = doubled(base)
    done = found.where("to is null").select("cell", F.col("tail").alias("chain"), F.lit(False).alias("closed"), "hops", "after")
    circles = found.where("to is not null").select(F.col("cell").alias("c"), "least")
    if circles.limit(1).count():
        opened = base.join(circles, F.col("cell") == F.col("c"))
        opened = opened.select("cell", F.when(F.col("next") != F.col("least"), F.col("next")).alias("next"), "length")
        again = doubled(opened).drop("least").join(circles, F.col("cell") == F.col("c"))
        done = done.unionByName(again.select("cell", F.col("least").alias("chain"), F.lit(True).alias("closed"), "hops", "after"))
    own = base.select(F.col("cell").alias("c"), "length")
    at = written(done.join(own, F.col("cell") == F.col("c")).drop("c"))
    whole = at.groupBy(F.col("chain").alias("k")).agg(F.max("hops").alias("last"), F.max_by(F.col("after") + F.col("length"), "hops").alias("total"))
    out = at.join(whole, F.col("chain") == F.col("k"))
    return out.select("cell", "chain", "closed", (F.col("last") - F.col("hops")).alias("seq"), (F.col("total") - F.col("after") - F.col("length")).alias("before"), "length", "total")
