"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

Legal sequences: at most one system turn, first; then user and assistant in turn, the user beginning. Each
turn of a conversation is kept, relabelled, merged into the turn before it, or preceded by an inserted
empty turn; dynamic programming over the automaton's states finds the choices of least total cost (COSTS; ties by
the order keep, relabel, merge, insert, then the first role in ROLES). Unknown and null roles must be relabelled.

The result has a row for each turn: its new role, what was done, the role inserted before it if any, and its piece
of the rendered conversation; the pieces of a conversation, in `seq` order, concatenate to the whole (its last piece
closes the last turn).

Turns are put in order (turn, null last, then role, text) by a range shuffle, which splits a
conversation of any length; blocks of BLOCK rows of that order are worked on apart. Where a conversation spans blocks,
each block first gives its least costs from any state to any other, a small matrix; running over the matrices
gives each block's states at its borders, with which it is solved. So the optimum is exact and no task
gets a whole long conversation. Only the roles are worked on in Python: the texts stay in Spark's rows, however long they are.

Markers are `<|name|>`. In a turn's text `<|` is written `<\\|`, with one backslash more for those that stand there already, so no text
forges a turn; `unescaped` gives the text back. A null conv_id is a conversation of its own; repeated rows are turns of their own;
null text is empty. An empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torrentia.llm.common import materialise

ROLES = ("system", "user", "assistant")  # states 1, 2, 3; 0 is the start
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
COSTS = {"relabel": 2, "merge": 1, "insert": 3}
BLOCK = 512
FAR = 1 << 40


@lru_cache(maxsize=8)
def moves(role: int) -> list[list[tuple[int, int, str, int]]]:
    """For each state, the choices for a turn of the role: (new state, cost, action, inserted role or 0)."""
    out = []
    for s in range(4):
        best: dict[int, tuple[int, int, str, int]] = {}

        def offer(x: int, cost: int, action: str, inserted: int = 0, best=best) -> None:
            if x not in best or cost < best[x][1]:
                best[x] = (x, cost, action, inserted)

        label = lambda x: 0 if x == role else COSTS["relabel"]
        for x in NEXT[s]:
            offer(x, label(x), "keep" if x == role else "relabel")
        if s:
            offer(s, COSTS["merge"] + label(s), "merge")
        for y in NEXT[s]:
            for x in NEXT[y]:
                offer(x, COSTS["insert"] + label(x), "insert", y)
        out.append([best[x] for x in sorted(best)])
    return out


def repair(roles: list[int], entry: int = 0, leave: int | None = None) -> tuple[list[tuple[int, str, int]], int]:
    """The best (new state, action, inserted) of each turn from state `entry` to state `leave` (any if None), and their cost."""
    cost, back = {entry: 0}, []
    for r in roles:
        after: dict[int, tuple[int, int, str, int]] = {}
        for s in sorted(cost):
            for x, c, action, inserted in moves(r)[s]:
                if x not in after or cost[s] + c < after[x][0]:
                    after[x] = (cost[s] + c, s, action, inserted)
        back.append(after)
        cost = {x: v[0] for x, v in after.items()}
    if not roles:
        return [], 0
    at = leave if leave is not None else min(cost, key=lambda x: (cost[x], x))
    total, out = cost[at], []
    for after in reversed(back):
        _, s, action, inserted = after[at]
        out.append((at, action, inserted))
        at = s
    return out[::-1], total


def span_costs(roles: list[int]) -> list[int]:
    """Least cost from each of the four states to each other, row by row."""
    out = []
    for entry in range(4):
        cost = {entry: 0}
        for r in roles:
            after: dict[int, int] = {}
            for s, c0 in cost.items():
                for x, c, _, _ in moves(r)[s]:
                    after[x] = min(after.get(x, FAR), c0 + c)
            cost = after
        out += [cost.get(x, FAR) for x in range(4)]
    return out


def _runs(pdf: pd.DataFrame):
    """The conversations in a sorted block, as slices."""
    key = pdf["conv"].to_numpy()
    start = 0
    for i in range(1, len(key) + 1):
        if i == len(key) or key[i] != key[start]:
            yield slice(start, i)
            start = i


def _costs(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    out = [(pdf["conv"].iloc[s.start], pdf["block"].iloc[0], span_costs(pdf["state"].iloc[s].tolist())) for s in _runs(pdf)]
    return pd.DataFrame(out, columns=["conv", "block", "costs"])


def _borders(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states at the borders of a conversation's blocks on a cheapest way."""
    pdf = pdf.sort_values("block")
    cost, back = {0: 0}, []
    for m in pdf["costs"]:
        after: dict[int, tuple[int, int]] = {}
        for s in sorted(cost):
            for x in range(4):
                c = cost[s] + int(m[4 * s + x])
                if c < FAR and (x not in after or c < after[x][0]):
                    after[x] = (c, s)
        back.append(after)
        cost = {x: v[0] for x, v in after.items()}
    at, way = min(cost, key=lambda x: (cost[x], x)), []
    for after in reversed(back):
        way.append((after[at][1], at))
        at = after[at][1]
    way.reverse()
    return pd.DataFrame({"conv": pdf["conv"], "block": pdf["block"], "entry": [w[0] for w in way], "leave": [w[1] for w in way]})


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    rows = []
    for s in _runs(pdf):
        part = pdf.iloc[s]
        entry, leave = part["entry"].iloc[0], part["leave"].iloc[0]
        entry, leave = (0, None) if pd.isna(entry) else (int(entry), int(leave))
        steps, _ = repair(part["state"].tolist(), entry, leave)
        before = entry
        for (x, action, inserted), seq in zip(steps, part["seq"], strict=True):
            head = "" if not before else ("\n" if action == "merge" else "<|end|>\n")
            if inserted:
                head += f"<|{ROLES[inserted - 1]}|>\n<|end|>\n"
            if action != "merge":
                head += f"<|{ROLES[x - 1]}|>\n"
            rows.append((seq, ROLES[x - 1], action, ROLES[inserted - 1] if inserted else None, head))
            before = x
    return pd.DataFrame(rows, columns=["s_seq", "new_role", "action", "inserted", "head"])


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a turn: conv_id, seq (orders the turns), turn, role, new_role, action, inserted, rendered."""
    state = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.lower(F.trim(F.col(role)))), F.lit(0)).cast("int")
    own = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), state.alias("state"),
        F.coalesce(F.col(conv_id).cast("string"), F.lit("\0null")).alias("conv"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text")]
    rid = F.monotonically_increasing_id()
    placed = own.withColumn("rid", rid).repartitionByRange(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order, "rid").sortWithinPartitions(*order, "rid")
    placed = materialise(placed.drop("rid").withColumn("seq", F.monotonically_increasing_id()).withColumn("block", F.expr(f"seq div {BLOCK}")))
    ends = placed.groupBy("conv").agg(F.min("block").alias("b0"), F.max("block").alias("b1"), F.max("seq").alias("last"))
    ends = materialise(ends.withColumnRenamed("conv", "e_conv"))
    rows = placed.join(ends, F.col("conv") == F.col("e_conv")).withColumn("is_last", F.col("seq") == F.col("last"))
    costs = rows.where("b0 < b1").select("conv", "block", "seq", "state").groupBy("block").applyInPandas(_costs, "conv string, block long, costs array<long>")
    borders = costs.groupBy("conv").applyInPandas(_borders, "conv string, block long, entry int, leave int")
    borders = materialise(borders.select(F.col("conv").alias("o_conv"), F.col("block").alias("o_block"), "entry", "leave"))
    rows = rows.join(borders, (F.col("conv") == F.col("o_conv")) & (F.col("block") == F.col("o_block")), "left")
    solved = rows.select("conv", "block", "seq", "state", "entry", "leave").groupBy("block").applyInPandas(_solve, "s_seq long, new_role string, action string, inserted string, head string")
    done = rows.drop("entry", "leave", "o_conv", "o_block").join(materialise(solved), F.col("seq") == F.col("s_seq"))
    rendered = F.concat("head", escaped(F.col("text")), F.when(F.col("is_last"), "<|end|>\n").otherwise(""))
    return done.select("conv_id", "seq", "turn", "role", "new_role", "action", "inserted", rendered.alias("rendered"))


def op1_chat_format(spark, sf_dir):
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
