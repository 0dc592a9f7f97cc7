"""Components: each round deals its edges by node once for the least neighbours and the join with them alike."""

import random

from torrentia import scratch
from torrentia.operators import graph


def test_stars_are_dealt_once_a_step(spark, monkeypatch):
    plans, r = [], random.Random(7)
    monkeypatch.setattr(graph, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or scratch.written(df))
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(900, 300 + i) for i in range(150)] + [(1000 + i, 1001 + i) for i in range(12)]
    own = {}

    def root(x):
        while own.setdefault(x, x) != x:
            x = own[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        own[max(a, b)] = min(a, b)
    got = [tuple(x) for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert sorted(got) == sorted((x, root(x)) for x in nodes)
    assert len(plans) > 2 and all(p.count("ENSURE_REQUIREMENTS") == 1 for p in plans[1:])  # the distinct edges of the round
