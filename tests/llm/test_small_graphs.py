"""A round over few links is one task's and shuffles nothing; components are those of dealt out rounds."""

from __future__ import annotations

import random

from mediaflow.llm import graph


def test_small_rounds_shuffle_nothing_and_find_the_same(spark, monkeypatch):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(20)]
    links = spark.createDataFrame([*links, (None, 3), (7, 7), (1000, 1001)], "a bigint, b bigint").repartition(3)
    plans = []
    stored = graph.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning"))
        return stored(df, name)

    monkeypatch.setattr(graph, "stored", seen)
    found = {}
    for few in (graph.FEW_LINKS, 0):
        monkeypatch.setattr(graph, "FEW_LINKS", few)
        plans.clear()
        found[few] = sorted(tuple(row) for row in graph.components(links).collect())
        # The first is the removal of double links, before anything is counted.
        assert len(plans) > 2 and (not any(plans[1:])) == (few > 0)
    leasts = dict(found.popitem()[1])
    assert sorted(leasts.items()) == found.popitem()[1]
    assert leasts[1020] == 1000 and 3 not in leasts or leasts[3] <= 3
