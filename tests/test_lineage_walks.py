"""Walks against brute force on random graphs, with and without cycles, and on long chains."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import lineage


def brute(edges, origin):
    """Shortest distances to all that an origin reaches."""
    next_of = {}
    for child, parent in edges:
        next_of.setdefault(child, set()).add(parent)
    found, frontier, depth = {}, {origin}, 0
    while frontier:
        depth += 1
        frontier = {p for c in frontier for p in next_of.get(c, ())} - found.keys()
        found |= dict.fromkeys(frontier, depth)
    return found


def graph(seed, nodes, edges, cycles):
    draw = random.Random(seed)
    pairs = [(draw.randrange(nodes), draw.randrange(nodes)) for _ in range(edges)]
    return [(f"n{a:03d}", f"n{b:03d}") for a, b in (pairs if cycles else [(max(p), min(p)) for p in pairs if p[0] != p[1]])]


@pytest.mark.parametrize("seed,nodes,count,cycles", [(1, 40, 60, False), (2, 30, 45, True), (3, 25, 20, True)])
def test_reach_and_cycles_against_brute_force(spark, seed, nodes, count, cycles):
    edges = graph(seed, nodes, count, cycles)
    frame = spark.createDataFrame(edges + edges[:5], "child string, parent string")
    names = sorted({n for e in edges for n in e})
    origins = spark.createDataFrame([(n,) for n in [*names[::2], "unknown"]], "origin string")
    want = {(o, n, d) for o in names[::2] for n, d in brute(edges, o).items()}
    assert {tuple(r) for r in lineage.ancestors(origins, frame).collect()} == want
    assert {tuple(r) for r in lineage.ancestors(origins, frame, max_depth=2).collect()} == {w for w in want if w[2] <= 2}
    cyclic = {n for n in names if any(m == n or m in brute(edges, m) for m in [n, *brute(edges, n)] if m in brute(edges, m))}
    assert {r.node_id for r in lineage.cyclic_nodes(frame).collect()} == cyclic


def test_long_chains_take_few_steps(spark, monkeypatch):
    """10,000 links in a row, once to a root and once into a circle."""
    steps = []
    whole = lineage.stage
    monkeypatch.setattr(lineage, "stage", lambda df, name="stage": steps.append(name) or whole(df, name))
    n = 10_000
    frame = spark.range(n).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("child"), F.concat(F.lit("a"), (F.col("id") + 1).cast("string")).alias("parent"))
    looped = spark.range(n).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("child"), F.concat(F.lit("b"), F.when(F.col("id") == n - 1, n - 3).otherwise(F.col("id") + 1).cast("string")).alias("parent"))
    found = lineage.cyclic_nodes(frame.unionByName(looped))
    assert found.count() == n and found.filter("node_id not like 'b%'").isEmpty()
    assert len(steps) < 45


def test_nodes_that_nobody_rests_on_do_not_walk(spark, monkeypatch):
    """1,000 leaves over a chain into a circle and over a root: only the inner edges are peeled, and what circles is told at once."""
    frame = spark.createDataFrame([(f"l{i}", ("a0", "r")[i % 2]) for i in range(1000)] + [(f"a{i}", f"a{i + 1}") for i in range(20)] + [("a20", "a19"), ("r", "top"), (None, "a0")], "child string, parent string")
    sizes, steps = [], []
    circling, whole = lineage._circling, lineage.stage
    monkeypatch.setattr(lineage, "_circling", lambda df: sizes.append(df.count()) or circling(df))
    monkeypatch.setattr(lineage, "stage", lambda df, name="stage": steps.append(name) or whole(df, name))
    found = [r.node_id for r in lineage.cyclic_nodes(frame).collect()]
    assert len(found) == len(set(found)) and set(found) == {None} | {f"l{i}" for i in range(0, 1000, 2)} | {f"a{i}" for i in range(21)}
    assert sizes and sizes[0] <= 22 and steps.count("stepped") <= 2
