"""Lineage as two tables, nodes and edges (child, parent), and the walks over them.

What is asked about many values is built once for what they share: the ancestors of a node follow from those of its
parents, layer by layer, and values take the set of the node they start from. Every step is written out so that plans
stay flat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

LEGITIMATE_ROOTS = ("source", "assumption")


def edges_from(df: DataFrame, child: str | Column, parents: str | Column) -> DataFrame:
    """One edge per parent id in an array column."""
    child = F.col(child) if isinstance(child, str) else child
    return df.select(child.alias("child"), F.explode(parents).alias("parent"))


def fact_nodes(facts: DataFrame) -> DataFrame:
    label = F.when(F.col("fiscal_period") == "FY", F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"))).otherwise(
        F.concat_ws("-", "fiscal_period", F.col("fiscal_year").cast("string")))
    attributes = F.create_map(
        F.lit("value"), F.col("value").cast("string"), F.lit("unit"), F.col("unit"), F.lit("period"), label, F.lit("formula"), F.col("formula"),
        F.lit("concept"), F.col("concept"), F.lit("accession"), F.col("accession"),
    )
    return facts.select(F.col("fact_id").alias("node_id"), F.lit("fact").alias("kind"), F.col("metric_id").alias("label"),
                        F.map_filter(attributes, lambda k, v: v.isNotNull()).alias("attributes"))


def simple_nodes(df: DataFrame, node_id: str | Column, kind: str, label: str | Column) -> DataFrame:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    distinct = df.select(as_col(node_id).alias("node_id"), F.lit(kind).alias("kind"), as_col(label).alias("label")).distinct()
    return distinct.withColumn("attributes", F.create_map().cast("map<string,string>"))


def build_edges(documents: DataFrame, facts: DataFrame, analytics: DataFrame | None = None, forecast: DataFrame | None = None,
                assumptions: DataFrame | None = None) -> DataFrame:
    """Every edge of a run: document to source, reported fact to document, derived fact to inputs, analytic to facts
    and analytics, forecast to values, facts and assumptions, assumption to the facts it was measured on."""
    parts = [
        documents.select(F.col("document_id").alias("child"), F.concat(F.lit("src:"), "source").alias("parent")),
        facts.filter("provenance = 'reported'").select(F.col("fact_id").alias("child"), F.col("document_id").alias("parent")),
        edges_from(facts.filter("provenance = 'derived'"), "fact_id", F.col("inputs")),
    ]
    if analytics is not None:
        parts.append(edges_from(analytics, "value_id", F.concat("input_fact_ids", "input_value_ids")))
    assumption_node = F.concat(F.lit("asm:"), "company_id", F.lit(":"), "key")
    if assumptions is not None:
        parts.append(edges_from(assumptions, assumption_node, F.col("source_fact_ids")))
        parts.append(assumptions.filter("source_document_id IS NOT NULL").select(assumption_node.alias("child"), F.col("source_document_id").alias("parent")))
    if forecast is not None:
        named = F.transform("assumption_ids", lambda k: F.concat(F.lit("asm:"), F.col("company_id"), F.lit(":"), k))
        parts.append(edges_from(forecast, "value_id", F.concat("input_value_ids", "input_fact_ids", named)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.distinct()


def conflicting_nodes(nodes: DataFrame) -> DataFrame:
    """Node ids defined in more than one way. Definitions are compared by hash, which also combines map-side."""
    attributes = F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    definition = F.xxhash64("kind", "label", F.array_join(attributes, "|"))
    return nodes.groupBy("node_id").agg(F.min(definition).alias("a"), F.max(definition).alias("b")).filter("a <> b").select("node_id")


def reach(start: DataFrame, edges: DataFrame, *, up: bool = True, max_depth: int | None = None) -> DataFrame:
    """(origin, node, depth): every node reachable from each origin, with the shortest distance. start: (origin, node).

    Following edges up means towards sources. Each node's set is built once, from those of the nodes next to it, however
    many origins there are above it; only the sets of nodes that are asked for are given to origins. Nodes on cycles, and
    those that lead into one, have no order to be built in and are walked from the origins that start there.
    """
    here, there = ("child", "parent") if up else ("parent", "child")
    links = edges.select(F.col(here).alias("node"), F.col(there).alias("next")).distinct()
    near = reached(start.select("node"), links, max_depth)
    own = stage(links.join(near, "node", "left_semi"), "links")
    sets, rest = _layered(own)
    within = sets if max_depth is None else sets.filter(F.col("depth") <= max_depth)
    found = start.select("origin", F.col("node").alias("at")).join(within.withColumnRenamed("node", "at"), "at")
    found = found.groupBy("origin", F.col("to").alias("node")).agg(F.min("depth").alias("depth"))
    if rest is None:
        return found
    circling = stage(start.select("origin", "node").join(rest.select("node").distinct(), "node", "left_semi"), "circling")
    walked = _walked(circling, own, max_depth)
    return found.unionByName(walked).groupBy("origin", "node").agg(F.min("depth").alias("depth"))


def reached(heads: DataFrame, links: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node): the heads (node) and all that can be reached from any of them over links (node, next); each node moves once."""
    new = stage(heads.select("node").distinct(), "reached")
    seen, depth = new, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = stage(new.join(links, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti"), "reached")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def _layered(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Sets (node, to, depth) of all that nodes reach over links (node, next), and the links of nodes on or above a cycle.

    A layer is the nodes all of whose next ones are done; it takes their sets over its links. Of the sets done only those
    that are still asked for are joined again.
    """
    waiting = links
    layers: list[DataFrame] = []
    while True:
        blocked = waiting.join(waiting.select(F.col("node").alias("next")).distinct(), "next", "left_semi").select("node").distinct()
        blocked = stage(blocked, "blocked")
        ready = stage(waiting.join(blocked, "node", "left_anti"), "ready")
        if ready.isEmpty():
            break
        new = ready.select("node", F.col("next").alias("to"), F.lit(1).alias("depth"))
        if layers:
            asked = ready.select("next").distinct()
            known = layers[0]
            for layer in layers[1:]:
                known = known.unionByName(layer)
            passed = ready.join(known.withColumnRenamed("node", "next").join(asked, "next", "left_semi"), "next").select("node", "to", (F.col("depth") + 1).alias("depth"))
            new = new.unionByName(passed)
        layers.append(stage(new.groupBy("node", "to").agg(F.min("depth").alias("depth")), "layer"))
        waiting = stage(waiting.join(blocked, "node", "left_semi"), "waiting")
    if not layers:
        return links.select("node", F.col("next").alias("to"), F.lit(0).alias("depth")).filter("false"), None if waiting.isEmpty() else waiting
    sets = layers[0]
    for layer in layers[1:]:
        sets = sets.unionByName(layer)
    return sets, None if waiting.isEmpty() else waiting


def _walked(start: DataFrame, links: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(origin, node, depth) by moving every origin's frontier; ends when a level finds nothing new, so cycles do no harm."""
    levels: list[DataFrame] = []
    frontier, seen, depth = start.select("origin", "node"), None, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(links, "node").select("origin", F.col("next").alias("node")).distinct()
        if seen is not None:
            found = found.join(seen, ["origin", "node"], "left_anti")
        level = stage(found.withColumn("depth", F.lit(depth)), "frontier")
        if level.isEmpty():
            break
        levels.append(level)
        frontier = level.select("origin", "node")
        seen = frontier if seen is None else seen.unionByName(frontier)
    if not levels:
        return start.select("origin", "node", F.lit(0).alias("depth")).filter("false")
    result = levels[0]
    for level in levels[1:]:
        result = result.unionByName(level)
    return result


def ancestors(origins: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """origins: (origin). Every ancestor of each."""
    return reach(origins.select("origin", F.col("origin").alias("node")), edges, max_depth=max_depth)


def root_paths(origins: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, path): every path from an origin to a root, origin first, however long. For single values a reader asks
    about; the number of paths can grow with the graph, so whole-graph questions use `reach` instead. A path that comes
    back to one of its own nodes is an error."""
    links = edges.select(F.col("child").alias("tip"), F.col("parent").alias("next"))
    open_paths = origins.select("origin", F.col("origin").alias("tip"), F.array("origin").alias("path"))
    closed = None
    while True:
        stepped = stage(open_paths.join(links, "tip", "left"), "paths")
        back = stepped.filter(F.array_contains("path", F.col("next"))).select("next").first()
        if back:
            raise RuntimeError(f"the graph has a cycle through {back.next}")
        done = stepped.filter("next IS NULL").select("origin", "path")
        closed = done if closed is None else closed.unionByName(done)
        open_paths = stepped.filter("next IS NOT NULL").select("origin", F.col("next").alias("tip"), F.concat("path", F.array("next")).alias("path"))
        if open_paths.isEmpty():
            return closed


def broken_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with some path that ends in a root that is neither a source nor an assumption: such roots and everything
    built on them. One walk down from all bad roots together, without enumerating paths."""
    roots = nodes.join(edges.select(F.col("child").alias("node_id")).distinct(), "node_id", "left_anti")
    bad = stage(roots.filter(~F.col("kind").isin(*LEGITIMATE_ROOTS)).select("node_id"), "bad-roots")
    return reached(bad.select(F.col("node_id").alias("node")), edges.select(F.col("parent").alias("node"), F.col("child").alias("next"))).withColumnRenamed("node", "node_id")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle or leading into one.

    Nodes that nobody rests on are set aside first, and again as long as that takes half of the edges: no other node
    depends on them, and they lead into a cycle where one of their parents does. Most edges move once for that.
    """
    levels = [stage(edges.select("child", "parent"), "edges")]
    size = levels[0].count()
    while size:
        inner = stage(levels[-1].join(levels[-1].select(F.col("parent").alias("child")).distinct(), "child", "left_semi").distinct(), "inner")
        before, size = size, inner.count()
        levels.append(inner)
        if 2 * size > before:
            break
    if not size:
        return levels[-1].select(F.col("child").alias("node_id"))
    found = _circling(levels.pop())
    for level in reversed(levels):
        # A node leads into a cycle if and only if a parent of it does, so the level's children are all there is to add.
        found = level.join(found.select(F.col("node_id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node_id")).distinct()
        found = stage(found, "cyclic")
    return found


def _circling(edges: DataFrame) -> DataFrame:
    """`cyclic_nodes` by peeling from the parents' side.

    Nodes whose parents are all settled go, and with them their edges; a node with a single parent left shares its fate
    and is bridged, chains of any length at once by doubling; a node over a known cycle is known too. Only edges of nodes
    that are still open are written again. When a round changes nothing, every open node has an open parent: all are
    above cycles. A known node is held as an edge to itself.
    """
    left = edges
    bridged: list[DataFrame] = []
    before = None
    while True:
        live = stage(left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent"), "live")
        known = live.filter("child = parent").select(F.col("child").alias("parent")).distinct()
        above = live.join(known, "parent", "left_semi").select("child").distinct()
        left = stage(live.join(above, "child", "left_anti").unionByName(above.select("child", F.col("child").alias("parent"))), "open")
        single = stage(left.groupBy("child").agg(F.count("*").alias("n"), F.first("parent").alias("parent")).filter("n = 1 and child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("to")), "single")
        ends, looped = _bridged(single)
        bridged.append(ends)
        rest = left.join(single.select(F.col("node").alias("child")), "child", "left_anti")
        over = ends.select(F.col("node").alias("parent"), "to")
        left = stage(rest.join(over, "parent", "left").select("child", F.coalesce("to", "parent").alias("parent")).unionByName(looped.select(F.col("node").alias("child"), F.col("node").alias("parent"))).distinct(), "open")
        now = left.agg(F.count("*"), F.count_if(F.col("child") == F.col("parent"))).first()
        if tuple(now) == before or not now[0]:
            break
        before = tuple(now)
    found = left.select(F.col("child").alias("node_id")).distinct()
    for ends in reversed(bridged):
        found = stage(found.unionByName(ends.join(found.select(F.col("node_id").alias("to")), "to", "left_semi").select(F.col("node").alias("node_id"))), "cyclic")
    return found


def _bridged(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From single (node, to), one row a node: where each chain of them ends (node, to), and (node) of those that never do.

    In every step an open chain takes the way of the node it has come to, so steps double. The links of a chain that ends
    have every distance to its end up to its own, so while there are any, each step ends some; when one ends none, all
    that are open run in circles.
    """
    open_, ended = single, []
    while True:
        onward = open_.select(F.col("node").alias("to"), F.col("to").alias("next"))
        # Chains that come to an ended one end where it does.
        for e in ended:
            onward = onward.unionByName(e.select(F.col("node").alias("to"), F.col("to").alias("next")))
        stepped = stage(open_.join(onward, "to", "left").select("node", "to", "next"), "stepped")
        ended.append(stepped.filter("next is null").select("node", "to"))
        open_ = stepped.filter("next is not null").select("node", F.col("next").alias("to"))
        of, done = stepped.agg(F.count("*"), F.count_if(F.col("next").isNull())).first()
        if not done or done == of:
            break
    result = single.filter("false")
    for e in ended:
        result = result.unionByName(e)
    return result, open_.select("node")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose parent is not a known node: facts citing unregistered documents, derivations of unknown inputs."""
    return edges.join(nodes.select(F.col("node_id").alias("parent")), "parent", "left_anti").select("child", "parent")


def facts_under(values: DataFrame) -> DataFrame:
    """Analytic values with the facts under them, directly or through other analytics of any depth (`fact_ids`).

    Only values that stand on other values walk; where none does, the first step finds nothing and the walk ends.
    """
    shown = ["company_id", "analytic_id", "fiscal_year", "value", "fact_ids"]
    direct = values.select("value_id", F.explode("input_fact_ids").alias("fact_id"))
    links = edges_from(values, "value_id", F.col("input_value_ids"))
    nested = values.filter("size(input_value_ids) > 0")
    walked = reach(nested.select(F.col("value_id").alias("origin"), F.col("value_id").alias("node")), links)
    through = walked.join(direct, walked.node == direct.value_id).select(F.col("origin").alias("value_id"), "fact_id")
    facts = direct.unionByName(through).groupBy("value_id").agg(F.array_sort(F.collect_set("fact_id")).alias("fact_ids"))
    return values.join(facts, "value_id").select(*shown)


def source_urls(origins: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, url): the sources a value finally rests on."""
    found = ancestors(origins, edges).join(nodes.filter("kind = 'source'").select(F.col("node_id").alias("node"), "label"), "node")
    return found.select("origin", F.col("label").alias("url")).distinct()


def trace(origins: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ancestor rows per origin with kind, depth and root flag: the whole trace."""
    found = ancestors(origins, edges).join(nodes.withColumnRenamed("node_id", "node"), "node")
    roots = found.join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti").select("node").distinct().withColumn("is_root", F.lit(True))
    return found.join(roots, "node", "left").withColumn("is_root", F.coalesce("is_root", F.lit(False))).drop("attributes")


def trace_page(traced: DataFrame, nodes_shown: int) -> DataFrame:
    """The nearest rows of each trace, for a reader who asked for a page; `truncated` says when there is more."""
    from pyspark.sql import Window

    per = Window.partitionBy("origin")
    ranked = traced.withColumn("place", F.row_number().over(per.orderBy("depth", "node"))).filter(F.col("place") <= nodes_shown + 1)
    return ranked.withColumn("truncated", F.max("place").over(per) > nodes_shown).filter(F.col("place") <= nodes_shown).drop("place")


def integrity_violations(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """(rule, fact_id, missing): reported facts of unknown documents and derived facts of unknown inputs."""
    reported = facts.filter("provenance = 'reported'").join(documents.select("document_id"), "document_id", "left_anti")
    inputs = facts.filter("provenance = 'derived'").select("fact_id", F.explode("inputs").alias("missing"))
    unknown = inputs.join(facts.select(F.col("fact_id").alias("missing")), "missing", "left_anti")
    return reported.select(F.lit("unknown_document").alias("rule"), "fact_id", F.col("document_id").alias("missing")).unionByName(
        unknown.select(F.lit("unknown_input").alias("rule"), "fact_id", "missing")
    )
