"""Lineage graphs made of the tables' own keys, and of facts and analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, lineage
from ..session import stage
from .common import annual, sql
from .facts_set import _SWING, _events


def _key(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _tables(spark, sf):
    return {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("region", "nation", "customer", "supplier", "orders")}


def _graph(spark, sf):
    """Customers and suppliers rest on nations, nations on regions; a customer also rests on its market segment, which
    was declared. Region 3 has no legitimate root behind it."""
    t = _tables(spark, sf)
    node = lineage.simple_nodes
    nodes = (
        node(t["customer"], _key("c", "c_custkey"), "fact", "c_name").unionByName(node(t["supplier"], _key("s", "s_suppkey"), "fact", "s_name"))
        .unionByName(node(t["nation"], _key("n", "n_nationkey"), "document", "n_name"))
        .unionByName(node(t["region"].filter("r_regionkey <> 3"), _key("r", "r_regionkey"), "source", "r_name"))
        .unionByName(node(t["region"].filter("r_regionkey = 3"), _key("r", "r_regionkey"), "document", "r_name"))
        .unionByName(node(t["customer"], F.concat(F.lit("m"), "c_mktsegment"), "assumption", "c_mktsegment"))
    )
    edge = lambda df, child, parent: df.select(child.alias("child"), parent.alias("parent"))
    edges = (
        edge(t["customer"], _key("c", "c_custkey"), _key("n", "c_nationkey")).unionByName(edge(t["customer"], _key("c", "c_custkey"), F.concat(F.lit("m"), "c_mktsegment")))
        .unionByName(edge(t["supplier"], _key("s", "s_suppkey"), _key("n", "s_nationkey"))).unionByName(edge(t["nation"], _key("n", "n_nationkey"), _key("r", "n_regionkey")))
    )
    return nodes, edges


def _customers(spark, sf):
    return _tables(spark, sf)["customer"].select(_key("c", "c_custkey").alias("origin"))


def lineage_ancestors(spark, sf):
    return lineage.ancestors(_customers(spark, sf), _graph(spark, sf)[1])


_EDGES = """WITH RECURSIVE edges AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'c' || c_custkey, 'm' || c_mktsegment FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
LINEAGE_ANCESTORS = _EDGES + """,
up AS (SELECT 'c' || c_custkey AS origin, 'c' || c_custkey AS node, 0 AS depth FROM customer UNION ALL SELECT origin, parent, depth + 1 FROM up JOIN edges ON child = node)
SELECT origin, node, min(depth) AS depth FROM up WHERE depth > 0 GROUP BY 1, 2
"""


def lineage_broken(spark, sf):
    nodes, edges = _graph(spark, sf)
    return lineage.broken_nodes(nodes, edges)


LINEAGE_BROKEN = _EDGES + """,
down AS (SELECT 'r3' AS node_id UNION SELECT child FROM down JOIN edges ON parent = node_id)
SELECT DISTINCT node_id FROM down
"""


def root_paths(spark, sf):
    found = lineage.root_paths(_customers(spark, sf), _graph(spark, sf)[1])
    return found.select("origin", F.array_join("path", " < ").alias("path"))


ROOT_PATHS = """
SELECT 'c' || c_custkey AS origin, 'c' || c_custkey || ' < n' || n_nationkey || ' < r' || n_regionkey AS path FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'c' || c_custkey, 'c' || c_custkey || ' < m' || c_mktsegment FROM customer
"""


def source_urls(spark, sf):
    nodes, edges = _graph(spark, sf)
    return lineage.source_urls(_customers(spark, sf), nodes, edges)


SOURCE_URLS = """
SELECT 'c' || c_custkey AS origin, r_name AS url FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey <> 3
"""


def trace_rows(spark, sf):
    nodes, edges = _graph(spark, sf)
    return lineage.trace(_customers(spark, sf), nodes, edges).select("origin", "node", "kind", "depth", "is_root")


TRACE = _EDGES + """
SELECT 'c' || c_custkey AS origin, x.node, x.kind, x.depth, x.root AS is_root FROM customer JOIN nation ON n_nationkey = c_nationkey
CROSS JOIN LATERAL (SELECT 'm' || c_mktsegment AS node, 'assumption' AS kind, 1 AS depth, true AS root UNION ALL SELECT 'n' || c_nationkey, 'document', 1, false
  UNION ALL SELECT 'r' || n_regionkey, CASE n_regionkey WHEN 3 THEN 'document' ELSE 'source' END, 2, true) x
"""


def _cyclic_edges(spark, sf):
    t = _tables(spark, sf)
    c = F.col("c_custkey")
    n = t["customer"].agg(F.max("c_custkey").alias("top"))
    doubled = t["customer"].join(F.broadcast(n), c * 2 <= F.col("top")).filter("c_custkey > 0").select(_key("c", "c_custkey").alias("child"), F.concat(F.lit("c"), (c * 2).cast("string")).alias("parent"))
    looped = t["customer"].filter("c_custkey % 50 = 0").select(F.explode(F.array(
        F.struct(_key("c", "c_custkey").alias("child"), _key("d", "c_custkey").alias("parent")), F.struct(_key("d", "c_custkey").alias("child"), _key("c", "c_custkey").alias("parent")))).alias("e")).select("e.*")
    return t["orders"].select(_key("o", "o_orderkey").alias("child"), _key("c", "o_custkey").alias("parent")).unionByName(doubled).unionByName(looped)


def cyclic_nodes(spark, sf):
    return lineage.cyclic_nodes(_cyclic_edges(spark, sf))


CYCLIC = """
WITH RECURSIVE edges AS (SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'c' || (2 * c_custkey) FROM customer WHERE c_custkey > 0 AND 2 * c_custkey <= (SELECT max(c_custkey) FROM customer)),
hit AS (SELECT 'c' || c_custkey AS node_id FROM customer WHERE c_custkey % 50 = 0 UNION SELECT child FROM hit JOIN edges ON parent = node_id)
SELECT node_id FROM hit UNION SELECT 'd' || c_custkey FROM customer WHERE c_custkey % 50 = 0
"""


def dangling_edges(spark, sf):
    t = _tables(spark, sf)
    nodes = t["customer"].filter("c_custkey % 10 <> 0").select(_key("c", "c_custkey").alias("node_id"))
    edges = t["orders"].select(_key("o", "o_orderkey").alias("child"), _key("c", "o_custkey").alias("parent"))
    return lineage.dangling_edges(nodes, edges)


DANGLING = "SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)"


def conflicting_nodes(spark, sf):
    c = _tables(spark, sf)["customer"]
    first = lineage.simple_nodes(c, _key("c", "c_custkey"), "fact", "c_name")
    again = lineage.simple_nodes(c, _key("c", "c_custkey"), "fact", F.when(F.col("c_custkey") % 25 == 0, "renamed").otherwise(F.col("c_name")))
    return lineage.conflicting_nodes(first.unionByName(again))


CONFLICTING = "SELECT 'c' || c_custkey AS node_id FROM customer WHERE c_custkey % 25 = 0"


def analytic_sources(spark, sf):
    """Ancestors of every growth value: its facts, their document and the document's source."""
    facts = stage(annual(spark, sf, ["revenue"], ("gap",), formulas=False), "facts")
    gated = facts.withColumn("blocked", F.lit(None).cast("string")).withColumn("flags", F.array().cast("array<string>"))
    from .common import frameworks

    values = stage(analytics.analytic_values(analytics.analytic_events(analytics.annual_frame(gated), frameworks(), ["revenue_growth"])), "values")
    documents = facts.select("document_id", F.concat(F.lit("companyfacts:"), "company_id").alias("source")).distinct()
    edges = stage(lineage.build_edges(documents, facts, values), "edges")
    found = lineage.ancestors(values.select(F.col("value_id").alias("origin")), edges)
    return found.join(values.select(F.col("value_id").alias("origin"), "company_id", "fiscal_year"), "origin").groupBy("company_id", "fiscal_year").agg(F.count("*").alias("ancestors"), F.max("depth").alias("depth"))


ANALYTIC_SOURCES = sql(
    """
SELECT company_id, y AS fiscal_year, 4 AS ancestors, 3 AS depth FROM (SELECT company_id, y, v, lag(v) OVER w AS pv, lag(y) OVER w AS py FROM revgap WINDOW w AS (PARTITION BY company_id ORDER BY y))
WHERE py = y - 1 AND pv > 0 AND v > 0
"""
)


def facts_under_analytic(spark, sf):
    events = stage(_events(spark, sf, ["operating_income", "income_tax_expense", "pre_tax_income"], ["nopat"]), "events")
    found = lineage.facts_under(analytics.analytic_values(events))
    return found.select("company_id", "analytic_id", "fiscal_year", F.size("fact_ids").alias("n_facts"))


FACTS_UNDER = sql(
    "SELECT company_id, m.m AS analytic_id, y AS fiscal_year, m.n AS n_facts FROM ann CROSS JOIN (VALUES ('effective_tax_rate', 2), ('nopat', 3)) m(m, n) WHERE net - disc > 0", _SWING
)

QUERIES = {
    "lineage_ancestors": (lineage_ancestors, LINEAGE_ANCESTORS),
    "lineage_broken": (lineage_broken, LINEAGE_BROKEN),
    "root_paths": (root_paths, ROOT_PATHS),
    "source_urls": (source_urls, SOURCE_URLS),
    "trace_rows": (trace_rows, TRACE),
    "cyclic_nodes": (cyclic_nodes, CYCLIC),
    "dangling_edges": (dangling_edges, DANGLING),
    "conflicting_nodes": (conflicting_nodes, CONFLICTING),
    "analytic_sources": (analytic_sources, ANALYTIC_SOURCES),
    "facts_under_analytic": (facts_under_analytic, FACTS_UNDER),
}
