"""Queries on markup trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.operators import graph
from tessella.views import read

_VOID = ", ".join(f"'{x}'" for x in graph.VOID)
_N = f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(lower(coalesce(html, '')), '</?[a-zA-Z][a-zA-Z0-9]*')) AS tag, generate_subscripts(regexp_extract_all(lower(coalesce(html, '')), '</?[a-zA-Z][a-zA-Z0-9]*'), 1) AS pos FROM pages),
  c AS (SELECT *, regexp_replace(tag, '^</?', '') AS name, CASE WHEN regexp_replace(tag, '^</?', '') IN ({_VOID}) THEN 0 WHEN starts_with(tag, '</') THEN -1 ELSE 1 END AS ch FROM t),
  o AS (SELECT *, sum(ch) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS op FROM c),
  n AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS node_index, name AS node_type, CAST(greatest(0, op - ch) AS BIGINT) AS depth FROM o WHERE NOT starts_with(tag, '</'))"""  # fmt: skip
_E = _N + """, e AS (SELECT b.page_id, max(a.node_index) AS src, b.node_index AS dst FROM n b JOIN n a ON a.page_id = b.page_id AND a.depth = b.depth - 1 AND a.node_index < b.node_index GROUP BY b.page_id, b.node_index)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tag_nodes(read(spark, sf_dir, "pages"), "page_id", "html")


@query(_N + " SELECT * FROM n")
def ast_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir)


@query(_N + " SELECT page_id, node_index AS src, dst FROM (SELECT page_id, node_index, lead(node_index) OVER (PARTITION BY page_id ORDER BY node_index) AS dst FROM n) WHERE dst IS NOT NULL")
def next_token_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.next_edges(nodes(spark, sf_dir), "page_id")


@query(_E + " SELECT * FROM e")
def child_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.child_edges(nodes(spark, sf_dir), "page_id")


@query(_N + """ SELECT page_id, node_index, round(node_index / greatest(1, max(node_index) OVER w), 6) AS x_position, round(depth / greatest(1, max(depth) OVER w), 6) AS x_depth,
  round(length(node_type) / greatest(1, max(length(node_type)) OVER w), 6) AS x_length FROM n WINDOW w AS (PARTITION BY page_id)""")  # fmt: skip
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_features(nodes(spark, sf_dir), "page_id").withColumns({c: F.round(c, 6) for c in ("x_position", "x_depth", "x_length")})


@query(_N + ", f AS (SELECT node_type, min(page_id * 1000000 + node_index) AS f, count(*) AS n FROM n GROUP BY node_type) SELECT node_type, row_number() OVER (ORDER BY f) - 1 AS type_id, n FROM f")
def node_type_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.type_ids(nodes(spark, sf_dir), "page_id")


@query(_E + """, p AS (SELECT n.page_id, n.node_index, count(e.src) AS parents FROM n LEFT JOIN e ON e.page_id = n.page_id AND e.dst = n.node_index GROUP BY n.page_id, n.node_index)
  SELECT page_id, count(*) FILTER (parents = 0) AS roots, count(*) FILTER (parents > 1) AS shared, max(node_index) + 1 - count(*) AS gaps FROM p GROUP BY page_id""")  # fmt: skip
def tree_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(spark, sf_dir)
    return graph.audit(found, graph.child_edges(found, "page_id"), "page_id")


@query(_E + """, u AS (SELECT * FROM e UNION ALL SELECT page_id, dst, src FROM e), g AS (SELECT u.page_id, u.dst AS node_index, avg(n.depth) AS got FROM u JOIN n ON n.page_id = u.page_id AND n.node_index = u.src GROUP BY u.page_id, u.dst),
  h AS (SELECT n.page_id, coalesce(got, 0.0) AS got FROM n LEFT JOIN g ON g.page_id = n.page_id AND g.node_index = n.node_index)
  SELECT page_id, round(avg(got), 6) AS mean, round(max(got), 6) AS max, round(sum(got), 4) AS sum, count(*) AS nodes FROM h GROUP BY page_id""")  # fmt: skip
def message_passing_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(spark, sf_dir)
    edges = graph.undirected(graph.child_edges(found, "page_id"), "page_id")
    out = graph.readout(graph.mean_hop(found, edges, "page_id", "depth"), "page_id", "got")
    return out.withColumns({"mean": F.round("mean", 6), "max": F.round("max", 6), "sum": F.round("sum", 4)})


@query(_E + """ SELECT count(*) AS nodes, count(DISTINCT page_id) AS graphs, max(depth) AS deepest, (SELECT count(*) FROM e) AS child_edges, (SELECT count(*) - count(DISTINCT page_id) FROM n) AS next_edges FROM n""")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(spark, sf_dir)
    edges = graph.child_edges(found, "page_id").agg(F.count("*").alias("child_edges"))
    told = found.agg(F.count("*").alias("nodes"), F.countDistinct("page_id").alias("graphs"), F.max("depth").alias("deepest"))
    after = graph.next_edges(found, "page_id").agg(F.count("*").alias("next_edges"))
    return told.join(F.broadcast(edges)).join(F.broadcast(after))
