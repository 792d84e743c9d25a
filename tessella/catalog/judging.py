"""Queries on variants, attributions, costs and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.catalog.draws import DRAWS, picks_sql, uniform_sql
from tessella.catalog.structure import _N, nodes
from tessella.operators import graph, judging, labels, ranges, resampling, variants
from tessella.views import predictions, read, reviews, snippets, with_views

_P = with_views("predictions")
_V = with_views("reviews")


@query(_P + """, c AS (SELECT seed, y, least(1 - 1e-6, greatest(1e-6, prob)) AS p, least(1 - 1e-6, greatest(1e-6, prob2)) AS q, prob >= 0.5 AS a, prob2 >= 0.5 AS b FROM predictions WHERE part = 'test')
  SELECT seed, count(*) AS n, round(avg(CASE WHEN a = (y = 1) AND b <> (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS right_to_wrong, round(avg(CASE WHEN a <> (y = 1) AND b = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS wrong_to_right,
  round(avg(CASE WHEN NOT a AND b THEN 1.0 ELSE 0.0 END), 6) AS up, round(avg(CASE WHEN a AND NOT b THEN 1.0 ELSE 0.0 END), 6) AS down, round(avg(ln(q / (1 - q)) - ln(p / (1 - p))), 4) AS logit_change FROM c GROUP BY seed""")  # fmt: skip
def variant_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judging.flips(predictions(spark, sf_dir).where("part = 'test'"), ["seed"], "prob", "prob2")
    return out.withColumns({c: F.round(c, 6) for c in ("right_to_wrong", "wrong_to_right", "up", "down")} | {"logit_change": F.round("logit_change", 4)})


# a line of a text scores by its length; every third line is marked
@query(r"""WITH l AS (SELECT lang, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
  s AS (SELECT lang, doc_id, n, CAST(length(line) % 17 AS DOUBLE) - 4 AS s, n % 3 = 0 AS m FROM l),
  t AS (SELECT *, row_number() OVER (PARTITION BY lang, doc_id ORDER BY s DESC, n) AS r FROM s),
  i AS (SELECT lang, doc_id, count(*) AS n, count(*) FILTER (m) AS k, sum(greatest(s, 0)) AS a, sum(CASE WHEN m THEN greatest(s, 0) ELSE 0 END) AS o, max(CASE WHEN m THEN 1.0 ELSE 0.0 END) FILTER (r = 1) AS h FROM t GROUP BY lang, doc_id),
  g AS (SELECT lang, count(*) AS items, avg(coalesce(o / nullif(a, 0), 0)) AS mass, avg(k / n) AS share, avg(h) AS pointing FROM i WHERE n >= 3 AND k > 0 GROUP BY lang)
  SELECT lang, items, round(mass, 6) AS mass, round(share, 6) AS share, round(pointing, 6) AS pointing, round(mass / share, 6) AS lift FROM g""")  # fmt: skip
def localization_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("lang", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    marked = lines.withColumns({"score": (F.char_length("line") % 17).cast("double") - 4, "marked": F.col("line_no") % 3 == 0})
    return judging.localization(marked, ["lang"], "doc_id").withColumns({c: F.round(c, 6) for c in ("mass", "share", "pointing", "lift")})


@query("""SELECT event_type, count(*) AS n, round(median(value), 6) AS median_seconds, round(sum(value), 4) AS seconds, round(sum(length(props)) / sum(value), 6) AS tokens_per_second FROM events GROUP BY event_type""")
def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("tokens", F.char_length("props"))
    out = judging.costs(rows, ["event_type"], "value", "tokens")
    return out.withColumns({"median_seconds": F.round("median_seconds", 6), "seconds": F.round("seconds", 4), "tokens_per_second": F.round("tokens_per_second", 6)})


@query("""SELECT l_suppkey, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS alerts, round(1000 * (count(*) FILTER (l_returnflag = 'R')) / sum(l_quantity), 6) AS per_kloc, round(10000 * (count(*) FILTER (l_returnflag = 'R')) / sum(l_quantity), 6) AS per_10kloc,
  round(100 * (count(*) FILTER (l_returnflag = 'R')) / count(*), 6) AS per_100_units FROM lineitem GROUP BY l_suppkey""")  # fmt: skip
def alert_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumns({"a": (F.col("l_returnflag") == "R").cast("long"), "u": F.lit(1)})
    return judging.alert_rates(rows, ["l_suppkey"], "a", "l_quantity", "u").withColumns({c: F.round(c, 6) for c in ("per_kloc", "per_10kloc", "per_100_units")})


@query(_V + """, c AS (SELECT smell, sample, count(*) AS v FROM reviews GROUP BY smell, sample), r AS (SELECT *, row_number() OVER (PARTITION BY smell ORDER BY v DESC, sample) AS r FROM c)
  SELECT smell, count(*) AS n, round(sum(CASE WHEN r <= 5 THEN v ELSE 0 END) / sum(v), 6) AS top_share FROM r GROUP BY smell""")  # fmt: skip
def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reviews(spark, sf_dir).groupBy("smell", "sample").agg(F.count("*").alias("v"))
    return judging.top_share(counts, "smell", "v", "sample", 5).withColumn("top_share", F.round("top_share", 6))


# spans of ten orders; a lineitem's order is the point
@query("""WITH s AS (SELECT o_custkey % 50 AS g, o_orderkey AS a, o_orderkey + o_custkey % 37 AS b FROM orders), p AS (SELECT DISTINCT o_custkey % 50 AS g, o_orderkey + 3 AS x FROM orders),
  j AS (SELECT p.g, p.x, s.a, s.b, row_number() OVER (PARTITION BY p.g, p.x ORDER BY s.b - s.a, s.a) AS n FROM p LEFT JOIN s ON s.g = p.g AND p.x BETWEEN s.a AND s.b)
  SELECT g, x, a AS span_start, b AS span_end FROM j WHERE n = 1""")  # fmt: skip
def innermost_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    spans = orders.select((F.col("o_custkey") % 50).alias("g"), F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + F.col("o_custkey") % 37).alias("b"))
    points = orders.select((F.col("o_custkey") % 50).alias("g"), (F.col("o_orderkey") + 3).alias("x")).distinct()
    return ranges.innermost(points, spans, "g", "x", "a", "b")


@query(_V + """, k AS (SELECT *, row_number() OVER (PARTITION BY sample, smell ORDER BY ts, id) AS n FROM reviews WHERE severity IS NOT NULL),
  u AS (SELECT smell, sample, max(severity) FILTER (n = 1) > 0 AS f, list_sort(list(severity)) AS s FROM k GROUP BY smell, sample), t AS (SELECT smell, f, s[len(s) // 2 + 1] > 0 AS y FROM u)
  SELECT smell, count(*) AS reviewed_units, count(*) FILTER (f) AS first_above_none, count(*) FILTER (f AND y) AS kept, count(*) FILTER (NOT f AND y) AS raised, round(count(*) FILTER (f) / count(*), 6) AS first_rate, round(count(*) FILTER (y) / count(*), 6) AS final_rate FROM t GROUP BY smell""")  # fmt: skip
def first_review_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = labels.first_reviews(reviews(spark, sf_dir))
    first, final = F.col("first") > 0, F.col("y") == 1
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return units.groupBy("smell").agg(F.count("*").alias("reviewed_units"), F.count_if(first).alias("first_above_none"), F.count_if(first & final).alias("kept"), F.count_if(~first & final).alias("raised"), share(first).alias("first_rate"), share(final).alias("final_rate"))


@query(_V + """, u AS (SELECT sample, smell, least(count(*), 10) AS n, list_sort(list(severity) FILTER (severity IS NOT NULL)) AS s FROM reviews GROUP BY sample, smell)
  SELECT n AS reviews, count(*) AS units, count(*) FILTER (coalesce(s[len(s) // 2 + 1], 0) > 0) AS positives FROM u GROUP BY n""")  # fmt: skip
def rate_by_review_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = labels.unit_labels(reviews(spark, sf_dir))
    return units.groupBy(F.least(F.lit(10), F.col("votes")).alias("reviews")).agg(F.count("*").alias("units"), F.sum("y").cast("long").alias("positives"))


@query(_N + """, d AS (SELECT page_id, depth, count(*) AS n FROM n GROUP BY page_id, depth), r AS (SELECT page_id, max(depth) AS max_nesting, sum(n) AS nodes FROM d GROUP BY page_id)
  SELECT max_nesting, count(*) AS graphs, CAST(sum(nodes) AS BIGINT) AS nodes FROM r GROUP BY max_nesting""")  # fmt: skip
def nesting_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = nodes(spark, sf_dir).groupBy("page_id").agg(F.max("depth").alias("max_nesting"), F.count("*").alias("n"))
    return per.groupBy("max_nesting").agg(F.count("*").alias("graphs"), F.sum("n").alias("nodes"))


@query(_N + """ SELECT a.page_id, a.node_index, coalesce(min(b.node_index), (SELECT max(x.node_index) + 1 FROM n x WHERE x.page_id = a.page_id)) - a.node_index AS size
  FROM n a LEFT JOIN n b ON b.page_id = a.page_id AND b.node_index > a.node_index AND b.depth <= a.depth GROUP BY a.page_id, a.node_index""")  # fmt: skip
def subtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = graph.subtree_ends(nodes(spark, sf_dir), "page_id")
    return ends.select("page_id", "node_index", (F.col("end") - F.col("node_index")).alias("size"))


@query()
def variant_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transform on every text, counted by level and in all."""
    rows = snippets(spark, sf_dir)
    outcome = F.explode(F.array(*[F.struct(F.lit(name).alias("transform"), variants.transform(name)("code").alias("v")) for name in sorted(variants.TRANSFORMS)])).alias("x")
    each = rows.select("level", outcome).select("level", "x.transform", F.col("x.v.status").alias("status"))
    return each.groupingSets([["level", "transform", "status"], ["transform", "status"]], "level", "transform", "status").agg(F.count("*").alias("n"))


@query(_P + """, units AS (SELECT seed, k1, count(*) FILTER ((prob >= 0.5) = (y = 1)) AS hits, count(*) AS k FROM predictions WHERE part = 'test' GROUP BY seed, k1), """ + picks_sql("units", ["seed"], "k1", 100)
  + """, v AS (SELECT seed, draw, sum(hits * times) / sum(k * times) AS v FROM drawn GROUP BY seed, draw), p AS (SELECT seed, sum(hits) / sum(k) AS value FROM units GROUP BY seed)
  SELECT p.seed, round(max(p.value), 6) AS value, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS draws FROM p JOIN v ON v.seed = p.seed GROUP BY p.seed""")  # fmt: skip
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each seed's predictions with an interval over draws of whole orders."""
    rows = predictions(spark, sf_dir).where("part = 'test'").select("seed", "k1", ((F.col("prob") >= 0.5) == (F.col("y") == 1)).cast("long").alias("right"), F.lit(1).cast("long").alias("n"))
    out = resampling.bootstrap(rows, ["seed"], "k1", ["right", "n"], F.col("right") / F.col("n"), 100)
    return out.withColumns({c: F.round(c, 6) for c in ("value", "low", "high")})


@query(_V + f""", r AS (SELECT id, sample, CASE WHEN severity > 0 THEN 1 ELSE 0 END AS v FROM reviews WHERE severity IS NOT NULL),
  e AS (SELECT d AS draw, id, sample, v, CASE WHEN d < 0 THEN 0 ELSE {uniform_sql(0, 'd', 'sample')} END AS u FROM r CROSS JOIN range(-1, {DRAWS}) t(d)),
  z AS (SELECT draw, v, sum(1 - v) OVER (PARTITION BY draw ORDER BY u, CASE WHEN draw < 0 THEN id ELSE 0 END, sample, id ROWS UNBOUNDED PRECEDING) AS z FROM e),
  l AS (SELECT draw, max(k) AS longest FROM (SELECT draw, z, count(*) AS k FROM z WHERE v = 1 GROUP BY draw, z) GROUP BY draw), o AS (SELECT longest AS observed FROM l WHERE draw < 0)
  SELECT observed, round((1 + count(*) FILTER (longest >= observed)) / (1 + count(*)), 6) AS p FROM l, o WHERE draw >= 0 GROUP BY observed""")  # fmt: skip
def run_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).where("severity is not null").select("sample", "id", (F.col("severity") > 0).cast("int").alias("v"))
    return resampling.permutation_p(resampling.block_permutation(rows, "sample", "id", "v", DRAWS)).withColumn("p", F.round("p", 6))


@query("""WITH RECURSIVE d AS (SELECT source AS g, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS place FROM documents),
  b AS (SELECT g, place AS begins, 0 AS batch, place + greatest(1, least(32, 100000 // greatest(n_chars, 1))) AS nxt FROM d WHERE place = 0
    UNION ALL SELECT d.g, d.place, b.batch + 1, d.place + greatest(1, least(32, 100000 // greatest(d.n_chars, 1))) FROM b JOIN d ON d.g = b.g AND d.place = b.nxt)
  SELECT d.g, d.doc_id, CAST(b.batch AS INTEGER) AS batch FROM d JOIN b ON b.g = d.g AND d.place >= b.begins AND d.place < b.nxt""")  # fmt: skip
def budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("g"), "doc_id", "n_chars")
    return ranges.budget_batches(rows, "g", "doc_id", "n_chars", 32, 100_000)


@query("""WITH s AS (SELECT o_custkey % 50 AS g, o_orderkey AS a, o_orderkey + o_custkey % 37 AS b FROM orders WHERE o_orderkey % 2 = 0), t AS (SELECT o_custkey % 50 AS g, o_orderkey AS a, o_orderkey + o_custkey % 41 AS b FROM orders WHERE o_orderkey % 2 = 1),
  j AS (SELECT s.g, s.a AS a_start, s.b AS a_end, t.a AS b_start, t.b AS b_end, (least(s.b, t.b) - greatest(s.a, t.a) + 1) / (greatest(s.b, t.b) - least(s.a, t.a) + 1) AS iou FROM s JOIN t ON t.g = s.g AND s.a <= t.b AND t.a <= s.b),
  r AS (SELECT *, row_number() OVER (PARTITION BY g, a_start, a_end ORDER BY iou DESC, b_start, b_end) AS r FROM j)
  SELECT g, a_start, a_end, b_start, b_end, round(iou, 6) AS iou FROM r WHERE r = 1""")  # fmt: skip
def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each even order's span the odd one's that overlaps it best."""
    orders = read(spark, sf_dir, "orders")
    spans = lambda parity, k: orders.where(F.col("o_orderkey") % 2 == parity).select((F.col("o_custkey") % 50).alias("g"), F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + F.col("o_custkey") % k).alias("b"))
    return ranges.best_overlap(spans(0, 37), spans(1, 41), "g", "a", "b").withColumn("iou", F.round("iou", 6))


@query("SELECT 'read' AS name, CAST(NULL AS VARCHAR) AS error, count(*) AS n FROM conversations WHERE role = 'assistant'")
def tool_call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in the assistant's turns, as a transcript would have them: every text is put into one."""
    text = F.concat(F.lit('<tool_call>{"name": "read", "arguments": {"chars": '), F.char_length("text").cast("string"), F.lit("}}</tool_call>"))
    calls = read(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.explode(judging.tool_calls(text)).alias("c"))
    return calls.groupBy("c.name", F.col("c.error").alias("error")).agg(F.count("*").alias("n"))
