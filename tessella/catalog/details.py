"""Queries on checked joins, spans, attributions, sessions and graph filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.catalog.structure import _E, nodes
from tessella.functions import scalar
from tessella.operators import graph, joins, judging, ranges, statistics, text
from tessella.views import read, reviews, snippets, with_views

_V = with_views("reviews")
_N = with_views("snippets")

_LOCATION = ["repo", "commit", "path", "start_line", "end_line"]


# a line item's order, part, supplier, number and quantity stand for its place; every third sample is in no review
@query("""WITH s AS (SELECT DISTINCT l_orderkey AS repo, l_partkey AS commit, l_suppkey AS path, l_linenumber AS start_line, CAST(l_quantity AS BIGINT) AS end_line FROM lineitem),
  r AS (SELECT l_orderkey AS repo, l_partkey AS commit, l_suppkey AS path, l_linenumber AS start_line, CAST(l_quantity AS BIGINT) + CASE WHEN l_orderkey % 3 = 0 THEN 1000 ELSE 0 END AS end_line FROM lineitem),
  j AS (SELECT s.repo IS NOT NULL AS linked FROM r LEFT JOIN s ON s.repo = r.repo AND s.commit = r.commit AND s.path = r.path AND s.start_line = r.start_line AND s.end_line = r.end_line)
  SELECT count(*) AS reviews, count(*) FILTER (linked) AS linked, count(*) FILTER (NOT linked) AS lost FROM j""")  # fmt: skip
def location_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews joined to samples by the five columns of their place; a place that two samples have is an error, reviews without a sample are counted."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("repo"), F.col("l_partkey").alias("commit"), F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("start_line"), F.col("l_quantity").cast("long").alias("end_line"))
    samples = joins.unique(rows.distinct(), _LOCATION).withColumn("_there", F.lit(1))
    moved = rows.withColumn("end_line", F.col("end_line") + F.when(F.col("repo") % 3 == 0, 1000).otherwise(0))
    both = moved.join(samples, _LOCATION, "left")
    return both.agg(F.count("*").alias("reviews"), F.count("_there").alias("linked"), F.count_if(F.col("_there").isNull()).alias("lost"))


@query(_N + """ SELECT CAST(json_index AS BIGINT) AS json_index, CASE WHEN json_index % 11 = 0 THEN 'level' ELSE 'y1' END AS columns FROM snippets WHERE json_index % 11 = 0 OR (json_index % 7 = 0 AND y1 IS NOT NULL)""")
def variant_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant entries that don't agree with their base in a field besides the code; nulls are equal."""
    base = snippets(spark, sf_dir).select(F.col("json_index").cast("long").alias("json_index"), "repo", "level", "y0", "y1")
    odd = F.col("json_index") % 11 == 0
    changed = base.withColumns({"level": F.when(odd, F.lit("other")).otherwise(F.col("level")), "y1": F.when(~odd & (F.col("json_index") % 7 == 0), F.col("y1") + 1).otherwise(F.col("y1"))})
    return joins.differences(base, changed, ["json_index"], ["repo", "level", "y0", "y1"]).select("json_index", "columns")


@query("""WITH m AS (SELECT o_custkey % 50 AS f, o_orderkey AS a, o_orderkey + 20 AS b FROM orders WHERE o_orderkey % 8 < 4), v AS (SELECT o_custkey % 50 AS f, o_orderkey + 5 AS line FROM orders),
  j AS (SELECT v.f, v.line, m.a, m.b, row_number() OVER (PARTITION BY v.f, v.line, v.n ORDER BY m.b - m.a, m.a) AS r FROM (SELECT *, row_number() OVER () AS n FROM v) v LEFT JOIN m ON m.f = v.f AND v.line BETWEEN m.a AND m.b)
  SELECT f, count(*) AS violations, count(a) AS inside, count(DISTINCT a) AS methods FROM j WHERE r = 1 GROUP BY f""")  # fmt: skip
def violations_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a file's violations lie inside a method, and in how many methods; lines that come twice count twice."""
    o = read(spark, sf_dir, "orders")
    file = (F.col("o_custkey") % 50).alias("f")
    spans = o.where("o_orderkey % 8 < 4").select(file, F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 20).alias("b"))
    found = ranges.innermost(o.select(file, (F.col("o_orderkey") + 5).alias("line")), spans, "f", "line", "a", "b")
    return found.groupBy("f").agg(F.count("*").alias("violations"), F.count("span_start").alias("inside"), F.countDistinct("span_start").alias("methods"))


@query("""WITH a AS (SELECT user_id, event_id % 50 AS item, ts, event_id, value, event_type FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, event_id DESC) AS r FROM a)
  SELECT event_type AS outcome, count(*) AS answers, round(sum(value), 4) AS value, (SELECT count(*) FROM a) - (SELECT count(*) FROM l WHERE r = 1) AS repeated FROM l WHERE r = 1 GROUP BY event_type""")  # fmt: skip
def last_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of each item's last attempt, and how many attempts were made again."""
    rows = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("item"), "ts", "event_id", "value", "event_type")
    last = judging.last_attempts(rows, ["user_id", "item"], ["ts", "event_id"])
    counts = rows.agg(F.count("*").alias("_all")).join(F.broadcast(last.agg(F.count("*").alias("_last"))))  # one row each
    out = last.groupBy(F.col("event_type").alias("outcome")).agg(F.count("*").alias("answers"), F.round(F.sum("value"), 4).alias("value"))
    return out.join(F.broadcast(counts)).select("outcome", "answers", "value", (F.col("_all") - F.col("_last")).alias("repeated"))


@query("""WITH s AS (SELECT DISTINCT doc_id, source FROM documents), d AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS answered FROM s GROUP BY source)
  SELECT source, n, answered, round(answered / n, 6) AS coverage FROM d""")  # fmt: skip
def answer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of samples of each repository that have an answer."""
    answered = read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("_a", F.lit(1))
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").distinct().join(answered, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("_a").alias("answered"), F.round(F.count("_a") / F.count("*"), 6).alias("coverage"))


# two attributions of a line: its length, and how many distinct letters its first ten characters have
@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc_id, length(line) AS a, length(line) % 7 AS b FROM l), k AS (SELECT doc_id, rank() OVER (PARTITION BY doc_id ORDER BY a) + (count(*) OVER (PARTITION BY doc_id, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY doc_id ORDER BY b) + (count(*) OVER (PARTITION BY doc_id, b) - 1) / 2 AS rb FROM s),
  r AS (SELECT doc_id, count(*) AS n, corr(ra, rb) AS rho FROM k GROUP BY doc_id HAVING count(*) >= 3)
  SELECT count(*) AS texts, count(rho) FILTER (NOT isnan(rho)) AS told, round(avg(rho) FILTER (NOT isnan(rho)), 6) AS mean_rho FROM r""", signed=("mean_rho",))  # fmt: skip
def attribution_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of two attributions over each text's lines, averaged over the texts that have one."""
    lines = text.lines(read(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")
    rows = lines.select("doc_id", F.char_length("line").alias("a"), (F.char_length("line") % 7).alias("b"))
    each = statistics.spearman(rows, ["doc_id"], "a", "b").where("n >= 3")
    return each.agg(F.count("*").alias("texts"), F.count("rho").alias("told"), F.round(F.avg("rho"), 6).alias("mean_rho"))


@query(_V + """, g AS (SELECT reviewer, ts, id, smell, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY reviewer ORDER BY ts, id)) AS gap FROM reviews), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY reviewer ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM g),
  k AS (SELECT reviewer, session, count(*) AS n, count(DISTINCT smell) AS smells FROM s GROUP BY reviewer, session)
  SELECT CASE WHEN n = 1 THEN 'single' WHEN smells = 1 THEN 'one smell' ELSE 'mixed' END AS kind, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS reviews FROM k GROUP BY kind""")  # fmt: skip
def session_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of reviewers (no gap above a day) by what they hold."""
    order = Window.partitionBy("reviewer").orderBy("ts", "id")
    gap = F.col("ts") - F.lag("ts").over(order)  # to the microsecond
    rows = reviews(spark, sf_dir).withColumn("_gap", gap)
    begun = F.sum(F.when(F.col("_gap").isNull() | (F.col("_gap") > F.expr("INTERVAL 1 DAY")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = rows.withColumn("session", begun).groupBy("reviewer", "session").agg(F.count("*").alias("n"), F.countDistinct("smell").alias("smells"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("smells") == 1, "one smell").otherwise("mixed").alias("kind")
    return each.groupBy(kind).agg(F.count("*").alias("sessions"), F.sum("n").alias("reviews"))


@query(_E + """, kept AS (SELECT page_id, node_index, row_number() OVER (PARTITION BY page_id ORDER BY node_index) - 1 AS new FROM n WHERE node_type NOT IN ('p', 'a')),
  linked AS (SELECT e.page_id, a.new AS src, b.new AS dst, 'Child' AS edge_type FROM e JOIN kept a ON a.page_id = e.page_id AND a.node_index = e.src JOIN kept b ON b.page_id = e.page_id AND b.node_index = e.dst)
  SELECT page_id, src, dst, edge_type FROM linked UNION ALL SELECT page_id, dst, src, 'Child_reverse' FROM linked""")  # fmt: skip
def filtered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nodes of wanted types, numbered anew, and their reverse as a type of its own."""
    found = nodes(spark, sf_dir)
    edges = graph.child_edges(found, "page_id").withColumn("edge_type", F.lit("Child"))
    _, kept = graph.filtered(found, edges, "page_id", F.col("node_type").isin("p", "a"))
    return graph.typed_reverse(kept, "page_id")


@query(_V + """, c AS (SELECT reviewer % 8 AS g, smell, count(*) AS n, count(*) FILTER (severity > 0) AS k FROM reviews WHERE severity IS NOT NULL GROUP BY reviewer % 8, smell), t AS (SELECT smell, sum(n) AS a, sum(k) AS p FROM c GROUP BY smell)
  SELECT c.smell, count(*) - 1 AS dof, round(sum(pow(k - n * p / a, 2) / (n * p / a) + pow((n - k) - n * (a - p) / a, 2) / (n * (a - p) / a)), 6) AS chi2, round(max(k / n) - min(k / n), 6) AS spread FROM c JOIN t ON t.smell = c.smell GROUP BY c.smell""")  # fmt: skip
def reviewer_heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether groups of reviewers see a smell at different rates: chi-square of each smell, and the spread of the rates."""
    counts = reviews(spark, sf_dir).where("severity is not null").groupBy("smell", (F.col("reviewer") % 8).alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("severity") > 0).alias("k"))
    total = counts.groupBy("smell").agg(F.sum("n").alias("a"), F.sum("k").alias("p"))
    one, zero = F.col("n") * F.col("p") / F.col("a"), F.col("n") * (F.col("a") - F.col("p")) / F.col("a")
    part = F.pow(F.col("k") - one, 2) / one + F.pow(F.col("n") - F.col("k") - zero, 2) / zero
    return counts.join(total, "smell").groupBy("smell").agg((F.count("*") - 1).alias("dof"), F.round(F.sum(part), 6).alias("chi2"), F.round(F.max(F.col("k") / F.col("n")) - F.min(F.col("k") / F.col("n")), 6).alias("spread"))


@query("""WITH b AS (SELECT p_size // 5 AS bin, CAST(substr(p_brand, 7, 1) AS INTEGER) % 2 AS y, p_retailprice AS v FROM part), w AS (SELECT a.bin, sum(CASE WHEN a.v > c.v THEN 1.0 WHEN a.v = c.v THEN 0.5 ELSE 0 END) AS wins, count(*) AS pairs FROM b a JOIN b c ON a.bin = c.bin AND a.y = 1 AND c.y = 0 GROUP BY a.bin)
  SELECT round(sum(wins) / sum(pairs), 6) AS matched_auc, CAST(sum(pairs) AS BIGINT) AS pairs, count(*) AS strata FROM w""")  # fmt: skip
def matched_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins of positives over the negatives of their coarsened stratum."""
    from tessella.operators.metrics import score_steps

    rows = read(spark, sf_dir, "part").select(F.floor(F.col("p_size") / 5).alias("bin"), (F.substring("p_brand", 7, 1).cast("int") % 2).alias("y"), F.col("p_retailprice").alias("p"))
    won = F.col("pos") * (F.col("all_neg") - (F.col("fp") - F.col("neg")) - F.col("neg") / 2)
    each = score_steps(rows, ["bin"]).groupBy("bin").agg(F.sum(won).alias("wins"), F.max(F.col("all_pos") * F.col("all_neg")).alias("pairs")).where("pairs > 0")
    return each.agg(F.round(F.sum("wins") / F.sum("pairs"), 6).alias("matched_auc"), F.sum("pairs").cast("long").alias("pairs"), F.count("*").alias("strata"))


@query("SELECT '{\"k\":' || regexp_extract(props, '[0-9]+') || ',\"type\":\"' || event_type || '\"}' AS record, count(*) AS n, max(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS k FROM events GROUP BY record")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed JSON texts written again with sorted names."""
    rows = read(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string, bigint>"))
    out = rows.select(scalar.canonical({"type": F.col("event_type"), "k": F.col("m")["k"]}).alias("record"), F.col("m")["k"].alias("k"))
    return out.groupBy("record").agg(F.count("*").alias("n"), F.max("k").alias("k"))

