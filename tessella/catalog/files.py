"""Queries that write tables in the forms experiments leave behind and read them back by the scans and sinks."""

from __future__ import annotations

import io
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.operators import joins
from tessella.plans.lineage import put_bytes, scratch
from tessella.sources import readers, sinks
from tessella.views import read

_NATION = "n_nationkey long, n_name string, n_regionkey long"
_CUSTOMER = "c_custkey long, c_name string, c_nationkey long, c_acctbal double"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"))


_CUSTOMERS = "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer"
_NATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


@query(_NATIONS)
def scan_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each region that holds one list of its nations."""
    path = scratch(spark)
    rows = _nations(spark, sf_dir)
    lists = rows.groupBy(F.col("n_regionkey").alias("of")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    lists.write.partitionBy("of").text(path)
    return readers.json_array(spark, f"{path}/of=*/*.txt", _NATION)


@query(_CUSTOMERS)
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    _customers(spark, sf_dir).write.json(path)
    return readers.jsonl(spark, f"{path}/*.json", _CUSTOMER)


def _torn(spark: SparkSession, sf_dir: str) -> str:
    """Customers as lines, every tenth of which was cut off."""
    path = scratch(spark)
    line = F.to_json(F.struct(*_customers(spark, sf_dir).columns))
    torn = F.when(F.col("c_custkey") % 10 == 0, F.substring(line, 1, 20)).otherwise(line)
    _customers(spark, sf_dir).select(torn.alias("value")).write.text(path)
    return f"{path}/*.txt"


@query(_CUSTOMERS + " WHERE c_custkey % 10 <> 0")
def scan_jsonl_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.jsonl(spark, _torn(spark, sf_dir), _CUSTOMER, tolerant=True)


@query("SELECT '{\"c_custkey\":' || CAST(c_custkey AS VARCHAR) AS head, count(*) AS lines FROM customer WHERE c_custkey % 10 = 0 GROUP BY head")
def scan_jsonl_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that the tolerant scan leaves out, by what they begin with."""
    bad = readers.jsonl_problems(spark, _torn(spark, sf_dir), _CUSTOMER)
    return bad.groupBy(F.regexp_extract("line", r'^(\{"c_custkey":\d+)', 1).alias("head")).agg(F.count("*").alias("lines"))


@query("SELECT CAST(item_id AS BIGINT) AS item_id, text || ' \"quoted\", ' || chr(10) || 'next' AS text FROM benchmark")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, separators and line ends inside a field."""
    path = scratch(spark)
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), F.concat("text", F.lit(' "quoted", \nnext')).alias("text"))
    rows.write.options(header=True, quote='"', escape='"').csv(path)
    return readers.csv(spark, f"{path}/*.csv", "item_id long, text string")


@query(_CUSTOMERS)
def scan_csv_semicolon(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    _customers(spark, sf_dir).write.options(header=True, sep=";").csv(path)
    return readers.csv(spark, f"{path}/*.csv", _CUSTOMER, sep=";")


@query("SELECT CAST(p_partkey AS BIGINT) AS sample_idx, CAST(p_size AS DOUBLE) AS size, round(sign(p_retailprice - 1500) * ln(1 + abs(p_retailprice - 1500)), 6) AS price FROM part")
def scan_feature_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns but the key and the excluded one, by the header; signed logarithms of the long-tailed one."""
    path = scratch(spark)
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_idx"), F.col("p_size").alias("size"), (F.col("p_retailprice") - 1500).alias("price"), F.lit("x").alias("note"))
    rows.write.options(header=True).csv(path)
    found = readers.feature_csv(spark, f"{path}/*.csv", "sample_idx", exclude=["note"], signed_log=["price"])
    return found.withColumn("price", F.round("price", 6))


@query("SELECT c_custkey % 3 AS shard, 3 AS shards, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_custkey % 3")
def scan_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of three shards read as one table, with the shard of each row from its file's name."""
    path = scratch(spark)
    for k in range(3):
        _customers(spark, sf_dir).where(F.col("c_custkey") % 3 == k).write.json(f"{path}/out_shard{k}of3")
    rows = readers.sharded(spark, f"{path}/out_shard*/*.json", _CUSTOMER)
    return rows.groupBy(F.col("shard").cast("long").alias("shard"), "shards").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(_CUSTOMERS.replace("CAST(c_acctbal AS DOUBLE)", "CASE WHEN c_custkey % 4 = 0 THEN CAST(c_acctbal AS DOUBLE) + 1000 ELSE CAST(c_acctbal AS DOUBLE) END"))
def scan_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run wrote a quarter of the keys again; its rows count."""
    path = scratch(spark)
    rows = _customers(spark, sf_dir)
    rows.write.json(f"{path}/run1")
    rows.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1000).write.json(f"{path}/run2")
    return readers.newest(spark, f"{path}/run*/*.json", _CUSTOMER, "c_custkey")


@query("SELECT CAST(l.doc_id AS BIGINT) AS json_index, CAST(l.quality AS VARCHAR) || CAST(l.toxic AS VARCHAR) AS y, length(d.text) AS chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 0 AND l.toxic = 1")
def scan_file_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """json_index and labels of each file from its name."""
    path = scratch(spark)
    rated = read(spark, sf_dir, "labels").where("quality = 0 and toxic = 1")
    name = F.concat(F.lit("idx_"), F.col("doc_id").cast("string"), F.lit("_y_"), F.col("quality").cast("string"), F.lit("_"), F.col("toxic").cast("string"))
    rows = read(spark, sf_dir, "documents").join(rated, "doc_id").select(name.alias("sample"), F.char_length("text").cast("string").alias("value"))
    rows.write.partitionBy("sample").text(path)
    files = spark.read.text(readers.expanded(spark, f"{path}/sample=*/*.txt")).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("int").alias("chars"))
    return readers.named(files, "file").select("json_index", F.array_join(F.transform("y", lambda x: x.cast("string")), "").alias("y"), "chars")


@query("""SELECT CAST(o_orderkey AS BIGINT) AS json_index, CASE o_orderstatus WHEN 'F' THEN 'success' ELSE 'skipped' END AS status FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def scan_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "skipped").otherwise("failed")
    read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("json_index"), status.alias("status"), F.lit("x.dot").alias("dot_file")).write.json(path)
    return readers.manifest(spark, f"{path}/*.json").select("json_index", "status")


@query("""WITH r AS (SELECT n_regionkey AS g, CAST(n_nationkey AS BIGINT) AS node, n_name AS name FROM nation)
  SELECT CAST(g AS BIGINT) AS json_index, count(*) AS nodes, CAST(sum(length(name)) AS BIGINT) AS name_chars, count(*) - 1 AS edges, min(node) AS first_node FROM r GROUP BY g""")  # fmt: skip
def scan_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each region: its nations as nodes with escaped names, each with an edge to the next."""
    path = scratch(spark)
    of = _nations(spark, sf_dir).groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    nodes = F.transform("n", lambda x: F.concat(F.lit("  n"), x["n_nationkey"].cast("string"), F.lit(' [node_index='), x["n_nationkey"].cast("string"), F.lit(', token_text="'), x["n_name"], F.lit('\\"q", node_kind="leaf"];')))
    edges = F.transform(F.sequence(F.lit(2), F.size("n")), lambda i: F.concat(F.lit("  n"), F.element_at("n", i - 1)["n_nationkey"].cast("string"), F.lit(" -> n"), F.element_at("n", i)["n_nationkey"].cast("string"), F.lit(' [edge_type="NextToken"];')))
    lines = of.select(F.concat(F.lit("idx_"), F.col("n_regionkey").cast("string")).alias("graph"), F.explode(F.concat(F.array(F.lit("digraph G {")), nodes, F.when(F.size("n") > 1, edges).otherwise(F.array().cast("array<string>")), F.array(F.lit("}")))).alias("value"))
    lines.write.partitionBy("graph").text(path)
    found = readers.with_nodes(readers.dot_lines(spark, f"{path}/graph=*/*.txt"))
    named = F.char_length(F.regexp_replace(F.col("attributes")["token_text"], r'\\"q$', "")).cast("long")
    n = readers.dot_nodes(found).groupBy("json_index").agg(F.count("*").alias("nodes"), F.sum(named).alias("name_chars"), F.min(F.col("attributes")["node_index"].cast("long")).alias("first_node"))
    return n.join(readers.dot_edges(found).groupBy("json_index").agg(F.count("*").alias("edges")), "json_index", "left").na.fill(0, ["edges"])


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' (''x''), ' || chr(10) || 'y' AS name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS size FROM part")
def scan_mysql_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended INSERT statements of parts: quotes, parentheses, line ends and NULL in values."""
    path = scratch(spark)
    size = F.when(F.col("p_partkey") % 5 == 0, "NULL").otherwise(F.col("p_size").cast("string"))
    row = F.concat(F.lit("("), F.col("p_partkey").cast("string"), F.lit(",'"), F.replace("p_name", F.lit("'"), F.lit("\\'")), F.lit(" (\\'x\\'), \\ny',"), size, F.lit(")"))
    rows = read(spark, sf_dir, "part").select((F.col("p_partkey") % 16).alias("g"), row.alias("r"))
    lines = rows.groupBy("g").agg(F.concat(F.lit("INSERT INTO `part` VALUES "), F.array_join(F.collect_list("r"), ","), F.lit(";")).alias("value"))
    lines.select("value").union(spark.sql("SELECT 'INSERT INTO `other` VALUES (1);'")).write.text(path)
    return readers.mysql_table(spark, f"{path}/*.txt", "part", ["id", "name", "size"])


@query("SELECT 'a' || CAST(n_regionkey AS VARCHAR) || '/N' || CAST(n_nationkey AS VARCHAR) || '.java' AS member, 'class ' || n_name AS text FROM nation")
def scan_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    by: dict[int, list] = {}
    for r in _nations(spark, sf_dir).collect():  # 25 rows at any scale
        by.setdefault(r.n_regionkey, []).append(r)
    for region, rows in by.items():
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("readme.txt", "not a source")
            for r in rows:
                z.writestr(f"a{region}/N{r.n_nationkey}.java", f"class {r.n_name}")
        put_bytes(spark, f"{path}/r{region}.zip", held.getvalue())
    return readers.zip_members(spark, f"{path}/*.zip", ".java").select("member", "text")


@query("""SELECT kind, CAST(n_nationkey AS BIGINT) AS row, CAST(n_nationkey + n_regionkey AS DOUBLE) AS total FROM nation, (VALUES ('npy'), ('npz')) k(kind)""")
def scan_npy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of nation and region numbers, in a file of its own and under a name in an archive."""
    path = scratch(spark)
    x = np.array([[r.n_nationkey, r.n_regionkey] for r in _nations(spark, sf_dir).orderBy("n_nationkey").collect()], np.float64)  # 25 rows at any scale
    one, many = io.BytesIO(), io.BytesIO()
    np.save(one, x)
    np.savez(many, features=x, index=np.arange(len(x)))
    put_bytes(spark, f"{path}/m.npy", one.getvalue())
    put_bytes(spark, f"{path}/m.npz", many.getvalue())
    total = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v)
    plain = readers.npy_matrix(spark, f"{path}/*.npy").select(F.lit("npy").alias("kind"), "row", total.alias("total"))
    return plain.unionAll(readers.npz_matrix(spark, f"{path}/*.npz", "features").select(F.lit("npz"), "row", total))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS place, 'class ' || n_name AS text FROM nation")
def scan_source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files below folders, numbered by path."""
    path = scratch(spark)
    for r in _nations(spark, sf_dir).collect():  # 25 rows at any scale
        put_bytes(spark, f"{path}/d{r.n_nationkey:03}/N.java", f"class {r.n_name}".encode())
        put_bytes(spark, f"{path}/d{r.n_nationkey:03}/N.txt", b"no source")
    return readers.source_tree(spark, path, numbered=True).select("place", "text")


@query(_CUSTOMERS)
def append_and_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stopped after a third of its rows goes on; what is there isn't written again."""
    path = scratch(spark)
    rows = _customers(spark, sf_dir)
    sinks.append_new(rows.where("c_custkey % 3 = 0"), path, ["c_custkey"])
    sinks.append_new(rows.withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, -1.0).otherwise(F.col("c_acctbal"))), path, ["c_custkey"])
    return spark.read.parquet(path)


@query("SELECT 'before records' AS state, false AS complete UNION ALL SELECT 'after records', true UNION ALL SELECT 'while it is written again', false")
def commit_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions alone are no complete run, and a run that is being written again isn't one either."""
    path = scratch(spark)
    rows = _nations(spark, sf_dir)
    rows.write.parquet(f"{path}/predictions")
    states = [("before records", sinks.is_complete(spark, path, 25))]
    sinks.write_run(rows, rows, path)
    states.append(("after records", sinks.is_complete(spark, path, 25)))
    sinks.drop_records(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/predictions")
    states.append(("while it is written again", sinks.is_complete(spark, path, 25)))
    return spark.createDataFrame(states, "state string, complete boolean")


@query("SELECT 'new' AS section, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'kept', CAST(n_nationkey AS BIGINT) FROM nation WHERE n_nationkey >= 20")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section of a report is replaced, the other stays."""
    path = scratch(spark)
    rows = _nations(spark, sf_dir).select("n_nationkey")
    sinks.replace_section(rows.where("n_nationkey >= 20"), path, "kept")
    sinks.replace_section(rows, path, "new")
    sinks.replace_section(rows.where("n_nationkey < 3"), path, "new")
    return spark.read.parquet(path).select(F.col("section").cast("string").alias("section"), "n_nationkey")


@query("""WITH r AS (SELECT r_name, count(*) AS nations, avg(n_nationkey) AS mean FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name)
  SELECT '| r_name | nations | mean |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || r_name || ' | ' || nations || ' | ' || printf('%.3f', mean) || ' |', chr(10) ORDER BY r_name) AS markdown FROM r""")  # fmt: skip
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = read(spark, sf_dir, "region").join(_nations(spark, sf_dir), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = regions.groupBy("r_name").agg(F.count("*").alias("nations"), F.avg("n_nationkey").alias("mean")).orderBy("r_name")
    return spark.createDataFrame([(sinks.markdown(rows, ["r_name", "nations", "mean"]),)], "markdown string")


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, round(CAST(c_acctbal AS DOUBLE), 2) AS c_acctbal FROM customer")
def atomic_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced as a whole: it is written beside the old one, which goes when the new one is complete."""
    path = f"{scratch(spark)}/table"
    rows = _customers(spark, sf_dir).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))
    sinks.write_atomic(rows.limit(5), path, "json")
    sinks.write_atomic(rows, path, "json")
    return spark.read.schema("c_custkey long, c_acctbal double").json(path)


@query("""WITH p AS (SELECT DISTINCT l_linenumber AS seed, l_orderkey % 5 AS fold FROM lineitem), r AS (SELECT s AS seed, f AS fold, s * 10 + f AS score FROM range(1, 8) a(s), range(5) b(f) WHERE (s + f) % 6 <> 0)
  SELECT CAST(coalesce(p.seed, r.seed) AS BIGINT) AS seed, CAST(coalesce(p.fold, r.fold) AS BIGINT) AS fold, CAST(score AS BIGINT) AS score, CASE WHEN r.seed IS NULL THEN 'no record' WHEN p.seed IS NULL THEN 'no predictions' ELSE 'both' END AS status
  FROM p FULL JOIN r ON p.seed = r.seed AND p.fold = r.fold""")  # fmt: skip
def predictions_with_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions' cells and run records side by side; what one of them lacks is listed."""
    cells = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("seed"), (F.col("l_orderkey") % 5).alias("fold")).distinct()
    grid = spark.range(1, 8).select(F.col("id").alias("seed"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("fold"))
    records = grid.where((F.col("seed") + F.col("fold")) % 6 != 0).withColumn("score", F.col("seed") * 10 + F.col("fold"))
    return joins.matched(cells, records, ["seed", "fold"], "no record", "no predictions")
