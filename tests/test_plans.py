"""Sources, sinks, configuration, stage cache and streams."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators.labels import aggregated, severity_counts
from tessella.plans import config
from tessella.plans.stage_cache import StageCache, fingerprint
from tessella.sources import readers, sinks
from tessella.streaming import labels as stream
from tessella.views import reviews


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": 1}, {"k": 2}]))
    assert readers.json_array(spark, f"{tmp_path}/a.json", "k long").count() == 2
    (tmp_path / "x.shard0of2.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n{"k": ')
    (tmp_path / "x.shard1of2.jsonl").write_text('{"k": 3}\n')
    got = readers.sharded(spark, f"{tmp_path}/x.shard*of*.jsonl", "k long", tolerant=True).collect()
    assert sorted((r.k, r.shard, r.shards) for r in got) == [(1, 0, 2), (2, 0, 2), (3, 1, 2)]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.jsonl(spark, f"{tmp_path}/x.shard0of2.jsonl", "k long").collect()
    with pytest.raises(FileNotFoundError):
        readers.expanded(spark, f"{tmp_path}/none*")
    (tmp_path / "r.csv").write_text('id;t\n1;"a;b"\n2;c\n')
    assert [(r.id, r.t) for r in readers.csv(spark, f"{tmp_path}/r.csv", "id long, t string", ";").collect()] == [(1, "a;b"), (2, "c")]
    (tmp_path / "f.csv").write_text("sample_idx,loc,wmc,y_blob\n1,2,3.5,1\n")
    with pytest.raises(ValueError):
        readers.feature_csv(spark, f"{tmp_path}/f.csv", "sample_idx")
    assert readers.feature_csv(spark, f"{tmp_path}/f.csv", "sample_idx", ["y_blob"]).first().asDict() == {"sample_idx": 1, "loc": 2.0, "wmc": 3.5}
    newest = readers.newest(spark, f"{tmp_path}/x.shard1of2.jsonl", "k long", "k")
    assert newest.count() == 1


def test_dot_and_dumps(spark, tmp_path):
    (tmp_path / "g_idx_7.dot").write_text('digraph {\n node [shape=box];\n n0 [label="A, \\"b\\"", kind=Node];\n n1 [label="c"];\n n0 -> n1 [edge_type="Child"];\n}\n')
    lines = readers.dot_lines(spark, f"{tmp_path}/*.dot")
    nodes = {r.node: r.attributes for r in readers.dot_nodes(lines).collect()}
    assert set(nodes) == {"n0", "n1"}
    assert nodes["n0"]["kind"] == "Node"
    assert nodes["n0"]["label"] == 'A, \\"b\\"'
    edge = readers.dot_edges(lines).first()
    assert (edge.json_index, edge.src, edge.dst, edge.attributes["edge_type"]) == (7, "n0", "n1", "Child")
    (tmp_path / "d.sql").write_text("-- dump\nINSERT INTO `t` VALUES (1,'a\\'b, (c)',NULL),(2,'it''s',3.5);\nINSERT INTO `u` VALUES (1);\n")
    got = sorted((r.a, r.b, r.c) for r in readers.mysql_table(spark, f"{tmp_path}/d.sql", "t", ["a", "b", "c"]).select("a", "b", F.coalesce("c", F.lit("-")).alias("c")).collect())
    assert got == [("1", "a'b, (c)", "-"), ("2", "it's", "3.5")]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("p/A.java", "class A {}")
        z.writestr("p/readme", "x")
    assert [(r.member, r.text) for r in readers.zip_members(spark, f"{tmp_path}/z.zip", ".java").collect()] == [("p/A.java", "class A {}")]
    (tmp_path / "src/q").mkdir(parents=True)
    (tmp_path / "src/q/B.java").write_text("class B {}")
    assert readers.source_tree(spark, f"{tmp_path}/src").first().text == "class B {}"
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [r.vector for r in readers.npy_matrix(spark, f"{tmp_path}/m.npy").orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    path = f"{tmp_path}/out"
    assert sinks.append_new(rows, path, ["k"]) == 2
    assert sinks.append_new(rows.unionAll(spark.createDataFrame([(3, "c")], "k long, v string")), path, ["k"]) == 1
    assert spark.read.parquet(path).count() == 3
    run = f"{tmp_path}/run"
    assert not sinks.is_complete(spark, run, 1)
    sinks.write_run(rows, rows.limit(1), run)
    assert sinks.is_complete(spark, run, 1)
    assert not sinks.is_complete(spark, run, 2)
    report = f"{tmp_path}/report"
    for name, n in (("x", 1), ("y", 2), ("x", 3)):
        sinks.replace_section(spark.range(n), report, name)
    assert {r.section: r["count"] for r in spark.read.parquet(report).groupBy("section").count().collect()} == {"x": 3, "y": 2}
    table = spark.createDataFrame([("a_b", 0.5, None)], "m string, f double, g double")
    assert sinks.markdown(table, ["m", "f", "g"]).splitlines()[-1] == "| a_b | 0.500 | n/a |"
    assert r"a\_b & 0.500 & --" in sinks.latex(table, ["m", "f", "g"])


def test_config(tmp_path):
    (tmp_path / "base.yml").write_text("a: {x: 1, y: 2}\nb: [1]\n")
    (tmp_path / "top.yml").write_text("_include_yml: base.yml\na: {y: 3}\n")
    assert config.load(tmp_path / "top.yml") == {"a": {"x": 1, "y": 3}, "b": [1]}
    (tmp_path / "loop.yml").write_text("_include_yml: [loop.yml]\n")
    with pytest.raises(ValueError):
        config.load(tmp_path / "loop.yml")
    assert config.overrides(["--a.b=1.5", "--c.d", "[1, x]"]) == {"a.b": 1.5, "c.d": [1, "x"]}
    with pytest.raises(ValueError):
        config.overrides(["--seed=1"])
    assert config.with_value({"a": {"x": 1}}, "a.b.c", 2) == {"a": {"x": 1, "b": {"c": 2}}}
    every = list(config.trials({"lr": [1, 2], "d": [3]}, [7, 8]))
    assert [n for n, _, _ in every] == [1, 2, 3, 4]
    assert every[1] == (2, {"lr": 1, "d": 3}, 8)
    parts = [t for s in range(3) for t in config.trials({"lr": [1, 2], "d": [3]}, [7, 8], 3, s)]
    assert sorted(n for n, _, _ in parts) == [1, 2, 3, 4]


def test_stage_cache(spark, tmp_path):
    def build(n, redo=None):
        cache = StageCache(spark, str(tmp_path / "stages"), runtime=["threads"], redo=redo)
        cache.stage("numbers", {"n": n, "threads": n * 100}, lambda: spark.range(n))
        total = cache.stage("total", {}, lambda df: df.agg(F.sum("id").alias("s")), "numbers")
        return total.first().s, cache.made

    assert build(4) == (6, ["numbers", "total"])
    assert build(4) == (6, [])
    assert build(5) == (10, ["numbers", "total"])
    assert build(5, "total") == (10, ["total"])
    assert fingerprint({"a": 1, "b": 2}) == fingerprint({"b": 2, "a": 1})


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = reviews(spark, sf_dir)
    source = tmp_path / "in"
    for k in range(3):
        batch.where(F.col("id") % 3 == k).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source))
    # a record that comes twice counts once
    batch.where("id = 1").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    stream.upsert(stream.unit_stream(live, "4000 days"), f"{tmp_path}/out", f"{tmp_path}/check", compact_every=3).awaitTermination()
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["base=2", "batch=3"]
    got = stream.state(spark, f"{tmp_path}/out")
    columns = ["sample", "smell", "votes", "c0", "c1", "c2", "c3", "rank"]
    want = aggregated(severity_counts(batch)).select(columns)
    assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(tuple(r) for r in want.collect())


@pytest.mark.parametrize("make", [lambda s: stream.counts_by_window(s), lambda s: stream.counts_by_window(s, "7 days", "1 day"), lambda s: stream.sessions(s)])
def test_windows(spark, sf_dir, tmp_path, make):
    rows = reviews(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    name = f"w{abs(hash(str(tmp_path)))}"
    query = make(live).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.table(name)
    assert out.count() > 0
    if "smell" in out.columns:
        whole = {tuple(r) for r in make(rows).collect()}
        assert {tuple(r) for r in out.collect()} <= whole
