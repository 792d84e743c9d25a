"""Queries on small tables made for what a review found, against their SQL in DuckDB."""

import duckdb
import pytest

from tessella import catalog
from tessella.operators import text

catalog.load()


def plain(v):
    return f"{float(v):.9g}" if isinstance(v, bool | int | float) else str(v)


@pytest.fixture
def held(spark, tmp_path):
    """held(name, **tables): the query's rows and its SQL's over tables given as SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        df, other = catalog.QUERIES[name](spark, str(tmp_path)), con.sql(catalog.ORACLES[name])
        at = [other.columns.index(c) for c in df.columns]
        return sorted(tuple(map(plain, r)) for r in df.collect()), sorted(tuple(plain(r[i]) for i in at) for r in other.fetchall())

    return run


LINES = """SELECT CAST({order} AS BIGINT) AS l_orderkey, CAST({part} AS BIGINT) AS l_partkey, CAST({supplier} AS BIGINT) AS l_suppkey, CAST({line} AS INTEGER) AS l_linenumber, CAST(i % 50 AS DOUBLE) AS l_quantity,
  CAST({price} AS DOUBLE) AS l_extendedprice, (i * 7 % 11) / 100.0::DOUBLE AS l_discount, (i * 5 % 9) / 100.0::DOUBLE AS l_tax, CASE WHEN {returned} THEN 'R' ELSE 'N' END AS l_returnflag FROM range({n}) r(i)"""


def lines(n, order="i", part="i", supplier="i % 40", line="1 + i % 7", price="1000 + i * 37 % 99000", returned="i % 3 = 1"):
    return LINES.format(n=n, order=order, part=part, supplier=supplier, line=line, price=price, returned=returned)


def test_threshold_curve_rounds_as_its_sql(held):
    # prices whose seventh digit is a 5, so that the sixth decides on which side of a threshold a row is
    mine, theirs = held("f1_threshold_curve", lineitem=lines(2000, part="3 * i", price="1000 * (1 + i % 100) - 0.05 * (1 + i % 3)"))
    assert mine == theirs


def test_sessions_end_after_a_day_to_the_microsecond(held):
    ts = "TIMESTAMP '2024-01-01 00:00:00.9' + to_microseconds(CASE i % 3 WHEN 0 THEN 0 WHEN 1 THEN 86400000000 + (i // 3) % 3 - 1 ELSE 86400000000 * 2 + 600000 END)"
    events = f"SELECT i AS event_id, {ts} AS ts, i // 3 AS user_id, 'click' AS event_type, 1.0::DOUBLE AS value, '{{\"k\": 1}}' AS props FROM range(30) r(i)"
    mine, theirs = held("session_kinds", events=events)
    assert mine == theirs


def test_draws_are_made_where_the_units_are(spark):
    """Sums of draws, by packs and blocks of units and without rows for picks, are those of the picks."""
    from pyspark.sql import functions as F

    from tessella.operators import resampling

    units = spark.range(300).select((F.col("id") % 2).alias("c"), F.col("id").alias("u"), (F.col("id") * 7 % 13).alias("a"), (F.col("id") / 3).alias("b"))
    want = resampling.drawn(units, ["c"], "u", 20).groupBy("c", "draw").agg(F.sum(F.col("a") * F.col("times")).alias("a"), F.sum(F.col("b") * F.col("times")).alias("b"))
    told = lambda df: {(r.c, r.draw): (r.a, round(r.b, 6)) for r in df.collect()}
    sizes = resampling.PACK, resampling.PACKS, resampling.PICKS
    try:
        resampling.PACK, resampling.PACKS, resampling.PICKS = 16, 3, 50
        small = resampling.draw_sums(units, ["c"], "u", ["a", "b"], 20)
        assert told(small) == told(want)
    finally:
        resampling.PACK, resampling.PACKS, resampling.PICKS = sizes
    plan = resampling.bootstrap(units, ["c"], "u", ["a", "b"], F.col("a") / F.col("b"), 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "_pick" not in plan  # a row for each pick is what large tables failed on


def test_digests_of_numbers():
    import hashlib

    from tessella.functions.digests import fractions

    for prefix in (b"0:", b"0:3:17:", b"7:" + b"9" * 60 + b":"):
        want = [int(hashlib.md5(b"%s%d" % (prefix, k)).hexdigest()[:13], 16) / 2.0**52 for k in range(95, 1203)]
        assert fractions(prefix, 95, 1203).tolist() == want


@pytest.mark.parametrize("name", ["paired_cluster_bootstrap", "threshold_bootstrap", "bootstrap_intervals"])
def test_no_row_for_each_pick(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "_pick" not in plan


def test_regions_hold_no_group_in_one_task(spark):
    """Cuts of regions are interpolated quantiles, without a table of all values in one task."""
    from pyspark.sql import functions as F

    from tessella.operators import cartography, ordered

    rows = spark.range(1003).select(F.lit(1).alias("all"), (F.col("id") * 37 % 101 / 100).alias("confidence"), (F.col("id") * 11 % 97 / 96).alias("variability"), F.lit(0.5).alias("correctness"))
    got = ordered.quantiles(rows, ["all"], "confidence", {"a": 0.25, "b": 0.777}).first()
    want = rows.select(F.percentile("confidence", F.lit(0.25)), F.percentile("confidence", F.lit(0.777))).first()
    assert (got.a, got.b) == pytest.approx(tuple(want))
    assert "percentile(" not in cartography.regions(rows, ["all"])._jdf.queryExecution().optimizedPlan().toString()


def test_rater_pairs_meet_in_blocks(held, spark, monkeypatch, tmp_path):
    """Pairs of reviewers of several blocks, strips and parts of the units are those of the SQL, and no pair of reviews is a row of the plan."""
    from tessella.operators import agreement

    for name, size in {"RATERS": 7, "STRIP": 3, "UNITS": 5}.items():
        monkeypatch.setattr(agreement, name, size)
    events = """SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i * 37 % 1000) AS ts, i * 13 % 41 AS user_id, ['view', 'click', 'error', 'signup'][1 + i * 7 % 4] AS event_type, 1.0::DOUBLE AS value,
      '{"k": ' || (i * 31 % 17) || '}' AS props FROM range(900) r(i)"""
    mine, theirs = held("cohen_kappa_pairs", events=events)
    assert mine == theirs
    assert len(mine) > 100
    plan = catalog.QUERIES["cohen_kappa_pairs"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "(a#" not in plan.partition("MapInArrow")[2]


def test_nearest_by_matrices(held, monkeypatch):
    """Votes over several strips, with equal distances and copies of vectors, are those of the SQL."""
    from tessella.operators import neighbours

    for name, size in {"STRIP": 3, "WIDTH": 7}.items():
        monkeypatch.setattr(neighbours, name, size)
    rows = "SELECT i AS vec_id, [(i * 7 % 5)::FLOAT, (i * 3 % 4)::FLOAT, (i % 2 / 10.0)::FLOAT] AS embedding, (i % 3)::INTEGER AS label FROM range(700) r(i)"
    for name in ("knn_vote", "knn_embeddings"):
        mine, theirs = held(name, embeddings=rows)
        assert mine == theirs
        assert mine


def test_graphs_are_audited_where_the_texts_are(spark, sf_dir):
    """Audits of broken graphs held as arrays are those of tables of nodes and edges, and no node is a row of the query's plan."""
    import random

    import numpy as np
    import pyarrow as pa

    from tessella.operators import graph, java

    rng = random.Random(3)
    nodes = [(g, i, rng.choice(("token", "token", "rule"))) for g in range(60) for i in range(-1, 9) if rng.random() < 0.8 for _ in range(rng.choice((1, 1, 1, 2)))]
    edges = [(g, rng.randrange(9), rng.randrange(9), kind) for g in range(60) for kind in ("Child", "NextToken") for _ in range(rng.randrange(1, 12))]
    for g in range(60, 90):  # some that are right but for an edge
        nodes += [(g, i, "token") for i in range(6)]
        edges += [(g, 0, i, "Child") for i in range(1, 6)] + [(g, i, i + 1, "NextToken") for i in range(5) if (g - 60) % 7 != i]
    found, both = spark.createDataFrame(nodes, "k int, node_index int, node_kind string"), spark.createDataFrame(edges, "k int, src int, dst int, edge_type string")
    want = graph.audit(found, both.where("edge_type = 'Child'"), "k").join(graph.order_audit(found, both, "k"), "k").select("k", *graph.AUDITED).orderBy("k").collect()
    column = lambda rows, i: np.array([r[i] for r in rows])
    got = graph.audits(column(nodes, 0), column(nodes, 1), column(nodes, 2) == "token", {"graph": column(edges, 0), "src": column(edges, 1), "dst": column(edges, 2), "follow": column(edges, 3) == "NextToken"}, 90)
    assert [tuple(r) for r in want] == list(zip(range(90), *[got[c].tolist() for c in graph.AUDITED], strict=True))
    texts = spark.createDataFrame([(1, "class A { int f() { return 1; } }"), (2, None), (3, ""), (4, "if (a) b(); }")], "k int, code string")
    tree = java.nodes(texts, "k", "code")
    told = java.edge_arrays(java.tree_lists(pa.array([r.code for r in texts.orderBy("k").collect()])))
    assert sorted(zip((told["graph"] + 1).tolist(), told["src"].tolist(), told["dst"].tolist(), told["follow"].tolist(), strict=True)) == sorted((r.k, r.src, r.dst, r.edge_type == "NextToken") for r in java.edges(tree, "k").collect())
    assert [r.s and (r.s.nodes, r.s.roots) for r in texts.orderBy("k").select(java.audit_column("code").alias("s")).collect()] == [(tree.where("k = 1").count(), 1), None, (1, 1), (tree.where("k = 4").count(), 1)]
    plan = catalog.QUERIES["source_graphs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert "Generate" not in plan


def test_skip_gram_vectors_are_learned_by_replicas(spark, sf_dir, monkeypatch):
    """Words of like neighbours get like vectors, in several slices and replicas; means and shares are those of the tokens, and no token meets the vectors in a join."""
    from collections import Counter

    import numpy as np
    from pyspark.sql import functions as F

    from tessella.operators import skipgram

    for name, size in {"SLICE": 3, "BATCH": 64}.items():
        monkeypatch.setattr(skipgram, name, size)
    groups = [("a", "b", "c"), ("x", "y", "z")]
    texts = [(i % 900, [groups[i % 2][(i * j * j + i // 7 + j) % 3] for j in range(20)] + [f"only{i}"] * (i % 3 == 0)) for i in range(1000)]
    texts += [(2000 + i, [w]) for i, w in enumerate("abcxyz")] + [(3000, ["never"])]
    rows = spark.createDataFrame(texts, "k int, t array<string>").repartition(3)
    got = {r.k: (np.array(r.vector), r.unknown) for r in skipgram.text_vectors(rows, "k", "t", 8, 2).collect()}
    of = {w: got[2000 + i][0] for i, w in enumerate("abcxyz")}
    counts, tokens = Counter(w for _, t in texts for w in t), {}
    for k, t in texts:
        tokens[k] = tokens.get(k, []) + t
    assert got.keys() == tokens.keys()
    for k, t in tokens.items():
        known = [of[w] for w in t if counts[w] > 1]
        assert got[k][1] == pytest.approx(1 - len(known) / len(t))
        assert got[k][0] == pytest.approx(np.mean(known, axis=0) if known else np.zeros(8))
    like = lambda a, b: of[a] @ of[b] / np.linalg.norm(of[a]) / np.linalg.norm(of[b])
    assert min(like(a, b) for g in groups for a in g for b in g) > max(like(a, b) for a in groups[0] for b in groups[1]) + 0.3
    plan = catalog.QUERIES["attached_vectors"](spark, sf_dir).withColumn("n", F.lit(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert "Generate" not in plan


def test_vectors_are_attached_to_whole_texts(held, spark):
    """Tokens behind the 512th count and are counted: doc 1 ends in words of its own, docs 2 and 3 in one they share, and the share of doc 4 lies half-way between two roundings."""
    from pyspark.sql import functions as F

    texts = {1: "w " * 512 + " ".join(f"own{i}" for i in range(128)), 2: "w " * 600 + "shared", 3: "w " * 513 + "shared", 4: "w " * 599 + " ".join(f"rare{i}" for i in range(41)), 5: "", 6: "alone"}
    rows = " UNION ALL ".join(f"SELECT {k}::BIGINT AS doc_id, '{t}' AS text, 'en' AS lang, 's' AS source" for k, t in texts.items())
    mine, theirs = held("attached_vectors", documents=rows, labels="SELECT 1::BIGINT AS doc_id, 1 AS quality, 0 AS toxic")
    assert mine == [("1", "0.2", "16"), ("2", "0", "16"), ("3", "0", "16"), ("4", "0.064062", "16"), ("6", "1", "16")]
    assert mine == theirs
    mine, theirs = held("attached_vectors", documents=rows, labels="SELECT 6::BIGINT AS doc_id, i AS quality, 0 AS toxic FROM range(2) r(i)")  # two labels repeat a text
    assert mine == theirs
    assert mine[-1] == ("6", "0", "16")
    sizes = spark.createDataFrame([("w " * 600,)], "t string").select(text.tokens(F.col("t")).alias("all"), text.tokens(F.col("t"), 512).alias("first")).first()
    assert (len(sizes["all"]), len(sizes["first"])) == (600, 512)


def test_replicas_train_by_blocks(spark, monkeypatch):
    """Slopes by products of blocks are those of the pairs one by one, whatever the number of words and texts; words that a replica doesn't meet get no row; texts without a vector have zeros."""
    import numpy as np

    from tessella.operators import skipgram

    moved = []
    for n in (1, 2, 31, 32, 33, 300):
        draw = np.random.default_rng(n)
        model = skipgram.Replica(np.cumsum(np.ones(5000)), 4, 3)
        rows, texts = model.of(draw.integers(0, 50, n)), np.sort(draw.integers(0, 6, n))
        model.inner[: model.used], model.outer[: model.used] = draw.normal(size=(2, model.used, 4))
        same = np.random.default_rng([1, 3])
        reach, a, b = same.integers(1, skipgram.WINDOW + 1, n), model.inner[rows].astype(float), model.outer[rows].astype(float)
        da, db, pairs = np.zeros_like(a), np.zeros_like(b), np.zeros(n)
        for i in range(n):
            for j in range(n):
                if i != j and abs(i - j) <= reach[i] and texts[i] == texts[j]:
                    slope = 1 / (1 + np.exp(a[i] @ b[j]))
                    da[i], db[j], pairs[i] = da[i] + slope * b[j], db[j] + slope * a[i], pairs[i] + 1
        drawn = np.minimum((same.random(skipgram.SHARED) * 5000).astype(int), 4999)
        monkeypatch.setattr(model, "move", lambda table, steps, at, total: moved.append((at, total)))
        model.train(rows, texts)
        c = model.outer[model.rows[drawn]].astype(float)
        slope = (pairs * skipgram.NEGATIVE / skipgram.SHARED)[:, None] / (1 + np.exp(-(a @ c.T)))
        for places, slopes in ((rows, da - slope @ c), (rows, db), (model.rows[drawn], -(slope.T @ a))):
            want, got, (at, total) = np.zeros((model.used, 4)), np.zeros((model.used, 4)), moved.pop(0)
            np.add.at(want, places, slopes)
            got[at] = total
            assert got == pytest.approx(want, abs=1e-3)
        assert model.used <= len(set(rows)) + skipgram.SHARED
    texts = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"]), (3, [])], "k int, t array<string>")
    assert sorted((r.k, r.vector, r.unknown) for r in skipgram.text_vectors(texts, "k", "t", 2, 2).collect()) == [(1, [0, 0], 1), (2, [0, 0], 1), (3, [0, 0], None)]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None
