"""Goldens by hand, properties, and odd inputs of the library's operators."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import scalar, tails
from tessella.operators import agreement, conditional, effort, graph, java, labels, metrics, models, neighbours, ranges, resampling, similarity, splits, statistics, text, thresholds, variants
from tessella.operators.components import components

REVIEW = "id long, sample long, smell long, reviewer long, ts timestamp_ntz, severity int"


def reviews(spark, rows):
    return spark.createDataFrame(rows, "sample long, smell long, reviewer long, severity int").withColumns({"id": F.monotonically_increasing_id(), "ts": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")})


def test_severity_methods(spark):
    rows = [(1, 0, r, s) for r, s in enumerate([0, 2])] + [(2, 0, r, s) for r, s in enumerate([0, 0, 3])] + [(3, 0, 1, None)]
    got = {m: {r.sample: (r.rank, r.y, r.votes) for r in labels.unit_labels(reviews(spark, rows), m).collect()} for m in ("median", "max", "majority")}
    assert got["median"] == {1: (2, 1, 2), 2: (0, 0, 3), 3: (0, 0, 1)}
    assert got["max"] == {1: (2, 1, 2), 2: (3, 1, 3), 3: (0, 0, 1)}
    assert got["majority"] == {1: (0, 0, 2), 2: (0, 0, 3), 3: (0, 0, 1)}
    with pytest.raises(ValueError):
        labels.rule_ranks("grave")
    with pytest.raises(ValueError):
        labels.aggregated(labels.severity_counts(reviews(spark, rows)), "mean")


def test_alpha_goldens(spark):
    # two coders, four units: 8/15 by hand
    units = [(0, 0), (1, 1), (0, 1), (0, 0)]
    rows = [(u, 0, r, v) for u, pair in enumerate(units) for r, v in enumerate(pair)]
    got = agreement.krippendorff_alpha(agreement.coincidences(reviews(spark, rows)), "nominal").first().alpha
    assert got == pytest.approx(8 / 15)
    perfect = [(u, 0, r, u % 4) for u in range(8) for r in range(3)]
    for m in ("nominal", "ordinal", "interval"):
        assert agreement.krippendorff_alpha(agreement.coincidences(reviews(spark, perfect)), m).first().alpha == pytest.approx(1)
    alone = agreement.coincidences(reviews(spark, [(1, 0, 1, 2)]))
    assert agreement.krippendorff_alpha(alone, "ordinal").count() == 0


def scored(spark, n=300, seed=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(i % 3, int(rng.random() < 0.2), round(rng.random(), 2), float(rng.randrange(1, 50)), i) for i in range(n)], "c int, y int, p double, effort double, id long")


def test_auc_and_precision_by_brute_force(spark):
    df = scored(spark)
    rows = df.collect()
    auc = {r.c: r.roc_auc for r in metrics.roc_auc(df, ["c"]).collect()}
    ap = {r.c: r.average_precision for r in metrics.average_precision(df, ["c"]).collect()}
    for c in range(3):
        pos, neg = ([r.p for r in rows if r.c == c and r.y == k] for k in (1, 0))
        assert auc[c] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
        steps = sorted({r.p for r in rows if r.c == c}, reverse=True)
        area, before = 0.0, 0
        for s in steps:
            tp, n = sum(p >= s for p in pos), sum(p >= s for p in pos + neg)
            area += (tp - before) / len(pos) * tp / n
            before = tp
        assert ap[c] == pytest.approx(area)
    power = df.withColumn("p", F.pow("p", F.lit(3)))
    assert {r.c: pytest.approx(r.roc_auc) for r in metrics.roc_auc(power, ["c"]).collect()} == auc
    one = df.where("y = 0")
    assert metrics.roc_auc(one, ["c"]).first().roc_auc is None
    assert metrics.average_precision(one, ["c"]).first().average_precision == 0


@pytest.mark.parametrize("spec", [(101, 0.0, 1.0, True), (101, 0.0, 1.0, False), (91, 0.05, 0.95, True)])
def test_threshold_sweep_is_the_grid_join(spark, spec):
    grid = thresholds.grid(*spec)
    df = scored(spark, 400, 1).withColumn("p", F.when(F.col("id") % 7 == 0, F.col("id") % 11 / 10).when(F.col("id") % 5 == 0, -0.5).otherwise(F.col("p")))
    rows = df.collect()
    got = {(r.c, r.step): (r.tp, r.fp, r.fn, r.tn) for r in thresholds.sweep(df, ["c"], grid).collect()}
    want = {}
    for c, (k, t) in itertools.product(range(3), enumerate(grid)):
        cells = [(r.y, r.p >= t) for r in rows if r.c == c]
        want[c, k] = tuple(cells.count(x) for x in ((1, True), (0, True), (1, False), (0, False)))
    assert got == want
    best = {r.c: r.threshold for r in thresholds.tuned(df, ["c"], thresholds=grid).collect()}
    for c in range(3):
        value = lambda k, c=c: (lambda tp, fp, fn, _: 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0)(*want[c, k])
        assert best[c] == grid[max(range(len(grid)), key=lambda k: (value(k), -k))]
    assert thresholds.tuned(df.where("y = 0"), ["c"], thresholds=grid).first().threshold == 0.5
    assert thresholds.tuned(df.where("y = 0"), ["c"], thresholds=grid, empty=None).first().threshold == grid[0]


def test_effort_extremes(spark):
    df = scored(spark, 90, 2)
    density = df.withColumn("p", F.col("y") * 1000 / F.col("effort") - F.col("effort") / 1e6)
    got = effort.rank_metrics(density, ["c"], ["id"]).collect()
    assert all(r.popt == pytest.approx(1) and r.ifa == 0 for r in got)
    worst = df.withColumn("p", -(F.col("y") * 1000 / F.col("effort")) + F.when(F.col("y") == 1, F.col("effort") / 1e3).otherwise(F.col("effort") / 1e6))
    assert all(r.popt == pytest.approx(0, abs=1e-9) for r in effort.rank_metrics(worst, ["c"], ["id"]).collect())
    assert effort.rank_metrics(df.where("y = 1"), ["c"], ["id"]).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, 501), (501, 502), (502, 500)] + [(1000, 1000 + k) for k in range(1, 300)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_pairs(spark):
    rng = random.Random(6)
    base = [f"t{i}" for i in range(40)]
    texts = [" ".join(rng.sample(base, 40 - rng.randrange(3)) + [f"x{rng.randrange(4)}" for _ in range(rng.randrange(3))]) for _ in range(60)] + ["", None, "a b", "b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {(r.a, r.b, r.both, r.either) for r in similarity.jaccard_pairs(similarity.token_sets(df, "id", "t"), "id").collect()}
    first = {}
    for i, t in enumerate(texts):
        if (t or "").split():
            first.setdefault(frozenset(t.split()), i)
    want = set()
    for (s, i), (u, j) in itertools.combinations(first.items(), 2):
        if 100 * len(s & u) >= 90 * len(s | u):
            want.add((min(i, j), max(i, j), len(s & u), len(s | u)))
    assert got == want


def test_splits(spark):
    df = spark.range(103).select(F.col("id"), (F.col("id") % 4).alias("y"), (F.col("id") % 9).alias("g"))
    folds = splits.stratified_folds(df, "id", ["y"], 5)
    assert splits.split_problems(folds, "id", df).first().asDict() == {"missing": 0, "repeated": 0, "unknown": 0}
    counts = [r["count"] for r in folds.groupBy("y", "fold").count().collect()]
    assert max(counts) - min(counts) <= 1
    assert splits.group_folds(df, "g", 4).groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    small, large = ({r.id for r in splits.nested_subset(df, "id", ["y"], f).collect()} for f in (0.2, 0.5))
    assert small < large
    assert splits.split_problems(folds.where("fold > 0").unionAll(folds.where("fold = 1")), "id", df).first().repeated > 0
    with pytest.raises(ValueError):
        splits.round_robin(df, "id", 3, 3)
    soft = splits.oversampled(spark.createDataFrame([(1, 0.25), (2, 1.0)], "id long, share double"), "share").collect()
    assert sorted((r.id, r.y, r.weight) for r in soft) == [(1, 0, 0.75), (1, 1, 0.25), (2, 1, 1.0)]


def test_tree_of_tags(spark):
    df = spark.createDataFrame([(1, "<html><p>a<br>b<i>c</i></p><div></div></html>"), (2, None), (3, "</x>")], "k long, h string")
    nodes = graph.tag_nodes(df, "k", "h")
    assert [(r.node_index, r.node_type, r.depth) for r in nodes.orderBy("node_index").collect()] == [(0, "html", 0), (1, "p", 1), (2, "br", 2), (3, "i", 2), (4, "div", 1)]
    assert sorted((r.src, r.dst) for r in graph.child_edges(nodes, "k").collect()) == [(0, 1), (0, 4), (1, 2), (1, 3)]
    assert {r.node_index: r.end for r in graph.subtree_ends(nodes, "k").collect()} == {0: 5, 1: 4, 2: 3, 3: 4, 4: 5}


def test_neighbours_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, [rng.randrange(4) / 1.0 for _ in range(5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {(r.id, r.rank): r.other for r in neighbours.nearest(df.where("id < 10"), df, "id", "v", 3, 4).collect()}
    for i in range(10):
        order = sorted((sum((a - b) ** 2 for a, b in zip(rows[i][1], v, strict=True)), j) for j, v in rows if j != i)
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in order[:3]]


def test_tails():
    assert tails.normal_sf(1.959963984540054) == pytest.approx(0.025)
    assert tails.t_sf(2.228138852, 10) == pytest.approx(0.025, abs=1e-9)
    assert tails.t_sf(-2.228138852, 10) == pytest.approx(0.975, abs=1e-9)
    assert tails.t_sf(1, 1) == pytest.approx(0.25)
    assert tails.t_quantile(0.975, 4) == pytest.approx(2.776445105, abs=1e-6)
    assert tails.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_sf(2, 2) == pytest.approx(math.exp(-1))
    assert tails.binomial_test(3, 10) == pytest.approx(0.34375)
    assert tails.mcnemar(0, 0) == 1
    assert tails.fisher(3, 1, 1, 3) == pytest.approx(34 / 70)
    assert tails.wilcoxon([1, 2, 3, 4, 5]) == (0.0, 0.0625)
    assert tails.wilcoxon([0, 0]) == (0.0, 1.0)
    assert tails.paired_t([1, 2, 3, 4])[0] == pytest.approx(2.5 / math.sqrt(5 / 12))
    assert math.isnan(tails.paired_t([1, 1])[0])
    assert [tails.marker(p) for p in (0.0001, 0.005, 0.02, 0.5, None)] == ["***", "**", "*", "ns", "n/a"]
    x = [[1.0, v] for v in (0, 0, 0, 0, 1, 1, 1, 1)]
    y = [0, 0, 0, 1, 0, 1, 1, 1]
    want = -2 * 8 * (0.75 * math.log(0.75) + 0.25 * math.log(0.25))
    assert tails.logistic_deviance(x, y) == pytest.approx(want)


def test_holm_and_epochs(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "k string, p double")
    assert {r.k: pytest.approx(r.p_holm) for r in statistics.holm(df, "p", ["k"]).collect()} == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9}
    history = spark.createDataFrame([(0, e, v) for e, v in enumerate([0.1, 0.3, 0.3, 0.2, 0.25, 0.9])] + [(1, 0, 0.5)], "run int, epoch int, v double")
    assert {r.run: r.epoch for r in statistics.best_epoch(history, ["run"], "epoch", "v", 3).collect()} == {0: 1, 1: 0}


def test_bootstrap(spark):
    df = spark.range(400).select((F.col("id") % 40).alias("u"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("hit"), F.lit(1).alias("n"))
    value = F.col("hit") / F.col("n")
    a, b = (resampling.bootstrap(df, [], "u", ["hit", "n"], value).first() for _ in range(2))
    assert a == b
    assert a.low < a.value < a.high
    same = resampling.paired_bootstrap(df.withColumns({"h2": F.col("hit"), "n2": F.col("n")}), "u", ["hit", "n"], ["h2", "n2"], value, F.col("h2") / F.col("n2")).first()
    assert (same.low, same.high) == (0, 0)
    runs = spark.createDataFrame([(i // 5, i, int(i < 10)) for i in range(60)], "b long, o long, v int")
    p = resampling.permutation_p(resampling.block_permutation(runs, "b", "o", "v", 40)).first()
    assert p.observed == 10
    assert 0 < p.p < 0.6


def test_models_learn(spark):
    rng = random.Random(3)
    rows = [(i, float(y), rng.gauss(2 * y, 1), rng.gauss(-y, 1), None if i % 10 == 0 else rng.random()) for i in range(240) for y in [i % 2]]
    df = spark.createDataFrame(rows, "id long, y double, a double, b double, c double")
    for name in ("logistic", "entropy_tree", "naive_bayes", "svm"):
        out = models.predicted(models.fit(df, ["a", "b", "c"], "y", name), df, df, ["a", "b", "c"])
        auc = metrics.roc_auc(out.select("y", "p", F.lit(1).alias("all")), ["all"]).first().roc_auc
        assert auc > 0.8, name
    rules = models.evolve(df, ["a", "b"], "y")
    right = df.where((models.rule_score(rules) >= 0.5) == (F.col("y") == 1)).count()
    assert right > 150


JAVA = """class A {
  int size = 0; // kept
  /* two
     lines */
  int first(int n) {
    int total = 0;
    for (int i = 0; i < n; i++) { total += this.size * i; }
    String s = "// not a comment } ";
    return total;
  }

  void second() { first(2); }
}
"""


def test_variants():
    for name in variants.TRANSFORMS:
        code = JAVA.replace("\n    ", "\n\t") if name == "reindent" else JAVA
        got = variants.variant(code, name)
        assert got["status"] == "applied", name
        assert variants.TRANSFORMS[name][1](code, got["code"])
    stripped = variants.variant(JAVA, "strip_comments")["code"]
    assert "kept" not in stripped
    assert "// not a comment } " in stripped
    assert stripped.count("\n") == JAVA.count("\n")
    named = variants.variant(JAVA, "rename_locals")["code"]
    assert "total" not in named
    assert "this.size" in named
    shuffled = variants.variant(JAVA, "shuffle_methods")["code"]
    assert shuffled.index("second()") < shuffled.index("int first")
    assert variants.variant("class A { int f() {", "compact")["status"] == "not_applicable"
    assert variants.variant(None, "compact")["status"] == "not_applicable"
    assert variants.variant("class A {}", "strip_comments")["status"] == "no_change"


def test_variant_column(spark):
    df = spark.createDataFrame([(1, JAVA), (2, None), (3, "}")], "id long, code string")
    got = {r.id: r.v.status for r in df.select("id", variants.transform("compact")("code").alias("v")).collect()}
    assert got == {1: "applied", 2: "not_applicable", 3: "not_applicable"}
    with pytest.raises(ValueError):
        variants.transform("paint")


def test_scalar_functions(spark):
    row = spark.range(1).select(
        scalar.repo_slug(F.lit("git@github.com:a/b.git")).alias("slug"), scalar.repo_slug(F.lit("https://x@github.com/a/b/")).alias("slug2"), scalar.years(F.lit("1Y6M")).alias("y"), scalar.years(F.lit("none")).alias("y0"),
        scalar.truth(F.lit(" Yes ")).alias("t"), scalar.safe_int(F.lit("x"), 7).alias("i"), scalar.sanitize(F.lit(float("nan"))).alias("s"), scalar.label_array(F.lit("[True, False]")).alias("l"),
        scalar.padded(F.array(F.lit(1)), 3, F.lit(0)).alias("p"), scalar.windows(F.sequence(F.lit(1), F.lit(7)), 3, 2).alias("w"), scalar.truncated(F.lit("a\nb\nc"), 2).alias("c"),
        scalar.dot_unescape(scalar.dot_escape(F.lit('a"\\n\n\\'))).alias("d"), scalar.canonical({"b": F.lit(1), "a": F.lit("x")}).alias("j"), scalar.ppv(F.lit(0.0), F.lit(1.0), F.lit(0.3)).alias("ppv"),
    ).first()
    assert (row.slug, row.slug2) == ("github.com/a/b", "github.com/a/b")
    assert (row.y, row.y0, row.t, row.i, row.s, row.l) == (1.5, None, 1, 7, 0.0, [True, False])
    assert (row.p, row.w) == ([1, 0, 0], [[1, 2, 3], [3, 4, 5], [5, 6, 7]])
    assert row.c == "a\nb\n... (1 lines omitted)"
    assert row.d == 'a"\\n\n\\'
    assert row.j == '{"a":"x","b":1}'
    assert row.ppv is None


def test_line_kinds(spark):
    said = ["int f() {", "}", "// x", "return 1;", "if (a) {", "int a = 1;", "List<A> b = c;", "a = b;", "call(a);", "a == b", "x"]
    df = spark.createDataFrame([(1, "\n".join(said))], "k long, t string")
    got = [r.kind for r in text.lines(df, "k", "t").select("line_no", text.line_kind(F.col("line"), F.col("line_no") == 0).alias("kind")).orderBy("line_no").collect()]
    assert got == ["signature", "braces only", "comment or annotation", "return", "condition, loop or try", "declaration", "declaration", "assignment", "call", "other", "other"]


SOURCE = '''package a.b;
import java.util.*;
/** doc */
public class Foo<T> extends Bar implements Baz {
  private int size, total = f(1, 2);  // note
  public static final Map<String, List<Integer>> M = new HashMap<>();
  static { init(); }
  public Foo(int a) { this.size = a; }
  @Override public int getSize() { return size; }
  void setSize(int s) { this.size = s; }
  <R> R run(Map<String, R> m, final int... xs) throws IOException {
    for (int i = 0; i < 3; i++) { if (i > 1 && x) other.call(i); else foo(); }
    Runnable r = () -> { helper.go(); };
    Comparator<T> c = new Comparator<T>() { public int compare(T a, T b) { return a.x - b.x; } };
    switch (k) { case 1: return null; default: break; }
    try (A q = b()) { z(); } catch (Exception e) { throw e; } finally { w(); }
    do { t++; } while (t < 5);
    int[] arr = {1, 2};
    return size > 1 ? getSize() : this.total;
  }
  enum E { A, B(1) { void f() {} }; int y; }
}
'''


def test_source_trees():
    tree = java.parse(SOURCE)
    kinds = Counter(n.kind for n in tree.nodes)
    assert tree.errors == 0
    assert tree.comments == 2
    want = {"class": 1, "enum": 1, "field": 3, "initializer": 1, "constructor": 1, "constant": 2, "method": 5, "for": 1, "if": 1, "else": 1, "switch": 1, "case": 2, "try": 1, "catch": 1, "finally": 1, "do": 1, "lambda_block": 1, "class_body": 2, "local": 3, "return": 4, "throw": 1, "break": 1}
    assert {k: kinds[k] for k in want} == want
    assert [n.name for n in tree.nodes if n.kind == "method"] == ["getSize", "setSize", "run", "compare", "f"]
    assert "".join(tree.text(n.first) for n in tree.nodes if n.kind == "token") == "".join(t.text for t in tree.tokens)
    for i, n in enumerate(tree.nodes):
        assert n.parent < i
        if n.parent >= 0:
            assert tree.nodes[n.parent].first <= n.first <= n.last <= tree.nodes[n.parent].last
    facts = {m["name"]: m for m in java.method_facts(SOURCE)}
    assert (facts["run"]["n_params"], facts["run"]["own"], facts["run"]["foreign"]) == (2, 3, 4)
    assert java.class_structure(SOURCE)["n_getters"] == java.class_structure(SOURCE)["n_setters"] == 1
    assert "void f" not in java.skeleton(SOURCE).split("\n")[-1]


def test_odd_sources_have_trees():
    rng = random.Random(7)
    parts = ["class", "A", "{", "}", "(", ")", ";", "if", "else", "case", ":", "->", "=", "int", "x", ".", "new", "enum", "@", "switch", "<", ">", ",", "return", "for", "do", "while", '"s"', "// c\n", "["]
    texts = ["", " ", "}", "class {", "int f() { return 1; }", "if (a) b(); else c();", "(" * 400, "{" * 400 + "x" + "}" * 400, "é ü"] + [" ".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]
    for text in texts:
        tree = java.parse(text)
        assert [n.first for n in tree.nodes if n.kind == "token"] == list(range(len(tree.tokens))), text
        assert all(n.last >= n.first for n in tree.nodes)
        java.sizes(text)
        java.class_structure(text)
        java.method_facts(text)
        java.skeleton(text)


def test_members_are_renamed_by_scope():
    new = variants.variant("class A {\n  int size;\n  A(int size) { this.size = size; }\n  int get() { return size + other.length; }\n  int length;\n}", "rename_members")
    assert new["status"] == "applied"
    assert new["code"] == "class A {\n  int m0;\n  A(int size) { this.m0 = size; }\n  int get() { return m0 + other.length; }\n  int length;\n}"
    copy = variants.variant("class A { int f(int a) { int b = a; g(b); return b; } }", "duplicate_body")
    assert copy["code"] == "class A { int f(int a) { int b = a; g(b); if (false) { int copy_b = a; g(copy_b); return copy_b;\n}\nreturn b; } }"
    assert variants.variant("interface A { int f(); }", "duplicate_body")["status"] == "no_change"


def test_innermost_keeps_repeated_points(spark):
    points = spark.createDataFrame([(1, 5), (1, 5), (1, 99), (None, 5)], "g int, x int")
    spans = spark.createDataFrame([(1, 0, 10), (1, 4, 6), (1, 4, 6)], "g int, a int, b int")
    got = Counter(tuple(r) for r in ranges.innermost(points, spans, "g", "x", "a", "b").collect())
    assert got == Counter({(1, 5, 4, 6): 2, (1, 99, None, None): 1, (None, 5, None, None): 1})


def test_greedy_label_split(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.random() < 0.1), int(rng.random() < 0.5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a int, b int")
    parts = {"train": 0.7, "val": 0.1, "test": 0.2}
    got = {r.id: r.part for r in splits.greedy_labels(df, "id", ["a", "b"], parts).collect()}
    assert sorted(got) == list(range(500))
    for name, share in parts.items():
        held = [r for r in rows if got[r[0]] == name]
        assert abs(len(held) - share * 500) <= 4
        for k in (1, 2):
            assert abs(sum(r[k] for r in held) - share * sum(r[k] for r in rows)) <= 2


def test_draws_have_as_many_picks_as_units(spark):
    units = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(3)], "c string, u int")
    got = resampling.drawn(units, ["c"], "u", 20).groupBy("c", "draw").agg(F.sum("times").alias("n")).collect()
    assert Counter((r.c, r.n) for r in got) == Counter({("a", 7): 20, ("b", 3): 20})


def test_conditional_likelihood_by_all_choices():
    rng = np.random.default_rng(2)

    def value(x, y, beta):
        w = np.exp(x @ beta)
        every = sum(np.prod(w[list(c)]) for c in itertools.combinations(range(len(y)), int(y.sum())))
        return np.log(np.prod(w[y == 1]) / every)

    for _ in range(20):
        m = int(rng.integers(2, 7))
        y = np.zeros(m, int)
        y[: int(rng.integers(1, m))] = 1
        x, beta = rng.normal(size=(m, 3)), rng.normal(size=3)
        got, gradient, curve = conditional.unit_terms(x, y, beta)
        assert got == pytest.approx(value(x, y, beta))
        for i, step in enumerate(1e-5 * np.eye(3)):
            assert gradient[i] == pytest.approx((value(x, y, beta + step) - value(x, y, beta - step)) / 2e-5, abs=1e-6)
            slope = (conditional.unit_terms(x, y, beta + step)[1] - conditional.unit_terms(x, y, beta - step)[1]) / 2e-5
            assert curve[i] == pytest.approx(-slope, abs=1e-5)


def test_conditional_fit_finds_effects(spark):
    rng = np.random.default_rng(4)
    rows = []
    for u in range(300):
        base = rng.normal()
        for k in range(4):
            x = float(rng.normal())
            rows.append((u, x, k % 2, int(rng.random() < 1 / (1 + np.exp(-(base + 1.5 * x))))))
    df = spark.createDataFrame(rows, "u int, x double, r int, y int")
    found = conditional.fit(df, "u", "y", ["x"])
    assert found.beta[0] == pytest.approx(1.5, abs=0.35)
    assert found.deviance < conditional.fit(df, "u", "y", []).deviance
    assert conditional.reviewer_test(df, "u", "r", "y", ["x"], 5)["p"] > 0.001
    biased = df.withColumn("y", F.when(F.col("r") == 1, F.greatest("y", (F.col("u") % 3 != 0).cast("int"))).otherwise(F.col("y")))
    assert conditional.reviewer_test(biased, "u", "r", "y", ["x"], 5)["p"] < 1e-4
