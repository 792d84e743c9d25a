"""Queries on duplicates, leakage, tokens and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.catalog.statistics import _FOLDS, folds
from tessella.functions import scalar
from tessella.operators import similarity, text
from tessella.views import read, snippets, with_views

_S = with_views("snippets")
_WS = r"[ \t\n\r\f\x0B]+"
_COLLAPSED = f"trim(regexp_replace(coalesce(code, ''), '{_WS}', ' ', 'g'), ' ')"


@query(_S + f", d AS (SELECT json_index, sha256({_COLLAPSED}) AS digest FROM snippets) SELECT digest, count(*) AS n, min(json_index) AS first FROM d GROUP BY digest")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.exact_groups(snippets(spark, sf_dir), "json_index", "code")


_SETS = _S.replace("WITH ", "WITH RECURSIVE ", 1) + r""", t AS (SELECT json_index AS id, list_sort(list_distinct(regexp_extract_all(coalesce(code, ''), '[a-zA-Z_][\p{L}\p{N}_]*|\p{Nd}+'))) AS t FROM snippets),
  u AS (SELECT t, min(id) AS id, len(t) AS n FROM t WHERE len(t) > 0 GROUP BY t), x AS (SELECT id, n, unnest(t) AS w FROM u),
  o AS (SELECT a.id AS a, b.id AS b, count(*) AS "both", max(a.n) AS na, max(b.n) AS nb FROM x a JOIN x b ON a.w = b.w AND a.id < b.id GROUP BY a.id, b.id),
  p AS (SELECT a, b, "both", na + nb - "both" AS either FROM o WHERE 100 * "both" >= 90 * (na + nb - "both"))"""
_CLASSES = _SETS + """, e AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT x AS id, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id),
  c AS (SELECT t.id AS json_index, coalesce(m.root, u.id, t.id) AS class FROM t LEFT JOIN u ON u.t = t.t LEFT JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) m ON m.id = u.id)"""


@query(_SETS + ' SELECT a, b, "both", either FROM p')
def jaccard_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.jaccard_pairs(similarity.token_sets(snippets(spark, sf_dir), "json_index", "code"), "json_index")


@query(_CLASSES + " SELECT * FROM c")
def duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.duplicate_classes(snippets(spark, sf_dir), "json_index", "code")


@query(_CLASSES + """ SELECT class, count(*) AS n, count(DISTINCT level) AS levels, count(DISTINCT repo) AS repos, count(DISTINCT y0) > 1 OR count(DISTINCT y1) > 1 AS conflict FROM c JOIN snippets s ON s.json_index = c.json_index GROUP BY class HAVING count(*) > 1""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snippets(spark, sf_dir)
    held = similarity.duplicate_classes(rows, "json_index", "code").join(rows.drop("code"), "json_index")
    conflict = (F.countDistinct("y0") > 1) | (F.countDistinct("y1") > 1)
    return held.groupBy("class").agg(F.count("*").alias("n"), F.countDistinct("level").alias("levels"), F.countDistinct("repo").alias("repos"), conflict.alias("conflict")).where("n > 1")


@query(_CLASSES + _FOLDS.removeprefix(_S) + """, h AS (SELECT f.fold, c.class, c.json_index FROM f JOIN c ON c.json_index = f.json_index),
  k AS (SELECT h.fold, h.json_index, EXISTS (SELECT 1 FROM h o WHERE o.class = h.class AND o.fold <> h.fold) AS leaks FROM h)
  SELECT fold, count(*) AS rows, count(*) FILTER (leaks) AS leaking FROM k GROUP BY fold""")  # fmt: skip
def leakage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.leakage(folds(spark, sf_dir), similarity.duplicate_classes(snippets(spark, sf_dir), "json_index", "code"), "json_index")


@query(_S + f""", b AS (SELECT DISTINCT regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') AS t FROM benchmark)
  SELECT json_index, repo FROM snippets WHERE repo NOT IN ('src1', 'src2') AND regexp_replace(coalesce(code, ''), '{_WS}', '', 'g') NOT IN (SELECT t FROM b)""")  # fmt: skip
def decontamination_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.decontaminated(snippets(spark, sf_dir), read(spark, sf_dir, "benchmark"), "code", "text", "repo", ["src1", "src2"])
    return out.select("json_index", "repo")


def _runs_sql(table: str, key: str, column: str) -> str:
    return f"SELECT {key}, unnest(list_distinct(list_transform(range(0, greatest(0, len(w) - 7)), lambda i: array_to_string(w[i + 1:i + 8], ' ')))) AS run FROM (SELECT {key}, string_split(lower(trim(regexp_replace(coalesce({column}, ''), '{_WS}', ' ', 'g'), ' ')), ' ') AS w FROM {table})"


@query(f"WITH a AS ({_runs_sql('documents', 'doc_id', 'text')}), b AS ({_runs_sql('benchmark', 'item_id', 'text')}) SELECT doc_id, item_id, count(*) AS hits FROM a JOIN b ON a.run = b.run GROUP BY doc_id, item_id")
def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.passages_of(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


_TOKEN = text.TOKEN.replace("'", "''")
_TOKENS = _S + f", k AS (SELECT json_index, level, regexp_extract_all(coalesce(code, ''), '{_TOKEN}') AS w FROM snippets)"


@query(_TOKENS + " SELECT json_index, CAST(least(512, len(w)) AS BIGINT) AS n, md5(array_to_string(w[1:512], ' ')) AS digest FROM k")
def token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tokens(F.col("code"), 512)
    return snippets(spark, sf_dir).select("json_index", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


_VOCAB = _TOKENS + """, q AS (SELECT json_index, unnest(w[1:512]) AS token, generate_subscripts(w[1:512], 1) AS pos FROM k),
  n AS (SELECT token, count(*) AS n, min(json_index * 1000 + pos) AS f FROM q GROUP BY token), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, f) AS r FROM n),
  v AS (SELECT token, row_number() OVER (ORDER BY n DESC, f) + 1 AS id, n FROM r WHERE r <= 1998 AND n >= 2)"""  # fmt: skip


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.vocabulary(snippets(spark, sf_dir), "code", "json_index", 2000)


@query(_VOCAB + " SELECT * FROM v")
def vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir)


@query(_VOCAB + """, e AS (SELECT q.json_index, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM q LEFT JOIN v ON v.token = q.token GROUP BY q.json_index)
  SELECT s.json_index, array_to_string(list_resize(coalesce(ids, []), 512, 0), ' ') AS ids FROM snippets s LEFT JOIN e ON e.json_index = s.json_index""")  # fmt: skip
def encoded_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.encoded(snippets(spark, sf_dir), "json_index", "code", _vocabulary(spark, sf_dir))
    return out.select("json_index", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


# the vocabulary of the reference's size, 10,000 with the two reserved ids
_VOCAB_10000 = _VOCAB.replace("r <= 1998", "r <= 9998")


def _vocabulary_10000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.vocabulary(snippets(spark, sf_dir), "code", "json_index")


@query(_VOCAB_10000 + " SELECT * FROM v")
def vocab_topk_10000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary_10000(spark, sf_dir)


@query(_VOCAB_10000 + """, e AS (SELECT q.json_index, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM q LEFT JOIN v ON v.token = q.token GROUP BY q.json_index)
  SELECT s.json_index, array_to_string(list_resize(coalesce(ids, []), 512, 0), ' ') AS ids FROM snippets s LEFT JOIN e ON e.json_index = s.json_index""")  # fmt: skip
def encoded_padded_10000(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.encoded(snippets(spark, sf_dir), "json_index", "code", _vocabulary_10000(spark, sf_dir))
    return out.select("json_index", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query(_TOKENS + """, c AS (SELECT level, len(w) AS n, greatest(1, CAST(ceil(len(w) / 512) AS BIGINT)) AS c FROM k)
  SELECT level, count(*) AS texts, CAST(sum(n) AS BIGINT) AS tokens, max(n) AS longest, CAST(sum(c) AS BIGINT) AS chunks, count(*) FILTER (c > 1) AS chunked FROM c GROUP BY level""")  # fmt: skip
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunk_stats(snippets(spark, sf_dir), ["level"], "code")


_STRIP = r"regexp_replace(line, '^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$', '', 'g')"


@query(r"""WITH l AS (SELECT page_id, unnest(string_split(coalesce(html, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(html, ''), chr(10)), 1) - 1 AS n FROM pages), s AS (SELECT page_id, n, """ + _STRIP + r""" AS s FROM l),
  k AS (SELECT page_id, CASE WHEN n = 0 THEN 'signature' WHEN regexp_matches(s, '^[{}();]*$') THEN 'braces only' WHEN regexp_matches(s, '^(//|/\*|\*|@)') THEN 'comment or annotation' WHEN starts_with(s, 'return') THEN 'return'
    WHEN regexp_matches(s, '^(if|else|for|while|switch|case|do|try|catch|finally)\b') THEN 'condition, loop or try'
    WHEN regexp_matches(s, '^(final\s+)?[A-Z][\w<>\[\], ?]*\s+\w+\s*(=|;)') OR regexp_matches(s, '^(int|long|boolean|double|float|char|byte|short)\b') THEN 'declaration'
    WHEN contains(s, '=') AND NOT contains(s, '==') THEN 'assignment' WHEN contains(s, '(') THEN 'call' ELSE 'other' END AS kind FROM s)
  SELECT kind, count(*) AS lines, count(DISTINCT page_id) AS pages FROM k GROUP BY kind""")  # fmt: skip
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.lines(read(spark, sf_dir, "pages"), "page_id", "html")
    kind = text.line_kind(F.col("line"), F.col("line_no") == 0)
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("lines"), F.countDistinct("page_id").alias("pages"))


@query(_TOKENS + r""", z AS (SELECT s.json_index, string_split(coalesce(code, ''), chr(10)) AS l, length(coalesce(code, '')) AS c, len(w) AS t FROM snippets s JOIN k ON k.json_index = s.json_index)
  SELECT json_index, len(l) AS loc_physical, len(list_filter(l, lambda x: regexp_matches(x, '[^ \t\r\f\x0B]'))) AS loc_nonblank, c AS chars, t AS n_tokens FROM z""")  # fmt: skip
def size_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir).select("json_index", *[c.alias(k) for k, c in text.sizes(F.col("code")).items()])


@query(_S + r""", l AS (SELECT json_index, string_split(code, chr(10)) AS l FROM snippets)
  SELECT json_index, md5(array_to_string(list_filter(l, lambda x: regexp_matches(x, '[^ \t\r\f\x0B]')), chr(10))) AS removed, md5(array_to_string(l, chr(10) || chr(10))) AS inflated,
  md5(array_to_string(flatten(list_transform(l, lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN ['// note', x] ELSE [x] END)), chr(10))) AS commented FROM l""")  # fmt: skip
def layout_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("code")
    digest = lambda c: F.md5(c.cast("binary"))
    return snippets(spark, sf_dir).select("json_index", digest(text.blank_removed(code)).alias("removed"), digest(text.blank_inflated(code)).alias("inflated"), digest(text.commented(code, "// note")).alias("commented"))


@query(_S + r""", l AS (SELECT json_index, code, string_split(code, chr(10)) AS l FROM snippets)
  SELECT json_index, md5(CASE WHEN len(l) > 3 THEN array_to_string(l[1:3], chr(10)) || chr(10) || '... (' || (len(l) - 3) || ' lines omitted)' ELSE code END) AS truncated,
  md5(regexp_replace(code, '[ \t\n\r\f\x0B]+', '', 'g')) AS squashed, md5(replace(replace(replace(replace(code, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r')) AS escaped FROM l""")  # fmt: skip
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("code")
    digest = lambda c: F.md5(c.cast("binary"))
    return snippets(spark, sf_dir).select("json_index", digest(scalar.truncated(code, 3)).alias("truncated"), digest(scalar.squashed(code)).alias("squashed"), digest(scalar.dot_escape(code)).alias("escaped"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url, ' '), '^(?:[a-zA-Z]+://)?(?:[^/@]*@)?', ''), '(?:\.git)?/*$', ''), '^([^/:]+):', '\1/') AS slug,
  regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS stem, sha1(url) AS file_key FROM pages""")  # fmt: skip
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", scalar.repo_slug(url).alias("slug"), scalar.file_stem(url).alias("stem"), F.sha1(url.cast("binary")).alias("file_key"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(1 - 1e-6, greatest(1e-6, l_tax * 10)) AS q, l_extendedprice - 50000 AS v FROM lineitem)
  SELECT l_linenumber, round(avg(ln(q / (1 - q))), 6) AS logit, round(avg(1 / (1 + exp(-ln(q / (1 - q)) / 2))), 6) AS tempered, round(avg(sign(v) * ln(1 + abs(v))), 6) AS signed_log FROM p GROUP BY l_linenumber""")  # fmt: skip
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = scalar.logit(F.col("l_tax") * 10)
    out = read(spark, sf_dir, "lineitem").groupBy("l_linenumber")
    return out.agg(F.round(F.avg(z), 6).alias("logit"), F.round(F.avg(scalar.sigmoid(z, 2.0)), 6).alias("tempered"), F.round(F.avg(scalar.signed_log1p(F.col("l_extendedprice") - 50000)), 6).alias("signed_log"))


@query("""SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (regexp_matches(text, '[?]')) AS asks, max(turn) AS last_turn FROM conversations GROUP BY role""")
def transcript_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").groupBy("role")
    return rows.agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.char_length("text")).alias("chars"), F.count_if(F.col("text").rlike("[?]")).alias("asks"), F.max("turn").alias("last_turn"))


# the answer's candidates are the event types; a share of the mass is what the yes-like ones have
@query("""WITH t AS (SELECT user_id, ln(count(*) / sum(count(*)) OVER (PARTITION BY user_id)) AS lp, event_type IN ('click', 'purchase') AS yes, event_type IN ('error', 'view') AS no FROM events GROUP BY user_id, event_type)
  SELECT user_id, round(sum(exp(lp)) FILTER (yes) / (sum(exp(lp)) FILTER (yes) + sum(exp(lp)) FILTER (no)), 6) AS p_yes FROM t GROUP BY user_id""")  # fmt: skip
def answer_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    lp = F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    mass = lambda *names: F.sum(F.when(F.col("event_type").isin(*names), F.exp("lp")))
    yes, no = mass("click", "purchase"), mass("error", "view")
    return counts.withColumn("lp", lp).groupBy("user_id").agg(F.round(yes / (yes + no), 6).alias("p_yes"))
