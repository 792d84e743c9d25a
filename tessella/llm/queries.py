"""The ten operators as queries over whole tables; SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat, language, licenses, line_crf, mixing, ngram_join, ogg, packing, quality_model, shards
from tessella.llm.common import stored, table


#: Says what a conversation of the template's own control strings comes out as.
OWN_MARKS = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(OWN_MARKS).alias("text"))
    made = chat.format_trees(stored(chat.threads(rows.unionByName(own))))
    # all below is read back from the formatted texts
    turns = chat.parse(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select("*", turns.alias("turns"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|/?SYS\]|/?TURN\]|SAYS\])', '\1\\\2', 'g'))
    + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 11
      ELSE 19 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\]|/?SYS\]|/?TURN\]|SAYS\])', '\1\\\2', 'g')) END AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id"""


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", ogg.to_ogg("text").alias("media"))
    read = files.select("doc_id", "media", ogg.from_ogg("media").alias("got"))
    payload = F.col("got.payload")
    return read.select(
        "doc_id",
        F.col("got.text_bytes").alias("n_bytes"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(got.payload, -{ogg.PAD}, {ogg.PAD})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("seconds=%.3f;rms=%.4f;crossings=%d", F.col("got.seconds"), F.col("got.rms"), F.col("got.crossings")).alias("feature"),
        F.col("got.pages").alias("pages"),
        F.col("got.packets").alias("packets"),
        F.col("got.bad_pages").alias("bad_pages"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(k.links, 0) AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
LEFT JOIN (SELECT x, count(*) AS links FROM e GROUP BY x) k ON k.x = d.doc_id"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", licenses.scanner()("text").alias("got"))
    return found.select("doc_id", *[f"got.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def _pattern(template: str) -> str:
    """A template as a regular expression over words that each end with a space."""
    marks = re.sub(r"<<var;min=(\d+);max=(\d+)>>", r"\0\1,\2\0", template.replace("<<beginOptional>>", "\0(\0").replace("<<endOptional>>", "\0)\0"))
    held = {"(": "(?:", ")": ")?"}
    parts = marks.split("\0")
    return "".join("".join(w + " " for w in x.split()) if i % 2 == 0 else held.get(x) or "(?:[^ ]+ ){%s}" % x for i, x in enumerate(parts))


def _demanded(template: str) -> str:
    """The longest run of words outside all regions, so that few texts are matched by the expression."""
    text, before = template, None
    while text != before:
        before, text = text, re.sub(r"<<beginOptional>>(?:(?!<<(?:begin|end)Optional).)*<<endOptional>>", "|", text)
    return max((" ".join(x.split()) for x in re.split(r"<<[^>]*>>|[|]", text)), key=len)


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line,
    CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' under the mit license ') THEN list_filter(range(len(w)), lambda i: array_to_string(w[i + 1:i + 4], ' ') = 'under the mit license') ELSE [] END AS a,
    CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' apache license version 2 ') THEN list_filter(range(len(w)), lambda i: array_to_string(w[i + 1:i + 4], ' ') = 'apache license version 2') ELSE [] END AS b,
    CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' cc by nc ') THEN list_filter(range(len(w)), lambda i: array_to_string(w[i + 1:i + 3], ' ') = 'cc by nc') ELSE [] END AS c FROM w),
f AS (
  SELECT *, list_concat(list_concat(a, b), c) AS hits, list_filter(['apache-2', 'cc-by-nc', 'mit'], lambda x: len(CASE x WHEN 'mit' THEN a WHEN 'cc-by-nc' THEN c ELSE b END) > 0) AS base,
    list_filter([""" + ", ".join(f"'{k}'" for k in sorted(licenses.TEMPLATES)) + r"""], lambda x: CASE x """ + " ".join(f"WHEN '{k}' THEN contains(line, '{_demanded(t)}') AND regexp_matches(line, ' {_pattern(t)}')" for k, t in licenses.TEMPLATES.items()) + r""" END) AS more FROM p)
SELECT doc_id, len(w) AS n_words, len(hits) AS n_base, list_min(hits) AS first_word, list_max(hits) AS last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_concat(base, more)), ',') AS labels, CASE WHEN len(more) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM f"""


def op5_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out("doc_id")))
    return docs.select("doc_id", language.held_out("doc_id").alias("held_out"), language.language_of(model)("text").alias("said")).select("doc_id", "held_out", "said.*")


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train(docs, quality_model.graded(table(spark, sf_dir, "labels")))
    return docs.select("doc_id", quality_model.grade(model)("text").alias("said")).select("doc_id", "said.*")


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = line_crf.fit(line_crf.training_lines(docs, table(spark, sf_dir, "labels")))
    return docs.select("doc_id", line_crf.line_rules(weights)("text").alias("got")).select("doc_id", "got.*")


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_ids(table(spark, sf_dir, "documents"), gain=mixing.GAIN)


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, list_extract(t, xor(c & 255, b) + 1))), 4294967295) AS text_crc32
  FROM documents, crc),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM sized),
placed AS (
  SELECT *, CAST(least(15, ((2 * before + size) * 16) // (2 * total)) AS INTEGER) AS shard FROM ordered)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed"""


def op10_linear_grouping_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_ogg_media, op3_ngram_jaccard, op4_license_scan, op5_output_codes, op6_ordinal_quality, op7_line_rules, op8_temperature_mix, op9_sampled_splitters, op10_linear_grouping_pack)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op3_ngram_jaccard": OP3_SQL, "op4_license_scan": OP4_SQL, "op9_sampled_splitters": OP9_SQL}
