"""Scans of the file forms that experiments leave behind, each with a schema of the caller's."""

from __future__ import annotations

import re
import struct
import zipfile
from collections.abc import Callable, Iterator, Sequence
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.functions.scalar import signed_log1p


def expanded(spark: SparkSession, pattern: str) -> list[str]:
    """The sorted paths of a glob, by Hadoop's file systems; an error when nothing matches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(x.getPath().toString() for x in found or [])
    if not names:
        raise FileNotFoundError(f"nothing matches {pattern}")
    return names


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that each hold one list of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(expanded(spark, path))


def jsonl(spark: SparkSession, path: str, schema: StructType | str, tolerant: bool = False) -> DataFrame:
    """One object for each line. A line that can't be read is an error, or is left out if `tolerant`, like the torn last line of a run that was stopped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(expanded(spark, path))


def csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).options(header=True, sep=sep, quote='"', escape='"', multiLine=True).csv(expanded(spark, path))


def jsonl_problems(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(file, line) of the lines that the tolerant scan leaves out."""
    held = StructType([*(schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fields, StructField("_line", StringType())])
    rows = spark.read.text(expanded(spark, path)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    bad = F.from_json("line", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"})["_line"]
    return rows.where(bad.isNotNull())


def feature_csv(spark: SparkSession, path: str, key: str, exclude: Sequence[str] = (), labels: Sequence[str] = (), signed_log: Sequence[str] = ()) -> DataFrame:
    """The key and all other columns as doubles, those of `signed_log` as sign times log1p; a column that looks like a label is an error unless excluded.

    All files must have the header of the first.
    """
    paths = expanded(spark, path)
    names = spark.read.options(header=True, inferSchema=False).csv(paths[0]).columns
    raw = spark.read.options(header=True, enforceSchema=False).schema(StructType([StructField(c, StringType()) for c in names])).csv(paths)
    names = [c for c in names if c != key and c not in exclude]
    leaks = [c for c in names if c in labels or re.match(r"(y|label)(_|$)", c.lower())]
    if leaks:
        raise ValueError(f"labels among the features: {leaks}")
    value = lambda c: signed_log1p(F.col(c).cast("double")) if c in signed_log else F.col(c).cast("double")
    return raw.select(F.col(key).cast("long").alias(key), *[value(c).alias(c) for c in names])


def named(rows: DataFrame, file: str) -> DataFrame:
    """`rows` with json_index and y (array of int) as the name of their file tells them: `idx_12`, `y_0_1`; null where it doesn't."""
    digits = F.regexp_extract(file, r"(?:^|[^A-Za-z])y((?:[_-]?[01])+)(?![0-9])", 1)
    y = F.when(digits != "", F.transform(F.regexp_extract_all(digits, F.lit("[01]"), F.lit(0)), lambda x: x.cast("int")))
    return rows.withColumns({"json_index": F.regexp_extract(file, r"idx[_-]?(\d+)", 1).try_cast("long"), "y": y})


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest of graphs that were made or left out on purpose, by json_index."""
    rows = jsonl(spark, path, "json_index long, status string, dot_file string")
    return rows.where(F.col("status").isin("success", "skipped")).orderBy("json_index")


def sharded(spark: SparkSession, pattern: str, schema: StructType | str, tolerant: bool = False) -> DataFrame:
    """All shards below each other, with the `file` each row is from and, where its name tells, shard and shards."""
    rows = jsonl(spark, pattern, schema, tolerant).withColumn("file", F.input_file_name())
    part = lambda k: F.regexp_extract("file", r"shard(\d+)of(\d+)", k).try_cast("int")
    return rows.withColumns({"shard": part(1), "shards": part(2)})


def newest(spark: SparkSession, pattern: str, schema: StructType | str, key: str) -> DataFrame:
    """Of each key the rows of the file changed last; of files of one time the last by name."""
    rows = spark.read.schema(schema).json(expanded(spark, pattern)).select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("_file"))
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max("_file").alias("_last"))
    return rows.join(last, (F.col(key) == F.col("_key")) & (F.col("_file") == F.col("_last"))).drop("_key", "_last", "_file")


_NODE = r"^\s*(\w+)\s*\[(.*)\]\s*;?\s*$"
_EDGE = r"^\s*(\w+)\s*->\s*(\w+)\s*(?:\[(.*)\])?\s*;?\s*$"


def dot_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, json_index, line): lines of DOT files; the number in the name's `idx` part is the json_index."""
    rows = spark.read.text(expanded(spark, path)).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    return rows.withColumn("json_index", F.regexp_extract("file", r"idx[_-]?(\d+)", 1).try_cast("long"))


def _attributes(text: F.Column) -> F.Column:
    pairs = F.regexp_extract_all(text, F.lit(r'(\w+)\s*=\s*(?:"(?:[^"\\]|\\.)*+"|[^,\s\]]+)'), F.lit(0))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("key"), F.regexp_replace(F.regexp_replace(x, r"(?s)^\w+\s*=\s*\"?", ""), r'"$', "").alias("value"))
    return F.map_from_entries(F.transform(pairs, entry))


def dot_nodes(lines: DataFrame) -> DataFrame:
    """(file, json_index, node, attributes) of node lines, without the defaults of a graph."""
    held = lines.where(F.col("line").rlike(_NODE) & ~F.col("line").rlike(r"^\s*(graph|node|edge)\b"))
    return held.select("file", "json_index", F.regexp_extract("line", _NODE, 1).alias("node"), _attributes(F.regexp_extract("line", _NODE, 2)).alias("attributes"))


def with_nodes(lines: DataFrame) -> DataFrame:
    """`lines`; a file without a node is an error when they are read."""
    node = F.col("line").rlike(_NODE) & ~F.col("line").rlike(r"^\s*(graph|node|edge)\b")
    counts = lines.groupBy(F.col("file").alias("_file")).agg(F.count_if(node).alias("_n"))
    checked = F.when(F.col("_n") == 0, F.raise_error(F.concat(F.lit("no nodes in "), F.col("file"))).cast("boolean")).otherwise(True)
    return lines.join(counts, F.col("file") == F.col("_file")).where(checked).drop("_file", "_n")


def dot_edges(lines: DataFrame) -> DataFrame:
    held = lines.where(F.col("line").rlike(_EDGE))
    part = lambda k: F.regexp_extract("line", _EDGE, k)
    return held.select("file", "json_index", part(1).alias("src"), part(2).alias("dst"), _attributes(part(3)).alias("attributes"))


def insert_tuples(statement: str) -> Iterator[list[str | None]]:
    """Value tuples of one extended INSERT statement; NULL is None, strings are unescaped, other values are their text."""
    at = statement.find("VALUES")
    if at < 0:
        return
    escapes = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "Z": "\x1a"}
    row: list[str | None] | None = None
    text, quoted, depth, i = [], False, 0, at + 6
    was_string = False

    def value() -> str | None:
        said = "".join(text)
        return said if was_string else None if said.strip().upper() == "NULL" else said.strip()

    while i < len(statement):
        c = statement[i]
        if quoted:
            if c == "\\" and i + 1 < len(statement):
                i += 1
                text.append(escapes.get(statement[i], statement[i]))
            elif c == "'" and statement[i + 1 : i + 2] == "'":
                i += 1
                text.append("'")
            elif c == "'":
                quoted = False
            else:
                text.append(c)
        elif c == "'":
            quoted = was_string = True
            text = [x for x in text if not x.isspace() and x != "_binary"]
        elif c == "(":
            depth += 1
            if depth == 1:
                row, text, was_string = [], [], False
            else:
                text.append(c)
        elif c == ")" and row is not None:
            depth -= 1
            if depth:
                text.append(c)
            else:
                row.append(value())
                yield row
                row, text, was_string = None, [], False
        elif c == "," and depth == 1 and row is not None:
            row.append(value())
            text, was_string = [], False
        elif row is not None and not (was_string and c.isspace()):
            text.append(c)
        elif c == ";" and row is None:
            return
        i += 1


def mysql_table(spark: SparkSession, path: str, name: str, columns: Sequence[str]) -> DataFrame:
    """Rows of one table of a MySQL dump, all columns as text; a statement is one line, as dumps write them. A row of another width is an error."""
    head = f"INSERT INTO `{name}`"
    lines = spark.read.text(expanded(spark, path)).where(F.col("value").startswith(head))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.column(0).to_pylist():
                found = list(insert_tuples(line))
                if wrong := next((r for r in found if len(r) != len(columns)), None):
                    raise ValueError(f"{name}: {len(wrong)} values for {len(columns)} columns")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.string()) for k in range(len(columns))], list(columns))

    return lines.mapInArrow(rows, ", ".join(f"`{c}` string" for c in columns))


def zip_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, text) of the members with this ending; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(expanded(spark, path)).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(BytesIO(content)) as z:
                    for member in sorted(x for x in z.namelist() if x.endswith(suffix) and not x.endswith("/")):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([z.read(member).decode("utf-8", "replace")])], ["archive", "member", "text"])

    return files.mapInArrow(rows, "archive string, member string, text string")


def source_tree(spark: SparkSession, path: str, suffix: str = ".java", numbered: bool = False) -> DataFrame:
    """(path, text) of all files below a folder with this ending; `numbered` adds their `place` in the order of paths."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=f"*{suffix}").load(path)
    rows = files.select("path", F.col("content").cast("string").alias("text"))
    if not numbered:
        return rows
    # a path a file; texts stay out of the one task that numbers them
    places = files.select(F.col("path").alias("_path")).withColumn("place", (F.row_number().over(Window.orderBy("_path")) - 1).cast("long"))
    return rows.join(places, F.col("path") == F.col("_path")).drop("_path")


def npz_matrix(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(row, vector) of the array with this name in NPZ archives; an archive without it is an error."""
    return _matrices(spark, path, lambda x: x[name])


def npy_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, vector) of two-dimensional NPY files of floats, row by row."""
    return _matrices(spark, path, lambda x: x)


def _matrices(spark: SparkSession, path: str, pick: Callable) -> DataFrame:
    files = spark.read.format("binaryFile").load(expanded(spark, path)).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for content in batch.column(1).to_pylist():
                x = pick(np.load(BytesIO(content), allow_pickle=False))
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096].astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float32()))], ["row", "vector"])

    return files.mapInArrow(rows, "row bigint, vector array<float>")


def packed_floats(content: bytes) -> list[float]:
    """Little-endian single floats of a blob; the rest of a length that 4 doesn't divide is left out."""
    return list(struct.unpack(f"<{len(content) // 4}f", content[: len(content) // 4 * 4]))
