"""Sources and sinks: JSON lines, JSON documents, TOML manifests, CSV, Parquet."""

from __future__ import annotations

import json
import tomllib
import uuid
from collections.abc import Sequence
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField("manifest", T.StringType()), T.StructField("benchmark", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("item_id", T.StringType())])


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of JSON-lines files under an explicit schema; blank lines are none."""
    return spark.read.schema(schema).json(path)


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, line_no, payload`` of text files, blank lines dropped.

    A file is one value while it is split, so line numbers need no shuffle; use
    ``json_lines`` for files beyond some hundred megabytes.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("i", "payload"))
    return lines.filter(F.length(F.trim("payload")) > 0).select("path", (F.col("i") + 1).alias("line_no"), "payload")


def json_documents(spark: SparkSession, path: str | list[str], schema: T.StructType | str, recursive: bool = False) -> DataFrame:
    """One row per JSON document, with its file in ``source_file``."""
    r = spark.read.schema(schema).option("multiLine", True)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    return r.json(path).withColumn("source_file", F.col("_metadata.file_path"))


def finished_summaries(docs: DataFrame, completed: str, requested: str) -> DataFrame:
    """Summaries that are not in flight: as many completed as requested."""
    return docs.filter(F.size(completed) >= F.size(requested))


def _read_text(spark: SparkSession, path: str) -> str:
    if urlparse(path).scheme in ("", "file"):
        with open(urlparse(path).path or path, encoding="utf-8") as f:
            return f.read()
    return spark.read.text(path, wholetext=True).first()[0]


def toml_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``manifest, benchmark, ord, item_id`` of a manifest; its order is kept in ``ord``."""
    doc = tomllib.loads(_read_text(spark, path))
    ids = doc.get("item_ids")
    if not isinstance(ids, list) or not all(isinstance(i, str) for i in ids):
        raise ValueError(f"{path}: item_ids is no list of strings")
    return spark.createDataFrame([(path, doc.get("benchmark"), i, x) for i, x in enumerate(ids)], MANIFEST)


def toml_table(spark: SparkSession, path: str, table: str, schema: T.StructType) -> DataFrame:
    """Rows of an array of tables with typed, optional fields."""
    rows = tomllib.loads(_read_text(spark, path)).get(table, [])
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def items_by_id(items: DataFrame, wanted: DataFrame, key: str = "item_id") -> DataFrame:
    """The wanted items in the manifest's order; raises if one is missing."""
    if lost := wanted.join(items.select(key), key, "left_anti").take(5):
        raise ValueError(f"items not found: {[r[key] for r in lost]}")
    return items.join(wanted.select(key, "ord"), key).orderBy("ord")


def append_json_lines(df: DataFrame, path: str) -> None:
    """Appends rows with their fields in sorted order."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Replaces a JSON folder: written beside it and renamed, so readers see the old one or the new one whole."""
    spark = df.sparkSession
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.json(new)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(p(path), True)
    if not fs.rename(p(new), p(path)):
        raise OSError(f"{new} could not be renamed to {path}")


def directory_hash(spark: SparkSession, path: str) -> str:
    """One SHA-256 of all files of a folder: their relative names and contents, in order of name."""
    root = f"{spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip('/')}/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", F.lit(root), 2), -1)
    lines = files.select(F.concat_ws("\t", name, F.sha2("content", 256)).alias("line"))
    return lines.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h")).first().h  # a line per file


def curve_points(docs: DataFrame, payload: str, keep: Sequence[str]) -> DataFrame:
    """``keep, frame_count, dense_accuracy, ci95_low, ci95_high, n`` of summaries in any of three layouts.

    The points stand in ``runs``, ``dev.dense_curve`` or ``dense_curve``; an
    accuracy has one of two names, its interval is a pair, two fields or absent (0
    to 1).  Other documents have no points.
    """
    v = F.try_parse_json(payload)
    where = [F.try_variant_get("_v", at, "array<variant>") for at in ("$.runs", "$.dev.dense_curve", "$.dense_curve")]
    points = docs.select(*keep, v.alias("_v")).select(*keep, F.explode(F.coalesce(*where)).alias("_r"))
    number = lambda at: F.try_variant_get("_r", at, "double")
    given = lambda *names: F.coalesce(*[F.nullif(number(f"$.{n}"), F.lit(0.0)) for n in names], F.lit(0.0))
    low, high = (F.coalesce(number(f"$.dense_accuracy_ci95[{i}]"), F.when(number("$.ci95_low").isNotNull() & number("$.ci95_high").isNotNull(), number(f"$.{name}")), F.lit(none)) for i, name, none in ((0, "ci95_low", 0.0), (1, "ci95_high", 1.0)))
    return points.select(*keep, F.try_variant_get("_r", "$.frame_count", "int").alias("frame_count"), given("dense_accuracy", "accuracy").alias("dense_accuracy"), low.alias("ci95_low"), high.alias("ci95_high"), given("count", "n").cast("int").alias("n"))


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """CSV with a header and a fixed order of fields."""
    df.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_manifest(df: DataFrame, path: str, benchmark: str, key: str = "item_id", limit: int = 100_000) -> None:
    """A TOML manifest of ids; a list beyond ``limit`` is refused, it would not fit a manifest."""
    ids = [r[0] for r in df.select(key).orderBy(key).limit(limit + 1).collect()]
    if len(ids) > limit:
        raise ValueError(f"more than {limit} ids")
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"benchmark = {json.dumps(benchmark)}\nitem_ids = [\n" + "".join(f"  {json.dumps(i)},\n" for i in ids) + "]\n")


def markdown_table(df: DataFrame, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``ord, line``: a Markdown table as ordered lines."""
    head = df.sparkSession.createDataFrame([(-2, "| " + " | ".join(fields) + " |"), (-1, "|" + "---|" * len(fields))], "ord bigint, line string")
    from pyspark.sql import Window

    body = df.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint").alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), F.lit(" |")).alias("line"))
    return head.unionByName(body)


def cache_get(requests: DataFrame, cache: DataFrame, digest: str = "digest") -> DataFrame:
    """Requests with the cached columns; null where the cache misses."""
    return requests.join(cache, digest, "left")


def cache_put(entries: DataFrame, path: str, digest: str = "digest") -> None:
    """Adds cache entries, partitioned by the digest's first digits; the newest of a digest holds on reading."""
    entries.withColumn("_prefix", F.substring(digest, 1, 2)).write.mode("append").partitionBy("_prefix").option("compression", "zstd").parquet(path)


def encode_array(values: str, shape: str, dtype: str):
    """Struct of type, shape and data for a JSON payload."""
    return F.struct(F.lit(dtype).alias("dtype"), F.col(shape).alias("shape"), F.col(values).alias("data"))


def decode_array(payload: str):
    """The data of an encoded array; an error if the shape does not fit it."""
    size = F.aggregate(F.col(f"{payload}.shape"), F.lit(1), lambda a, x: a * x.cast("int"))
    return F.when(F.size(F.col(f"{payload}.data")) == size, F.col(f"{payload}.data")).otherwise(F.raise_error(F.lit("array does not fit its shape")))
