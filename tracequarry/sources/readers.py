"""Readers and writers of rollout data. A missing path gives an empty table where the reader says so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


#: Readers by suffix; ``register_format`` adds a user's own.
FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parquet": lambda spark, path: spark.read.parquet(path),
    "json": lambda spark, path: spark.read.json(path),
    "jsonl": lambda spark, path: spark.read.json(path),
}


def register_format(suffix: str, read: Callable[[SparkSession, str], DataFrame]) -> None:
    """A reader (session, path) -> table for paths with a suffix; giving a suffix another reader raises."""
    if FORMATS.get(suffix, read) is not read:
        raise ValueError(f"{suffix} is already registered")
    FORMATS[suffix] = read


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Tables by suffix, concatenated; missing columns become null; a suffix without a reader raises."""
    parts = []
    for path in paths:
        kind = path.rsplit(".", 1)[-1]
        if kind not in FORMATS:
            raise ValueError(f"unknown format {kind!r}")
        parts.append(FORMATS[kind](spark, path))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_prefix(text: Column, prefix: str) -> Column:
    """The text with its prefix, once: a text that has it is left as it is."""
    return F.when(F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "strict") -> DataFrame:
    """JSON lines. ``strict`` raises on a malformed line, ``tolerant`` drops it; blank lines are skipped; a missing
    path gives an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", {"strict": "FAILFAST", "tolerant": "DROPMALFORMED"}[mode]).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file whose top level is a list of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_step_files(spark: SparkSession, folder: str, schema: str, mask: str | None = None) -> DataFrame:
    """One JSON lines file per step (``<step>.jsonl``): rows with ``step`` from the name; texts matching ``mask``
    are starred."""
    df = spark.read.schema(schema).json(f"{folder}/*.jsonl").withColumn("step", F.regexp_extract(F.input_file_name(), r"([0-9]+)\.jsonl$", 1).cast("int"))
    if mask:
        df = df.select(*[F.regexp_replace(c, mask, "*").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    return df


def last_metrics_line(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) pairs of the last log line that has ``step:`` and ``val/``."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n")).where(F.col("value").contains("step:") & F.col("value").contains("val/"))
    last = lines.agg(F.max_by("value", "n").alias("line"))
    pairs = F.regexp_extract_all("line", F.lit(r"([A-Za-z0-9_@/.-]+:[-+0-9.eE]+)"))
    return last.select(F.explode(pairs).alias("p")).select(F.regexp_extract("p", "^(.*):", 1).alias("key"), F.regexp_extract("p", ":([^:]*)$", 1).try_cast("double").alias("value")).where("value is not null")


def newest_file(spark: SparkSession, pattern: str) -> str | None:
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime") if _exists(spark, pattern) else None
    row = files.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1).first() if files is not None else None
    return row["path"] if row else None


def write_splits(df: DataFrame, folder: str, split: str = "split") -> None:
    """One parquet folder per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(folder)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; binary values become ``<n bytes>``."""
    cols = [F.concat(F.lit("<"), F.octet_length(c), F.lit(" bytes>")).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").json(path)


def write_csv(parts: list[DataFrame], path: str) -> None:
    """CSV with the union of all columns in the order first seen; missing values are empty."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in out.columns]).write.mode("overwrite").option("header", True).csv(path)


def write_generations(df: DataFrame, folder: str, step: str = "step") -> None:
    df.write.mode("append").partitionBy(step).json(folder)


def write_step_files(df: DataFrame, folder: str, step: str = "step") -> None:
    """One JSON lines file per step, named ``<step>.jsonl``, written in parallel: a folder per step whose only file is moved."""
    spark = df.sparkSession
    df.repartition(step).write.mode("overwrite").partitionBy(step).json(f"{folder}/_parts")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{folder}/_parts")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for own in fs.listStatus(root):  # one entry a step
        if own.isDirectory():
            name = own.getPath().getName().split("=", 1)[1]
            files = [f.getPath() for f in fs.listStatus(own.getPath()) if f.getPath().getName().startswith("part-")]
            fs.rename(files[0], jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.jsonl"))
    fs.delete(root, True)


def require_objects(df: DataFrame, number: str, text: str) -> DataFrame:
    """(number, v): the JSON object of every line; a line that holds none raises with its number. Blank lines are skipped."""
    x = df.where(F.length(F.trim(text)) > 0).select(number, F.try_parse_json(text).alias("v"))
    whole = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return x.select(number, F.when(whole, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("no JSON object in line "), F.col(number).cast("string"))).cast("variant")).alias("v"))


def flatten_struct(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested fields as top-level columns named by their path."""
    out = []

    def walk(prefix: str, names: list[str], fields) -> None:
        for f in fields:
            path, name = f"{prefix}`{f.name}`", [*names, f.name]
            if f.dataType.typeName() == "struct":
                walk(path + ".", name, f.dataType.fields)
            else:
                out.append(F.col(path).alias(separator.join(name)))

    walk("", [], df.schema.fields)
    return df.select(*out)


def cache_key(*columns: str):
    """A key that is the same in every process."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def load_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """The stored table, or the computed one after storing it."""
    if not _exists(spark, path):
        compute().write.parquet(path)
    return spark.read.parquet(path)
