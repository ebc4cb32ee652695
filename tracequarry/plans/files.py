"""Queries of readers and writers: a table is written to the shared folder in a format and read back."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import textnorm as N
from tracequarry.functions.hooks import grow
from tracequarry.plans.registry import Registry
from tracequarry.plans.views import rollout_rows
from tracequarry.session import ensure_checkpoint_dir, table
from tracequarry.sources import readers
from tracequarry.streaming import queues as Q

R = Registry()
_P = "prompted_search_smoke"


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder, removed when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone by then
            pass

    atexit.register(remove)
    return path


@R.query("s02_json_scan", "SELECT row_id, question, split FROM fvqa_toy")
def json_scan(s, d):
    path = scratch(s) + "/rows.json"
    readers.write_jsonl(table(s, d, "fvqa_toy").select("row_id", "question", "split"), path)
    return readers.read_jsonl(s, path, "row_id bigint, question string, split string")


@R.query("s05_strict_lines", "SELECT line_id, sample_id FROM agentic_rollout_smoke")
def strict_lines(s, d):
    path = scratch(s)
    readers.write_jsonl(table(s, d, "agentic_rollout_smoke").select("line_id", "sample_id"), path)
    return readers.read_jsonl(s, path, "line_id bigint, sample_id string", "strict")


@R.query("s06_objects_only", "SELECT line_id FROM agentic_rollout_smoke WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'")
def objects_only(s, d):
    """Lines that hold an object, kept with their number; others are what the strict reader raises for."""
    x = table(s, d, "agentic_rollout_smoke").select("line_id", F.try_parse_json("raw").alias("v")).where("v is not null")
    return x.where(F.schema_of_variant("v").startswith("OBJECT")).select("line_id")


@R.query("s07_tolerant_lines", "SELECT j->>'$.method' AS method, count(*) AS n FROM (SELECT raw::JSON AS j FROM (SELECT raw FROM agentic_rollout_smoke WHERE json_valid(raw) AND json_type(raw) = 'OBJECT')) GROUP BY 1")
def tolerant_lines(s, d):
    path = scratch(s)
    table(s, d, "agentic_rollout_smoke").where("raw is not null and not contains(raw, '\\n')").select("raw").write.text(path)
    return readers.read_jsonl(s, path, "method string", "tolerant").groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@R.query("s08_json_array", "SELECT sample_id, question FROM toy_vqa")
def json_array(s, d):
    path = scratch(s)
    rows = table(s, d, "toy_vqa").select("sample_id", "question")  # a table of fixed size
    rows.agg(F.to_json(F.collect_list(F.struct("sample_id", "question"))).alias("value")).write.text(path)
    return readers.read_json_array(s, path, "sample_id string, question string")


@R.query("s10_step_files", "SELECT (row_id % 5)::INT AS step, row_id, regexp_replace(question, '[0-9]', '*', 'g') AS question FROM fvqa_toy")
def step_files(s, d):
    path = scratch(s)
    readers.write_step_files(table(s, d, "fvqa_toy").select((F.col("row_id") % 5).cast("int").alias("step"), "row_id", "question"), path)
    return readers.read_step_files(s, path, "row_id bigint, question string", mask="[0-9]")


@R.query("k02_json_lines", "SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE '<' || strlen(text) || ' bytes>' END AS blob, lang FROM documents")
def json_lines(s, d):
    """JSON lines in which binary values are told by their size."""
    path = scratch(s)
    readers.write_jsonl(table(s, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("blob"), "lang"), path)
    return readers.read_jsonl(s, path, "doc_id bigint, blob string, lang string")


@R.query("k03_csv_file", "SELECT sample_id, replace(coalesce(question, ''), chr(13), '') AS question, '' AS source FROM toy_vqa UNION ALL SELECT '', '', source FROM source_catalog")
def csv_file(s, d):
    """A CSV file whose header is the union of the columns of its parts."""
    path = scratch(s)
    readers.write_csv([table(s, d, "toy_vqa").select("sample_id", "question"), table(s, d, "source_catalog").select("source")], path)
    return readers.read_csv_rows(s, path, "sample_id string, question string, source string").na.fill("")


@R.query("s06_strict_objects", "SELECT line_id FROM agentic_rollout_smoke WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'")
def strict_objects(s, d):
    """Numbered lines that hold an object; another line raises, as the strict reader does."""
    good = table(s, d, "agentic_rollout_smoke").withColumn("v", F.try_parse_json("raw")).where(F.schema_of_variant("v").startswith("OBJECT"))
    return readers.require_objects(good.select("line_id", "raw"), "line_id", "raw").select("line_id")


@R.query("s11_last_metrics", "SELECT * FROM (VALUES ('step', 2.0::DOUBLE), ('val/acc', 0.75), ('val/f1', 0.5)) t(key, value)")
def last_metrics(s, d):
    path = scratch(s)
    s.createDataFrame([("step:1 val/acc:0.5\nnoise\nstep:2 val/acc:0.75 val/f1:5e-1 x:bad\nend",)], "value string").coalesce(1).write.text(path)
    return readers.last_metrics_line(s, path)


@R.query("s12_newest_file", "SELECT 'two' AS name")
def newest(s, d):
    import time

    path = scratch(s)
    for name in ("one", "two"):
        s.createDataFrame([(name,)], "value string").coalesce(1).write.text(f"{path}/{name}")
        time.sleep(1.1)
    found = readers.newest_file(s, f"{path}/*/part-*")
    return s.createDataFrame([(found.rsplit("/", 2)[-2],)], "name string")


@R.query("s18_queue_source", "SELECT row_id, (count(*) OVER () - row_number() OVER (ORDER BY row_id))::BIGINT AS remaining FROM fvqa_toy")
def queue_source(s, d):
    """Items in order of arrival with the number that remains behind each."""
    from tracequarry.operators.batch import with_row_number

    x = with_row_number(table(s, d, "fvqa_toy").select("row_id"), "row_id")
    return x.select("row_id", (F.lit(x.count()) - 1 - F.col("i")).alias("remaining"))


@R.query("k01_parquet_splits", "SELECT row_id, split FROM fvqa_toy")
def parquet_splits(s, d):
    path = scratch(s)
    readers.write_splits(table(s, d, "fvqa_toy").select("row_id", "split"), path)
    return s.read.parquet(path).select("row_id", "split")


@R.query("k04_json_document", "SELECT count(*) AS n, min(row_id) AS first FROM fvqa_toy")
def json_document(s, d):
    path = scratch(s)
    table(s, d, "fvqa_toy").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first")).select(F.to_json(F.struct("n", "first"), {"pretty": "true"}).alias("value")).write.text(path)
    return s.read.schema("n bigint, first bigint").option("multiLine", True).json(path)


@R.query("k05_generation_dump", f"SELECT (row_id % 3)::INT AS step, count(*) AS n FROM {_P} GROUP BY 1")
def generation_dump(s, d):
    path = scratch(s)
    readers.write_generations(rollout_rows(s, d).select((F.col("row_id") % 3).alias("step"), F.col("question").alias("input"), F.col("final_answer").alias("output")), path)
    return s.read.schema("input string, output string, step int").json(path).groupBy("step").agg(F.count(F.lit(1)).alias("n"))


@R.query("k06_metrics_log", "SELECT * FROM (SELECT 1 AS step, 'train' AS label, 0.5::DOUBLE AS loss UNION ALL SELECT 2, 'train', 0.25 UNION ALL SELECT 3, 'final_validation', NULL)")
def metrics_log(s, d):
    path = scratch(s)
    for row in ((1, "train", 0.5), (2, "train", 0.25), (3, "final_validation", None)):
        s.createDataFrame([row], "step int, label string, loss double").write.mode("append").json(path)
    return readers.read_jsonl(s, path, "step int, label string, loss double")


@R.query("k07_file_logger", "SELECT event_id AS step, json_object('value', value)::VARCHAR AS data FROM events")
def file_logger(s, d):
    path = scratch(s)
    table(s, d, "events").select(F.col("event_id").alias("step"), F.to_json(F.struct("value")).alias("data")).write.json(path)
    return readers.read_jsonl(s, path, "step bigint, data string")


R.add("k08_metric_key", lambda s, d: table(s, d, "source_catalog").select("source", N.metric_key(F.concat(F.lit("val//"), "source", F.lit("/acc@5:x"))).alias("key")), "SELECT source, 'val/' || source || '/acc_at_5_x' AS key FROM source_catalog")


@R.query("k10_queue_sink", "SELECT user_id, greatest(count(*) - 32, 0) AS dropped FROM events GROUP BY user_id")
def queue_sink(s, d):
    from tracequarry.streaming.queues import queue_statistics

    return queue_statistics(table(s, d, "events"), "user_id", 32).select("user_id", "dropped")


@R.query("k12_memoised_table", f"SELECT data_source, count(*) AS n FROM {_P} GROUP BY data_source")
def memoised(s, d):
    path = scratch(s)
    make = lambda: rollout_rows(s, d).groupBy("data_source").agg(F.count(F.lit(1)).alias("n"))
    readers.load_or_compute(s, path, make)
    return readers.load_or_compute(s, path, make)


def event_stream(s, d):
    """The events as a stream of files."""
    return s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")


def drained(df, path: str, name: str, mode: str = "update") -> None:
    """Runs a streaming query over all that is there; each micro-batch is appended with its number."""
    write = lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{path}/rows")
    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state-{name}").trigger(availableNow=True).start().awaitTermination()


_QUEUE = "SELECT user_id, least(count(*), 32)::INT AS size, count(*) AS produced, greatest(count(*) - 32, 0) AS dropped, min(event_id) FILTER (WHERE r <= 32) AS oldest FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) GROUP BY user_id"


@R.query("st01_queue_stream", _QUEUE)
def queue_stream(s, d):
    """The bounded queue as a streaming operator; the last state of every queue."""
    path = scratch(s)
    drained(Q.bounded_queue(event_stream(s, d), "user_id", "event_id", 32), path, "queue")
    return Q.last_state(s.read.parquet(f"{path}/rows"), "user_id", "produced")


@R.query("st10_metric_stream", "SELECT event_id AS step, event_type AS label, round(value, 6) AS value FROM events")
def metric_stream(s, d):
    """Metrics appended per micro-batch as JSON lines, read again."""
    path = scratch(s)
    rows = event_stream(s, d).select(F.col("event_id").alias("step"), F.col("event_type").alias("label"), F.round("value", 6).alias("value"))
    Q.append_metrics(rows, f"{path}/log", path.rsplit("-", 1)[-1]).awaitTermination()
    return readers.read_jsonl(s, f"{path}/log", "step bigint, label string, value double")


@R.query("st11_grown_stream", "SELECT event_id, value FROM events UNION ALL SELECT event_id + 10000000, value / 2 FROM events WHERE event_type = 'error'")
def grown_stream(s, d):
    """Every micro-batch and the rows a generator makes of it."""
    path = scratch(s)
    half = lambda x: x.where("event_type = 'error'").select((F.col("event_id") + 10_000_000).alias("event_id"), (F.col("value") / 2).alias("value"))
    drained(grow(event_stream(s, d).select("event_id", "event_type", "value"), half), path, "grown", "append")
    return s.read.parquet(f"{path}/rows").select("event_id", "value")


@R.query("st13_late_data_stream", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def late_data_stream(s, d):
    """Event-time counts per day with a watermark; the last update of every window."""
    path = scratch(s)
    stream = event_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    drained(Q.windowed_counts(stream, "ts", "event_type", "1 day", "2 days"), path, "days")
    last = s.read.parquet(f"{path}/rows").groupBy("start", "event_type").agg(F.max_by("n", "_batch").alias("n"))
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@R.query("k08_fan_out", "SELECT sink, event_id, 'val/' || event_type || '_at_1' AS key FROM events, (VALUES ('file'), ('log')) t(sink)")
def fan_out(s, d):
    """Metrics of a stream to two sinks, under safe keys."""
    path = scratch(s)
    rows = event_stream(s, d).select("event_id", F.concat(F.lit("val//"), "event_type", F.lit("@1")).alias("key"))
    sinks = {"file": lambda x, n: x.write.mode("append").parquet(f"{path}/file"), "log": lambda x, n: x.write.mode("append").json(f"{path}/log")}
    Q.fan_out(rows, sinks, path.rsplit("-", 1)[-1]).awaitTermination()
    both = s.read.parquet(f"{path}/file").withColumn("sink", F.lit("file")).unionByName(readers.read_jsonl(s, f"{path}/log", "event_id bigint, key string").withColumn("sink", F.lit("log")))
    return both.select("sink", "event_id", "key")
