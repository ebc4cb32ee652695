"""Sample queues and replay pools: Structured Streaming operators and their batch replay.

The reference semantics are about order of arrival, not event time; watermarks in ``windowed_counts`` are an
addition of this engine. State of a key is bounded by its capacity.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracequarry.functions.textnorm import metric_key
from tracequarry.operators.batch import running_sum
from tracequarry.session import ensure_checkpoint_dir


def bounded_queue(stream: DataFrame, key: str, seq: str, capacity: int) -> DataFrame:
    """(key, size, produced, dropped, oldest) after each trigger: a queue that drops its oldest item when full."""
    kind = {f.name: f.dataType.simpleString() for f in stream.schema}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, produced = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        new = sorted(int(x) for b in batches for x in b[seq])
        produced += len(new)
        items = (items + new)[-capacity:]
        state.update((json.dumps(items), produced))
        yield pd.DataFrame({key: [k[0]], "size": [len(items)], "produced": [produced], "dropped": [produced - len(items)], "oldest": [items[0] if items else None]})

    schema = f"{key} {kind[key]}, size int, produced bigint, dropped bigint, oldest bigint"
    return stream.select(key, seq).groupBy(key).applyInPandasWithState(step, schema, "items string, produced bigint", "update", GroupStateTimeout.NoTimeout)


def last_state(updates: DataFrame, key: str, produced: str) -> DataFrame:
    """The latest of the updates of each key: that which has seen most; other columns but the batch number are kept."""
    cols = [c for c in updates.columns if c not in (key, "_batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*cols), produced).alias("_s")).select(key, *[F.col(f"_s.{c}").alias(c) for c in cols])


def queue_replay(df: DataFrame, key: str, seq: str, capacity: int) -> DataFrame:
    """Rows still in each queue after all have arrived: the last ``capacity`` by sequence."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(seq)))).where(F.col("_r") <= capacity).drop("_r")


def queue_statistics(df: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, produced, size, dropped)."""
    n = F.count(F.lit(1))
    return df.groupBy(key).agg(n.alias("produced"), F.least(n, F.lit(capacity)).alias("size"), F.greatest(n - capacity, F.lit(0)).alias("dropped"))


def staleness_budget(required: int, staleness: float, sync_step: int) -> int:
    """Samples that may be produced before the next parameter version."""
    return int(required * (staleness + 1) * sync_step)


def staleness(df: DataFrame, key: str, seq: str, kind: str, budget: int, capacity: int) -> DataFrame:
    """(columns, version, queued, stale, pause) after every event of a producer, in order.

    Events are "sample" (one more is queued), "consume" (one less, if there is any to take) and "sync" (a new parameter version);
    others change nothing. What is queued at a version change counts as stale from then on, besides the samples since; the
    producer has to pause while the stale ones reach the budget or the queue its capacity. Windows run per producer.
    """
    w = W.partitionBy(key).orderBy(seq)
    upto, here = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(key, "version").orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    change = F.when(F.col(kind) == "sample", 1).when(F.col(kind) == "consume", -1).otherwise(0)
    # a queue that is never below 0: the running sum over its least value so far
    x = df.withColumn("_sum", F.sum(change).over(upto)).withColumn("version", F.count_if(F.col(kind) == "sync").over(upto))
    x = x.withColumn("queued", F.col("_sum") - F.least(F.min("_sum").over(upto), F.lit(0)))
    carried = F.first(F.when(F.col("version") > 0, F.col("queued")).otherwise(0)).over(here)
    x = x.withColumn("stale", carried + F.count_if(F.col(kind) == "sample").over(here))
    return x.withColumn("pause", (F.col("stale") >= budget) | (F.col("queued") >= capacity)).drop("_sum")


def version_spans(df: DataFrame, first: str, last: str) -> DataFrame:
    """One row: mean span of parameter versions, share of samples that span several."""
    span = F.abs(F.col(last) - F.col(first))
    return df.agg(F.round(F.avg(span), 6).alias("mean_span"), F.round(F.avg((span > 0).cast("int")), 6).alias("partial_ratio"))


def accumulate_until(df: DataFrame, step: str, prompts: Column, target: int) -> DataFrame:
    """(step, prompts, total, ready): batches in order until their prompts reach the target. One row per batch."""
    per = df.groupBy(step).agg(prompts.alias("prompts"))
    x = running_sum(per, "prompts", step)
    return x.withColumn("ready", F.col("total") >= target).where(F.col("total") - F.col("prompts") < target)


def replay_pool(df: DataFrame, task: str, positive: str, block: str, seq: str, capacity: int) -> DataFrame:
    """Rows in each (task, polarity) ring after all blocks: a block longer than the ring keeps its first rows, and
    the last ``capacity`` rows remain."""
    in_block = df.withColumn("_b", F.row_number().over(W.partitionBy(task, positive, block).orderBy(seq))).where(F.col("_b") <= capacity)
    last = W.partitionBy(task, positive).orderBy(F.desc(block), F.desc(seq))
    return in_block.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= capacity).drop("_b", "_r")


def balanced_counts(size: int, ratio: float, positives: int, negatives: int) -> tuple[int, int, int]:
    """(positives, negatives, padding) of a sampled batch: half-even target, the deficit filled from the side with
    more left, the rest padded."""
    want = round(size * min(1.0, max(0.0, ratio)))
    p, n = min(want, positives), min(size - want, negatives)
    first_positive = positives - p >= negatives - n
    for positive in (first_positive, not first_positive):
        short = size - p - n
        if positive:
            p += min(short, positives - p)
        else:
            n += min(short, negatives - n)
    return p, n, size - p - n


def round_robin(df: DataFrame, task: str, order: str, total: int) -> DataFrame:
    """One row of each task in turn until ``total`` are taken."""
    turn = df.withColumn("turn", F.row_number().over(W.partitionBy(task).orderBy(order))).where(F.col("turn") <= total)
    return turn.orderBy("turn", task).limit(total)


def windowed_counts(stream: DataFrame, ts: str, key: str, window: str, late: str) -> DataFrame:
    """Tumbling event-time counts with late data up to ``late`` (an extension; the sample queue has no event time)."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], name: str) -> StreamingQuery:
    """Every micro-batch to every sink, computed once; keys of metrics (column ``key``, if there is one) are made safe first."""
    where = f"{ensure_checkpoint_dir(stream.sparkSession)}/stream-{name}"
    rows = stream.withColumn("key", metric_key(F.col("key"))) if "key" in stream.columns else stream

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks.values():
                sink(batch, number)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", where).trigger(availableNow=True).start()


def append_metrics(stream: DataFrame, path: str, name: str) -> StreamingQuery:
    """Metrics rows appended as JSON lines, once per micro-batch, until the available input is read."""
    where = f"{ensure_checkpoint_dir(stream.sparkSession)}/stream-{name}"
    return stream.writeStream.foreachBatch(lambda df, epoch: df.write.mode("append").json(path)).option("checkpointLocation", where).trigger(availableNow=True).start()
