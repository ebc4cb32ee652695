"""Batch algebra on row-indexed frames: repeat, chunk, pad, reorder, slice.

A batch is a frame with a row number column (``i``, from 0, without gaps). Operators keep it explicit instead
of relying on the order of partitions; nothing moves all rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracequarry.session import staged


def ordered(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows with their part and their place in it (``_part``, ``_at``), parts and places in the given order.

    One range shuffle on all order columns, so that ties in the first of them are spread by the next; the result is staged,
    because range bounds are sampled and must not differ between evaluations.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    return staged(x.withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"))


def _with_starts(x: DataFrame, total: Column, out: str, kind: str) -> DataFrame:
    """The total of all earlier parts beside each row; a row per part reaches the driver."""
    sums = sorted((r["_part"], r["t"]) for r in x.groupBy("_part").agg(total.alias("t")).collect())
    starts, run = [], 0
    for part, t in sums:
        starts.append((part, run))
        run += t or 0
    return x.join(F.broadcast(x.sparkSession.createDataFrame(starts, f"_part bigint, {out} {kind}")), "_part")


def with_row_number(df: DataFrame, *order: str | Column, out: str = "i", within: str | None = None) -> DataFrame:
    """Row numbers from 0 in the given order, nulls first (per value of ``within``, if given), without a window: places in
    range parts and the sizes of the parts before. A hot value of ``within`` is spread over the parts as well."""
    x = ordered(df, *([within] if within else []), *order)
    x = _with_starts(x, F.count(F.lit(1)), "_s", "bigint").withColumn(out, F.col("_s") + F.col("_at")).drop("_part", "_at", "_s")
    if not within:
        return x
    first = x.groupBy(F.col(within).alias("_w")).agg(F.min(out).alias("_f"))
    return x.join(first, F.col(within).eqNullSafe(F.col("_w"))).withColumn(out, F.col(out) - F.col("_f")).drop("_w", "_f")


def running_sum(df: DataFrame, value: str, *order: str | Column, out: str = "total") -> DataFrame:
    """Sum of an integer column from the first row to each row in the given order; null counts as 0."""
    x = _with_starts(ordered(df, *order), F.sum(value), "_s", "bigint")
    own = F.sum(F.coalesce(value, F.lit(0))).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    return x.withColumn(out, F.col("_s") + own).drop("_part", "_at", "_s")


def exact_quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: exact quantiles, interpolated between neighbouring values; nulls left out; null without values."""
    x = with_row_number(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), "v")
    n = x.count()

    def at(share: float) -> Column:
        place = share * max(0, n - 1)
        low = int(place)
        pick = lambda i: F.max(F.when(F.col("i") == min(i, n - 1), F.col("v")))
        return pick(low) + (pick(low + 1) - pick(low)) * (place - low)

    return x.agg(*[at(q).alias(name) for name, q in shares.items()])


def repeat(df: DataFrame, k: int, interleave: bool = True, i: str = "i", n: int | None = None) -> DataFrame:
    """Every row k times; aabb if interleaved, else abab. The new row number is ``i`` again."""
    x = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) if k > 0 else df.where("false").withColumn("_j", F.lit(0))
    if interleave:
        return x.withColumn(i, F.col(i) * k + F.col("_j")).drop("_j")
    n = df.count() if n is None else n
    return x.withColumn(i, F.col("_j") * n + F.col(i)).drop("_j")


def repeat_each(df: DataFrame, times: Column, out: str = "copy") -> DataFrame:
    """Every row as often as its count says; counts below 1 and null drop it."""
    return df.withColumn("_t", times).where("_t >= 1").withColumn(out, F.explode(F.sequence(F.lit(1), F.col("_t")))).drop("_t")


def chunks(df: DataFrame, parts: int, i: str = "i", n: int | None = None, out: str = "chunk") -> DataFrame:
    """Equal parts of consecutive rows; the number of rows must be divisible."""
    n = df.count() if n is None else n
    if n % parts:
        raise ValueError(f"{n} rows do not divide into {parts} parts")
    return df.withColumn(out, F.floor(F.col(i) / F.lit(max(1, n // parts))).cast("int"))


def split(df: DataFrame, size: int, i: str = "i", out: str = "chunk") -> DataFrame:
    """Parts of ``size`` rows, the last one short."""
    return df.withColumn(out, F.floor(F.col(i) / size).cast("int"))


def pad_to_divisor(df: DataFrame, divisor: int, i: str = "i", n: int | None = None) -> DataFrame:
    """Rows from the beginning again, cyclically, until the number is divisible."""
    n = df.count() if n is None else n
    pad = -n % divisor
    if n == 0 or pad == 0:
        return df
    turns = -(-pad // n)
    extra = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).withColumn("_k", F.col("_j") * n + F.col(i)).where(F.col("_k") < pad)
    return df.unionByName(extra.withColumn(i, F.lit(n) + F.col("_k")).drop("_j", "_k"))


def unpad(df: DataFrame, pad: int, i: str = "i", n: int | None = None) -> DataFrame:
    n = df.count() if n is None else n
    return df.where(F.col(i) < n - pad)


def pad_edge(df: DataFrame, n: int, first: bool, i: str = "i") -> DataFrame:
    """n copies of the first row before all others, or of the last row after them."""
    if first:
        return df.withColumn(i, F.col(i) + n).unionByName(df.where(F.col(i) == 0).withColumn(i, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))))
    last = df.count() - 1
    return df.unionByName(df.where(F.col(i) == last).withColumn(i, F.explode(F.sequence(F.lit(last + 1), F.lit(last + n)))))


def equal_parts(df: DataFrame, parts: int, i: str = "i", out: str = "part") -> DataFrame:
    """Parts of equal size of consecutive rows; the rows that remain are dropped."""
    size = df.count() // parts
    return df.where(F.col(i) < parts * size).withColumn(out, F.floor(F.col(i) / F.lit(max(1, size))).cast("int"))


def percent_slice(df: DataFrame, low: float, high: float, i: str = "i") -> DataFrame:
    """Rows from low to high percent of their number, both rounded down."""
    n = df.count()
    return df.where((F.col(i) >= int(n * low / 100)) & (F.col(i) < int(n * high / 100)))


def collate(df: DataFrame, columns: list[str], size: int, i: str = "i", out: str = "batch") -> DataFrame:
    """One row per batch of ``size`` consecutive rows: an array per column, in order."""
    g = df.groupBy(F.floor(F.col(i) / size).alias(out)).agg(F.array_sort(F.collect_list(F.struct(F.col(i).alias("_o"), *columns))).alias("_t"))
    return g.select(out, *[F.col(f"_t.{c}").alias(c) for c in columns])


def union_by_position(a: DataFrame, b: DataFrame, i: str = "i") -> DataFrame:
    """Columns of two batches of the same size by row position; a column of both must hold the same values (null equals
    null, NaN equals NaN), else it raises, as does another size."""
    x = a.join(b.select(F.col(i).alias("_i"), F.struct(*[c for c in b.columns if c != i]).alias("_b")), F.col(i) == F.col("_i"), "full")
    whole = F.when(F.col(i).isNotNull() & F.col("_i").isNotNull(), F.col(i)).otherwise(F.raise_error(F.lit("the batches differ in size")))
    out = [whole.alias(i)]
    for c in [*a.columns, *[c for c in b.columns if c not in a.columns]]:
        if c == i:
            continue
        if c in a.columns and c in b.columns:
            out.append(F.when(F.col(c).eqNullSafe(F.col(f"_b.{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs"))).alias(c))
        else:
            out.append(F.col(c if c in a.columns else f"_b.{c}").alias(c))
    return x.select(*out)


def python_slice(df: DataFrame, start: int | None, stop: int | None, step: int, i: str = "i", n: int | None = None) -> DataFrame:
    """Rows of [start:stop:step] with Python's meaning of negative bounds; step must be positive."""
    if step < 1:
        raise ValueError("the step must be positive")
    n = df.count() if n is None else n
    a, b, _ = slice(start, stop, step).indices(n)
    return df.where((F.col(i) >= a) & (F.col(i) < b) & ((F.col(i) - a) % step == 0))


def row_at(df: DataFrame, at: int, i: str = "i") -> DataFrame:
    """The row at a place; a place outside the batch raises."""
    n = df.count()
    if not 0 <= at < n:
        raise IndexError(f"row {at} of {n}")
    return df.where(F.col(i) == at)


def column_partition(df: DataFrame, first: list[str], both: list[str]) -> tuple[DataFrame, DataFrame]:
    """The columns of one step, and the others; columns in ``both`` stay on both sides. Names that are missing are ignored."""
    own = [c for c in df.columns if c in first or c in both]
    return df.select(*own), df.select(*[c for c in df.columns if c not in first or c in both])


def take(df: DataFrame, wanted: DataFrame, i: str = "i", pos: str = "pos") -> DataFrame:
    """Rows by index, repeated and reordered as ``wanted`` (pos, i) says."""
    return wanted.join(df, i)


def union_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both by key; shared columns must be equal (NaN equals NaN), a difference raises."""
    shared = [c for c in b.columns if c in a.columns and c != key]
    own = [c for c in b.columns if c not in a.columns]
    x = a.join(b.select(key, *[F.col(c).alias(f"_b_{c}") for c in shared], *own), key)
    for c in shared:
        x = x.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs"))))
    return x.drop(*[f"_b_{c}" for c in shared])


def pad_sequence(x: Column, length: int, fill: Column, left: bool = False, cut: str = "error") -> Column:
    """Array of exactly ``length``: padded, or cut left, right or in the middle, or an error."""
    n = F.size(x)
    padding = F.array_repeat(fill, F.greatest(F.lit(length) - n, F.lit(0)))
    padded = F.concat(padding, x) if left else F.concat(x, padding)
    head = length // 2
    too_long = {
        "left": F.slice(x, F.greatest(n - length + 1, F.lit(1)), length),
        "right": F.slice(x, 1, length),
        "middle": F.concat(F.slice(x, 1, head), F.slice(x, F.greatest(n - (length - head) + 1, F.lit(1)), length - head)),
        "error": F.raise_error(F.lit("the sequence is too long")).cast("array<int>"),
    }[cut]
    return F.when(n <= length, padded).otherwise(too_long)


def unfold(df: DataFrame, col: str, parts: int, out: str = "part") -> DataFrame:
    """Each row's array in ``parts`` equal pieces, other columns repeated."""
    size = (F.size(col) / parts).cast("int")
    return df.select(*[c for c in df.columns if c != col], F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(F.col(col), p * size + 1, size))).alias(out, col))


def fold(df: DataFrame, col: str, k: int, i: str = "i") -> DataFrame:
    """k consecutive rows as one array."""
    return df.groupBy(F.floor(F.col(i) / k).alias(i)).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(i).alias("_o"), F.col(col).alias("_v")))), lambda x: x["_v"]).alias(col))


def compatible_schema(a: DataFrame, b: DataFrame) -> bool:
    return {(f.name, f.dataType.simpleString()) for f in a.schema} == {(f.name, f.dataType.simpleString()) for f in b.schema}
