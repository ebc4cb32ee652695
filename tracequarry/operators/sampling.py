"""Samples, shuffles, splits and resampling that come out the same at every run.

Randomness is an MD5 of a seed and the row's key, so a row keeps its draw whatever the partitions, and rows of equal key
share it; keys should be unique. Null keys count as the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.batch import running_sum, with_row_number


def draw(seed: int, *key: str | Column) -> Column:
    """A text of 32 hexadecimal digits, uniform over seeds and keys."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def uniform(seed: int, *key: str | Column) -> Column:
    """A number in [0, 1) from the first eight digits of the draw."""
    return F.conv(F.substring(draw(seed, *key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def seeded_order(df: DataFrame, seed: int, *key: str, out: str = "i") -> DataFrame:
    """A shuffle: the place of every row in the order of its draws, equal draws by key."""
    return with_row_number(df.withColumn("_draw", draw(seed, *key)), "_draw", *key, out=out).drop("_draw")


def random_subset(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows without replacement: the first of the shuffle."""
    return df.withColumn("_draw", draw(seed, *key)).orderBy("_draw", *key).limit(n).drop("_draw")


def random_split(df: DataFrame, shares: dict[str, float], seed: int, *key: str, out: str = "part") -> DataFrame:
    """Each row to a part with the given chance; the last part takes what rounding leaves."""
    u, at, part = uniform(seed, *key), 0.0, None
    names = list(shares)
    for name in names[:-1]:
        at += shares[name]
        part = F.when(u < at, name) if part is None else part.when(u < at, name)
    return df.withColumn(out, F.lit(names[-1]) if part is None else part.otherwise(names[-1]))


def epoch_batches(df: DataFrame, size: int, epochs: int, seed: int, *key: str) -> DataFrame:
    """(columns, epoch, batch): every epoch in another order, in batches of ``size`` rows."""
    x = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    x = x.withColumn("_draw", draw(seed, F.col("epoch"), *key))
    return with_row_number(x, "_draw", *key, within="epoch").withColumn("batch", F.floor(F.col("i") / size).cast("int")).drop("_draw", "i")


def resample(df: DataFrame, weight: str, n: int, seed: int, *key: str) -> DataFrame:
    """(draw, columns): n rows with replacement, each with a chance in proportion to its integer weight.

    The weights lie end to end on a line of running sums; a draw takes the row whose stretch holds it. Line and draws meet
    by cells of equal width, of which there are about as many as rows and draws, so a heavy row is met in as many cells as
    it covers and no range join is needed. Null, zero and negative weights are never drawn.
    """
    rows = running_sum(df.where(F.col(weight) > 0), weight, *key, out="_end").withColumn("_start", F.col("_end") - F.col(weight))
    line = rows.agg(F.max("_end").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not line["n"]:
        return df.where("false").withColumn("draw", F.lit(0).cast("bigint"))
    total = line["t"]
    width = max(1, total // (line["n"] + n))
    cell = lambda c: F.floor(c / F.lit(width))
    rows = rows.withColumn("_cell", F.explode(F.sequence(cell(F.col("_start")), cell(F.col("_end") - 1))))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(uniform(seed, "id") * F.lit(float(total))).alias("_at"))
    hit = draws.withColumn("_cell", cell(F.col("_at"))).join(rows, "_cell").where((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_end")))
    return hit.select("draw", *df.columns)
