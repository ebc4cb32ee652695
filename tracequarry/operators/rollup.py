"""Roll-ups of evaluation results: partial aggregates, a few rows out.

Empty inputs give one row with zeros where the measure says so (``_rate``), null elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.batch import with_row_number


def rate(c: Column) -> Column:
    """Share of rows that are true; null counts as false; 0 without rows."""
    return F.coalesce(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), F.lit(0.0))


def mean0(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def std0(c: Column) -> Column:
    """Population deviation, 0 without rows."""
    return F.coalesce(F.stddev_pop(c), F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation from sums; 0 with fewer than two rows or without variance (no error under ANSI)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(a)
    cov = F.avg(a * b) - F.avg(a) * F.avg(b)
    vx, vy = F.avg(a * a) - F.avg(a) * F.avg(a), F.avg(b * b) - F.avg(b) * F.avg(b)
    return F.when((n < 2) | (vx <= 1e-15) | (vy <= 1e-15), 0.0).otherwise(F.coalesce(F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))), F.lit(0.0)))


def best_of(df: DataFrame, draws: dict[str, tuple[int, bool]], value: str, group: str, order: str) -> DataFrame:
    """(group, one column per entry of ``draws``): the expected best (or worst, if True) of n draws with
    replacement, in closed form: sorted ascending, the i-th of N values is the largest with probability
    (i/N)^n - ((i-1)/N)^n. Ranks come from bucketed row numbers, so a large group is not sorted in one task.
    """
    ranked = with_row_number(df.where(F.col(value).isNotNull()), value, order, out="_i", within=group)
    sizes = df.groupBy(group).agg(F.count(value).alias("_n")).withColumnsRenamed({group: "_g"})
    x = ranked.join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    n = F.col("_n")

    def expected(k: int, worst: bool) -> Column:
        i = n - F.col("_i") if worst else F.col("_i") + 1
        return F.sum(F.col(value) * (F.pow(i / n, F.lit(k)) - F.pow((i - 1) / n, F.lit(k))))

    return x.groupBy(group).agg(*[expected(k, worst).alias(name) for name, (k, worst) in draws.items()])


def majority_value(df: DataFrame, group: list[str], pred: str, value: str, order: str) -> DataFrame:
    """(group, maj): value of the first row with the most frequent prediction; ties go to the prediction seen first."""
    votes = df.groupBy(*group, pred).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"), F.min_by(value, order).alias("_v"))
    return votes.groupBy(*group).agg(F.max(F.struct("_n", (-F.col("_o")).alias("o"), "_v")).alias("m")).select(*group, F.col("m._v").alias("maj"))


def named_reduction(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): reduced by the key's name: max, then min, else mean."""
    k = F.col(key)
    return df.groupBy(key).agg(F.when(k.contains("max"), F.max(value)).when(k.contains("min"), F.min(value)).otherwise(F.avg(value)).alias("value"))


def cross_step(df: DataFrame, key: str, value: str, step: str) -> DataFrame:
    """(key, value) over steps by name: timings are summed, then mean/avg, max, min, sum/total; anything else is
    the value of the last step."""
    k = F.lower(F.col(key))
    has = lambda *w: F.expr(" or ".join(f"contains(lower(`{key}`), '{x}')" for x in w))
    return df.groupBy(key).agg(
        F.when(k.startswith("timing_s"), F.sum(value)).when(has("mean", "avg"), F.avg(value)).when(has("max"), F.max(value)).when(has("min"), F.min(value)).when(has("sum", "total"), F.sum(value)).otherwise(F.max_by(value, step)).alias("value")
    )


def ranks_then_all(df: DataFrame, key: str, slot: str, value: str, how: str) -> DataFrame:
    """Typed metric over ranks: SUM and MEAN average each slot over ranks first, MIN and MAX take all values."""
    if how in ("min", "max"):
        return df.groupBy(key).agg(getattr(F, how)(value).alias("value"))
    per = df.groupBy(key, slot).agg(F.avg(value).alias("_v"))
    return per.groupBy(key).agg((F.sum if how == "sum" else F.avg)("_v").alias("value"))


def weighted_merge(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """sum(value * weight) / sum(weight); a missing value counts as 0 with its weight."""
    return df.groupBy(key).agg(F.coalesce(F.try_divide(F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.col(weight)), F.sum(weight)), F.lit(0.0)).alias("value"))
