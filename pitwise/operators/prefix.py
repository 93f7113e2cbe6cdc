"""Running sums and maxima along one global order without passing the rows through one task.

Rows are cut into buckets by quantiles of the leading key; each bucket runs its
own window, and what all earlier buckets came to is joined on: one row a
bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(value: Column, bounds: list[float]) -> Column:
    """Number of bounds below ``value``, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    table = F.array(*[F.lit(float(b)) for b in bounds])
    at = lambda a, s: F.when((a + s <= len(bounds)) & (F.get(table, a + s - 1) < value), a + s).otherwise(a)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), at)


def running(df: DataFrame, key: str, ties: list[str], name: str | list[str], value: str | list[str], start: float = 0.0, kind: str = "sum", buckets: int = 0, by: list[str] | None = None) -> DataFrame:
    """``name``: ``start`` and the sum (or the maximum) of ``value`` up to each row in the order of ``key`` (a number) and ``ties``.

    Several names take as many values. With ``by``, sums are of the rows that are equal in these, however few such groups there are.
    """
    n, by = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by or []
    names, values = ([x] if isinstance(x, str) else x for x in (name, value))
    cuts = sorted(set(df.approxQuantile(key, [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    rows = df.withColumn("_bucket", _bucket(F.col(key).cast("double"), cuts))
    total = F.sum if kind == "sum" else F.max
    sums = rows.groupBy(*by, "_bucket").agg(*[total(v).alias(f"_all{i}") for i, v in enumerate(values)])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    on = [*by, "_bucket"]
    sums = sums.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[total(f"_all{i}").over(before).alias(f"_earlier{i}") for i in range(len(values))])
    upto = Window.partitionBy(*by, "_bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_inside{i}": total(v).over(upto) for i, v in enumerate(values)})
    rows = rows.join(sums, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]).drop(*[f"_on_{c}" for c in on])
    whole = lambda i: start + F.coalesce(f"_earlier{i}", F.lit(0.0)) + F.col(f"_inside{i}") if kind == "sum" else F.greatest(f"_earlier{i}", f"_inside{i}")
    return rows.withColumns({x: whole(i) for i, x in enumerate(names)}).drop("_bucket", *[f"_{part}{i}" for part in ("inside", "earlier") for i in range(len(values))])
