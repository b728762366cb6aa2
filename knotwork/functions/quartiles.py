"""Order statistics of integer samples, as the solver's statistics define them.

With N values, M = N div 2, L = M div 2 and U = M + L. The quartiles are the elements at L
and U, or, if N mod 4 is 0 or 1, the mean of that element and the one before it, rounded
down. With N <= 1 both are 0. The median is the mean of the middle elements, rounded down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def statistics(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: ``<prefix>_min, _q1, _median, _q3, _max`` as longs, ``_avg`` and ``_stddev`` rounded to 6 places.

    Values are counted first, so the running sum that finds an order statistic goes over
    distinct values, not over rows.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("x")).agg(F.count("*").alias("n"))
    order = W.partitionBy(F.lit(0)).orderBy("x")
    upto = counted.withColumn("last", F.sum("n").over(order)).withColumn("total", F.sum("n").over(W.partitionBy(F.lit(0))))
    m = F.floor(F.col("total") / 2)
    low = F.floor(m / 2)
    at = lambda i: F.max(F.when((i >= F.col("last") - F.col("n")) & (i < F.col("last")), F.col("x")))
    got = upto.agg(
        F.min("x").alias("min"), F.max("x").alias("max"), F.max("total").alias("total"), at(m).alias("m"), at(m - 1).alias("m_"), at(low).alias("l"), at(low - 1).alias("l_"),
        at(m + low).alias("u"), at(m + low - 1).alias("u_"),
        (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("avg"),
        F.sum(F.col("x") * F.col("n")).alias("s1"), F.sum(F.col("x") * F.col("x") * F.col("n")).alias("s2"),
    )
    even4, n = (F.col("total") % 4).isin(0, 1), F.col("total")
    quart = lambda a, b: F.when(n <= 1, F.lit(0)).when(even4, F.floor((F.col(a) + F.col(b)) / 2)).otherwise(F.col(a)).cast("long")
    variance = (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1)
    return got.select(
        F.col("min").alias(f"{prefix}_min"), quart("l", "l_").alias(f"{prefix}_q1"),
        F.when(n % 2 == 0, F.floor((F.col("m") + F.col("m_")) / 2)).otherwise(F.col("m")).cast("long").alias(f"{prefix}_median"),
        quart("u", "u_").alias(f"{prefix}_q3"), F.col("max").alias(f"{prefix}_max"), F.round("avg", 6).alias(f"{prefix}_avg"),
        F.round(F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(F.lit(0.0)), 6).alias(f"{prefix}_stddev"),
    )


def statistics_sql(source: str, column: str, prefix: str) -> str:
    """The same in DuckDB SQL."""
    return f"""SELECT min(x) AS {prefix}_min, max(q1) AS {prefix}_q1, max(md) AS {prefix}_median, max(q3) AS {prefix}_q3, max(x) AS {prefix}_max,
  round(avg(x), 6) AS {prefix}_avg, round(coalesce(stddev_samp(x), 0), 6) AS {prefix}_stddev FROM (
  SELECT x, CASE WHEN n <= 1 THEN 0 WHEN n % 4 < 2 THEN (a[l + 1] + a[l]) // 2 ELSE a[l + 1] END AS q1,
    CASE WHEN n <= 1 THEN 0 WHEN n % 4 < 2 THEN (a[m + l + 1] + a[m + l]) // 2 ELSE a[m + l + 1] END AS q3,
    CASE WHEN n % 2 = 0 THEN (a[m + 1] + a[m]) // 2 ELSE a[m + 1] END AS md
  FROM (SELECT a, n, n // 2 AS m, (n // 2) // 2 AS l, unnest(a) AS x FROM (SELECT list(CAST({column} AS BIGINT) ORDER BY {column}) AS a, CAST(count(*) AS BIGINT) AS n FROM {source})))"""
