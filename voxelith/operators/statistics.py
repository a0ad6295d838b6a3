"""Aggregates and distributions over values by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, value: str, orders: int = 4, central: bool = True, by: list[str] = ()) -> DataFrame:
    """m1 (mean) and population moments m2.., about the mean if central; one pass for the mean, one for the rest."""
    by = list(by)
    mean = df.groupBy(*by).agg(F.avg(value).alias("m1"))
    joined = df.join(F.broadcast(mean), by) if by else df.crossJoin(F.broadcast(mean))  # one row by group; without groups one row
    base = F.col(value) - F.col("m1") if central else F.col(value)
    return joined.groupBy(*by, "m1").agg(*(F.avg(F.pow(base, F.lit(float(k)))).alias(f"m{k}") for k in range(2, orders + 1)))


def covariance(df: DataFrame, names: list[str], by: list[str] = ()) -> DataFrame:
    """Population covariances c_i_j."""
    return df.groupBy(*by).agg(*(F.covar_pop(a, b).alias(f"c_{a}_{b}") for a in names for b in names))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, by: list[str] = ()) -> DataFrame:
    """bin, n of equal-width half-open bins; values at or above high or below low fall out; empty bins have no row."""
    width = (high - low) / bins
    b = F.floor((F.col(value) - F.lit(low)) / F.lit(width)).cast("int")
    return df.withColumn("bin", b).where(F.col("bin").between(0, bins - 1)).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def edge_histogram(df: DataFrame, value: str, edges: list[float], by: list[str] = ()) -> DataFrame:
    """bin = the largest edge at or below the value; values under the first or at the last edge and above fall out."""
    b = sum(((F.col(value) >= F.lit(e)).cast("int") for e in edges), F.lit(0)) - 1
    return df.withColumn("bin", b).where(F.col("bin").between(0, len(edges) - 2)).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def with_pdf_cdf(hist: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adds pdf (share) and cdf (running share by bin)."""
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bin")
    return hist.withColumn("pdf", F.col("n") / F.sum("n").over(whole)).withColumn("cdf", F.sum("n").over(upto) / F.sum("n").over(whole))


def _pair(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("bin", F.col("pdf").alias("pa"), F.col("cdf").alias("ca")).join(b.select("bin", F.col("pdf").alias("pb"), F.col("cdf").alias("cb")), "bin", "full")


def kolmogorov_smirnov(a: DataFrame, b: DataFrame) -> DataFrame:
    """ksd: the largest difference of two CDFs given by bins; a bin that one lacks carries its last value on."""
    pair = _pair(a, b)
    upto = Window.orderBy("bin")
    fill = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(0.0))
    return pair.select(F.abs(fill("ca") - fill("cb")).alias("d")).agg(F.max("d").alias("ksd"))


def _entropy_term(p: Column) -> Column:
    return F.when(p > 0, p * F.log(p)).otherwise(0.0)


def jensen_shannon(a: DataFrame, b: DataFrame) -> DataFrame:
    """jsd, the divergence in natural logarithms, and similarity, ln 2 less it."""
    pair = _pair(a, b).select(F.coalesce("pa", F.lit(0.0)).alias("pa"), F.coalesce("pb", F.lit(0.0)).alias("pb"))
    both = F.col("pa") + F.col("pb")
    coded = -0.5 * F.sum(_entropy_term(F.col("pa")) + _entropy_term(F.col("pb")) - _entropy_term(both))
    return pair.agg(coded.alias("similarity")).select((F.log(F.lit(2.0)) - F.col("similarity")).alias("jsd"), "similarity")


def element_quantile(df: DataFrame, value: str, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """For each name the element at floor(n * share) of the sorted values: an element, not an interpolation.

    Ranks come from a window by group, so no group is held in memory at once.
    """
    w = Window.partitionBy(*by)
    ranked = df.select(*by, value).withColumn("i_", F.row_number().over(w.orderBy(value)) - 1).withColumn("n_", F.count("*").over(w))
    return ranked.groupBy(*by).agg(*(F.max(F.when(F.col("i_") == F.least(F.floor(F.col("n_") * F.lit(s)), F.col("n_") - 1), F.col(value))).alias(n) for n, s in shares.items()))


def correlation(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """Population Pearson correlation; 0 where a side is constant."""
    return df.groupBy(*by).agg(F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0)).alias("r"))
