"""One-scan statistics. Wide inputs are unpivoted (``stack``) so several
columns share one aggregation; every output is small (<= a few hundred rows)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, functions as F

from murmur.operators.ordering import exact_quantiles, ranked_values


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate (a global aggregate: exactly one row, so
    the broadcast is size-bounded) through an equi-join on a constant key."""
    k = "_one"
    return (df.withColumn(k, F.lit(0)).join(F.broadcast(one_row.withColumn(k, F.lit(0))), k, "inner")
            .drop(k))


def with_group_rows(df: DataFrame, per_group: DataFrame, group_cols: list[str]) -> DataFrame:
    return df.join(per_group, group_cols, "inner") if group_cols else with_row(df, per_group)


def unpivot(df: DataFrame, columns: list[str], name: str = "variable", value: str = "value",
            keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    return df.unpivot(keep, columns, name, value) if keep else df.unpivot([], columns, name, value)


def pearson(a: str, b: str):
    """Pearson correlation over the rows where both are present; NULL when either side is
    constant (Spark's ``corr`` raises a division by zero under ANSI mode there)."""
    x = F.when(F.col(b).isNotNull(), F.col(a))
    y = F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every ordered column pair in one aggregation
    (pairwise-complete rows). Long form ``(row, col, corr)``."""
    pairs = list(product(columns, columns))
    agg = df.agg(*[pearson(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    stacked = agg.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)])).alias("s"))
    return stacked.select("s.*")


def describe(df: DataFrame, value_col: str, group_cols: list[str] | None = None) -> DataFrame:
    """A10: count, mean, sample std, min, exact quartiles, max per group. The input is read once: all of it comes
    from the stored table of distinct values with their counts. A group without a value has no row (ungrouped: a row of NULLs)."""
    group_cols = list(group_cols or [])
    ranked = ranked_values(df, value_col, group_cols)
    v, n = F.col(value_col), F.col("_cnt")
    base = ranked.groupBy(*group_cols).agg(
        F.sum(n).alias("count"), F.try_divide(F.sum(v * n), F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    # squares of the distances from the mean, not of the values: no cancellation
    away = with_group_rows(ranked, base.select(*group_cols, "mean"), group_cols).groupBy(*group_cols).agg(
        F.sqrt(F.try_divide(F.sum((v - F.col("mean")) * (v - F.col("mean")) * n), F.nullif(F.sum(n) - 1, F.lit(0)))).alias("std"))
    q = exact_quantiles(None, value_col, [0.25, 0.5, 0.75], group_cols, ranked=ranked)
    wide = q.groupBy(*group_cols).pivot("p", [0.25, 0.5, 0.75]).agg(F.first("value"))
    wide = wide.withColumnsRenamed({"0.25": "q25", "0.5": "q50", "0.75": "q75"})
    if not group_cols:
        out = with_row(with_row(base, away), wide).withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    else:
        out = base.join(away, group_cols).join(wide, group_cols, "left")
    return out.select(*group_cols, "count", "mean", "std", "min", "max", "q25", "q50", "q75")


def top_frequencies(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The k most frequent values (NULL included), ties by value. A top-k report."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_first(col)).limit(k))


def histogram(df: DataFrame, value_col: str, bins: int, group_cols: list[str] | None = None) -> DataFrame:
    """``bins`` equal-width bins over each group's [min, max]; the last bin is
    closed; min = max spreads the range to [v - 0.5, v + 0.5] (all rows in the middle bin).
    Empty bins are listed with count 0. ``(*group, bin, lo, hi, count)``.
    Two passes over ``df`` (ranges, then bins): checkpoint an expensive input first."""
    group_cols = list(group_cols or [])
    x = df.where(F.col(value_col).isNotNull())
    rng = x.groupBy(*group_cols).agg(F.min(value_col).alias("_mn"), F.max(value_col).alias("_mx"))
    rng = rng.select(*group_cols,
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    # one row per group: joined by key (AQE broadcasts it from its measured size)
    j = with_group_rows(x, rng, group_cols)
    b = F.least(F.floor((F.col(value_col) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))),
                F.lit(bins - 1)).cast("int")
    counts = j.groupBy(*group_cols, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*group_cols, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, [*group_cols, "bin"], "left")
    width = (F.col("_hi") - F.col("_lo")) / bins
    return out.select(*group_cols, "bin", (F.col("_lo") + F.col("bin") * width).alias("lo"),
                      (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def box_stats(df: DataFrame, value_col: str, group_cols: list[str] | None = None, whisker: float = 1.5) -> DataFrame:
    """Exact quartiles, IQR fences, whisker ends (extreme values inside the fences)
    and the outlier count per group. The input is read once: quartiles, whiskers and
    outliers all come from the checkpointed table of distinct values with counts."""
    group_cols = list(group_cols or [])
    ranked = ranked_values(df, value_col, group_cols)
    q = exact_quantiles(None, value_col, [0.25, 0.5, 0.75], group_cols, ranked=ranked)
    wide = (q.groupBy(*group_cols).pivot("p", [0.25, 0.5, 0.75]).agg(F.first("value"))
            .withColumnsRenamed({"0.25": "q1", "0.5": "median", "0.75": "q3"}))
    wide = wide.withColumn("iqr", F.col("q3") - F.col("q1"))
    wide = (wide.withColumn("fence_lo", F.col("q1") - whisker * F.col("iqr"))
            .withColumn("fence_hi", F.col("q3") + whisker * F.col("iqr")))
    j = with_group_rows(ranked, wide, group_cols)
    v, lo, hi, n = F.col(value_col), F.col("fence_lo"), F.col("fence_hi"), F.col("_cnt")
    agg = j.groupBy(*group_cols, "q1", "median", "q3", "iqr", "fence_lo", "fence_hi").agg(
        F.min(F.when(v >= lo, v)).alias("whisker_lo"), F.max(F.when(v <= hi, v)).alias("whisker_hi"),
        F.sum(F.when((v < lo) | (v > hi), n).otherwise(0)).alias("outliers"), F.sum(n).alias("count"))
    return agg


def outliers(df: DataFrame, value_col: str, boxes: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """The rows outside the whisker fences."""
    group_cols = list(group_cols or [])
    f = boxes.select(*group_cols, "fence_lo", "fence_hi")
    j = with_group_rows(df, f, group_cols)
    return j.where((F.col(value_col) < F.col("fence_lo")) | (F.col(value_col) > F.col("fence_hi"))) \
        .drop("fence_lo", "fence_hi")


def binned_scatter(df: DataFrame, x: str, y: str, x_width: float, y_width: float,
                   group_cols: list[str] | None = None) -> DataFrame:
    """E7 at scale: a scatter plot as 2-D binned counts."""
    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
            .groupBy(*(group_cols or []), F.floor(F.col(x) / x_width).alias("x_bin"), F.floor(F.col(y) / y_width).alias("y_bin"))
            .agg(F.count(F.lit(1)).alias("count")))


def cohen_kappa(df: DataFrame, pairs: list[tuple[str, str]], name_fmt: str = "{a} vs {b}") -> DataFrame:
    """Cohen's kappa for each pair of label columns in one pass.

    Unpivot pairs -> contingency counts (partial aggregation; <= classes^2 cells per pair)
    -> per pair, the cell list (bounded by classes^2) gives observed agreement
    sum(diagonal)/n and expected agreement sum_k(row_k * col_k)/n^2 without any join.
    NULL when expected agreement is 1 (a single class on both sides)."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(name_fmt.format(a=a, b=b)).alias("comparison"), F.col(a).alias("la"), F.col(b).alias("lb"))
        for a, b in pairs])).alias("s")).select("s.*")
    cells = stacked.groupBy("comparison", "la", "lb").agg(F.count(F.lit(1)).alias("n"))
    per = cells.groupBy("comparison").agg(
        F.collect_list(F.struct("la", "lb", "n")).alias("cells"),
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0)).alias("diag"))

    def margin(side, k):
        return F.aggregate(F.filter("cells", lambda c: c[side] == k), F.lit(0).cast("long"),
                           lambda acc, c: acc + c["n"])

    labels = F.array_distinct(F.concat(F.transform("cells", lambda c: c["la"]),
                                       F.transform("cells", lambda c: c["lb"])))
    n = F.col("total").cast("double")
    part = lambda side, k: margin(side, k).cast("double") / n  # noqa: E731 - a product of counts may pass a bigint
    pe = F.aggregate(labels, F.lit(0.0), lambda acc, k: acc + part("la", k) * part("lb", k))
    po = F.col("diag") / n
    k = per.select("comparison", "total", po.alias("po"), pe.alias("pe"))
    return k.select("comparison", F.col("total").alias("sample_size"),
                    F.when(F.abs(F.col("pe") - 1) < 1e-12, F.lit(None).cast("double"))
                    .otherwise((F.col("po") - F.col("pe")) / (F.lit(1.0) - F.col("pe"))).alias("kappa"))


def regression_metrics(pred: DataFrame, label: str = "actual", prediction: str = "prediction",
                       group_cols: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R^2 per group (e.g. per model). R^2 is NULL for a constant label."""
    group_cols = list(group_cols or [])
    e = F.col(label) - F.col(prediction)
    stats = pred.groupBy(*group_cols).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"), F.var_pop(label).alias("_var"), F.count(label).alias("_n"))
    sst = F.col("_var") * F.col("_n")
    return stats.select(*group_cols, "mae", "rmse",
                        F.when(sst == 0, F.lit(None).cast("double")).otherwise(F.lit(1.0) - F.col("_sse") / sst).alias("r2"))
