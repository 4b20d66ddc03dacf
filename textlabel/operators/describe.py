"""Frequency tables, summaries, prevalence and co-occurrence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlabel.functions.numeric import ratio
from textlabel.functions.text import as_col
from textlabel.operators.ranking import quantiles_by_variable


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def count_by(df: DataFrame, keys: Sequence[str], min_count: int = 0) -> DataFrame:
    """Rows per key; with `min_count`, only keys with more rows than that. Sort it for display."""
    out = df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") > min_count) if min_count else out


def sorted_counts(counts: DataFrame) -> DataFrame:
    """Most frequent first, ties by key."""
    return counts.orderBy(F.desc("n"), *[c for c in counts.columns if c != "n"])


def freq_table(df: DataFrame, key: str, places: int = 1) -> DataFrame:
    """Rows and percentage of all rows per value of `key`, most frequent first."""
    counts = count_by(df, [key])
    total = counts.agg(F.sum("n").alias("t")).scalar()
    share = F.round(ratio(F.col("n") * 100, total), places)
    return sorted_counts(counts.withColumn("percentage", share).select(key, "n", "percentage"))


def indicator_long(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Wide indicators to (name, value) rows."""
    return df.unpivot([quoted(i) for i in ids], [quoted(c) for c in cols], "name", "value")


def prevalence(df: DataFrame, cols: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Positive rows per indicator. All indicators are summed in one aggregate and turned to rows after
    it, so the table is not multiplied by the number of indicators before the shuffle."""
    cols = [c for c in cols if c not in drop]
    sums = df.agg(*[F.sum(F.when(quoted(c) == 1, 1).otherwise(0)).alias(c) for c in cols])
    out = sums.unpivot([], [quoted(c) for c in cols], "name", "n")
    return out.filter(F.col("n") > 0)


def pct_within(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Share of each inner value among the rows of its outer value, in percent."""
    counts = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(outer).agg(F.sum("n").alias("_total"))
    same = F.col("c._k").eqNullSafe(F.col("t._k"))
    joined = counts.withColumn("_k", F.col(outer)).alias("c").join(
        totals.select(F.col(outer).alias("_k"), "_total").alias("t"), same
    )
    return joined.select(outer, inner, "n", ratio(F.col("n") * 100, F.col("_total")).alias("freq"))


def indicator_pct(df: DataFrame, cols: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Percentage of rows with value 1 per indicator, in one aggregate (NULLs count as a value)."""
    cols = [c for c in cols if c not in drop]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.sum(F.when(quoted(c) == 1, 1).otherwise(0)).alias(c) for c in cols]
    wide = df.agg(*aggs)
    long = wide.unpivot([F.col("_rows")], [quoted(c) for c in cols], "name", "n")
    return long.filter(F.col("n") > 0).select(
        "name", F.lit(1).cast("long").alias("value"), "n", ratio(F.col("n") * 100, F.col("_rows")).alias("freq")
    )


def six_num(df: DataFrame, expr: Column | str) -> DataFrame:
    """Min, lower quartile, mean, median, upper quartile and max of a whole-number measure.

    Values are counted first; the exact percentiles then work on (value, count), whose number of rows is
    bounded by the largest value and not by the number of texts.
    """
    counts = df.select(as_col(expr).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col("v"), F.col("n")
    quart = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n)
    known = F.when(v.isNotNull(), n)
    one = counts.agg(
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        ratio(F.sum(v * n), F.sum(known)).alias("mean"),
        quart.alias("q"),
    )
    q = F.col("q")
    return one.select(
        F.col("min"), q[0].alias("q1"), F.col("mean"), q[1].alias("median"), q[2].alias("q3"), F.col("max")
    )


def summary_table(
    df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], type2: bool = False
) -> DataFrame:
    """One long table over mixed columns: level counts with percentages for categories, median and
    quartiles for numbers, and missing values for both. Percentages are of the known values.

    `type2` averages at jumps instead of interpolating between neighbours.
    """
    rows = F.explode(
        F.array(*[F.struct(F.lit(c).alias("variable"), quoted(c).cast("string").alias("level")) for c in categorical])
    )
    parts = []
    if categorical:
        counts = df.select(rows.alias("r")).groupBy("r.variable", "r.level").agg(F.count(F.lit(1)).alias("n"))
        known = F.when(F.col("level").isNotNull(), F.col("n"))
        totals = counts.groupBy("variable").agg(
            F.sum(known).alias("known"), F.sum("n").alias("total")
        )
        cats = counts.filter("level is not null").join(totals, "variable")
        parts.append(
            cats.select(
                "variable",
                "level",
                "n",
                ratio(F.col("n") * 100, F.col("known")).alias("pct"),
                F.lit(None).cast("double").alias("median"),
                F.lit(None).cast("double").alias("q1"),
                F.lit(None).cast("double").alias("q3"),
                (F.col("total") - F.col("known")).alias("missing"),
            )
        )
    if numeric:
        parts.append(
            quantiles_by_variable(df, numeric, [0.25, 0.5, 0.75], type2=type2).select(
                "variable",
                F.lit(None).cast("string").alias("level"),
                "n",
                F.lit(None).cast("double").alias("pct"),
                F.col("q")[1].alias("median"),
                F.col("q")[0].alias("q1"),
                F.col("q")[2].alias("q3"),
                "missing",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cooccurrence(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Symmetric table of joint positives: column `name` plus one column per indicator.

    Only the k(k+1)/2 sums of one aggregate leave a task. NULL counts as 0; `n_null` tells how many rows
    of the named indicator were NULL.
    """
    hit = {c: F.coalesce((quoted(c) == 1).cast("long"), F.lit(0)) for c in cols}
    sums = [
        F.sum(hit[a] * hit[b]).alias(f"s{i}_{j}")
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
        if i <= j
    ]
    sums += [F.sum(quoted(c).isNull().cast("long")).alias(f"null{i}") for i, c in enumerate(cols)]
    one = df.agg(*sums)
    rows = [
        F.struct(
            F.lit(a).alias("name"),
            *[F.col(f"s{min(i, j)}_{max(i, j)}").alias(b) for j, b in enumerate(cols)],
            F.col(f"null{i}").alias("n_null"),
        )
        for i, a in enumerate(cols)
    ]
    return one.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, expr: Column | str, width: int = 1, by: str | None = None) -> DataFrame:
    """Rows per bin (named by its lower edge) and per value of `by`."""
    edge = (F.floor(as_col(expr) / F.lit(width)) * width).cast("long").alias("bin")
    keys = [edge] if by is None else [quoted(by), edge]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def positives_per_record(df: DataFrame, cols: Sequence[str], out: str = "n_positive") -> DataFrame:
    """Records per number of positive indicators."""
    total = sum((F.coalesce((quoted(c) == 1).cast("long"), F.lit(0)) for c in cols), F.lit(0).cast("long"))
    return df.select(total.alias(out)).groupBy(out).agg(F.count(F.lit(1)).alias("n"))


def uncount(df: DataFrame, n: str) -> DataFrame:
    """Repeat each row `n` times and drop the count. Very large counts are unfolded in two steps with a
    shuffle between them, so one heavy row does not fill one task."""
    step = 10_000
    blocks = F.ceil(F.col(n) / F.lit(step)).cast("int")
    rest = [c for c in df.columns if c != n]
    outer = df.filter(F.col(n) > 0).withColumn("_b", F.explode(F.sequence(F.lit(1), blocks)))
    size = F.least(F.lit(step), F.col(n) - (F.col("_b") - 1) * step).cast("int")
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        outer = outer.hint("rebalance")
    return outer.select(*rest, F.explode(F.sequence(F.lit(1), size)).alias("_i")).drop("_i")


def pivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], value: str = "estimate") -> DataFrame:
    """Long metrics to one column per metric; the list of metrics is given, so no extra pass finds it."""
    return df.groupBy(*ids).pivot("metric", list(metrics)).agg(F.first(value, ignorenulls=True))


def pivot_multi(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long to wide with several value columns, named `{value}_{metric}`."""
    wide = df.groupBy(*ids).pivot("metric", list(metrics)).agg(
        *[F.first(v, ignorenulls=True).alias(v) for v in values]
    )
    one = len(values) == 1
    names = {(m if one else f"{m}_{v}"): f"{v}_{m}" for m in metrics for v in values}
    return wide.withColumnsRenamed(names)
