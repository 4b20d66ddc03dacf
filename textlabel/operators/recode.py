"""Projections, filters, recoding and keyword tagging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textlabel.functions.dictionaries import SUBSTANCES
from textlabel.functions.text import as_col, has_any
from textlabel.operators.joins import lookup_join

Rules = Sequence[tuple[str, str]]


def select_as(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Select and rename in one step: {new name: old name}."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def cols_between(df: DataFrame, first: str | int, last: str | int) -> list[str]:
    """Names from `first` to `last`, both included; numbers count from 1."""
    def place(c: str | int) -> int:
        return c - 1 if isinstance(c, int) else df.columns.index(c)

    return df.columns[place(first) : place(last) + 1]


def not_in(col: Column | str, values: Sequence[object]) -> Column:
    """True when the value is not listed; NULL is not listed, so its row is kept."""
    return ~F.coalesce(as_col(col).isin(list(values)), F.lit(False))


def filter_min_group(df: DataFrame, keys: Sequence[str], min_n: int) -> DataFrame:
    """Rows whose key occurs more than `min_n` times.

    Counting combines before its shuffle, and the rows themselves meet the frequent keys in a lookup
    join: a window would pull each word, however common, into one task.
    """
    frequent = df.groupBy(*keys).count().filter(F.col("count") > min_n).select(*keys)
    return lookup_join(df, frequent, list(keys), "left_semi")


def rule_column(col: Column | str, rules: Rules, default: Column | None = None) -> Column:
    """Label of the first rule whose pattern is found in the lower-cased value, else the value itself."""
    value = as_col(col)
    low = F.lower(value)
    out = value if default is None else default
    for pattern, label in reversed(list(rules)):
        out = F.when(low.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def recode_rules(df: DataFrame, col: str, rules: Rules, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, rule_column(col, rules))


def rule_hits(df: DataFrame, col: str, rules: Rules) -> DataFrame:
    """Per rule: rows it decides and rows it would match on its own. A rule that matches but never
    decides is hidden by an earlier one. One pass; the values are counted first, so each distinct value
    is tested once."""
    counts = df.groupBy(F.lower(F.col(col)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    hits = [F.coalesce(F.col("v").rlike(p), F.lit(False)) for p, _ in rules]
    counts = counts.select("n", F.array(*hits).alias("hit"))
    first = F.array_position(F.col("hit"), F.lit(True))
    sums = []
    for i in range(len(rules)):
        sums.append(F.sum(F.when(first == i + 1, F.col("n")).otherwise(0)).alias(f"f{i}"))
        sums.append(F.sum(F.when(F.get(F.col("hit"), F.lit(i)), F.col("n")).otherwise(0)).alias(f"a{i}"))
    wide = counts.agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).cast("long").alias("rule"),
                F.lit(pattern).alias("pattern"),
                F.lit(label).alias("label"),
                F.coalesce(F.col(f"f{i}"), F.lit(0)).alias("first_hits"),
                F.coalesce(F.col(f"a{i}"), F.lit(0)).alias("any_hits"),
            )
            for i, (pattern, label) in enumerate(rules)
        ]
    )
    return wide.select(F.inline(rows))


def keyword_flag(
    df: DataFrame, text: str, terms: Sequence[str], out: str, whole_word: bool = False
) -> DataFrame:
    return df.withColumn(out, has_any(text, terms, whole_word))


def tag_keywords(
    df: DataFrame,
    text: str,
    dictionary: Mapping[str, Sequence[str]] = SUBSTANCES,
    suffix: str = "",
    whole_word: bool = False,
) -> DataFrame:
    """One 0/1 column per dictionary entry, all from one projection over one scan."""
    return df.withColumns({k + suffix: has_any(text, terms, whole_word) for k, terms in dictionary.items()})


def recode_exact(df: DataFrame, col: str, labels: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(labels), subset=[col])


def with_order(df: DataFrame, by: Column | Sequence[Column], out: str = "ord") -> DataFrame:
    """Number the rows of a report table in plotting order.

    The sort is range-partitioned and the numbering adds an offset per partition, so even a long report
    is not pulled into one task.
    """
    by = [by] if isinstance(by, Column) else list(by)
    schema = StructType([*df.schema.fields, StructField(out, LongType())])
    numbered = df.orderBy(*by).rdd.zipWithIndex().map(lambda pair: (*pair[0], pair[1] + 1))
    return df.sparkSession.createDataFrame(numbered, schema)


def with_row_id(df: DataFrame, out: str = "row") -> DataFrame:
    """Row number (from 1) in file order, for files without a key of their own. Prefer a real key.

    Meant for a plain file scan, whose partitions are the same each time it is read. Files count in order of their
    paths, parts of a file in order of their places in it, whatever parts the scan packs into one task. One row for each
    part is summed up and joined back; no row of the table is shuffled while that summary is small.
    """
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    df = df.withColumn("_mid", F.monotonically_increasing_id())
    parts = df.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = lookup_join(df, starts, ["_file", "_block"])
    number = F.col("_start") + F.col("_mid") - F.col("_first") + 1
    return joined.withColumn(out, number).drop("_mid", "_file", "_block", "_first", "_start")


def audited(df: DataFrame, label: str) -> tuple[DataFrame, Observation]:
    """Count rows on their way through a step, at no extra pass; read the result after an action."""
    seen = Observation(label)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
