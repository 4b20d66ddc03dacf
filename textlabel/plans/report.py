"""Report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlabel.functions.dictionaries import SUBSTANCES
from textlabel.functions.numeric import round_numeric
from textlabel.operators.describe import pivot_metrics, pivot_multi
from textlabel.operators.metrics import class_metrics, confusion_wide
from textlabel.operators.ranking import top_n
from textlabel.operators.recode import tag_keywords

# Metric name and report heading, in report order.
HEADINGS = {
    "f_meas": "f_score",
    "accuracy": "accuracy",
    "kap": "kappa",
    "sens": "sensitivity",
    "spec": "specificity",
    "ppv": "ppv",
    "npv": "npv",
}


def keyword_report(
    tagged: DataFrame, pairs: Mapping[str, tuple[str, str]], places: int = 3, half_even: bool = True
) -> DataFrame:
    """Diagnostic table of flags against truths, {report name: (truth column, flag column)}, from one
    aggregate over one scan: 4 sums per pair leave a task, and no row is repeated."""
    wide = class_metrics(confusion_wide(tagged, pairs), list(HEADINGS)).drop("tp", "fp", "fn", "tn")
    return round_numeric(wide.withColumnsRenamed({"outcome": "substance", **HEADINGS}), places, half_even)


def keyword_metrics(
    records: DataFrame,
    truth: DataFrame,
    id_col: str,
    text: str,
    truths: Mapping[str, str],
    dictionary: Mapping[str, Sequence[str]] = SUBSTANCES,
    places: int = 3,
    half_even: bool = True,
) -> DataFrame:
    """Diagnostic table of the keyword classifier over all records that have a truth.

    `truths` maps a report name to a column of `truth`; the keyword list of that name in `dictionary`
    makes the estimate. Texts become flags where they are read, so the join by id moves flags, not texts.
    """
    used = {name: dictionary[name] for name in truths}
    flags = tag_keywords(records, text, used, suffix=".k").select(id_col, *[F.col(f"`{n}.k`") for n in used])
    joined = flags.join(truth, id_col)
    pairs = {name: (col, name + ".k") for name, col in truths.items()}
    return keyword_report(joined, pairs, places, half_even)


def test_table(m: DataFrame, ids: Sequence[str] = ("outcome",), places: int = 3, half_even: bool = True) -> DataFrame:
    """Long metrics of the final fits to one row per outcome under the report headings."""
    heads = {**HEADINGS, "roc_auc": "auroc"}
    wide = pivot_metrics(m, ids, list(heads))
    return round_numeric(wide.withColumnsRenamed({"outcome": "substance", **heads}), places, half_even)


def ci_table(ci: DataFrame, places: int = 3, half_even: bool = True) -> DataFrame:
    """Bootstrap intervals to one row per outcome: mean, lower and upper of each metric."""
    heads = {**HEADINGS, "roc_auc": "auroc"}
    wide = pivot_multi(ci, ["outcome"], list(heads), ["mean", "ci_lower", "ci_upper"])
    order = [F.col("outcome").alias("substance")]
    for metric, head in heads.items():
        order += [
            F.col(f"mean_{metric}").alias(head),
            F.col(f"ci_lower_{metric}").alias(f"{head}_lower"),
            F.col(f"ci_upper_{metric}").alias(f"{head}_upper"),
        ]
    return round_numeric(wide.select(*order), places, half_even)


def top_terms(imp: DataFrame, n: int = 10) -> DataFrame:
    """The n most important terms per sign, ties kept."""
    return top_n(imp.filter(F.col("importance") > 0), "sign", "importance", n)
