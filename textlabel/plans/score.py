"""Batch scoring of new texts with saved models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlabel.functions.text import space_out
from textlabel.operators.concepts import annotate, concept_strings, filter_concepts
from textlabel.operators.joins import attach_concepts
from textlabel.plans.models import FEATURES, Labeller, score


def prepare(
    df: DataFrame,
    lexicon: DataFrame,
    id_col: str = "id",
    text: str = "text",
    threshold: float = 0.70,
    semantic_type: str = "Organic Chemical",
    entities: Sequence[str] = ("opioid",),
) -> DataFrame:
    """Separate the words by commas, annotate, keep the wanted concepts, and add them as column `cui`.

    Used for training and for scoring alike, so that both see the same features.
    """
    spaced = df.withColumn(text, space_out(text))
    mentions = annotate(spaced, lexicon, id_col, text, threshold)
    kept = filter_concepts(mentions, semantic_type, entities)
    return attach_concepts(spaced, concept_strings(kept, id_col), id_col)


def _predict(df: DataFrame, models: Mapping[str, Labeller], probabilities: bool) -> DataFrame:
    """Apply all models to the same rows. Models that tokenize alike share one tokenization, and models
    with one recipe object share its features."""
    columns = df.columns
    by_tokenizer: dict[str | None, dict[int, list[str]]] = {}
    for outcome, model in models.items():
        pipeline = getattr(model.recipe, "pipeline", None)
        tokenizer = pipeline.stages[0].getStatement() if pipeline else None
        by_tokenizer.setdefault(tokenizer, {}).setdefault(id(model.recipe), []).append(outcome)
    out = df
    for tokenizer, recipes in by_tokenizer.items():
        for n, outcomes in enumerate(recipes.values()):
            recipe = models[outcomes[0]].recipe
            if tokenizer is None:
                out = recipe.transform(out)
            else:
                out = recipe.after_tokens(recipe.pipeline.stages[0].transform(out) if n == 0 else out)
            for outcome in outcomes:
                out = score(models[outcome].model, out)
                names = {"pred": outcome, "p1": f"{outcome}_pred_1", "p0": f"{outcome}_pred_0"}
                out = out.withColumnsRenamed(names)
                if not probabilities:
                    out = out.drop(names["p1"], names["p0"])
            out = out.drop(FEATURES)
        out = out.drop("_tokens")
    added = [c for o in models for c in ([o, f"{o}_pred_1", f"{o}_pred_0"] if probabilities else [o])]
    return out.select(*[F.col(f"`{c}`") for c in [*columns, *added]])


def predict_complete(
    df: DataFrame, models: Mapping[str, Labeller], keep: Sequence[str] = ("text", "cui")
) -> DataFrame:
    """Class, P(1) and P(0) per outcome beside the kept columns. The models are applied one after the
    other to the same rows: one scan, no join."""
    scored = _predict(df, models, probabilities=True)
    cols = [c for o in models for c in (o, f"{o}_pred_1", f"{o}_pred_0")]
    return scored.select(*[F.col(f"`{c}`") for c in [*keep, *cols]])


def predict_small(df: DataFrame, models: Mapping[str, Labeller]) -> DataFrame:
    """All input columns and one class column per outcome."""
    return _predict(df, models, probabilities=False)
