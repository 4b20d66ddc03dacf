"""The registered queries: each operator on the driver tables, whole tables and whole texts.

The tables hold invented prose, so dictionary, rules and lexicon use strings that occur in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlabel.functions.dictionaries import SUBSTANCES
from textlabel.functions.numeric import round_numeric
from textlabel.functions.text import has_any, n_chars, n_words, remove_all, space_out, tokenize
from textlabel.operators import concepts, densities, describe, draws, features, inverted, joins, metrics, neighbours, pairs, ranking, recode, replicates, resample, segment, terms, tokens
from textlabel.plans import boosting, models, network, path, report, score, tune
from textlabel.session import new_table_path, settle
from textlabel.sources import tables
from textlabel.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Nine outcomes on words of the test texts; the last overlaps others on purpose.
DEMO = {
    "license": ["license", "apache"],
    "free": ["free"],
    "token": ["token"],
    "tion": ["tion"],
    "ing": ["ing"],
    "mit": ["mit"],
    "nicht": ["nicht", "ensch"],
    "ment": ["ment", "mente"],
    "any_rare": ["license", "apache", "free", "token"],
}
FLAGS = list(DEMO)
TRUTHS = ["quality", "toxic"]
# Ordered rules with overlaps: "red ring" is decided by the first, the last two never decide alone.
PART_RULES = [
    ("red", "warm"),
    ("hot", "warm"),
    ("blue", "cool"),
    ("ring|gear", "round"),
    ("small", "small"),
    ("small bolt", "hidden"),
    ("red .*", "hidden"),
]
LEXICON = [
    ("license", "license", "C0001", "Organic Chemical"),
    ("mit license", "mit license", "C0002", "Organic Chemical"),
    ("apache license", "apache license", "C0003", "Organic Chemical"),
    ("apache", "apache license", "C0003", "Organic Chemical"),
    ("aning", "aning", "C0004", "Organic Chemical"),
    ("nicht", "nicht", "C0005", "Organic Chemical"),
    ("ention", "ention", "C0006", "Organic Chemical"),
    ("étion", "étion", "C0007", "Organic Chemical"),
    ("mente", "mente", "C0008", "Finding"),
    ("free", "free", "C0009", "Finding"),
    ("token", "token", "C0010", "Organic Chemical"),
]
LEXICON_SCHEMA = "alias string, entity string, cui string, semantic_type string"
PLACES = 6


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    """A table whose texts take work: a single small file is shared out over the cores first."""
    return tables.spread(table(spark, sf, name))


def rounded(df: DataFrame) -> DataFrame:
    return round_numeric(df, PLACES, half_even=False)


def flags(spark: SparkSession, sf: str) -> DataFrame:
    return recode.tag_keywords(texts(spark, sf), "text", DEMO).select("doc_id", *FLAGS)


def labelled_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Flags and truths; texts turn into flags before the join."""
    return flags(spark, sf).join(table(spark, sf, "labels"), "doc_id")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, LEXICON_SCHEMA)


# --- keyword classifier -------------------------------------------------------------------------


@query
def keyword_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return report.keyword_metrics(
        texts(spark, sf),
        table(spark, sf, "labels"),
        "doc_id",
        "text",
        dict.fromkeys(FLAGS, "quality"),
        DEMO,
        PLACES,
        half_even=False,
    )


@query
def keyword_flags(spark: SparkSession, sf: str) -> DataFrame:
    return flags(spark, sf)


@query
def substance_flags(spark: SparkSession, sf: str) -> DataFrame:
    tagged = recode.tag_keywords(texts(spark, sf), "text", SUBSTANCES)
    names = {name.lower().replace(" ", "_").replace(".", "_"): name for name in SUBSTANCES}
    return recode.select_as(tagged, {"doc_id": "doc_id", **names})


@query
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    pairs = {f"{t}:{k}": (t, k) for t in TRUTHS for k in FLAGS}
    return metrics.confusion_wide(labelled_flags(spark, sf), pairs)


@query
def keyword_metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    conf = metrics.confusion_wide(labelled_flags(spark, sf), {k: ("toxic", k) for k in FLAGS})
    return rounded(metrics.metrics_long(metrics.class_metrics(conf), ["outcome"]))


# --- tables and summaries -----------------------------------------------------------------------


@query
def freq_table(spark: SparkSession, sf: str) -> DataFrame:
    return describe.freq_table(table(spark, sf, "documents"), "lang")


@query
def event_freq_table(spark: SparkSession, sf: str) -> DataFrame:
    return describe.freq_table(table(spark, sf, "events"), "event_type")


@query
def recode_rules(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return recode.recode_rules(part, "p_name", PART_RULES, "part_group")


@query
def rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    return recode.rule_hits(table(spark, sf, "part"), "p_name", PART_RULES)


@query
def recoded_summary(spark: SparkSession, sf: str) -> DataFrame:
    part = recode.recode_rules(table(spark, sf, "part"), "p_name", PART_RULES)
    exact = recode.recode_exact(part, "p_name", {"round": "round part", "small": "small part"})
    return rounded(describe.summary_table(exact, ["p_name", "p_type"], ["p_retailprice", "p_size"]))


@query
def text_length_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.six_num(table(spark, sf, "documents"), n_chars("text")))


@query
def word_count_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.six_num(texts(spark, sf), n_words("text")))


@query
def turn_word_count_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.six_num(texts(spark, sf, "conversations"), n_words("text")))


@query
def summary_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    both = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    return rounded(describe.summary_table(both, ["lang", "source", "quality"], ["n_chars", "toxic"]))


@query
def order_summary_table(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return rounded(describe.summary_table(orders, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"]))


@query
def order_quartiles_type2(spark: SparkSession, sf: str) -> DataFrame:
    q = ranking.quantile_table(table(spark, sf, "orders"), "o_totalprice", [0.25, 0.5, 0.75], type2=True)
    return rounded(q.select("n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")))


@query
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return describe.histogram(table(spark, sf, "documents"), n_chars("text"), 1, "lang")


@query
def length_histogram_wide(spark: SparkSession, sf: str) -> DataFrame:
    return describe.histogram(table(spark, sf, "documents"), n_chars("text"), 250, "source")


@query
def indicator_long(spark: SparkSession, sf: str) -> DataFrame:
    return describe.indicator_long(flags(spark, sf), FLAGS, ["doc_id"])


@query
def prevalence(spark: SparkSession, sf: str) -> DataFrame:
    return describe.prevalence(flags(spark, sf), FLAGS, drop=["any_rare"])


@query
def ordered_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    counts = recode.recode_exact(describe.prevalence(flags(spark, sf), FLAGS), "name", {"any_rare": "any rare"})
    return recode.with_order(counts, [F.desc("n"), F.col("name")])


@query
def indicator_pct(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.indicator_pct(flags(spark, sf), FLAGS, drop=["any_rare"]))


@query
def pct_within(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(describe.pct_within(table(spark, sf, "documents"), "source", "lang"))


@query
def positives_per_record(spark: SparkSession, sf: str) -> DataFrame:
    return describe.positives_per_record(flags(spark, sf), FLAGS)


@query
def uncount_rows(spark: SparkSession, sf: str) -> DataFrame:
    counts = describe.count_by(table(spark, sf, "documents"), ["lang", "source"])
    return describe.uncount(counts, "n")


@query
def cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    cols = recode.cols_between(flags(spark, sf), 2, "ment")
    return describe.cooccurrence(flags(spark, sf), cols)


# --- words --------------------------------------------------------------------------------------


@query
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.word_counts(texts(spark, sf))


@query
def frequent_tokens_per_record(spark: SparkSession, sf: str) -> DataFrame:
    rows = recode.filter_min_group(tokens.tokens(texts(spark, sf), "doc_id"), ["word"], 10)
    kept = tokens.remove_stopwords(rows)
    return kept.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.min("pos").cast("long").alias("first_pos"), F.max("word").alias("last_word")
    )


@query
def common_words(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.common_words(texts(spark, sf), min_n=10)


@query
def common_words_by_table(spark: SparkSession, sf: str) -> DataFrame:
    """Stop words as a table: here the benchmark words, whose number grows with the data."""
    stop = tokens.word_counts(table(spark, sf, "benchmark")).select("word")
    return tokens.common_words(texts(spark, sf), min_n=10, stop=stop)


@query
def frequent_words(spark: SparkSession, sf: str) -> DataFrame:
    common = tokens.common_words(texts(spark, sf), min_n=10)
    return describe.sorted_counts(common.filter(F.col("n") > 200))


@query
def top_words(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.top_words(tokens.common_words(texts(spark, sf)), 15)


@query
def bigram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.bigram_counts(texts(spark, sf))


@query
def turn_bigram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.bigram_counts(texts(spark, sf, "conversations"))


@query
def bigram_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.bigram_pairs(texts(spark, sf))


@query
def bigram_edges(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.bigram_graph(tokens.bigram_pairs(texts(spark, sf)), 10)[1]


@query
def bigram_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.bigram_graph(tokens.bigram_pairs(texts(spark, sf)), 10)[0]


@query
def trigrams_per_record(spark: SparkSession, sf: str) -> DataFrame:
    grams = tokens.ngrams(texts(spark, sf), "doc_id", n=3, keep_null=False, out="grams", rows=False)
    # A largest string is found by sorting, so that rows of all n-grams would be sorted by text.
    each = grams.select("doc_id", F.size("grams").cast("long").alias("n"), F.array_max("grams").alias("last_gram"))
    return each.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("last_gram").alias("last_gram")).filter("n > 0")


@query
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    marked = tokenize("text", lower=False, strip_punct=False)
    return docs.select(
        "doc_id",
        n_chars(space_out("text")).alias("spaced_chars"),
        n_chars(remove_all("text", "tion")).alias("chars_without_tion"),
        F.size(marked).cast("long").alias("n_marked_tokens"),
        has_any("text", DEMO["license"], whole_word=True).alias("license_word"),
    )


# --- features -----------------------------------------------------------------------------------


@query
def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    return features.token_stats(texts(spark, sf), tokenize("text"))


@query
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return features.TfidfRecipe().vocabulary(texts(spark, sf))


@query
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    return rounded(features.TfidfRecipe().fit(docs).long(docs, "doc_id"))


@query
def tfidf_every_word(spark: SparkSession, sf: str) -> DataFrame:
    """No frequency filter and no largest vocabulary: each word of each text."""
    docs = texts(spark, sf)
    recipe = terms.WideTfidf("doc_id", min_times=1)
    counts = recipe.counts(docs)
    cells = recipe.fit(counts, docs.count()).cells(counts, "doc_id")
    return rounded(cells.select("doc_id", F.inline("features")).select("doc_id", "token", "tf", "tfidf"))


@query
def tfidf_without_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency and weight of the words of three dictionaries, each fitted without the documents of one fold."""
    docs = texts(spark, sf).withColumn("fold", F.pmod("doc_id", F.lit(3)))
    sizes = {r["fold"]: r["count"] for r in docs.groupBy("fold").count().collect()}
    recipe = terms.WideTfidf("doc_id", min_times=2)
    fitted = recipe.fit_folds(recipe.counts(docs, "fold"), "fold", [sizes.get(f, 0) for f in range(3)])
    parts = [d.table.select(F.lit(f).cast("long").alias("fold"), "token", "n", "df", "idf") for f, d in enumerate(fitted)]
    return rounded(joins.union_all(parts))


def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary word of rank r gets the vector with vec_id r; at most 100 rows are ranked."""
    stats = features.token_stats(texts(spark, sf), tokenize("text"))
    vocab = features.fit_vocabulary(stats)
    ranked = vocab.withColumn("vec_id", F.row_number().over(W.orderBy(F.desc("n"), "token")).cast("long") - 1)
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return vectors.join(F.broadcast(ranked), "vec_id").select("token", "vec")


def long_vectors(df: DataFrame, vec: Column) -> DataFrame:
    out = df.select("doc_id", F.posexplode(vec).alias("dim", "value"))
    return rounded(out.withColumn("dim", F.col("dim").cast("long")))


@query
def doc_embedding(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    recipe = features.EmbeddingRecipe(word_vectors(spark, sf), 64, lower=True, stop=())
    return long_vectors(recipe.fit(docs).transform(docs), vector_to_array("features"))


@query
def doc_embedding_joined(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    vecs = features.doc_embedding(docs, word_vectors(spark, sf), 64, "doc_id", tokenize("text"))
    return long_vectors(vecs, F.col("vec"))


@query
def oov_rate(spark: SparkSession, sf: str) -> DataFrame:
    cased = tokenize("text", lower=False)
    return rounded(features.oov_rate(texts(spark, sf), word_vectors(spark, sf), cased))


# --- resampling and curves ----------------------------------------------------------------------


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return resample.stratified_split(table(spark, sf, "labels"), "doc_id", "quality", 0.8, 100)


@query
def event_split(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "event_type")
    return resample.stratified_split(events, "event_id", "event_type", 0.8, 7)


@query
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return resample.stratified_folds(table(spark, sf, "labels"), "doc_id", "quality", 10, 100)


@query
def event_folds(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "event_type")
    return resample.stratified_folds(events, "event_id", "event_type", 10, 7)


@query
def bootstrap_weights(spark: SparkSession, sf: str) -> DataFrame:
    weights = resample.bootstrap_weights(table(spark, sf, "labels").select("doc_id"), "doc_id", 20, apparent=True)
    return weights


def flag_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, outcome, truth, pred): every dictionary entry as a prediction of quality."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("outcome"), F.col(k).alias("pred")) for k in FLAGS]))
    wide = labelled_flags(spark, sf)
    return wide.select("doc_id", F.col("quality").alias("truth"), rows.alias("r")).select("doc_id", "truth", "r.*")


@query
def bootstrap_metric_ci(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.bootstrap_metric_ci(flag_predictions(spark, sf), "doc_id", replicates=50))


@query
def bootstrap_ci_wide(spark: SparkSession, sf: str) -> DataFrame:
    names = ["f_meas", "accuracy"]
    pairs = {k: ("quality", k) for k in FLAGS}
    conf = metrics.bootstrap_confusion_wide(labelled_flags(spark, sf), pairs, "doc_id", replicates=50)
    long = metrics.metrics_long(metrics.class_metrics(conf, names), ["outcome", "replicate"], names)
    ci = metrics.bootstrap_ci(long)
    return rounded(describe.pivot_multi(ci, ["outcome"], names, ["mean", "ci_lower", "ci_upper"]))


@query
def bootstrap_cells_ci(spark: SparkSession, sf: str) -> DataFrame:
    conf = metrics.confusion(flag_predictions(spark, sf))
    reps = metrics.bootstrap_confusion_cells(conf, replicates=200)
    long = metrics.metrics_long(metrics.class_metrics(reps), ["outcome", "replicate"])
    return rounded(metrics.bootstrap_ci(long))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, outcome, truth, score): number of matched dictionary entries as a score for each truth."""
    total = sum((F.col(k) for k in FLAGS), F.lit(0)).cast("double").alias("score")
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("outcome"), F.col(t).alias("truth")) for t in TRUTHS]))
    wide = labelled_flags(spark, sf).select("doc_id", total, rows.alias("r"))
    return wide.select("doc_id", "score", "r.*")


@query
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc_curve(scored(spark, sf), "score"))


@query
def pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.pr_curve(scored(spark, sf), "score"))


@query
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc_auc(scored(spark, sf), "score"))


@query
def order_price_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Many distinct scores: does the price tell a finished order?"""
    done = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("truth")
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("outcome"), "o_totalprice", done)
    return rounded(metrics.roc_auc(rows, "o_totalprice"))


@query
def bootstrap_exact_draws(spark: SparkSession, sf: str) -> DataFrame:
    """1,000 resamples of exactly n orders: draws, and whether the mean price lies within six standard errors of that of all orders."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    sums = draws.weighted_sums(draws.exact_weights(orders, "o_orderkey", 1000), ["o_totalprice"], 1000)
    whole = orders.agg(F.avg("o_totalprice").alias("mean"), (6 * F.stddev("o_totalprice") / F.sqrt(F.count(F.lit(1)))).alias("far"))
    near_mean = F.abs(F.col("o_totalprice") / F.col("n") - F.col("mean")) <= F.col("far")
    return sums.join(F.broadcast(whole)).select("replicate", "n", near_mean.alias("near"))  # `whole` is one row


@query
def basket_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """How many orders hold two parts together, for all parts."""
    baskets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return pairs.pair_counts(baskets, "parts").select(F.col("a").cast("long").alias("part_a"), F.col("b").cast("long").alias("part_b"), "n")


# --- errors, folds and ranking ------------------------------------------------------------------


@query
def error_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    out = joins.error_analysis(flag_predictions(spark, sf), docs, "doc_id", ["text"])
    return out.withColumn("text", F.md5("text"))


@query
def error_rows_all_columns(spark: SparkSession, sf: str) -> DataFrame:
    out = joins.error_analysis(flag_predictions(spark, sf), table(spark, sf, "documents"), "doc_id", None)
    return out.withColumn("text", F.md5("text"))


def fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per fold the metrics of each dictionary entry ("model"), matched as substring or as whole word
    ("config"), for each truth ("outcome")."""
    docs = texts(spark, sf)
    made = {
        f"{k}:{c}": has_any("text", terms, whole_word=c == "word")
        for k, terms in DEMO.items()
        for c in ("substring", "word")
    }
    flagged = docs.select("doc_id", *[col.alias(name) for name, col in made.items()])
    folds = resample.stratified_folds(table(spark, sf, "labels"), "doc_id", "quality", 5, 100)
    wide = flagged.join(folds, "doc_id")
    pairs = {f"{t}:{name}": (t, name) for t in TRUTHS for name in made}
    conf = metrics.confusion_wide(wide, pairs, by=["fold"])
    part = F.split("outcome", ":")
    named = conf.withColumns({"outcome": part[0], "model": part[1], "config": part[2]})
    ids = ["outcome", "model", "config", "fold"]
    return metrics.metrics_long(metrics.class_metrics(named, ["f_meas", "accuracy"]), ids, ["f_meas", "accuracy"])


def mean_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Means rounded, so that ranks do not hang on the last bit."""
    return rounded(metrics.collect_metrics(fold_metrics(spark, sf)))


@query
def collect_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return mean_metrics(spark, sf)


@query
def collect_metrics_wide(spark: SparkSession, sf: str) -> DataFrame:
    ids = ["outcome", "model", "config"]
    return describe.pivot_metrics(mean_metrics(spark, sf), ids, ["f_meas", "accuracy"], "mean")


@query
def rank_models(spark: SparkSession, sf: str) -> DataFrame:
    return tune.rank_models(mean_metrics(spark, sf))


@query
def best_config(spark: SparkSession, sf: str) -> DataFrame:
    return tune.select_best(mean_metrics(spark, sf))


@query
def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tune.metric_summary(mean_metrics(spark, sf)))


@query
def metric_summary_best(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tune.metric_summary(mean_metrics(spark, sf), best_only=True))


@query
def ranking_table(spark: SparkSession, sf: str) -> DataFrame:
    return tune.ranking_table(mean_metrics(spark, sf), half_even=False)


@query
def best_three_table(spark: SparkSession, sf: str) -> DataFrame:
    return tune.ranking_table(mean_metrics(spark, sf), top=3, half_even=False)


@query
def top_terms_by_class(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed log-odds of a word between good and other texts: the ten largest each way, with ties."""
    docs = texts(spark, sf).select("doc_id", "text")
    words = docs.join(table(spark, sf, "labels"), "doc_id").select("quality", F.explode(tokenize("text")).alias("variable"))
    good, other = (F.sum(F.when(F.col("quality") == q, 1).otherwise(0)) for q in (1, 0))
    counts = words.groupBy("variable").agg(good.alias("g"), other.alias("o")).filter(F.col("g") + F.col("o") >= 5)
    odds = F.log((F.col("g") + F.lit(1.0)) / (F.col("o") + F.lit(1.0)))
    sign = F.when(F.col("v") > 0, "Positive").otherwise("Negative")
    imp = counts.withColumn("v", odds).select("variable", F.round(F.abs("v"), PLACES).alias("importance"), sign.alias("sign"))
    return report.top_terms(imp, 10)


# --- joins and unions ---------------------------------------------------------------------------


@query
def union_metrics(spark: SparkSession, sf: str) -> DataFrame:
    conf = metrics.confusion_wide(labelled_flags(spark, sf), {k: ("quality", k) for k in FLAGS})
    counts = describe.prevalence(flags(spark, sf), FLAGS).select(F.col("name").alias("outcome"), "n")
    return joins.union_all([conf, counts])


@query
def natural_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return joins.natural_left_join(docs, table(spark, sf, "labels"))


@query
def cross_models(spark: SparkSession, sf: str) -> DataFrame:
    seen = describe.count_by(table(spark, sf, "documents"), ["lang"]).withColumnRenamed("lang", "outcome")
    return joins.cross(seen, "model", [models.MODELS[m].workflow_id for m in models.COMPARED])


@query
def row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return recode.with_row_id(table(spark, sf, "documents").select("doc_id", "lang"))


@query
def audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows after each step of a chain, counted while the last step runs."""
    docs, read = recode.audited(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "read")
    long_, filtered = recode.audited(docs.filter(F.col("n_chars") > 1000), "filter")
    both, joined = recode.audited(long_.join(table(spark, sf, "labels"), "doc_id"), "join")
    both.write.format("noop").mode("overwrite").save()
    steps = [(name, seen.get["rows"]) for name, seen in (("read", read), ("filter", filtered), ("join", joined))]
    return spark.createDataFrame(steps, "step string, n_rows long")


# --- concepts -----------------------------------------------------------------------------------


@query
def annotate_concepts(spark: SparkSession, sf: str) -> DataFrame:
    found = concepts.annotate(texts(spark, sf), lexicon(spark), "doc_id")
    return found.select("doc_id", "pos", "gram", "entity", "cui", "semantic_type")


@query
def annotate_similar(spark: SparkSession, sf: str) -> DataFrame:
    found = concepts.annotate(texts(spark, sf), lexicon(spark), "doc_id", threshold=0.7)
    return rounded(found.select("doc_id", "pos", "gram", "entity", "cui", "semantic_type", "score"))


LONGEST_ALIAS = 40
LETTERS = r"[\p{L}\p{M}]+"


def opening_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """The first 1 to 40 words of each benchmark text as aliases: 40 different lengths, each beginning like the next."""
    words = tokenize("text", lower=True, strip_punct=False)
    items = table(spark, sf, "benchmark").select("item_id", words.alias("w"))
    upto = F.explode(F.expr(f"filter(sequence(1, {LONGEST_ALIAS}), n -> n <= size(w))"))
    aliases = items.select("w", upto.alias("n")).select(F.array_join(F.slice("w", 1, F.col("n")), " ").alias("alias"), "n").distinct()
    return aliases.select("alias", F.substring("alias", 1, 20).alias("entity"), F.col("n").cast("string").alias("cui"), F.lit("Opening").alias("semantic_type"))


@query
def segment_words(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations without their blanks, cut into words by a lexicon learned from them, beside the words they had."""
    turns = texts(spark, sf, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0)).alias("w"))
    glued = settle(turns.select(F.struct("conv_id", "turn").alias("id"), "w", F.array_join("w", "").alias("run")), "glued")
    lexicon_ = segment.Lexicon.learn(glued.groupBy("run").agg(F.count(F.lit(1)).alias("n")), max_len=12)
    ends = lambda w: F.aggregate(
        F.transform(w, F.length), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    )
    both = lexicon_.cut_runs(glued).withColumns({"had": ends("w"), "got": ends("words")})
    common = F.size(F.array_intersect("had", "got")) - 1
    return both.select(
        "id.conv_id", "id.turn", F.size("w").cast("long").alias("n_words"), F.size("words").cast("long").alias("n_found"),
        common.cast("long").alias("n_common_ends"), (F.array_join("words", "") == F.col("run")).alias("whole"),
    )


@query
def scan_concepts(spark: SparkSession, sf: str) -> DataFrame:
    found = concepts.scan(texts(spark, sf), opening_lexicon(spark, sf), "doc_id")
    return found.select("doc_id", "pos", "gram", "entity", "cui")


@query
def scan_concepts_longest(spark: SparkSession, sf: str) -> DataFrame:
    found = concepts.scan(texts(spark, sf), opening_lexicon(spark, sf), "doc_id", overlaps="longest")
    return found.select("doc_id", "pos", "gram", "entity", "cui")


@query
def collapse_concepts(spark: SparkSession, sf: str) -> DataFrame:
    found = concepts.annotate(texts(spark, sf), lexicon(spark), "doc_id")
    return concepts.concept_strings(concepts.filter_concepts(found, entities=["free"]), "doc_id")


@query
def attach_concepts(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    found = concepts.filter_concepts(concepts.annotate(docs, lexicon(spark), "doc_id"), entities=["free"])
    return joins.attach_concepts(docs.select("doc_id", "lang"), concepts.concept_strings(found, "doc_id"), "doc_id")


@query
def prepare_texts(spark: SparkSession, sf: str) -> DataFrame:
    ready = score.prepare(texts(spark, sf), lexicon(spark), "doc_id", threshold=0.70, entities=["free"])
    return ready.select("doc_id", F.md5("text").alias("text_md5"), "cui")


# --- models -------------------------------------------------------------------------------------


LABELS = [f"label_{i}" for i in range(3)]


def label_flags(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, features, label_0, …): is it the label 0, 1, 2?"""
    flags_of = [F.when(F.col("label") == i, 1).otherwise(0).alias(o) for i, o in enumerate(LABELS)]
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"), *flags_of)


@query
def nb_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and variance of each dimension by class of three outcomes, as a fitted naive Bayes holds them."""
    rows = label_flags(spark, sf)
    return rounded(replicates.fit_replicates(rows, "vec_id", LABELS, replicates=0).table(rows))


@query
def bootstrap_refit_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Naive Bayes refitted on 1,000 resamples for three outcomes and scored on the rows each leaves out."""
    return replicates.refit_confusion(label_flags(spark, sf), "vec_id", LABELS, replicates=1000)


@query
def kernel_densities(spark: SparkSession, sf: str) -> DataFrame:
    """Density of each dimension at 512 points, for label 0 and for the others."""
    fitted = densities.fit_densities(label_flags(spark, sf), "label_0")
    points = fitted.select("truth", F.col("dim").cast("long").alias("dim"), "bw", "low", "step", F.posexplode("density").alias("i", "density"))
    x = F.col("low") + F.col("step") * F.col("i")
    return rounded(points.select("truth", "dim", "bw", F.col("i").cast("long").alias("i"), x.alias("x"), "density"))


@query
def kernel_bayes_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Naive Bayes with kernel densities, fitted on four fifths and tested on the rest, for three outcomes."""
    rows = label_flags(spark, sf)
    parts = []
    for outcome in LABELS:
        split = resample.stratified_split(rows, "vec_id", outcome, 0.8, 100)
        model = densities.KernelBayes.fit(split.filter("part = 'train'"), outcome)
        test = model.transform(split.filter("part = 'test'"))
        parts.append(test.select(F.lit(outcome).alias("outcome"), F.col("vec_id").alias("id"), F.col(outcome).alias("truth"), "pred", "p0", "p1"))
    return rounded(tune.evaluate(settle(joins.union_all(parts), "kernel-predictions"), ["outcome"]))


def near(spark: SparkSession, sf: str, k: int) -> DataFrame:
    emb = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.when(F.col("label") == 0, 1).otherwise(0).alias("label")
    )
    return neighbours.knn(emb, emb, k, exclude_self=True)


@query
def knn_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(near(spark, sf, 5))


@query
def inverted_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest other rows of every row by inverted lists; the number of lists read is set by measured recall."""
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    index = inverted.InvertedLists.fit(emb, k=5)
    return rounded(index.search(emb, emb, 5, exclude_self=True))


@query
def knn_vote(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(neighbours.knn_vote(near(spark, sf, 6), 5, "triangular"))


def label_zero(spark: SparkSession, sf: str) -> DataFrame:
    """(id, truth, embedding, part): is the label 0?"""
    emb = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.when(F.col("label") == 0, 1).otherwise(0).alias("zero"), "embedding"
    )
    return resample.stratified_split(emb, "id", "zero", 0.8, 100)


# One moderate parameter set per model, the middle of its tuning range.
MID = {
    "random_forest": {"trees": 20, "min_n": 2, "mtry": 0.3},
    "gbt": {"trees": 10, "depth": 4, "mtry": 0.5},
    "knn": {"neighbors": 7, "weight_func": "inverse"},
    "svm": {"cost": 1.0},
    "mlp": {"hidden_units": 8, "epochs": 30},
    "lasso": {"penalty": 0.01},
}


def model_query(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        flow = tune.Workflow(models.MODELS[name].workflow_id, features.VectorRecipe("embedding"), name, [MID.get(name, {})])
        _, pred = tune.last_fit(label_zero(spark, sf), "id", {"zero": (flow, flow.grid[0])}, parallelism=1)
        m = tune.evaluate(pred, ["outcome", "model"])
        return report.test_table(m, ["outcome", "model"])

    return run


for _name in models.MODELS:
    QUERIES[f"model_{_name}_metrics"] = model_query(_name)


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf).select("doc_id", "text")
    return docs.join(table(spark, sf, "labels"), "doc_id").withColumnRenamed("doc_id", "id")


@query
def lasso_importance(spark: SparkSession, sf: str) -> DataFrame:
    docs = labelled_documents(spark, sf).withColumn("truth", F.col("quality"))
    recipe = features.TfidfRecipe().fit(docs)
    train = settle(recipe.transform(docs).select("features", "truth"), "features", even=True)
    model = models.fit_model("lasso", {"penalty": 0.01}, train)
    return report.top_terms(models.importance(model, recipe.terms))


def path_rows(spark: SparkSession, sf: str, v: int) -> DataFrame:
    """(id, features, nine outcomes, fold): TF-IDF of all documents."""
    docs = texts(spark, sf)
    recipe = features.TfidfRecipe().fit(docs)
    flagged = recode.tag_keywords(recipe.transform(docs), "text", DEMO).select(F.col("doc_id").alias("id"), "features", *FLAGS)
    # Rows with the same outcomes are spread evenly over the folds, which evens out each outcome.
    pattern = F.concat_ws("", *[F.col(f).cast("string") for f in FLAGS])
    return settle(resample.stratified_folds(flagged.withColumn("pattern", pattern), "id", "pattern", v), "path-features")


@query
def lasso_path(spark: SparkSession, sf: str) -> DataFrame:
    """Nine outcomes, 30 penalties, ten folds on TF-IDF: out-of-fold metrics of each, from one joint fit that goes on until every run has settled."""
    rows = path_rows(spark, sf, 10)
    fitted = path.fit_path(rows, FLAGS, v=10)
    pred = settle(fitted.predict(rows), "path-predictions").withColumn("model", F.lit("recipe_Lasso"))
    return rounded(metrics.collect_metrics(tune.evaluate(pred)))


@query
def network_tuning(spark: SparkSession, sf: str) -> DataFrame:
    """Nine outcomes, ten sets of units, penalty and epochs, ten folds on TF-IDF: out-of-fold metrics of each from one joint fit."""
    rows = path_rows(spark, sf, 10)
    fitted = network.fit_networks(rows, FLAGS, models.random_grid(models.MODELS["mlp"].space, 10), v=10)
    pred = settle(fitted.predict(rows), "network-predictions").withColumn("model", F.lit("recipe_MLP"))
    return rounded(metrics.collect_metrics(tune.evaluate(pred)))


@query
def boosted_tuning(spark: SparkSession, sf: str) -> DataFrame:
    """Nine outcomes, three sets of parameters of boosted trees, ten folds on TF-IDF: out-of-fold metrics of each from one joint fit."""
    rows = path_rows(spark, sf, 10)
    space = {**models.MODELS["gbt"].space, "trees": models.whole(5, 15), "depth": models.whole(2, 4)}
    fitted = boosting.fit_boosted(rows, FLAGS, models.random_grid(space, 3), v=10, bins=32)
    pred = settle(fitted.predict(rows), "boosted-predictions").withColumn("model", F.lit("recipe_Gradient.boosting"))
    return rounded(metrics.collect_metrics(tune.evaluate(pred)))


@query
def tuned_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Small tuning run: two outcomes, TF-IDF, two models, three folds."""
    recipe = features.TfidfRecipe()
    flows = [
        tune.Workflow("recipe_Lasso", recipe, "lasso", models.penalty_grid(-2, -1, 2)),
        tune.Workflow("recipe_Naive.Bayes", recipe, "naive_bayes", [{}]),
    ]
    pred = tune.tune(labelled_documents(spark, sf), "id", TRUTHS, flows, v=3)
    m = metrics.collect_metrics(tune.evaluate(pred))
    return tune.ranking_table(m)


@query
def bootstrap_refit_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals from 1,000 refits of each of three outcomes."""
    m = replicates.refit_metrics(replicates.refit_confusion(label_flags(spark, sf), "vec_id", LABELS, replicates=1000))
    return rounded(tune.bootstrap_refit_ci(m).select("outcome", "metric", "mean", "ci_lower", "ci_upper"))


def fitted_labellers(spark: SparkSession, sf: str) -> dict[str, models.Labeller]:
    docs = labelled_documents(spark, sf)
    recipe = features.TfidfRecipe().fit(docs)
    narrow = settle(recipe.transform(docs).select("id", "features", *TRUTHS), "features", even=True)
    out = {}
    for truth, name in zip(TRUTHS, ("naive_bayes", "logistic")):
        train = narrow.select("id", "features", F.col(truth).alias("truth"))
        out[truth] = models.Labeller(recipe, models.fit_model(name, {}, train))
    return out


@query
def predict_small(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf).select("doc_id", "text", "lang")
    return score.predict_small(docs, fitted_labellers(spark, sf)).drop("text")


@query
def predict_complete(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    ready = score.prepare(docs, lexicon(spark), "doc_id", threshold=0.70, entities=["free"])
    path = new_table_path(spark, "models")
    models.save_models(fitted_labellers(spark, sf), path)
    return score.predict_complete(ready, models.load_models(path), ["doc_id", "cui"])


def concept_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts at threshold 0.70 as the only text of two models, saved in two folders, merged and applied to every document."""
    ready = settle(score.prepare(texts(spark, sf), lexicon(spark), "doc_id", threshold=0.70, entities=["free"]), "prepared")
    known = ready.select("doc_id", "cui").join(table(spark, sf, "labels"), "doc_id").withColumnRenamed("doc_id", "id")
    # Ids of concepts are no words of a language, and a rare one counts like any other.
    recipe = features.TfidfRecipe(text="cui", min_times=1, stop=[]).fit(known)
    narrow = settle(recipe.transform(known).select("id", "features", *TRUTHS), "features", even=True)
    paths = []
    for truth, name in zip(TRUTHS, ("logistic", "naive_bayes")):
        train = narrow.select("id", "features", F.col(truth).alias("truth")).filter("truth is not null")
        paths.append(new_table_path(spark, f"models-{truth}"))
        models.save_models({truth: models.Labeller(recipe, models.fit_model(name, {}, train))}, paths[-1])
    return score.predict_complete(ready, models.load_models(paths), ["doc_id", "cui"])


@query
def predict_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return concept_predictions(spark, sf)


@query
def predict_concepts_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each prediction is a class with two shares that sum to one, the larger of them its own."""
    pred = concept_predictions(spark, sf)

    def valid(o: str) -> Column:
        p0, p1 = F.col(f"{o}_pred_0"), F.col(f"{o}_pred_1")
        return F.col(o).isin(0, 1) & (F.abs(p0 + p1 - 1) < 1e-9) & p0.between(0, 1) & ((F.col(o) == 1) == (p1 > 0.5))

    return pred.select("doc_id", "cui", *[F.coalesce(valid(o), F.lit(False)).alias(f"{o}_valid") for o in TRUTHS])


# --- sources, sinks and streams -----------------------------------------------------------------


@query
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_table_path(spark, "records")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    docs.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    back = tables.read_records(spark, path, docs.schema, {"lang": "language"}, multiline=True)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "language", "n_chars")


@query
def table_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_table_path(spark, "snapshot")
    labels = table(spark, sf, "labels")
    tables.write_table(labels, path, "2022-01-18")
    tables.write_table(labels.filter("toxic = 1"), path, "2022-01-28")
    return tables.read_table(spark, path, "2022-01-18").drop("run_date")


@query
def by_outcome_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_table_path(spark, "by-outcome")
    tables.write_by_outcome(flag_predictions(spark, sf), path, "csv")
    back = spark.read.option("header", True).schema("doc_id long, truth int, pred int, outcome string").csv(path)
    return back.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("pred").alias("n_pred"), F.sum("truth").alias("n_truth"))


@query
def embeddings_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_table_path(spark, "vectors")
    numbers = F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), " ")
    table(spark, sf, "embeddings").select(F.concat_ws(" ", F.concat(F.lit("t"), "vec_id"), numbers)).write.text(path)
    back = tables.read_embeddings(spark, path, 64)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return rounded(back.select("token", F.size("vec").cast("long").alias("dim"), total.alias("total")))


@query
def streamed_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword flags of documents that arrive as a stream."""
    docs = table(spark, sf, "documents")
    stream = scoring.stream_records(spark, f"{sf}/documents*.parquet", docs.schema)
    out, checkpoint = new_table_path(spark, "stream"), new_table_path(spark, "stream-checkpoint")
    run = scoring.score_stream(
        stream, lambda batch: recode.tag_keywords(batch, "text", DEMO).select("doc_id", *FLAGS), out, checkpoint
    )
    run.awaitTermination()
    return spark.read.parquet(out).drop("batch")
