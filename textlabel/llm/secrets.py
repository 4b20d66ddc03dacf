"""Secrets in text: fixed patterns, and a battery of randomness tests. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlabel.llm.arrays import let

# Base patterns in the order of their kinds; the last number is the least length of the group that counts.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
    "hex": (r"([0-9a-f]{32,}+)", 1, 32),
}
KINDS = [*PATTERNS, "random"]
# What may be an encoded secret: a long run of the characters of base64 and its URL form.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# Encodings from the narrowest: name, pattern of the whole token, alphabet in the order of its values.
ENCODINGS = [
    ("decimal", r"^[0-9]+$", DIGITS),
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[0-9a-z]+$", DIGITS + LOWER),
    ("base36_upper", r"^[0-9A-Z]+$", DIGITS + UPPER),
    ("base64", r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
]
# Words and numbers by their form: these are not tested, as chance alone makes no difference to them.
PLAIN = r"^[A-Z]?[a-z]+$|^[A-Z]+$|^[0-9]+$"
P_BINS = 1000
# A token whose combined p-value is below this is never random.
LEVEL = 0.01
SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points (end exclusive). Texts without a match
    are scanned once."""

    def placed(x: Column) -> Column:
        gaps = F.zip_with(
            F.slice(x["parts"], F.lit(1), F.size(x["found"])),
            x["found"],
            lambda part, value: F.struct(F.char_length(part).alias("gap"), value.alias("value")),
        )
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, m: Column) -> Column:
            begin = acc["at"] + m["gap"]
            end = begin + F.char_length(m["value"])
            span = F.struct(begin.alias("start"), end.alias("end"), m["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(gaps, start, step, lambda acc: acc["out"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.struct(F.split(text, pattern, -1).alias("parts"), found.alias("found"))
    return F.when(text.rlike(pattern), let(both, placed)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """array<struct<start,kind,end,name>> of the fixed patterns, by start, then kind."""
    parts = []
    for order, (name, (pattern, group, least)) in enumerate(PATTERNS.items()):
        long = F.filter(matches(text, pattern), lambda m: F.char_length(F.regexp_extract(m["value"], pattern, group)) >= least)  # noqa: B023
        parts.append(F.transform(long, lambda m: _span(m, order, name)))  # noqa: B023
    return F.array_sort(F.concat(*parts))


def _span(m: Column, order: int, name: str) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(order).alias("kind"), m["end"].alias("end"), F.lit(name).alias("name"))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, by the usual five-term polynomial."""
    x = F.abs(z)
    t = 1 / (1 + F.lit(0.2316419) * x)
    # Fixed values of that polynomial.
    terms = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    poly = F.lit(0.0)
    for c in reversed(terms):
        poly = (poly + c) * t
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _log_p(p: Column) -> Column:
    return F.log(F.least(F.greatest(p, F.lit(1e-300)), F.lit(1.0)))


def _battery(values: Column, size: Column) -> Column:
    """Combined p-value under "each symbol is drawn alike and independently from an alphabet of this size".

    Chi-squared for uniformity (too uneven only), number of runs in the lower and upper half of the alphabet
    and correlation of neighbours (both two-sided), each standardised with its exact mean and variance, joined by Fisher's sum."""

    def p_of(x: Column) -> Column:
        v, k, n = x["v"], x["k"], F.size(x["v"]).cast("double")
        squares = F.aggregate(
            F.array_distinct(v), F.lit(0.0), lambda acc, s: acc + F.pow(F.size(F.filter(v, lambda y: y == s)).cast("double"), 2)
        )
        uneven = (squares * k / n - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
        left, right = F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1)
        changes = F.zip_with(left, right, lambda a, b: F.when((a >= k / 2) != (b >= k / 2), 1.0).otherwise(0.0))
        runs = (F.aggregate(changes, F.lit(0.0), lambda acc, c: acc + c) - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        mean, var = (k - 1) / 2, (k * k - 1) / 12
        products = F.zip_with(left, right, lambda a, b: (a - mean) * (b - mean))
        serial = F.aggregate(products, F.lit(0.0), lambda acc, c: acc + c) / (F.sqrt(n - 1) * var)
        tails = F.array(uneven, F.abs(runs), F.abs(serial))
        sides = F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0))
        logs = F.zip_with(tails, sides, lambda z, side: -_log_p(side * _upper_tail(z)))
        total = F.aggregate(logs, F.lit(0.0), lambda acc, y: acc + y)
        return let(total, lambda s: F.exp(-s) * (1 + s + s * s / 2))

    return let(F.struct(values.alias("v"), size.cast("double").alias("k")), p_of)


def _encoding_of(core: Column) -> Column:
    """(name, alphabet) of the narrowest encoding that a token can be; NULL for words, numbers and what fits none."""
    out = F.lit(None).cast("struct<name:string,alphabet:string>")
    for name, pattern, alphabet in reversed(ENCODINGS):
        out = F.when(core.rlike(pattern), F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"))).otherwise(out)
    return F.when(~core.rlike(PLAIN), out)


def tested_tokens(text: Column) -> Column:
    """array<struct<start,end,band,p>>: candidates with the encoding and length class they are compared in."""

    def tested(m: Column) -> Column:
        core = F.translate(F.regexp_replace(m["value"], "=+$", ""), "-_", "+/")

        def judged(x: Column) -> Column:
            alphabet = x["e"]["alphabet"]
            symbols = F.array_remove(F.split(x["core"], ""), "")
            values = F.transform(symbols, lambda c: (F.position(c, alphabet) - 1).cast("double"))
            half_steps = F.floor(F.log2(F.char_length(x["core"]).cast("double")) * 2).cast("string")
            return F.struct(
                m["start"].alias("start"), m["end"].alias("end"),
                F.concat(x["e"]["name"], F.lit(":"), half_steps).alias("band"),
                F.when(alphabet.isNotNull(), _battery(values, F.char_length(alphabet))).alias("p"),
            )

        return let(let(core, lambda c: F.struct(c.alias("core"), _encoding_of(c).alias("e"))), judged)

    return F.filter(F.transform(matches(text, CANDIDATE), tested), lambda t: t["p"].isNotNull())


def thresholds(docs: DataFrame, text: Column, rate: float) -> dict[str, float]:
    """Per encoding and length class the p-value above which a token counts as random.

    p-values of random tokens spread evenly, those of words and names pile up near 0. The share of random tokens
    in a class is estimated from its upper fifth, plus one token and one standard error, so that chance in a small class does
    not write off random tokens; the threshold is the smallest at which at most `rate` of the tokens above it are not random by that
    estimate, and never below `LEVEL`. It is tried just above the next lower token, not at the token itself: how far a
    token lies above the others is no sign against it, and one that is alone in its class is tested at `LEVEL`. Counts are made per p
    bin over all documents; what comes to the driver is one number for each class, of which there are at most seven encodings
    times two for each doubling of length."""
    tokens = docs.select(F.explode(tested_tokens(text)).alias("t")).select("t.band", "t.p")
    bins = tokens.groupBy("band", F.least(F.floor(F.col("p") * P_BINS), F.lit(P_BINS - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    upper = F.sum(F.when(F.col("bin") >= P_BINS * 4 // 5, F.col("n")).otherwise(0)).over(W.partitionBy("band"))
    above = F.sum("n").over(W.partitionBy("band").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.partitionBy("band"))
    lower = F.lag("bin").over(W.partitionBy("band").orderBy("bin"))
    least = F.greatest((F.coalesce(lower, F.lit(-1)) + 1) / F.lit(float(P_BINS)), F.lit(LEVEL))
    random = F.least(5 * (F.col("upper") + 1 + F.sqrt(F.col("upper") + 1)), F.col("total")) * (1 - F.col("least"))
    tried = bins.withColumns({"upper": upper, "above": above, "total": total, "least": least})
    kept = tried.filter((F.col("bin") + 1 > LEVEL * P_BINS) & (1 - random / F.col("above") <= rate))
    found = kept.groupBy("band").agg(F.min("least").alias("p"))
    return {r["band"]: r["p"] for r in found.collect()}


def find_secrets(docs: DataFrame, text_col: str = "text", rate: float = 0.05, out_col: str = "spans") -> DataFrame:
    """`docs` with `out_col`: array<struct<start int, kind int, end int, name string>>, by start, then kind.

    Kinds are the fixed patterns (`PATTERNS`, leftmost non-overlapping for each, too short ones dropped) and `random`: tokens that
    pass the tests as random within the false-discovery `rate` of their class and touch no span of a fixed pattern. Places
    are code points, ends exclusive. NULL and empty texts have no spans. Rows are independent but for the thresholds, which come
    from all rows; repeated rows count as often as they stand there. Other columns are kept; `out_col` must be new.
    """
    if out_col in docs.columns:
        raise ValueError(f"column {out_col} exists")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    least = thresholds(docs, text, rate)
    if not least:
        return docs.withColumn(out_col, base_spans(text))
    limits = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair])
    passed = F.filter(tested_tokens(text), lambda t: t["p"] >= F.coalesce(limits[t["band"]], F.lit(2.0)))

    def joined(x: Column) -> Column:
        free = F.filter(
            x["more"], lambda t: ~F.exists(x["base"], lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
        )
        return F.array_sort(F.concat(x["base"], F.transform(free, lambda t: _span(t, len(PATTERNS), "random"))))

    both = F.struct(base_spans(text).alias("base"), passed.alias("more"))
    return docs.withColumn(out_col, let(both, joined))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by `mark`. NULL stays NULL."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        longer = F.struct(F.concat(acc["out"], before, F.lit(mark)).alias("out"), s["end"].alias("at"))
        overlap = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when((s["start"] >= acc["at"]), longer).otherwise(overlap)

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
