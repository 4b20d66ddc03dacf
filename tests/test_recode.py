import pytest
from pyspark.sql import functions as F

from textlabel.functions.dictionaries import OUTCOMES, OTHERS, RACE_RULES, SNOWBALL_ENGLISH, SUBSTANCES
from textlabel.functions.text import alternation, has_any
from textlabel.operators import recode


def flags_of(spark, text):
    df = spark.createDataFrame([("1", text)], "id string, text string")
    row = recode.tag_keywords(df, "text").first()
    return {o for o in OUTCOMES if row[o] == 1}


def test_scoring_example(spark):
    hit = flags_of(spark, "patient overdose fentanyl gabapentin methadone")
    assert hit == {"Fentanyl", "Prescription.opioids", "Others", "Any Opioids"}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("HEROIN toxicity", {"Heroin", "Any Opioids"}),
        ("methamphetamine", {"Methamphetamine", "Others"}),  # "amphetamine" is inside it
        ("nordiazepam", {"Benzodiazepines", "Others"}),  # "diazepam" is in both lists
        ("4-anpp", {"Fentanyl", "Any Opioids"}),
        ("", set()),
        (None, set()),
        ("3,4-Methylenedioxymethamphetamine", {"Methamphetamine", "Others"}),
    ],
)
def test_substances(spark, text, expected):
    assert flags_of(spark, text) == expected


def test_list_sizes():
    sizes = {k: len(v) for k, v in SUBSTANCES.items()}
    assert (sizes["Fentanyl"], sizes["Prescription.opioids"], sizes["Any Opioids"]) == (4, 15, 20)
    assert (sizes["Benzodiazepines"], sizes["Cocaine"], sizes["Alcohol"]) == (13, 2, 3)
    assert sizes["Others"] == len(OTHERS)
    assert len(SNOWBALL_ENGLISH) == len(set(SNOWBALL_ENGLISH)) == 175


@pytest.mark.parametrize("whole", [False, True])
def test_condensed_pattern_equals_plain_alternation(spark, whole):
    terms = SUBSTANCES["Others"] + ["ab", "abc", "abd", "a b", "3,4-x"]
    texts = [*terms, "xabcx", "abd.", " ab", "Zab cd", "PHENOBARBITAL", "mdab", "MDA ", "a-b", "nothing", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    edge = r"[^\p{L}\p{M}\p{N}_]"
    body = "|".join(terms)
    plain = f"(?i)(?:^|{edge})(?:{body})(?:{edge}|$)" if whole else "(?i)" + body
    both = df.select(
        has_any("text", terms, whole).alias("a"), F.coalesce(F.col("text").rlike(plain), F.lit(False)).cast("int").alias("b")
    )
    assert both.filter("a <> b").count() == 0
    assert both.filter("a = 1").count() > len(terms) - 3


def test_regular_expressions_stay_terms():
    assert alternation(["a.c", "b+"]) == "(?iu)a.c|b+"


def test_race_rules(spark, rows):
    values = ["WHITE", "Am. Indian", "American Indian", "Native American", "0", "B10", "Null", None, "Klingon", "Samoan"]
    df = spark.createDataFrame([(v,) for v in values], "race string")
    got = [r["race"] for r in recode.recode_rules(df, "race", RACE_RULES).collect()]
    assert got == [
        "White", "Asian", "Asian", "American Indian or Alaska Native", "Unknown", "Unknown", "Unknown", None,
        "Klingon", "Native Hawaiian and Other Pacific Islander",
    ]


def test_rule_hits_show_hidden_rules(spark):
    df = spark.createDataFrame([("american indian",), ("am. indian",), ("indian",), (None,)], "race string")
    hits = {r["pattern"]: (r["first_hits"], r["any_hits"]) for r in recode.rule_hits(df, "race", RACE_RULES).collect()}
    assert hits["indian"] == (3, 3)
    assert hits["american indian"] == (0, 1)
    assert hits["am. indian"] == (0, 1)


def test_filter_min_group_limit_and_null(spark, rows):
    data = [("ten",)] * 10 + [("eleven",)] * 11 + [("rare",)]
    df = spark.createDataFrame(data, "word string")
    assert {r["word"] for r in recode.filter_min_group(df, ["word"], 10).collect()} == {"eleven"}
    assert recode.filter_min_group(df, ["word"], 10).count() == 11


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "w string")
    assert [r["w"] for r in df.filter(recode.not_in("w", ["a"])).collect()] == [None, "b"]


def test_small_helpers(spark, rows):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, `b.x` int, `c d` int, e int")
    assert recode.cols_between(df, 2, 3) == ["b.x", "c d"]
    assert recode.cols_between(df, "b.x", "e") == ["b.x", "c d", "e"]
    assert recode.select_as(df, {"new": "b.x"}).columns == ["new"]
    labels = spark.createDataFrame([("Prescription.opioids",), ("x",)], "name string")
    fixed = recode.recode_exact(labels, "name", {"Prescription.opioids": "Prescription opioids"})
    assert rows(fixed) == [("Prescription opioids",), ("x",)]
    ordered = recode.with_order(labels.withColumn("n", F.length("name")), [F.desc("n")])
    assert rows(ordered, "name", "ord") == [("Prescription.opioids", 1), ("x", 2)]


def test_row_id_over_several_files(spark, tmp_path):
    spark.range(100).repartition(5).write.parquet(str(tmp_path / "t"))
    ids = [r["row"] for r in recode.with_row_id(spark.read.parquet(str(tmp_path / "t"))).collect()]
    assert sorted(ids) == list(range(1, 101))


def test_audit(spark):
    df, seen = recode.audited(spark.range(10), "all")
    kept, left = recode.audited(df.filter("id > 6"), "kept")
    assert kept.count() == 3
    assert (seen.get["rows"], left.get["rows"]) == (10, 3)


def test_plain_terms_fold_letters_as_java_does_and_leave_its_regex_engine(spark):
    texts = ["ICE", "İce", "ıCE", "liſk", "LISK", "no", "", None, "x ice\n", "\xe9ice", "icé", "\U0001d400 ice", "_ice"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for whole in (False, True):
        terms = ["ice", "lisk"]
        java = F.coalesce(F.col("text").rlike(alternation(terms, whole)), F.lit(False)).cast("int")
        both = df.select(has_any("text", terms, whole).alias("a"), java.alias("b"))
        assert [r.a for r in both.collect()] == [r.b for r in both.collect()]
        assert sum(r.a for r in both.collect()) >= 5
    # One pass of Arrow's automaton instead of Java's search, which costs about 100 times as much on nine lists.
    plan = df.select(has_any("text", ["ice"]).alias("a"))._jdf.queryExecution().toString()
    assert "RLIKE" not in plan and "ArrowEvalPython" in plan
