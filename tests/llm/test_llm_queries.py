"""The registered queries on the smallest tables, against SQL or brute force, and the pipeline against its stages by hand."""

import hashlib
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as registry
import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_passages import brute as brute_passages
from tests.llm.test_secrets import brute as brute_spans
from tests.llm.test_simhash import brute_fingerprint, classes
from tests.oracle_check import compare, connect
from textlabel.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in queries.table(spark, SF, "documents").collect()}


def rows_of(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    spark.catalog.clearCache()
    return {r.doc_id: r for r in rows}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    assert compare(registry.queries()[name](spark, SF), connect(SF), queries.SQL[name]).startswith("ok")


def test_operators_are_registered():
    names = registry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14)) and "pipeline" in names


def test_op1(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    for key, r in rows_of(spark, "op1_sentencepiece").items():
        ids = sp.encode(docs[key].text, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))


def test_op2(spark, docs):
    got = {(r.doc_id, r.start): (r.kept_id, r.kept_start) for r in registry.queries()["op2_passages"](spark, SF).collect()}
    assert got == brute_passages([(k, r.text) for k, r in docs.items()])


def test_op3(spark, docs):
    order, got = sorted(docs), rows_of(spark, "op3_fingerprints")
    assert sorted(got) == order
    for i, key in enumerate(order):
        text, other = docs[key].text, docs[order[(i + 1) % len(order)]].text
        n, r = len(text) // 4, got[key]
        edited = text[: len(text) - n] + other[:n]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        if edited == text:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
        hashes = [{x[j : j + 16] for j in range(0, len(x), 16)} for x in (r.fingerprint, r.edited_fingerprint, got[order[(i + 1) % len(order)]].fingerprint)]
        for value, b in ((r.near_edited, hashes[1]), (r.near_next, hashes[2])):
            assert value == pytest.approx(len(hashes[0] & b) / len(hashes[0] | b) if hashes[0] | b else 1.0)


def test_op4_and_op5_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    known = queries.table(spark, sf, "documents").select("doc_id", "lang")
    out = registry.queries()["op4_language"](spark, sf).join(known, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    out = registry.queries()["op5_quality"](spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    good = [r for r in out if r.quality == 1]
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.93
    assert sum(r.predicted for r in good) / len(good) > 0.97


def test_op6(spark, docs):
    got = rows_of(spark, "op6_simhash")
    prints = {k: brute_fingerprint(r.text) for k, r in docs.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{prints[k]:016x}", c) for k, c in classes(docs, links).items()}


def test_op8(spark, docs):
    for key, r in rows_of(spark, "op8_secrets").items():
        base = brute_spans(docs[key].text)
        said = [f"{s[3]}:{s[0]}:{s[2]}" for s in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == k for s in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == sha(",".join(said)) and set(said) <= set(r.spans.split(",")) | {""}


def test_op10_rules(spark):
    for r in registry.queries()["op10_url_filter"](spark, SF).collect():
        fits = [(h + p, v) for v, h, p in queries.URL_RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        rule = max(fits, key=lambda x: len(x[0]), default=None)
        assert r.rule == (rule and rule[0]) and r.verdict in ("allow", "block")
        assert rule is None or r.verdict == rule[1]


def test_pipeline_against_its_stages_by_hand(spark, docs):
    model = queries.quality_model(spark, queries.table(spark, SF, "documents"), SF)
    from textlabel.llm.quality import features

    size = features([r.text for r in docs.values()], model.good, model.bad) @ model.weights + model.intercept
    left = {k: r.text for (k, r), z in zip(docs.items(), size) if z >= 0}
    prints = {k: brute_fingerprint(t) for k, t in left.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    left = {k: left[k] for k, c in classes(left, links).items() if k == c}
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    left = {k: left[k] for k, _, _, _, bad in brute_hits(list(left.items()), items, 10) if not bad}
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == sorted(left) and 0 < len(got) < len(docs)
    for key, text in left.items():
        out, at = "", 0
        for start, _, end, _ in brute_spans(text):
            out += text[at:start] + "[SECRET]" if start >= at else ""
            at = max(at, end)
        clean = out + text[at:]
        ids = sp.encode(clean, add_eos=True)
        assert (got[key].n_tokens, got[key].decoded_sha256) == (len(ids), sha(sp.decode(ids)))


def test_pipeline_stages_stand_odd_rows(spark, tmp_path):
    from tests.llm.fixtures import odd_rows, with_clashes

    rows = [(i, t, None, "s", len(t or "")) for i, t in [*odd_rows(), (70, "token=abcdefgh12 x"), (71, None)]]
    base = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (base, base.filter("false")):
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            n = out.count()
            assert (n > 0) == (docs is base)
    assert corpus_pipeline.encoding(spark, base, SF).count() == len(rows)
    clean = {r.doc_id: r for r in corpus_pipeline.secret_scan(spark, base, SF).collect()}
    assert clean[70].text == "[SECRET] x" and clean[70].n_chars == 10 and clean[71].text is None


def test_native_operators_run_no_python(spark):
    for name in ("op3_fingerprints", "op7_decontamination", "op8_secrets"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
        spark.catalog.clearCache()


def test_whole_text_reaches_every_operator(spark):
    """A long text whose last words alone differ is told apart."""
    from textlabel.llm import sketch

    long = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, long), (2, long + " " + " ".join(f"v{i}" for i in range(60)))], "doc_id long, text string")
    a, b = (r.s for r in df.select(sketch.sketch(F.col("text")).alias("s")).collect())
    assert a != b
