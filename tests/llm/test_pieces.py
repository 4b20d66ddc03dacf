import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.fixtures import documents, odd_rows
from textlabel.llm import pieces

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
MORE = [
    (20, " lead"), (21, "tail   "), (22, "a  b\n\nc\td"), (23, "▁x▁▁ y"), (24, "Ａﬁ ½ \u00a0 \u3000z"), (25, "\0"), (26, "x" * 5000),
    (27, "</s> <s> <unk> <0x0A>"), (28, "é" * 300 + " " * 40 + "日本"), (29, "▁"), (30, "  "),
]


@pytest.mark.parametrize(("page", "block"), [(1 << 24, 1 << 20), (2000, 500), (1, 1)])
def test_equals_the_library(spark, monkeypatch, page, block):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(pieces, "PAGE_CHARS", page)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", block)
    rows = odd_rows() + MORE
    got = pieces.encode_decode(documents(spark, rows), MODEL).collect()
    want = []
    for key, text in rows:
        ids = sp.encode(text or "", add_eos=True)
        want.append((key or -1, ids, sp.decode(ids)))
    assert sorted((r.doc_id or -1, r.ids, r.decoded) for r in got) == sorted(want)


def test_both_passes_agree_on_pages(spark):
    """Page keys are the same where a union moves the partitions of the second pass."""
    schema = T.StructType([T.StructField("page", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("lens", T.ArrayType(T.IntegerType())), T.StructField("texts", T.BinaryType())])
    docs = documents(spark, [(i, f"some text number {i} of these") for i in range(50)]).select("doc_id", "text").repartition(5)
    words = docs.mapInArrow(pieces._word_groups(MODEL, 4), "page long, grp long, words binary")
    blocks = docs.mapInArrow(pieces._blocks(pa.int64()), schema).select("page")
    moved = spark.range(3).select(F.col("id").alias("page")).filter("page < 0").unionByName(blocks)
    assert {r.page for r in moved.collect()} == {r.page for r in words.collect()}


def test_without_end_and_empty_table(spark):
    got = pieces.encode_decode(documents(spark, [(1, ""), (2, "hi")]), MODEL, end=False).collect()
    assert {r.doc_id: len(r.ids) for r in got}[1] == 0
    assert pieces.encode_decode(documents(spark, [(1, "x")]).filter("false"), MODEL).collect() == []
