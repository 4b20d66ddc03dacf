from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from textlabel import session
from textlabel.operators import recode
from textlabel.sources import tables
from textlabel.streaming import scoring


def test_csv_with_repeated_header_and_quotes(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,Gender,text,Gender\n1,F,"said ""no"", left\nhome",Female\n2,M,,Male\n')
    got = tables.read_records(spark, str(tmp_path / "r.csv"), rename={"Gender1": "g", "Gender3": "gender"}, multiline=True)
    assert got.columns == ["id", "g", "text", "gender"]
    assert got.orderBy("id").first()["text"] == 'said "no", left\nhome'
    typed = tables.read_records(spark, str(tmp_path / "r.csv"), "id long, a string, text string, b string", multiline=True)
    assert typed.schema["id"].dataType.simpleString() == "bigint" and typed.filter("text is null").count() == 1


def test_dated_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(3), path, "2022-01-18")
    tables.write_table(spark.range(5), path, "2022-01-28")
    tables.write_table(spark.range(4), path, "2022-01-28")  # the same day again replaces only that day
    assert tables.read_table(spark, path).count() == 7
    assert tables.read_table(spark, path, "2022-01-28").count() == 4


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_by_outcome(spark, tmp_path, fmt):
    df = spark.createDataFrame([("Any Opioids", 1), ("Heroin", 2), ("Heroin", 3)], "outcome string, id int")
    tables.write_by_outcome(df, str(tmp_path / "o"), fmt)
    folders = {p.name for p in (tmp_path / "o").iterdir() if p.is_dir()}
    assert {f.replace("%20", " ") for f in folders} == {"outcome=Any Opioids", "outcome=Heroin"}


def test_embedding_formats(spark, tmp_path, rows):
    (tmp_path / "v.txt").write_text("dose 1.0 2.0\n. . . 0.5 -1e-3\nbroken\n")
    text = tables.read_embeddings(spark, str(tmp_path / "v.txt"), 2)
    assert rows(text) == [(". . .", [0.5, -0.001]), ("dose", [1.0, 2.0])]
    (tmp_path / "c.csv").write_text("cui,V1,V2\nC01,1,2\n")
    assert rows(tables.read_embeddings(spark, str(tmp_path / "c.csv"), 2, "cui", "csv")) == [("C01", [1.0, 2.0])]
    text.write.parquet(str(tmp_path / "p"))
    assert rows(tables.read_embeddings(spark, str(tmp_path / "p"), 2, fmt="parquet")) == rows(text)
    with pytest.raises(ValueError):
        tables.read_embeddings(spark, str(tmp_path / "c.csv"), 3, "cui", "csv")


def test_stop_word_lists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("the\n of \n\nthe\n")
    assert {r["word"] for r in tables.stopword_df(spark, path=str(tmp_path / "w.txt")).collect()} == {"the", "of"}
    assert tables.stopword_df(spark).count() == 175
    assert set(tables.stopwords("english")) >= set(tables.stopwords("spark_english")) | {"cannot"}
    with pytest.raises(ValueError):
        tables.stopwords("klingon")


def test_spread_only_small_inputs_in_few_files(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "my data" / "one"))
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("my data/one", "many"))
    cores = spark.sparkContext.defaultParallelism
    assert tables.spread(one).rdd.getNumPartitions() == cores
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        assert tables.spread(many) is many
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        assert sorted(r.id for r in tables.spread(one).collect()) == list(range(100))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def fake_session(folder, master):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_shared_folder_is_the_one_the_cluster_names():
    assert session.shared_folder(fake_session("s3://bucket/x/", "yarn")) == "s3://bucket/x"
    with pytest.raises(RuntimeError):
        session.shared_folder(fake_session(None, "yarn"))
    local = fake_session(None, "local[2]")
    assert session.shared_folder(local) == session.shared_folder(local)


def test_settle_keeps_rows_and_types(spark):
    df = spark.range(3).withColumn("v", F.array(F.col("id")))
    stored = session.settle(df, "x")
    assert stored.dtypes == df.dtypes and stored.count() == 3


def test_stream_equals_batch(spark, tmp_path, rows):
    data = [(str(i), "fentanyl and alcohol" if i % 3 else "nothing") for i in range(30)]
    df = spark.createDataFrame(data, "id string, text string")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = scoring.stream_records(spark, str(tmp_path / "in"), df.schema, files_per_trigger=2)
    run = scoring.score_stream(
        stream, lambda batch: recode.tag_keywords(batch, "text"), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    run.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).drop("batch")) == rows(recode.tag_keywords(df, "text"))
    assert scoring.tag_stream(stream).isStreaming
