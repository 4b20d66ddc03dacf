import base64
import hashlib

from tests.llm.fixtures import with_clashes
from textlabel.llm import queries, url_filter, warc
from textlabel.session import new_table_path

PAGES = [
    (1, "http://A.example.org/es/1?q", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "no scheme", ""), (4, "x://h/\r\nEvil: 1", None),
    (5, "http://a.example.com/de/", "<p>é</p>"), (6, "http://b.com/fr/x", "x" * 300_000), (7, "http://b.com/fr/x", "x" * 300_000),
    (None, "http://n/", "y"), (8, "http://c.net", "Content-Length: 5\r\n\r\nWARC/1.1"),
]


def pages(spark, rows=PAGES):
    return with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))


def brute(rows, least):
    out = {}
    for key, _, html in rows:
        body = (html or "").encode()
        ids = [k for k, _, h in rows if (h or "").encode() == body and k is not None]
        revisit = key is not None and len(body) >= least and key < max(ids)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out[key] = (len(body), digest, "revisit" if revisit else "response", max(ids) if revisit else None, body)
    return out


def test_archive_round_trip(spark):
    for least in (0, 5):
        path = new_table_path(spark, "warc")
        warc.write_archive(pages(spark), path, min_revisit_bytes=least)
        want = brute(PAGES, least)
        rows = warc.read_archive(spark, path).collect()
        assert len(rows) == len(PAGES)
        for r in rows:
            size, digest, kind, refers, body = want[r.id]
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) == (size, digest, kind, refers, body)
            assert r.intact
            head, _, block = bytes(r.record).partition(b"\r\n\r\n")
            assert block == (b"" if kind == "revisit" else body) + b"\r\n\r\n"
            assert f"Content-Length: {len(block) - 4}".encode() in head and b"Evil" not in [x.split(b":")[0] for x in head.split(b"\r\n")]
        assert spark.read.parquet(f"{path}/payloads").count() == len({w[4] for w in want.values()})


def test_damaged_payload_is_told(spark):
    from pyspark.sql import functions as F

    path, bad = new_table_path(spark, "warc"), new_table_path(spark, "warc")
    warc.write_archive(pages(spark), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit("!").cast("binary"))).write.parquet(f"{bad}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    assert not any(r.intact for r in warc.read_archive(spark, bad).collect())


def test_empty_archive(spark):
    path = new_table_path(spark, "warc")
    warc.write_archive(pages(spark).filter("false"), path)
    assert warc.read_archive(spark, path).collect() == []


def test_rules(spark):
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages(spark), none, queries.URL_RULES).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == got[3] == ("", "", None, "allow")
    assert got[5] == ("a.example.com", "/de/", "com/de/", "block")
    assert got[6] == got[7] == ("b.com", "/fr/x", "com/fr/", "allow")
    assert got[8] == ("c.net", "", None, "allow") and len(got) == 9
    more = [(1, "http://example.org", ""), (2, "q://myexample.org/es/", ""), (3, "q://U:1@x.org:80/a", ""), (4, "a://b://c/d", ""), (5, "http://example.org/en/12", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages(spark, more), none, queries.URL_RULES).collect()}
    assert got[1] == ("example.org", "", None, "allow")
    assert got[2] == ("myexample.org", "/es/", "org/", "allow")
    assert got[3] == ("u:1@x.org:80", "/a", None, "allow")
    assert got[4] == ("b:", "//c/d", None, "allow")
    assert got[5] == ("example.org", "/en/12", "example.org/en/1", "block")


def test_reputation_shrinks_and_blocks(spark):
    rows, marks = [], []
    for host, good, bad in [("a.good.com", 400, 4), ("b.good.com", 2, 1), ("x.spam.net", 3, 300), ("y.spam.net", 0, 2), ("lone.org", 0, 1)]:
        for i in range(good + bad):
            rows.append((len(rows), f"http://{host}/p", ""))
            marks.append((len(rows) - 1, int(i >= good)))
    rows += [(len(rows), "http://never.seen.com/", ""), (len(rows) + 1, "http://new.spam.net/", ""), (len(rows) + 2, "http://new.good.com/", "")]
    out = url_filter.judge(pages(spark, rows), spark.createDataFrame([*marks, (0, None)], "page_id long, bad int"))
    got = {r.host: r for r in out.collect()}
    assert got["x.spam.net"].verdict == "block" and got["a.good.com"].verdict == "allow"
    assert got["lone.org"].verdict == "allow" and got["lone.org"].reputation < 1  # one page proves little
    assert got["y.spam.net"].reputation > got["lone.org"].reputation  # its domain speaks against it
    assert 1 / 3 > got["b.good.com"].reputation  # drawn towards its domain
    # Hosts without a label get the prior of their domain, and where that has none, of their suffix.
    assert got["new.good.com"].reputation <= got["never.seen.com"].reputation < got["new.spam.net"].reputation
    assert got["new.spam.net"].reputation > 0.8 and got["new.good.com"].verdict == got["never.seen.com"].verdict == "allow"
    unlabelled = url_filter.judge(pages(spark, rows), spark.createDataFrame([], "page_id long, bad int"))
    assert {r.verdict for r in unlabelled.collect()} == {"allow"}
    assert url_filter.judge(pages(spark).filter("false"), spark.createDataFrame([], "page_id long, bad int")).collect() == []


def test_a_url_cannot_forge_headers(spark, tmp_path):
    """Line separators beyond CR and LF are part of the url."""
    rows = []
    for i, mark in enumerate(["\u2028", "\u2029", "\u0085", "\r\n", "\n", "\r"]):
        rows.append((i, f"http://a/{mark}WARC-Refers-To: <urn:record:77>{mark}X-Payload-Length: 5{mark}WARC-Type: revisit", f"page {i}"))
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "forged"))
    back = {r.id: r for r in warc.read_archive(spark, str(tmp_path / "forged")).collect()}
    for i, url, html in rows:
        r = back[i]
        assert (r.record_type, r.refers_to, r.payload_bytes, r.intact) == ("response", None, len(html), True)
        assert r.url == url.replace("\r", "").replace("\n", "")
