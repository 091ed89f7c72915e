import duckdb
import pytest
from freshet.llm import urlfilter, warc
from freshet.llm.url_queries import ORACLES, RULES
from freshet.llm.warc_queries import op9_warc_captures

URLS = [
    "https://a.example.org/es/x", "http://EXAMPLE.org/es/", "http://example.org/es", "https://x.org/en/1", "https://example.org/en/12?q=/es/", "http://badexample.org/es/1",
    "http://a.com/fr/1", "http://a.com/de/", "http://a.com/de", "http://com/fr/", "ftp://a.com#/fr/", "no scheme/org/", None, "", "http://", "http://org", "http://org/", "x://a..org/\n/es/",
    "http://example.org:80/es/", "http://example.org/en/1/es/",
]


@pytest.mark.parametrize("most", [100, 0])
def test_url_verdicts_equal_sql(spark, most):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [r[:2] for r in rows])
    want = sorted(con.execute(ORACLES["op2_url_filter"]).fetchall())
    got = urlfilter.judge(pages, rules, most_broadcast=most).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(tuple, got.collect())) == want
    assert urlfilter.judge(pages.limit(0), rules).collect() == []
    none = urlfilter.judge(pages, rules.limit(0), default="block", most_broadcast=most)
    assert {r["verdict"] for r in none.collect()} == {"block"}


@pytest.mark.parametrize("most", [100, 0])
def test_longest_match_and_precedence(spark, most):
    rules = [("org", "/a/b", "block"), ("x.org", "/", "allow"), ("x.org", "/a/", "block"), ("x.org", "/a/", "allow"), ("y.org", "", "block"), (None, "/", "block"), ("z.org", "/q/" * 30, "allow")]
    urls = [("http://x.org/a/b", "x.org/a/", "block"), ("http://x.org/b", "x.org/", "allow"), ("http://q.org/a/bc", "org/a/b", "block"), ("http://y.org", "y.org", "block"), ("http://w.org/a/", None, "allow")]
    df = spark.createDataFrame([(u,) for u, _, _ in urls] * 2, "url string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {(x["url"], x["rule"], x["verdict"]) for x in urlfilter.judge(df, r, most_broadcast=most).collect()}
    assert got == set(urls)


def pages(spark):
    rows = [(1, "http://a/\r\nWARC/1.1", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (2, "http://b/", "x\ny\r\n\r\n"), (3, None, "x\ny\r\n\r\n"), (4, "http://c/", None), (5, "", ""), (6, "http://d/", "héé" * 50_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write(pages(spark), path, per_file=2)
    got = warc.captures(warc.read_records(spark, path)).collect()
    assert len(got) == 6 and all(r["request"] and r["metadata"] for r in got)
    by = {int(bytes(r["metadata"]["payload"]).split(b":")[1]): r["response"] for r in got}
    texts = {r["page_id"]: r["html"] or "" for r in pages(spark).collect()}
    assert {i: r["record_type"] for i, r in by.items()} == {1: "response", 2: "response", 3: "revisit", 4: "response", 5: "revisit", 6: "response"}
    assert all(bytes(r["payload"]).decode() == texts[i] for i, r in by.items() if r["record_type"] == "response")


def test_captures_of_odd_pages(spark, tmp_path):
    d = str(tmp_path)
    pages(spark).unionByName(spark.createDataFrame([(2, "http://b/", "x\ny\r\n\r\n"), (None, "u", "n"), (None, "u", "n"), (9, "u", "n")], "page_id long, url string, html string")).write.parquet(f"{d}/pages.parquet")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in op9_warc_captures(spark, d).collect())
    assert got == sorted([("1", 33, "response", None), ("2", 7, "response", None), ("2", 7, "revisit", 2), ("3", 7, "revisit", 2), ("4", 0, "response", None), ("5", 0, "revisit", 4), ("6", 250_000, "response", None), ("9", 1, "response", None), ("None", 1, "revisit", 9), ("None", 1, "revisit", 9)])


def test_empty_archive(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write(pages(spark).limit(0), path)
    assert warc.captures(warc.read_records(spark, path)).collect() == []


def test_captures_of_foreign_archives(spark):
    rows = [
        ("a", "response", []), ("a1", "request", ["a"]), ("a2", "metadata", ["a", "a1"]), ("a3", "metadata", ["a"]), ("a4", "request", ["x", "a"]),
        ("b", "response", ["b1", "b2"]), ("b1", "request", []), ("b2", "metadata", []),
        ("c", "revisit", None), ("c1", "request", ["c"]), ("c2", "metadata", ["c1"]), ("c3", "metadata", ["c2"]),
        ("d1", "request", []), ("e2", "metadata", ["e1"]), ("e1", "request", None), ("g1", "metadata", ["gone"]), ("g2", "request", ["gone"]),
        (None, "request", ["b"]), (None, "metadata", []), ("w", "warcinfo", ["a"]), ("z", "response", ["z"]),
    ]
    df = spark.createDataFrame([(i, t, n, f"{i}{t}".encode()) for i, t, n in rows], "record_id string, record_type string, concurrent_to array<string>, payload binary")
    got = {}
    for r in warc.captures(df).collect():
        of = lambda x: x and x["record_id"]
        got[r["capture_id"][:6]] = (of(r["response"]), of(r["request"]), of(r["metadata"]), sorted(str(of(x)) for x in r["more"]))
    assert got == {
        "a": ("a", "a1", "a2", ["a3", "a4"]), "b": ("b", None, "b2", ["b1"]), "c": ("c", "c1", "c2", ["c3"]), "d1": (None, "d1", None, []), "e1": (None, "e1", "e2", []),
        "g1": (None, "g2", "g1", []), "no id ": (None, None, None, []), "z": ("z", None, None, []),
    }
    assert warc.captures(df.limit(0)).collect() == []
    assert warc.captures(df.where("record_id = 'a1'")).select("capture_id", "request.record_id").collect() == [("a", "a1")]


def test_every_concurrent_header_is_read(spark, tmp_path):
    import gzip

    text = "WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <m>\r\nWARC-Concurrent-To: <r>\r\nwarc-concurrent-to: <q>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(text.encode()) * 2)
    got = warc.read_records(spark, f"file://{tmp_path}").collect()
    assert [(r["concurrent_to"], bytes(r["payload"])) for r in got] == [(["<r>", "<q>"], b"hi")] * 2
