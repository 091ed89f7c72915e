"""References against the standard library's resolution, and the two hops to documents."""

from urllib.parse import urljoin

import pytest
from freshet.operators import links as k
from pyspark.sql import functions as F

BASES = ["http://a.org/b/c/d?q=1", "https://A.org:8080", "http://a.org/", "http://u@a.org/b/c/"]
REFS = ["g", "./g", "g/", "/g", "//h.net/x/../y", "?y", "g?y", "#s", "g#s", "g?y#s", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g/./h", "g/../h", "http://z.org/a/../b", "mailto:x@y.org", "g;x=1/../y", "/a/b/../../c.pdf?x=/../y", " g ", "x:y"]


def test_references_resolve_as_in_the_standard_library(spark):
    rows = [(b, r) for b in BASES for r in REFS]
    got = spark.createDataFrame(rows, "base string, ref string").withColumn("url", k.resolve(F.col("base"), F.col("ref"))).collect()
    bad = [(r.base, r.ref, r.url, urljoin(r.base, r.ref.strip())) for r in got if r.url != urljoin(r.base, r.ref.strip())]
    assert not bad
    nulls = spark.createDataFrame([(None, "g"), ("http://a.org/", None)], "base string, ref string")
    assert [r[0] for r in nulls.select(k.resolve(F.col("base"), F.col("ref"))).collect()] == [None, None]


@pytest.mark.parametrize(("url", "host", "ok"), [("http://X.gov.org/a", "x.gov.org", True), ("https://u:p@gov.org:81?x", "gov.org", True), ("http://notgov.org/gov.org", "notgov.org", False), ("mailto:a@gov.org", "", False)])
def test_hosts(spark, url, host, ok):
    r = spark.createDataFrame([(url,)], "u string").select(k.host_of(F.col("u")), k.allowed(F.col("u"), ["gov.org"])).first()
    assert (r[0], r[1]) == (host, ok)


def test_documents_by_one_and_two_hops(spark):
    pages = spark.createDataFrame([
        ("d1", "https://d1.gov.org/list/", '<A class=x HREF="../f/Camps.PDF?v=1"><b>Relief\n camps</b> 2024</a> <a href=\'plan#top\'>DDMP &amp; more</a><a href=/x.pdf>Other</a>'),
        ("d1", "https://d1.gov.org/list/plan", '<a href="a.pdf">Annex</a><a href="http://elsewhere.net/b.pdf">b</a><a href="notes.html">n</a><a>none</a>'),
        ("d2", "https://d2.gov.org/", '<a href="http://elsewhere.net/c.pdf">relief camp</a>'),
        ("d3", "https://d3.gov.org/", None), ("d4", None, '<a href="a.pdf">DDMP</a>'), ("d4", "https://d4.gov.org/", ""),
    ], "slug string, url string, html string")
    docs = k.documents(pages, "slug", ["gov.org"])
    assert sorted(tuple(r) for r in docs.collect()) == [
        ("d1", "https://d1.gov.org/f/Camps.PDF?v=1", "Relief camps 2024", "dedicated_camp_list"), ("d1", "https://d1.gov.org/list/a.pdf", "DDMP & more", "contingency_plan"),
    ]
    assert sorted(tuple(r) for r in k.group_status(pages, docs, "slug").collect()) == [
        ("d1", 2, 2, 2, "found"), ("d2", 1, 1, 0, "no_candidate_found"), ("d3", 1, 0, 0, "no_candidate_found"), ("d4", 2, 2, 0, "no_candidate_found"),
    ]
    assert k.documents(pages.limit(0), "slug", ["gov.org"]).count() == 0
