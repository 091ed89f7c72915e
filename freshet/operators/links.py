"""Links of landed pages: references made absolute, and documents found for each group of pages.

Everything is a column expression on the JVM; the second hop, from a page that is named to the documents on it, is a
join on the page's url.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A url or a reference: scheme, authority, path, query and fragment.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
ANCHOR = r"(?is)<a\s([^>]*)>(.*?)</a\s*>"
HREF = r"""(?is)(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
# Words that name a list of camps or a plan in a link's title, and those that name a list of camps.
KEYWORDS = r"(?i)\b(relief\s*camps?|pre[\s-]*identified\s+relief|flood\s+contingency|district\s+disaster\s+management\s+plan|ddmp)\b"
CAMP_LIST = r"(?i)relief\s*camps?|pre[\s-]*identified"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def without_dots(path: Column) -> Column:
    """A path without its `.` and `..` segments; `..` at the root stays at the root, and a path that ends in one of them
    ends in a slash."""
    segments = F.split(path, "/", -1)
    none = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.least(F.size(acc), F.lit(1))))).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(segments, none, step)
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(tail, "/")


def resolve(base: Column, ref: Column) -> Column:
    """The reference as an absolute url, seen from the page at base; null where either is null.

    A reference with a scheme or a host of its own keeps its path as it is written. One without a path stays on the
    page, with the page's query unless it has its own. Blanks around a reference do not count; its fragment is kept."""
    ref = F.trim(F.regexp_replace(ref, r"[\t\r\n]", ""))
    scheme, host, path, query, fragment = (_part(ref, n) for n in range(1, 6))
    head = F.concat(_part(base, 1), F.lit(":"))
    root = F.concat(head, _part(base, 2))
    old = F.when(_part(base, 3) == "", "/").otherwise(_part(base, 3))
    beside = F.concat(F.regexp_replace(old, "[^/]*$", ""), path)
    return (
        F.when(scheme != "", ref).when(host != "", F.concat(head, ref))
        .when(path == "", F.concat(root, _part(base, 3), F.when(query == "", _part(base, 4)).otherwise(query), fragment))
        .otherwise(F.concat(root, without_dots(F.when(path.startswith("/"), path).otherwise(beside)), query, fragment))
    )


def host_of(url: Column) -> Column:
    """The host, lower case, without user and port; empty where the url has none."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), r"^//([^@]*@)?", ""), r":\d*$", ""))


def allowed(url: Column, hosts: list[str]) -> Column:
    """Is the url's host one of hosts or below one?"""
    host = host_of(url)
    return reduce(lambda a, b: a | b, [(host == h) | host.endswith("." + h) for h in hosts], F.lit(False))


def is_pdf(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[^?]*", 0).endswith(".pdf")


def links(pages: DataFrame, *cols: str) -> DataFrame:
    """(cols, base, href, title, url) of every anchor with a reference, in pages(url, html): the title is its text
    without tags, blanks folded. Pages with null html or url have none. Equal anchors stay apart."""
    a = pages.where("url is not null").select(*cols, F.col("url").alias("base"), F.explode(F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("text"))).alias("a"))
    href = F.concat(*[F.regexp_extract("a.tag", HREF, n) for n in (1, 2, 3)])
    plain = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")], F.regexp_replace("a.text", "<[^>]*>", ""))
    title = F.trim(F.regexp_replace(plain, r"\s+", " "))
    got = a.select(*cols, "base", F.replace(href, F.lit("&amp;"), F.lit("&")).alias("href"), title.alias("title")).where("href <> ''")
    return got.withColumn("url", resolve(F.col("base"), F.col("href")))


def documents(pages: DataFrame, group: str, hosts: list[str], keywords: str = KEYWORDS, camp_list: str = CAMP_LIST) -> DataFrame:
    """(group, url, title, document_type): documents of each group, one row per url.

    A link counts if its title holds a keyword and its host is allowed. If it leads to a PDF, that is a document; else
    the PDFs, on allowed hosts, of the landed page that it leads to are, under its title (their own, where it has
    none). Of several titles of one url the first by code point stands. A fragment does not make another page."""
    found = links(pages, group).where(allowed(F.col("url"), hosts))
    named = found.where(F.col("title").rlike(keywords)).select(group, "url", "title")
    pdf = found.where(is_pdf(F.col("url"))).select(F.col("base").alias("page"), F.col("url").alias("_to"), F.col("title").alias("_own")).distinct()
    hops = named.where(~is_pdf(F.col("url"))).select(group, F.regexp_replace("url", "#.*$", "").alias("page"), "title").distinct()
    second = hops.join(pdf, "page").select(group, F.col("_to").alias("url"), F.when(F.col("title") == "", F.col("_own")).otherwise(F.col("title")).alias("title"))
    both = named.where(is_pdf(F.col("url"))).unionByName(second)
    one = both.groupBy(group, "url").agg(F.min("title").alias("title"))
    return one.withColumn("document_type", F.when(F.col("title").rlike(camp_list), "dedicated_camp_list").otherwise("contingency_plan"))


def group_status(pages: DataFrame, docs: DataFrame, group: str) -> DataFrame:
    """(group, pages, landed, documents, status): every group of pages; found, or no_candidate_found. A page without html
    did not land."""
    n = docs.groupBy(group).agg(F.count("*").alias("documents"))
    g = pages.groupBy(group).agg(F.count("*").alias("pages"), F.count("html").alias("landed")).join(n, group, "left")
    return g.select(group, "pages", "landed", F.coalesce("documents", F.lit(0)).alias("documents"), F.when(F.col("documents") > 0, "found").otherwise("no_candidate_found").alias("status"))
