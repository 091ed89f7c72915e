"""URL filters: allow and block entries in a trie over reversed host labels and path segments.

An entry is a host and a path, e.g. example.org and /es/. It fits its host and every subdomain, if the url's path
starts with the entry's path. Among the entries that fit, the one with the longest host wins, then the longest
path, then block before allow. The trie has one level per host label (from the top-level label down), then one per
full path segment; what stands after the entry's last slash is kept at the node as a prefix of the next segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.text import unused

#: Entries that are sent to the tasks as a trie at most; above, the same levels are matched by joins.
MOST_BROADCAST = 200_000

_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def _lower(text: F.Column) -> F.Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ://."""
    given = F.coalesce(url, F.lit(""))
    return _lower(F.regexp_extract(given, _HOST, 1)), F.regexp_extract(given, _PATH, 1)


class Trie:
    """Nested dicts; the keys None and "" hold a node's path level and its entries by segment prefix."""

    def __init__(self, entries: list[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in entries:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *full, last = path.split("/")
            for segment in full:
                node = node.setdefault(("s", segment), {})
            ends = node.setdefault("", {})
            if ends.get(last, ("", "allow"))[1] != "block":
                ends[last] = (f"{host}{path}", verdict)

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(entry, verdict) of the winner, or two nulls."""
        nodes, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            nodes.append(node)
        segments = path.split("/")
        for node in reversed(nodes):
            level, best = node.get(None), None
            for segment in segments:
                if level is None:
                    break
                ends = level.get("")
                if ends:
                    found = max((p for p in ends if segment.startswith(p)), key=len, default=None) if len(ends) <= len(segment) else next((segment[:n] for n in range(len(segment), -1, -1) if segment[:n] in ends), None)
                    best = ends[found] if found is not None else best
                level = level.get(("s", segment))
            if best:
                return best
        return None, None


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """urls with host, path, rule (the winner's host and path, else null) and verdict (the rule's, else default).

    rules(host, path, verdict): A-Z of hosts are lower-cased, as of urls; a null path is an empty one; rules with a null or empty
    host or another verdict than allow and block are left out. Equal entries count once, block before allow.
    A null url, or one without ://, has empty host and path and the default verdict. Columns of urls called host,
    path, rule or verdict are replaced. Repeated rows are judged alike.
    """
    entries = rules.select(_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' and verdict in ('allow', 'block')")
    entries = entries.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    host, path = host_and_path(F.col(url_col))
    named = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    given = urls.select(*named, host.alias("host"), path.alias("path"))
    held = entries.limit(most_broadcast + 1).collect()
    if len(held) > most_broadcast:
        return _joined(given, entries, named, default)
    shared = urls.sparkSession.sparkContext.broadcast([tuple(r) for r in held])

    @F.pandas_udf("rule string, verdict string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)
        for hosts, paths in batches:
            got = [trie.match(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": pd.Series([g[0] for g in got], dtype=object), "verdict": pd.Series([g[1] for g in got], dtype=object)})

    got = unused(urls.columns, "got")
    out = given.withColumn(got, run("host", "path"))
    return out.select(*named, "host", "path", F.col(f"{got}.rule").alias("rule"), F.coalesce(f"{got}.verdict", F.lit(default)).alias("verdict"))


def _joined(given: DataFrame, entries: DataFrame, named: list[str], default: str) -> DataFrame:
    """The same levels by equi-joins, for any number of entries: a url's host suffixes and leading full segments,
    as deep as the deepest entry, meet the entries of that trie node."""
    deep = entries.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.size(F.split("path", "/")))).first()
    cut = F.substring_index("path", "/", -1)
    at = entries.select(F.col("host").alias("_host"), F.expr("substr(path, 1, length(path) - length(substring_index(path, '/', -1)))").alias("_lead"), cut.alias("_last"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    distinct = given.select("host", "path").distinct()
    ways = distinct.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.lit(deep[0]), F.size(F.split("host", r"\."))))))
    ways = ways.withColumn("_host", F.expr("substring_index(host, '.', -_n)"))
    ways = ways.withColumn("_k", F.explode(F.sequence(F.lit(1), F.least(F.lit(deep[1]), F.size(F.split("path", "/"))))))
    ways = ways.withColumn("_lead", F.expr("array_join(slice(split(path, '/'), 1, _k - 1), '/') || if(_k > 1, '/', '')"))
    fits = ways.join(at, ["_host", "_lead"]).where(F.expr("startswith(substr(path, length(_lead) + 1), _last)"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("_host", "_path", "_verdict"), F.struct(F.length("_host"), F.length("_path"))).alias(won := unused(named, "won")))
    out = given.join(best, ["host", "path"], "left")
    return out.select(*named, "host", "path", F.concat(f"{won}._host", f"{won}._path").alias("rule"), F.coalesce(f"{won}._verdict", F.lit(default)).alias("verdict"))
