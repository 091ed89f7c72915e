"""WARC archives of crawled pages: writing, reading back, and assembling the records of each capture.

A capture is written as three records: a response (or a revisit of an earlier equal payload), the request, and
metadata; request and metadata name the response in WARC-Concurrent-To. Reading joins them again through those
identifiers. Archives are written by Spark's text writer, compressed, at most a given number of captures each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm.components import components

_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DATE = "2024-01-01T00:00:00Z"
_NL = "\r\n"


def base32_sha1(payload: F.Column) -> F.Column:
    """Bare upper-case base32 of SHA-1: five hex digits make four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def _urn(*parts: F.Column) -> F.Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: F.Column, rid: F.Column, target: F.Column, content_type: str, block: F.Column, *more: F.Column) -> F.Column:
    """One record as text, without the last line break (the writer adds it)."""
    head = [F.lit(f"WARC/1.1{_NL}WARC-Type: "), kind, F.lit(f"{_NL}WARC-Record-ID: "), rid, F.lit(f"{_NL}WARC-Date: {_DATE}{_NL}"),
            F.when(target == "", F.lit("")).otherwise(F.concat(F.lit("WARC-Target-URI: "), target, F.lit(_NL)))]
    tail = [F.lit(f"Content-Type: {content_type}{_NL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(_NL * 2), block, F.lit(_NL)]
    return F.concat(*head, *more, *tail)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with payload, payload_bytes, digest, first_id and copy.

    Equal payloads of at least least_bytes share first_id, the smallest page_id (nulls last). Rows with the same
    id and payload are numbered by copy (only if there are any, which costs a shuffle), and copy 1 of first_id is
    the response. The minimum is pre-aggregated per task, so many equal payloads do not meet in one; the join
    back can be split where one digest is hot.
    """
    payload = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    same = p.groupBy("digest", "payload_bytes", "page_id").agg(F.count("*").alias("rows"))
    first = same.groupBy("digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.sum("rows").alias("rows")).where("rows > 1").drop("rows")
    p = p.join(first.withColumn("shared", F.lit(True)), ["digest", "payload_bytes"], "left")
    p = p.withColumn("first_id", F.when(F.col("shared"), F.col("first_id")).otherwise(F.col("page_id")))
    repeated = not same.where("rows > 1").isEmpty()
    copy = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")) if repeated else F.lit(1)
    alone = F.col("payload_bytes") < least_bytes
    return p.withColumn("copy", copy).withColumn("revisit", ~alone & ((F.col("copy") > 1) | ~F.col("page_id").eqNullSafe(F.col("first_id"))))


def write(pages: DataFrame, path: str, least_bytes: int = 0, per_file: int = 20_000) -> None:
    """Write archives of pages(page_id, url, html) to a new folder.

    Null html is an empty payload, a null url no target; line breaks in a url are percent-encoded. Null page_ids
    and repeated rows are captures of their own. An empty table writes a folder without records."""
    p = with_revisits(pages, least_bytes)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    rid = _urn(F.lit("response"), page, F.col("digest"), F.col("copy").cast("string"))
    refers = _urn(F.lit("response"), F.coalesce(F.col("first_id").cast("string"), F.lit("")), F.col("digest"), F.lit("1"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_NL}Content-Type: text/html; charset=utf-8{_NL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_NL * 2))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(_NL))
    profile = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_NL}WARC-Refers-To: "
    main = _record(
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), rid, uri, "application/http;msgtype=response",
        F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload"))), digest, F.when(F.col("revisit"), F.concat(F.lit(profile), refers, F.lit(_NL))).otherwise(F.lit("")),
    )
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), rid, F.lit(_NL))
    request = _record(F.lit("request"), _urn(F.lit("request"), rid), uri, "application/http;msgtype=request", F.concat(F.lit("GET "), F.when(uri == "", F.lit("/")).otherwise(uri), F.lit(f" HTTP/1.1{_NL * 2}")), concurrent)
    meta = _record(F.lit("metadata"), _urn(F.lit("metadata"), rid), uri, "application/warc-fields", F.concat(F.lit("page-id: "), page, F.lit(_NL)), concurrent)
    records = p.select(F.explode(F.array(main, request, meta)).alias("value"))
    records.write.option("lineSep", _NL).option("compression", "gzip").option("maxRecordsPerFile", 3 * per_file).text(path)


_RECORD = "record_id string, record_type string, target_uri string, concurrent_to array<string>, refers_to string, payload_digest string, content_type string, http_head string, payload binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. Blocks are cut by Content-Length, so payloads may hold anything, also record heads.
    The block of an HTTP record is split into http_head and payload; of others it is all payload. concurrent_to holds every
    WARC-Concurrent-To of the record, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import io

        schema = pa.schema([(n, {"concurrent_to": pa.list_(pa.string()), "payload": pa.binary()}.get(n, pa.string())) for n in _NAMES])
        for batch in batches:
            for content in batch.column(0):
                with gzip.open(io.BytesIO(content.as_py())) as f:
                    held, size = [], 0
                    for record in _records(f):
                        held.append(record)
                        size += len(record["payload"])
                        if size > 4 << 20 or len(held) >= 2000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, _RECORD)


_NAMES = [part.split()[0] for part in _RECORD.split(", ")]
_HEADERS = {"warc-record-id": "record_id", "warc-type": "record_type", "warc-target-uri": "target_uri", "warc-refers-to": "refers_to", "warc-payload-digest": "payload_digest", "content-type": "content_type"}


def _records(f) -> Iterator[dict]:
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:60]!r}")
            continue
        row, length = dict.fromkeys(_NAMES) | {"concurrent_to": []}, 0
        while (line := f.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8").partition(":")
            if name.lower() == "content-length":
                length = int(value)
            elif name.lower() == "warc-concurrent-to":
                row["concurrent_to"].append(value.strip())
            elif name.lower() in _HEADERS:
                row[_HEADERS[name.lower()]] = value.strip()
        block = f.read(length)
        if len(block) != length:
            raise ValueError("a record is shorter than its Content-Length")
        if (row["content_type"] or "").startswith("application/http"):
            head, _, block = block.partition(b"\r\n\r\n")
            row["http_head"] = head.decode("utf-8", "replace")
        row["payload"] = block
        yield row


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response struct, request struct, metadata struct, more array).

    The records of a capture name each other in WARC-Concurrent-To, in either direction and any number of times. A request
    or metadata record belongs to the response (or revisit) that it names or that names it, of several to the one with the
    smallest id; without one, to that of the records it is linked with over any number of steps; where no response is
    linked, these records make a capture with a null response, whose id is the smallest id among them and those they name.
    request and metadata are the first by record id, null if there is none; further ones are in more, so none is lost.
    Each response is a capture, repeated ones too. A record without an id is told by its content. Other types go.

    records is read several times: keep() it first where parsing is dear. Links are slim rows of ids; the records
    themselves are shuffled once, by capture. Chains are followed only if some record has no direct response.
    """
    main = F.col("record_type").isin("response", "revisit")
    r = records.where(main | F.col("record_type").isin("request", "metadata"))
    r = r.select(F.coalesce("record_id", F.format_string("no id %d", F.xxhash64(*records.columns))).alias("id"), main.alias("main"), "record_type", F.col("concurrent_to").alias("near"), F.struct(*[c for c in records.columns if c != "concurrent_to"]).alias("rec"))
    named = r.select("id", "main", F.explode("near").alias("to")).where("id <> to").distinct()
    mains = r.where("main").select(F.col("id").alias("to")).distinct()
    pairs = named.where("not main").join(mains, "to").select("id", F.col("to").alias("of")).unionByName(named.where("main").select(F.col("to").alias("id"), F.col("id").alias("of")))
    of = pairs.groupBy("id").agg(F.min("of").alias("of"))
    others = r.where("not main")
    if not others.join(of, "id", "left_anti").isEmpty():
        links = named.where("not main").join(mains, "to", "left_anti").select(F.col("id").alias("a"), F.col("to").alias("b"))
        parts = components(links).withColumnRenamed("node", "id")
        answered = parts.join(of, "id").groupBy("component").agg(F.min("of").alias("of"))
        chained = parts.join(of, "id", "left_anti").join(answered, "component", "left").select("id", F.coalesce("of", "component").alias("of"))
        of = of.unionByName(chained)
    beside = others.join(of, "id", "left").groupBy(F.coalesce("of", "id").alias("capture_id")).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("record_type") == kind, F.col("rec")))).alias(kind) for kind in ("request", "metadata")]
    )
    responses = r.where("main").select(F.col("id").alias("capture_id"), F.col("rec").alias("response"))
    none = F.array().cast(beside.schema["request"].dataType)
    rest = [F.when(F.size(kind) > 1, F.slice(kind, 2, F.size(kind))).otherwise(none) for kind in ("request", "metadata")]
    return responses.join(beside, "capture_id", "full").select("capture_id", "response", F.try_element_at("request", F.lit(1)).alias("request"), F.try_element_at("metadata", F.lit(1)).alias("metadata"), F.concat(*rest).alias("more"))
