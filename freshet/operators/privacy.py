"""Personal data in nested JSON: every field path of a payload is looked at, of any shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.shared import once

# Field names that are personal data whatever they hold.
PII_KEYS = (
    "name", "full_name", "first_name", "last_name", "phone", "phone_number", "mobile", "email", "email_address", "imei", "imsi",
    "device_token", "device_id", "device_imei", "user_id", "username", "account", "password", "token", "secret", "aadhaar", "aadhar",
    "pan", "voter_id", "address", "street_address", "house", "house_number", "ip", "ip_address",
)
# Identifiers made by machines, whose digits can look like a phone number.
UNSCANNED_KEYS = (
    "reportid", "hwmid", "devicehash", "reporterhash", "sourcerevision", "sourcesha256", "artifactid", "schemaversion", "localityid",
    "gaugeid", "revisionid",
)
#: One character on either side is enough to know that an address or a number is there.
EMAIL = r"[^\s@]@[^\s@]+\.[^\s@]"
PHONE = r"(^|[^0-9])[6-9][0-9]{9}([^0-9]|$)"


def plain_key(key: Column) -> Column:
    return F.lower(F.regexp_replace(key, "[-_]", ""))


def nesting(text: Column) -> Column:
    """Depth of brackets outside strings. Escapes go first, so that a string is all up to the next quote."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '"[^"]*+"', "")
    steps = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def move(seen: Column, c: Column) -> Column:
        now = seen["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(seen["most"], now).alias("most"))

    return F.aggregate(steps, start, move)["most"]


def _children(path: Column, key: Column, v: Column) -> Column:
    """Members of an object or elements of an array with their paths; null for anything else. An element keeps the key
    of its array."""
    fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(
        F.concat(path, F.lit("."), e["key"]).alias("path"), e["key"].alias("key"), e["value"].alias("v"), F.lit(True).alias("named")))
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.struct(
        F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), key.alias("key"), x.alias("v"), F.lit(False).alias("named")))
    return F.coalesce(fields, items)


def findings(
    payloads: DataFrame, id_col: str, json_col: str, banned: Column | None = None, keys: tuple[str, ...] = PII_KEYS,
    unscanned: tuple[str, ...] = UNSCANNED_KEYS, levels: int | None = None, deepest: int = 32,
) -> DataFrame:
    """(id, path, kind) of all personal data in JSON payloads.

    kind: `field` (the key names personal data, even if it holds nothing), `email`, `phone` (in any text whose key is not
    exempt), `banned` (a text or number equal to one in `banned`, an array<string> column of the row, numbers compared as
    doubles; booleans never match), `unreadable` (null, no JSON, or a key twice in an object) and `deep` (nested beyond
    `deepest`: refused, not searched). Keys are compared without case, `-` and `_`, on both sides. Digits and blanks of
    the patterns are ASCII.

    The tree is opened level by level in one narrow stage, each level an explode; `levels` is measured over all
    payloads if not given. A payload given twice is reported once."""
    text = F.col(json_col)
    base = payloads.select(F.col(id_col).alias("id"), (F.lit(None).cast("array<string>") if banned is None else banned).alias("banned"), text.alias("text"))
    base = once(base, v=F.try_parse_json(F.col("text")), depth=nesting(F.col("text"))).drop("text")
    if levels is None:
        levels = base.where((F.col("depth") <= deepest) & F.col("v").isNotNull()).agg(F.max("depth")).first()[0] or 0
    too_deep = F.col("depth") > min(levels, deepest)
    whole = base.where(F.col("v").isNull() | too_deep).select("id", F.lit("$").alias("path"), F.when(F.col("v").isNull(), "unreadable").otherwise("deep").alias("kind"))

    private = [k.replace("_", "").lower() for k in keys]
    nodes = base.where(F.col("v").isNotNull() & ~too_deep).select("id", "banned", F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), "v", F.lit(None).cast("array<string>").alias("hits"))
    for _ in range(min(levels, deepest)):
        opened = nodes.withColumn("child", F.explode_outer(_children(F.col("path"), F.col("key"), F.col("v"))))
        some = F.col("child").isNotNull()
        hit = some & F.col("child.named") & plain_key(F.col("child.key")).isin(private)
        old = F.coalesce("hits", F.array().cast("array<string>"))
        nodes = opened.select(
            "id", "banned", F.when(some, F.col("child.path")).otherwise(F.col("path")).alias("path"), F.when(some, F.col("child.key")).otherwise(F.col("key")).alias("key"),
            F.when(some, F.col("child.v")).otherwise(F.col("v")).alias("v"), F.when(hit, F.array_append(old, F.col("child.path"))).otherwise(F.col("hits")).alias("hits"),
        )

    kind = F.schema_of_variant("v")
    string = F.when(kind == "STRING", F.try_variant_get("v", "$", "string"))
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("v", "$", "double"))
    scanned = F.coalesce(~plain_key(F.col("key")).isin(*unscanned), F.lit(True))
    leaf = nodes.withColumns({"string": string, "number": number})
    same = F.coalesce(F.array_contains("banned", F.col("string")), F.lit(False)) | F.coalesce(F.exists("banned", lambda b: b.try_cast("double") == F.col("number")), F.lit(False))
    seen = F.array_compact(F.array(
        F.when(scanned & F.col("string").rlike(EMAIL), F.struct("path", F.lit("email").alias("kind"))),
        F.when(scanned & F.col("string").rlike(PHONE), F.struct("path", F.lit("phone").alias("kind"))),
        F.when(same, F.struct("path", F.lit("banned").alias("kind"))),
    ))
    named = F.transform(F.coalesce("hits", F.array().cast("array<string>")), lambda p: F.struct(p.alias("path"), F.lit("field").alias("kind")))
    found = leaf.select("id", F.explode(F.concat(named, seen)).alias("f")).select("id", "f.path", "f.kind")
    return found.unionByName(whole).distinct()


def split(payloads: DataFrame, id_col: str, found: DataFrame) -> DataFrame:
    """payloads with `refused` and its reasons, `kind path`, in order; one finding refuses a whole payload."""
    why = found.groupBy(F.col("id").alias(id_col)).agg(F.array_sort(F.collect_set(F.concat_ws(" ", "kind", "path"))).alias("reasons"))
    return payloads.join(why, id_col, "left").withColumn("refused", F.col("reasons").isNotNull())
