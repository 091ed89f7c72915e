"""Checks of situation bulletins, and what may be published after them.

A bulletin is one nested document. Every check gives pass, warn or fail and the paths it speaks of; the checks lead to
the state, the profile and the allowed fields. All of it is column expressions over the document's own row, so it is
one narrow stage after the scan."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.shared import once

# Fields of a bulletin, kinds of damage, published parts.
CORE_FIELDS = (
    "affected_districts", "affected_revenue_circles", "affected_villages", "affected_population", "crop_area_submerged_hectares", "relief_camps_open",
    "relief_distribution_centres_open", "relief_camp_occupants", "confirmed_deaths", "missing_people",
)
BREAKDOWN_FIELDS = ("livestock_affected", "livestock_washed_away", "houses_damaged", "houses_damaged_others", "rescue_operations", "relief_distributed")
INFRASTRUCTURE_TYPES = ("road", "bridge", "embankment_breached", "embankment_affected")
FULL_ALLOWED_FIELDS = ("state_summary", "districts", "revenue_circles", "infrastructure", "rescue", "relief")
COUNT_MISMATCH = "infrastructure_detail_count_mismatch"
COUNT_PROFILE = "impact-v1-infrastructure-count-only"

_COUNTS = "map<string,double>"
_REF = "array<struct<source_revision_sha256:string,report_date:string,extractor_version:int,page:int,table:int,row:int>>"
_METRICS = ",".join([f"{f}:double" for f in CORE_FIELDS[1:]] + [f"{f}:{_COUNTS}" for f in BREAKDOWN_FIELDS])
#: Breakdowns are maps of part to count, so parts may differ from bulletin to bulletin. A field that is absent and one
#: that is null are the same.
SCHEMA = (
    "revision_id string, artifact_id string, extractor_version int, report_date string, source struct<sha256:string,fetched_at:string,source_url:string>, affected_district_names array<string>, "
    f"summary struct<affected_districts:double,{_METRICS},infrastructure_incidents:{_COUNTS},infrastructure_records_extracted:{_COUNTS}>, "
    f"districts array<struct<district:string,{_METRICS}>>, "
    f"infrastructure array<struct<incident_type:string,coordinate_validation:string,longitude:double,latitude:double,match_scope:string,provenance:{_REF}>>, "
    f"relief_material_notes array<struct<note:string,provenance:{_REF}>>, field_provenance map<string,{_REF}>, "
    "extraction_warnings array<struct<code:string,incident_type:string,reported_count:double,extracted_record_count:double>>"
)
_IST = timezone(timedelta(hours=5, minutes=30))


def read(bulletins: DataFrame, json: str) -> DataFrame:
    """bulletins with `doc`, parsed by the pinned schema, and `unreadable`, true where the text is null or breaks it."""
    d = F.from_json(json, f"{SCHEMA}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return once(bulletins, doc=d).withColumn("unreadable", F.col("doc").isNull() | F.col("doc._broken").isNotNull())


def _listed(value: Column, kind: str = "string") -> Column:
    return F.coalesce(value, F.array().cast(f"array<{kind}>"))


def _paths(*found: tuple[Column, str]) -> Column:
    """The paths whose condition holds; a null condition does not."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(path)) for cond, path in found]))


def _equal(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= 1e-6, F.lit(False))


def _part(counts: Column, name: str, other: float | None = 0) -> Column:
    x = F.try_element_at(counts, F.lit(name))
    return x if other is None else F.coalesce(x, F.lit(float(other)))


def _has(counts: Column) -> Column:
    return F.coalesce(F.size(counts) > 0, F.lit(False))


def _indexed(items: Column, bad, path: str) -> Column:
    """`path[i]` of the items for which bad(item) holds."""
    marked = F.transform(items, lambda x, i: F.when(F.coalesce(bad(x), F.lit(False)), F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"))))
    return F.coalesce(F.array_compact(marked), F.array().cast("array<string>"))


def _negative(of: Column, at: Column) -> Column:
    """Paths of negative numbers among the metrics of a summary or district."""
    single = [F.when(of[f] < 0, F.concat(at, F.lit(f".{f}"))) for f in CORE_FIELDS[1:]]
    names = lambda f: F.transform(F.map_keys(F.map_filter(of[f], lambda _, v: v < 0)), lambda k: F.concat(at, F.lit(f".{f}."), k))
    return F.concat(F.array_compact(F.array(*single)), *[F.coalesce(names(f), F.array().cast("array<string>")) for f in BREAKDOWN_FIELDS])


def _identity(d: Column) -> Column:
    good = (d["source"]["sha256"] == d["revision_id"]) & (d["artifact_id"] == F.concat(d["revision_id"], F.lit("-extractor-v"), d["extractor_version"].cast("string")))
    return F.when(F.coalesce(good, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("revision_id"), F.lit("artifact_id"), F.lit("source.sha256")))


def _required(d: Column) -> Column:
    s = d["summary"]
    inner = [*CORE_FIELDS, *BREAKDOWN_FIELDS, "infrastructure_incidents", "infrastructure_records_extracted"]
    top = ["field_provenance", "relief_material_notes", "infrastructure", "extraction_warnings"]
    return _paths(*[(s[f].isNull(), f) for f in inner], *[(d[f].isNull(), f) for f in top])


def _non_negative(d: Column) -> Column:
    s, empty = d["summary"], F.array().cast("array<string>")
    inc = [F.coalesce(F.transform(F.map_keys(F.map_filter(s[f], lambda _, v: v < 0)), lambda k: F.concat(F.lit(f"summary.{f}."), k)), empty) for f in ("infrastructure_incidents", "infrastructure_records_extracted")]
    each = F.flatten(F.transform(d["districts"], lambda x, i: _negative(x, F.concat(F.lit("districts["), i.cast("string"), F.lit("]")))))
    return F.concat(_paths((s["affected_districts"] < 0, "summary.affected_districts")), _negative(s, F.lit("summary")), *inc, F.coalesce(each, empty))


def _components(d: Column) -> Column:
    s = d["summary"]
    out = []
    for f in ("livestock_affected", "livestock_washed_away"):
        parts = _part(s[f], "big_animals") + _part(s[f], "small_animals") + _part(s[f], "poultry")
        out.append((_has(s[f]) & ~_equal(_part(s[f], "total", -1), parts), f"summary.{f}"))
    h, o = s["houses_damaged"], s["houses_damaged_others"]
    for kind in ("fully", "partially"):
        parts = _part(h, f"{kind}_kutcha") + _part(h, f"{kind}_pucca")
        out.append((_has(h) & ~_equal(_part(h, f"{kind}_total", -1), parts), f"summary.houses_damaged.{kind}_total"))
    out.append((_has(o) & ~_equal(_part(o, "other_total", -1), _part(o, "other_huts") + _part(o, "cattle_sheds")), "summary.houses_damaged_others.other_total"))
    return _paths(*out)


def _affected_rows(d: Column) -> Column:
    """The detail of every affected district, null where there is none; of a district that is there twice the last."""
    return F.transform(F.array_distinct(d["affected_district_names"]), lambda n: F.try_element_at(F.filter(d["districts"], lambda x: x["district"] == n), F.lit(-1)))


def _district_sums(d: Column, rows: Column) -> Column:
    """Totals are compared only where every affected district has detail and the field."""
    s, names = d["summary"], d["affected_district_names"]
    complete = (F.size(rows) > 0) & ~F.exists(rows, lambda x: x.isNull())
    out = [(~_equal(s["affected_districts"], F.size(_listed(names)).cast("double")), "summary.affected_districts")]
    for f in CORE_FIELDS[1:]:
        total = F.aggregate(rows, F.lit(0.0), lambda a, x: a + x[f])  # null if one lacks it
        out.append((complete & total.isNotNull() & s[f].isNotNull() & ~_equal(s[f], total), f"summary.{f}"))
    return _paths(*out)


def _record_count(d: Column, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(d["infrastructure"], lambda x: x["incident_type"] == kind)), F.lit(0)).cast("double")


def _record_counts(d: Column, actual: dict[str, Column]) -> Column:
    seen = d["summary"]["infrastructure_records_extracted"]
    return _paths(*[(~_part(seen, t, None).eqNullSafe(actual[t]), f"summary.infrastructure_records_extracted.{t}") for t in INFRASTRUCTURE_TYPES])


def _mismatched(d: Column, actual: dict[str, Column]) -> Column:
    """Kinds of damage whose declared number is not that of the records."""
    declared = d["summary"]["infrastructure_incidents"]
    return _paths(*[(~_part(declared, t, None).eqNullSafe(actual[t]), t) for t in INFRASTRUCTURE_TYPES])


def _source_counts(d: Column, actual: dict[str, Column], kinds: Column) -> tuple[Column, Column]:
    """Status and paths: a mismatch is approved (warn) if the extractor warned of exactly these numbers."""
    warned, declared = d["extraction_warnings"], d["summary"]["infrastructure_incidents"]
    excused = F.lit(True)
    for t in INFRASTRUCTURE_TYPES:
        last = F.try_element_at(F.filter(warned, lambda w: (w["code"] == COUNT_MISMATCH) & (w["incident_type"] == t)), F.lit(-1))
        same = last.isNotNull() & last["reported_count"].eqNullSafe(_part(declared, t, None)) & last["extracted_record_count"].eqNullSafe(actual[t])
        excused = excused & (~F.array_contains(kinds, t) | F.coalesce(same, F.lit(False)))
    odd = F.coalesce(F.exists(warned, lambda w: ~F.coalesce((w["code"] == COUNT_MISMATCH) & F.array_contains(kinds, w["incident_type"]), F.lit(False))), F.lit(False))
    status = F.when((F.size(kinds) == 0) & ~odd, "pass").when((F.size(kinds) > 0) & excused & ~odd, "warn").otherwise("fail")
    return status, F.transform(kinds, lambda t: F.concat(F.lit("summary.infrastructure_incidents."), t))


def _coordinates(d: Column) -> Column:
    def bad(x: Column) -> Column:
        inside = F.coalesce(x["longitude"].between(89.5, 97.5) & x["latitude"].between(24, 29.5) & (x["match_scope"] == "coordinates"), F.lit(False))
        return F.when(F.coalesce(x["coordinate_validation"] == "valid", F.lit(False)), ~inside).otherwise(x["match_scope"] == "coordinates")

    return _indexed(d["infrastructure"], bad, "infrastructure")


def _provenance(d: Column) -> Column:
    def wrong(refs: Column) -> Column:
        def off(r: Column) -> Column:
            here = r["source_revision_sha256"].eqNullSafe(d["revision_id"]) & r["report_date"].eqNullSafe(d["report_date"]) & r["extractor_version"].eqNullSafe(d["extractor_version"])
            return ~here | (F.coalesce(r["page"], F.lit(0)) < 1) | (F.coalesce(r["table"], F.lit(0)) < 1) | (F.coalesce(r["row"], F.lit(0)) < 1)

        return ~_has(refs) | F.coalesce(F.exists(refs, lambda r: F.coalesce(off(r), F.lit(True))), F.lit(False))

    fields = F.array_sort(F.map_keys(F.map_filter(d["field_provenance"], lambda _, refs: wrong(refs))))
    return F.concat(
        F.coalesce(fields, F.array().cast("array<string>")), _indexed(d["infrastructure"], lambda x: wrong(x["provenance"]), "infrastructure"),
        _indexed(d["relief_material_notes"], lambda x: wrong(x["provenance"]), "relief_material_notes"),
    )


def _fetched(d: Column) -> Column:
    """The instant of the fetch; null for a text without offset."""
    at = d["source"]["fetched_at"]
    return F.when(at.rlike(r"(Z|[+-]\d\d:\d\d)$"), at.try_cast("timestamp"))


def _local_day(at: Column) -> Column:
    """The day in India, whatever the session's time zone is."""
    return F.date_from_unix_date(F.floor((F.unix_seconds(at) + 19_800) / 86_400).cast("int"))


def _report_day(d: Column) -> Column:
    return F.when(d["report_date"].rlike(r"^\d{4}-\d\d-\d\d$"), d["report_date"].try_cast("date"))


def _today(now: str) -> date:
    at = datetime.fromisoformat(now)
    if at.tzinfo is None:
        raise ValueError("now needs an offset")
    return at.astimezone(_IST).date()


def _temporal(d: Column, now: str) -> Column:
    day = _report_day(d)
    good = (day <= F.lit(_today(now))) & (_local_day(_fetched(d)) >= day)
    return F.when(F.coalesce(good, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("report_date"), F.lit("source.fetched_at")))


def suite(read_bulletins: DataFrame, now: str) -> DataFrame:
    """Bulletins from read() with `checks`, an array of (check, status, paths) in fixed order. now: ISO time with offset."""
    d, kinds = F.col("doc"), F.col("_kinds")
    actual = {t: F.col(f"_n_{t}") for t in INFRASTRUCTURE_TYPES}
    rows = read_bulletins.withColumns({"_rows": _affected_rows(d)} | {f"_n_{t}": _record_count(d, t) for t in INFRASTRUCTURE_TYPES})
    rows = rows.withColumn("_kinds", _mismatched(d, actual))
    status, paths = _source_counts(d, actual, kinds)
    broken = F.when(F.col("unreadable"), F.array(F.lit("<root>"))).otherwise(F.array().cast("array<string>"))
    all_ = {
        "bulletin_schema": broken, "source_identity": _identity(d), "required_impact_fields": _required(d), "non_negative_metrics": _non_negative(d), "component_arithmetic": _components(d),
        "district_arithmetic": _district_sums(d, F.col("_rows")), "field_provenance": _provenance(d), "temporal_contract": _temporal(d, now), "infrastructure_record_count": _record_counts(d, actual),
        "infrastructure_source_reconciliation": paths, "coordinate_scope": _coordinates(d),
    }
    verdict = lambda name, bad: status if name == "infrastructure_source_reconciliation" else F.when(F.size(bad) == 0, "pass").otherwise("fail")
    found = rows.withColumns({f"_{n}": p for n, p in all_.items()})
    listed = F.array(*[F.struct(F.lit(n).alias("check"), verdict(n, F.col(f"_{n}")).alias("status"), F.col(f"_{n}").alias("paths")) for n in all_])
    return found.withColumn("checks", listed).drop("_rows", "_kinds", *[f"_n_{t}" for t in INFRASTRUCTURE_TYPES], *[f"_{n}" for n in all_])


def long(checked: DataFrame, *ids: str) -> DataFrame:
    """One row per bulletin and check."""
    return checked.select(*ids, F.explode("checks").alias("c")).select(*ids, "c.check", "c.status", "c.paths")


def state(checked: DataFrame, now: str, freshness_days: int = 3) -> DataFrame:
    """Bulletins from suite() with state, profile, allowed_fields and failures.

    A failed check, or a warning other than the approved mismatch of counts, quarantines. An older day than the current
    bulletin's, or one older than freshness_days, is historical; another revision of the same day that was fetched no
    later is superseded; the rest is validated, or validated_partial with a mismatch. The current bulletin comes with
    the row: `current`, a struct of report_date (date), revision_id and fetched_at (timestamp), null if there is none."""
    d, cur = F.col("doc"), F.col("current")
    of = lambda s: F.transform(F.filter("checks", lambda c: c["status"] == s), lambda c: c["check"])
    failed, warned = of("fail"), of("warn")
    partial = warned == F.array(F.lit("infrastructure_source_reconciliation"))
    held = (F.size(failed) > 0) | ((F.size(warned) > 0) & ~partial)
    kinds = F.transform(F.filter(_listed(d["extraction_warnings"], "struct<code:string,incident_type:string,reported_count:double,extracted_record_count:double>"), lambda w: w["code"] == COUNT_MISMATCH), lambda w: w["incident_type"])
    some = F.concat(F.array(*[F.lit(f) for f in FULL_ALLOWED_FIELDS if f != "infrastructure"], F.lit("infrastructure_filtered")), F.transform(kinds, lambda t: F.concat(F.lit("infrastructure_except:"), t)))
    day = _report_day(d)
    late = (day == cur["report_date"]) & (cur["revision_id"] != d["revision_id"]) & (_fetched(d) <= cur["fetched_at"])
    name = (
        F.when(held, "quarantined").when(day < cur["report_date"], "historical").when(late, "superseded")
        .when(F.datediff(F.lit(_today(now)), day) > freshness_days, "historical").when(partial, "validated_partial").otherwise("validated")
    )
    return checked.withColumns({
        "state": name, "profile": F.when(held, "none").when(partial, COUNT_PROFILE).otherwise("impact-v1"),
        "allowed_fields": F.when(held, F.array().cast("array<string>")).when(partial, some).otherwise(F.array(*[F.lit(f) for f in FULL_ALLOWED_FIELDS])),
        "failures": F.when(F.size(failed) > 0, failed).when(held, warned).otherwise(F.array().cast("array<string>")),
    })


def published_records(judged: DataFrame, *ids: str) -> DataFrame:
    """Damage records that may be shown: of publishable bulletins, without the kinds whose counts disagree, and with
    coordinates only where they are valid."""
    rows = judged.where("state <> 'quarantined'").select(*ids, "allowed_fields", F.explode("doc.infrastructure").alias("r"))
    shown = rows.where(~F.array_contains("allowed_fields", F.concat(F.lit("infrastructure_except:"), F.coalesce("r.incident_type", F.lit("")))))
    valid = F.coalesce(F.col("r.coordinate_validation") == "valid", F.lit(False))
    return shown.select(*ids, "r.incident_type", "r.match_scope", F.when(valid, F.col("r.longitude")).alias("longitude"), F.when(valid, F.col("r.latitude")).alias("latitude"))
