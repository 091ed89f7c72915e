"""Contracts of JSON payloads: pinned heads, checked rows, every breach listed; one breach refuses the payload whole."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.shared import once


@dataclass(frozen=True)
class Contract:
    """What a payload must be.

    pins: head field -> values it may have; paired: (field, other field, {value: what the other must be}); rows: the array
    of rows; values: an array inside each row whose elements are the measurements (none: the rows themselves). The fields of
    rows and values go by kind: texts, numbers (name -> lowest and highest, None for open), times (with offset).
    before: (earlier, later) fields of one row; issued, horizon_days and valid: the head's time, and how many days after it
    a value's time may lie; values must then be in order of time. point: a field that must hold [lon, lat]."""

    pins: dict[str, tuple[str, ...]]
    rows: str
    texts: tuple[str, ...] = ()
    numbers: dict[str, tuple[float | None, float | None]] | None = None
    times: tuple[str, ...] = ()
    before: tuple[str, str] | None = None
    paired: tuple[str, str, dict[str, str]] | None = None
    point: str | None = None
    values: str | None = None
    value_numbers: dict[str, tuple[float | None, float | None]] | None = None
    issued: str | None = None
    valid: str | None = None
    horizon_days: int = 0


# The reviewed products and versions.
RAIN_GRID = Contract(
    pins={"units": ("mm/hour",), "product_version": ("07",), "run": ("early", "late")},
    paired=("run", "product_short_name", {"early": "GPM_3IMERGHHE.07", "late": "GPM_3IMERGHHL.07"}),
    rows="observations", texts=("grid_cell_id",), numbers={"longitude": (-180, 180), "latitude": (-90, 90), "precipitation_rate": (0, None)},
    times=("interval_start", "interval_end"), before=("interval_start", "interval_end"),
)
DISCHARGE_FORECAST = Contract(
    pins={"dataset": ("cems-glofas-forecast",), "system_version": ("4.5",), "forecast_horizon_days": ("30",), "units": ("m3/s",), "ensemble_statistic": ("ensemble_mean", "ensemble_median")},
    rows="grid_points", texts=("grid_cell_id",), point="coordinates", values="values", value_numbers={"discharge_m3_per_second": (0, None)},
    issued="issued_at", valid="valid_at", horizon_days=30,
)

_OFFSET = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)$"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used: inside lambdas nothing else shares it."""
    return F.transform(F.array(value), use)[0]


def _text(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def _number(v: Column, name: str) -> Column:
    """A finite number, or null."""
    return _let(F.try_variant_get(v, f"$.{name}", "double"), lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))


def _time(v: Column, name: str) -> Column:
    """An instant, or null for a text that is none or has no offset."""
    return _let(_text(v, name), lambda t: F.when(t.rlike(_OFFSET), t.try_cast("timestamp")))


def _list(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "array<variant>")


def _breach(bad: Column, path: Column | str, reason: str) -> Column:
    """A null condition is a breach too: what cannot be judged is refused."""
    path = F.lit(path) if isinstance(path, str) else path
    return F.when(F.coalesce(bad, F.lit(True)), F.struct(path.alias("path"), F.lit(reason).alias("reason")))


def _bounded(v: Column, at: Column, numbers: dict[str, tuple[float | None, float | None]]) -> list[Column]:
    def judged(name: str, low: float | None, high: float | None) -> Column:
        path = F.concat(at, F.lit(f".{name}"))
        beyond = lambda x: reduce(lambda a, b: a | b, [c for c in (x < low if low is not None else None, x > high if high is not None else None) if c is not None], F.lit(False))
        return _let(_number(v, name), lambda x: F.when(x.isNull(), _breach(F.lit(True), path, "not a number")).otherwise(_breach(beyond(x), path, "out of range")))

    return [judged(name, low, high) for name, (low, high) in numbers.items()]


def _row_breaches(c: Contract, row: Column, at: Column, issued: Column) -> Column:
    here = lambda n: F.concat(at, F.lit(f".{n}"))
    out = [_breach(F.coalesce(F.trim(_text(row, n)), F.lit("")) == "", here(n), "missing") for n in c.texts]
    out += _bounded(row, at, c.numbers or {})
    out += [_breach(_time(row, n).isNull(), here(n), "not a time with offset") for n in c.times]
    if c.before:
        a, b = (_time(row, n) for n in c.before)
        out.append(F.when(a.isNotNull() & b.isNotNull(), _breach(a >= b, here(c.before[1]), "not after its start")))
    if c.point:
        lon, lat = (F.try_variant_get(row, f"$.{c.point}[{i}]", "double") for i in (0, 1))
        pair = F.size(_list(row, c.point)) == 2
        out.append(_breach(~(pair & lon.between(-180, 180) & lat.between(-90, 90)), here(c.point), "not [lon, lat]"))
    found = F.array_compact(F.array(*out))
    if not c.values:
        return found

    def one(value: Column, j: Column) -> Column:
        spot = F.concat(at, F.lit(f".{c.values}["), j.cast("string"), F.lit("]"))
        outside = lambda when: (when < issued) | (F.unix_micros(when) > F.unix_micros(issued) + c.horizon_days * 86_400_000_000)
        return _let(_time(value, c.valid), lambda when: F.array_compact(F.array(
            *_bounded(value, spot, c.value_numbers or {}), _breach(when.isNull(), F.concat(spot, F.lit(f".{c.valid}")), "not a time with offset"),
            F.when(when.isNotNull() & issued.isNotNull(), _breach(outside(when), F.concat(spot, F.lit(f".{c.valid}")), "outside the horizon")),
        )))

    def back(times: Column) -> Column:
        n = F.size(times)
        return F.exists(F.arrays_zip(F.slice(times, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(times, 2, F.greatest(n, F.lit(1))).alias("b")), lambda p: F.coalesce(p["a"] > p["b"], F.lit(False)))

    def all_of(values: Column) -> Column:
        empty = F.array_compact(F.array(_breach(F.coalesce(F.size(values), F.lit(0)) < 1, here(c.values), "no values")))
        unordered = F.array_compact(F.array(F.when(F.size(values) > 1, _breach(_let(F.transform(values, lambda x: _time(x, c.valid)), back), here(c.values), "not in order of time"))))
        each = F.flatten(F.transform(F.coalesce(values, F.array().cast("array<variant>")), one))
        return F.concat(found, empty, unordered, each)

    return _let(_list(row, c.values), all_of)


def breaches(v: Column, contract: Contract) -> Column:
    """All breaches of a parsed payload as array<struct<path, reason>>; empty: it keeps the contract. Null, which is also
    unreadable text, is one breach of `$`. A pinned number is compared by its text."""
    c = contract
    head = [_breach(~_text(v, n).isin(*allowed), f"$.{n}", "not as pinned") for n, allowed in c.pins.items()]
    if c.paired:
        name, other, pairs = c.paired
        want = reduce(lambda w, kv: w.when(_text(v, name) == kv[0], kv[1]), list(pairs.items())[1:], F.when(_text(v, name) == next(iter(pairs)), pairs[next(iter(pairs))]))
        head.append(_breach(_text(v, other) != want, f"$.{other}", f"not that of {name}"))
    if c.issued:
        head.append(_breach(_time(v, c.issued).isNull(), f"$.{c.issued}", "not a time with offset"))
    rows = _list(v, c.rows)
    head.append(_breach(F.coalesce(F.size(rows), F.lit(0)) < 1, f"$.{c.rows}", "no rows"))
    at = lambda i: F.concat(F.lit(f"$.{c.rows}["), i.cast("string"), F.lit("]"))
    issued = _time(v, c.issued) if c.issued else F.lit(None).cast("timestamp")
    each = _let(issued, lambda t: F.flatten(F.transform(F.coalesce(rows, F.array().cast("array<variant>")), lambda r, i: _row_breaches(c, r, at(i), t))))
    return F.when(v.isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("unreadable").alias("reason")))).otherwise(F.concat(F.array_compact(F.array(*head)), each))


def judge(payloads: DataFrame, json: str, contract: Contract) -> DataFrame:
    """payloads with breaches and accepted; narrow, so nothing is shuffled."""
    parsed = once(payloads, _v=F.try_parse_json(F.col(json)))
    judged = once(parsed, breaches=breaches(F.col("_v"), contract)).drop("_v")
    return judged.withColumn("accepted", F.size("breaches") == 0)


def rows(judged: DataFrame, json: str, contract: Contract, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of accepted payloads, typed: head pins, texts, numbers and times; with values, one row per value and its
    tier: `medium_range` up to 15 days after issue, `extended_range` later."""
    c = contract
    v = once(judged.where("accepted").select(*keep, json), _v=F.try_parse_json(F.col(json)))
    v = v.withColumn("_r", F.explode(_list(F.col("_v"), c.rows)))
    r = F.col("_r")
    cols = [_text(F.col("_v"), n).alias(n) for n in c.pins] + [_text(r, n).alias(n) for n in c.texts]
    cols += [_number(r, n).alias(n) for n in c.numbers or {}] + [_time(r, n).alias(n) for n in c.times]
    if c.point:
        cols += [F.try_variant_get(r, f"$.{c.point}[{i}]", "double").alias(n) for i, n in enumerate(("lon", "lat"))]
    if c.values:
        v = v.withColumn("_x", F.explode(_list(r, c.values)))
        issued, at = _time(F.col("_v"), c.issued), _time(F.col("_x"), c.valid)
        cols += [_number(F.col("_x"), n).alias(n) for n in c.value_numbers or {}]
        tier = F.when(F.unix_micros(at) <= F.unix_micros(issued) + 15 * 86_400_000_000, "medium_range").otherwise("extended_range")
        cols += [issued.alias(c.issued), at.alias(c.valid), tier.alias("tier")]
    return v.select(*keep, *cols)
