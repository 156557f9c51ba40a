"""Scalar column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_010.0
SEED = 32639


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def d(value: float) -> Column:
    """A double literal."""
    return F.lit(float(value))


def finite(x) -> Column:
    """The value, or null where it is NaN or infinite."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(x, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(x).cast("double"), d(low)), d(high))


def logit(p, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (d(1) - q))


def expit(x) -> Column:
    return d(1) / (d(1) + F.exp(-clip(x, -500, 500)))


def yeo_johnson(x, lam) -> Column:
    """Power transform of a column; lam may be a column. Null where the value is not finite."""
    x, lam = finite(x), (lam if isinstance(lam, Column) else d(lam))
    up = F.when(F.abs(lam) < 1e-8, F.ln(d(1) + x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(F.abs(lam - 2) < 1e-8, -F.ln(d(1) - x)).otherwise(-(F.pow(d(1) - x, d(2) - lam) - 1) / (d(2) - lam))
    return F.when(x >= 0, up).otherwise(down)


def unit_sphere(lon, lat) -> tuple[Column, Column, Column]:
    lon, lat = F.radians(_c(lon)), F.radians(_c(lat))
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def chord(distance_m: float, radius_m: float = EARTH_RADIUS_M) -> float:
    """Chord on the unit sphere of an arc of so many metres."""
    return 2 * math.sin(min(distance_m / radius_m, math.pi) / 2)


def slug(x) -> Column:
    s = F.btrim(F.regexp_replace(_c(x).cast("string"), r"[^A-Za-z0-9._-]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("na"))


def job_id(benchmark, scenario, region, species, model, repeat=None) -> Column:
    parts = F.concat_ws("__", *[slug(x) for x in (benchmark, scenario, region, species, model)])
    return parts if repeat is None else F.when(_c(repeat) > 0, F.concat(parts, F.lit("__r"), _c(repeat).cast("string"))).otherwise(parts)


def md5_int(*parts) -> Column:
    """A 32-bit number that depends on the parts alone, the same in every engine with md5."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def md5_order(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]))


def hash_split(ids, *extra: str) -> Column:
    """Aggregate: sha256 of the sorted distinct identifiers and the extras."""
    return F.sha2(F.concat_ws("|", F.concat_ws(",", F.array_sort(F.collect_set(_c(ids).cast("string")))), *[F.lit(x) for x in extra]), 256)


def binary_label(x, strict: bool = False) -> Column:
    """0/1 from numbers or the usual words; where there is no reading, null, or with strict an error that names the value."""
    s = F.lower(F.trim(_c(x).cast("string")))
    words = {"yes": 1, "true": 1, "presence": 1, "present": 1, "1": 1, "no": 0, "false": 0, "absence": 0, "absent": 0, "0": 0}
    table = F.create_map(*[F.lit(v) for kv in words.items() for v in kv])
    read = F.coalesce(F.when(s.rlike(r"^-?[0-9]+(\.0*)?$"), s.cast("double").cast("int")), table[s])
    return F.coalesce(read, F.raise_error(F.concat(F.lit("neither presence nor absence: "), F.coalesce(_c(x).cast("string"), F.lit("nothing"))))) if strict else read


def reproduction_status(difference, match: float = 0.010, close: float = 0.025) -> Column:
    x = finite(difference)
    return F.when(x.isNull(), "NOT RUN").when(F.abs(x) <= match, "MATCH").when(F.abs(x) <= close, "CLOSE").otherwise("MISMATCH")


def normalise_name(x) -> Column:
    return F.translate(F.lower(_c(x)), "_", "-")


def split_list(x) -> Column:
    return F.filter(F.transform(F.split(_c(x), ","), F.trim), lambda v: v != "")


def fmt(x, digits: int = 3) -> Column:
    return F.coalesce(F.format_number(finite(x), digits), F.lit("-"))


def three_channels(block) -> Column:
    """An array of channels repeated, cut or padded with its last to three."""
    b = _c(block)
    last = F.element_at(b, -1)
    return F.when(F.size(b) >= 3, F.slice(b, 1, 3)).when(F.size(b) == 1, F.array_repeat(last, 3)).otherwise(F.concat(b, F.array_repeat(last, 1)))
