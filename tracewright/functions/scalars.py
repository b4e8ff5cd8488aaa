"""Scalar expressions: content grammar of annotation atoms, paths, numbers, URLs, ramps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The styles whose atoms persist, and those that stand on a frame.
PERSISTENT = ("subtask", "plan", "memory", "motion", "task_aug")
EVENT = ("interjection", "vqa", "trace")


def style_column(style: Column) -> Column:
    """The column that a style belongs to; null goes to events, an unknown style is an error."""
    return F.when(style.isNull() | style.isin(*EVENT), "language_events").when(style.isin(*PERSISTENT), "language_persistent").otherwise(F.raise_error(F.concat(F.lit("unknown style "), style)))


def fixed(x: Column, digits: int) -> Column:
    """x with that many decimals, rounded from its exact binary value, halves to even, as C's printf does; format_string
    rounds the shortest decimal text half up."""
    plain = F.format_string(f"%.{digits}f", x.cast("double"))
    return F.when(F.abs(x) < float("inf"), F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits))).otherwise(plain)


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as DuckDB does: times a power of ten, halves away from zero, and back; F.round takes the shortest
    decimal text instead and ends elsewhere where a product falls on or off a half. Too large to be scaled, x stays."""
    scaled = x * float(10**digits)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / float(10**digits)).otherwise(x)


def atom_content(label: Column, conf: Column, finger: Column, seconds: Column, info: Column, **parts: Column) -> Column:
    """``[auto:conf] label fN D.DDs name value ... (info)``; nulls are left out."""
    named = [F.when(v.isNotNull(), F.concat(F.lit(f"{k} "), fixed(v, 1))) for k, v in parts.items()]
    return F.concat_ws(" ", F.format_string("[auto:%s] %s", conf, label), F.when(finger.isNotNull(), F.format_string("f%d", finger)), F.when(seconds.isNotNull(), F.concat(fixed(seconds, 2), F.lit("s"))), *named, F.when(info.isNotNull(), F.concat(F.lit("("), info, F.lit(")"))))


GRAMMAR = r"^\[auto:(\w+)\] (\w+)(?: (f\d))?(?: ([\d.]+)s)?"


def atom_parts(content: Column) -> Column:
    """conf, label, finger and seconds of an atom's content; nulls where it has none."""
    part = lambda k: F.nullif(F.regexp_extract(content, GRAMMAR, k), F.lit(""))
    return F.struct(part(1).alias("conf"), part(2).alias("label"), part(3).alias("finger"), part(4).cast("double").alias("seconds"))


def flag_parts(flag: Column) -> Column:
    """kind, start and end of ``kind@A-Bs``."""
    span = F.regexp_extract(flag, r"@([\d.]+)(?:-([\d.]+))?s?$", 1)
    return F.struct(F.split(flag, "@")[0].alias("kind"), F.nullif(span, F.lit("")).cast("double").alias("start"), F.nullif(F.regexp_extract(flag, r"@([\d.]+)-([\d.]+)s?$", 2), F.lit("")).cast("double").alias("end"))


def finite(x: Column) -> Column:
    """A number from a string or number; null for blanks, text, NaN and infinities."""
    v = x.cast("string").try_cast("double") if hasattr(x, "try_cast") else x.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def padded(n: Column, width: int) -> Column:
    """Left-padded with zeros, never cut."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def chunk_path(kind: str, chunk: Column, file: Column, suffix: str) -> Column:
    return F.concat(F.lit(f"{kind}/chunk-"), padded(chunk, 3), F.lit("/file-"), padded(file, 3), F.lit(suffix))


def duration(seconds: Column) -> Column:
    """``S s``, ``M m SS s`` or ``H h M m``."""
    s = F.floor(seconds + 0.5).cast("long")
    return F.when(s < 60, F.format_string("%d s", s)).when(s < 3600, F.format_string("%d m %02d s", F.floor(s / 60), s % 60)).otherwise(F.format_string("%d h %d m", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def depth_unit(x: Column, lo: Column, hi: Column, log: bool) -> Column:
    """Depth as 0 to 1 within a band, linear or logarithmic; null where it is not positive or the band empty."""
    f = (lambda v: F.ln(v)) if log else (lambda v: v)
    ok = (x > 0) & (hi > lo) & ((lo > 0) if log else F.lit(True))
    return F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (f(x) - f(lo)) / (f(hi) - f(lo)))))


def ramp(u: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise linear value between (position, value) stops."""
    out = F.lit(float(stops[-1][1]))
    for (a, x), (b, y) in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(u < b, x + (y - x) * (u - a) / (b - a)).otherwise(out)
    return F.when(u < stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)


def url_parts(url: Column) -> Column:
    part = lambda k: F.try_parse_url(url, F.lit(k))
    return F.struct(part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"), part("REF").alias("ref"))


def filled(template: Column, **values: Column) -> Column:
    """The template with ``{name}`` and ``{name:03d}`` replaced by the plain value; a width has no effect."""
    for name, value in values.items():
        text = F.regexp_replace(value.cast("string"), r"([\\$])", r"\\$1")
        template = F.regexp_replace(template, F.lit(rf"\{{{name}(:\d+d)?\}}"), text)
    return template
