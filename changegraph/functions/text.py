"""Small text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def unquote(c: Column) -> Column:
    """Without one pair of equal quotes around it."""
    return F.regexp_replace(c, r"""^(["'`])(.*)\1$""", "$2")


def string_literals(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r'"([^"]*)"'), F.lit(1))


def relaxed_key(c: Column) -> Column:
    """Lower case, without dashes, underscores and indexes."""
    return F.lower(F.translate(F.regexp_replace(c, r"\[[^\]]*\]", ""), "-_", ""))


def placeholders(c: Column) -> Column:
    """Names in ``${name:default}``."""
    return F.regexp_extract_all(c, F.lit(r"\$\{([^:}]+)[^}]*\}"), F.lit(1))


def url_segments(c: Column) -> Column:
    """Path segments of a URL, variables (``{x}``, ``:x``, ``*``) as ``{}``; null without a literal segment."""
    path = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x: F.when(x.rlike(r"^(\{.*\}|:.*|\*+)$"), "{}").otherwise(x))
    return F.when(F.exists(segments, lambda x: x != "{}"), segments)


def join_path(a: Column, b: Column) -> Column:
    return F.concat(F.regexp_replace(a, "/+$", ""), F.lit("/"), F.regexp_replace(b, "^/+", ""))


def decapitalize(c: Column) -> Column:
    """``OwnerService`` as ``ownerService``; ``URLService`` stays as it is."""
    return F.when(c.rlike(r"^.\p{Lu}"), c).otherwise(F.concat(F.lower(F.substring(c, 1, 1)), F.substr(c, F.lit(2))))


def squash(c: Column, n: int) -> Column:
    """White space runs as one space, trimmed, at most ``n`` characters."""
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, n)


def extract_json(c: Column) -> Column:
    """From the first brace to the last, if that parses."""
    body = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def tolerant_id(c: Column) -> Column:
    """The number of ``12``, ``"h12"`` or ``#12``."""
    return F.regexp_extract(c, r"^\s*[\"']?[A-Za-z#]?(\d+)[\"']?\s*$", 1).try_cast("bigint")


def position_id(path: Column, old: Column, new: Column) -> Column:
    return F.concat_ws("_", F.sha1(path.cast("binary")), F.coalesce(old, F.lit(0)).cast("string"), F.coalesce(new, F.lit(0)).cast("string"))


def location(path: Column, first: Column, last: Column, old_side: Column) -> Column:
    lines = F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))
    return F.concat(F.concat_ws(":", path, lines), F.when(old_side, " (old)").otherwise(""))


def content_id(*columns: Column | str) -> Column:
    """16 hex digits that identify the values."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *columns).cast("binary"), 256), 1, 16)
