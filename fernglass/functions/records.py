"""Loose values: dates, JSON, enumerations, maps, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp(c: Column) -> Column:
    """ISO text with or without zone, two plain formats, or epoch seconds or milliseconds (above 1e12); null if none fits."""
    text = F.trim(c.cast("string"))
    epoch = text.try_cast("double")
    return F.coalesce(
        F.when(epoch.isNotNull(), F.timestamp_micros(F.when(epoch > 1e12, epoch * 1000).otherwise(epoch * 1_000_000).cast("long"))),
        F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")),
    )


def first_object(c: Column) -> Column:
    """The first JSON object in a text: from the first brace to the one that closes it; braces inside quoted strings don't count, and an
    escaped quote doesn't end a string. Null without a brace, or where none closes it.

    The text after the first brace is cut into strings, braces and what is between them; a fold over the pieces keeps the
    depth, the length so far, and the length at which the depth came back to 0.
    """
    body = F.regexp_extract(c, r"(?s)(\{.*)", 1)
    pieces = F.regexp_extract_all(body, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+"?|[{}]|[^"{}]++'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(a, p):
        depth = a["depth"] + F.when(p == "{", 1).when(p == "}", -1).otherwise(0)
        n = a["n"] + F.length(p)
        return F.struct(depth.alias("depth"), n.alias("n"), F.when((a["end"] == 0) & (p == "}") & (depth == 0), n).otherwise(a["end"]).alias("end"))

    end = F.aggregate(pieces, start, step, lambda a: a["end"])
    return F.when(end > 0, F.substr(body, F.lit(1), end))


def loose_json(c: Column) -> Column:
    """The first JSON object in free text, as a variant: of a fenced block if there is one, without comments and trailing commas, typographic
    quotes as plain ones. Null if that isn't JSON."""
    fenced = F.regexp_extract(c, r"(?si)```(?:json)?\s*(.*?)```", 1)
    body = F.translate(F.when(fenced != "", fenced).otherwise(c), "“”‟＂’‘", "\"\"\"\"''")
    body = F.regexp_replace(F.regexp_replace(body, r"(?m)^\s*//.*$", ""), r"(?s)/\*.*?\*/", "")
    return F.try_parse_json(F.regexp_replace(first_object(body), r",(\s*[}\]])", "$1"))


def watermark_mode(c: Column, default: str = "none") -> Column:
    """One of none, full, city; synonyms are folded."""
    word = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(word.isin("1", "on", "true", "yes", "fully", "full"), "full").when(word.isin("city", "citylogo", "area"), "city").when(word.isin("0", "off", "false", "no", "none"), "none").otherwise(default)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))
