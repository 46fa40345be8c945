"""Answers as text: entry details, static sections, footers, slot answers, bounds of summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernglass.functions import text as T

# fixed values: labels of an entry's fields, in the order in which they are shown
FIELDS = {"address": "住所", "tel": "電話", "open_hours": "営業時間", "holiday": "定休日", "price": "料金", "tags": "タグ", "areas": "エリア"}
# fixed values: words that ask for ships and for flights
SHIP = ["船", "フェリー", "ジェットフォイル", "太古"]
FLIGHT = ["飛行機", "空港", "フライト", "ana", "jal", "orc", "オリエンタルエアブリッジ"]
FOOTER = "— 出典 —"


def detail(dtypes: dict[str, str], fields: dict[str, str] = FIELDS) -> Column:
    """An entry's title, description with single spaces, and its labelled fields that aren't blank, one a line; lists with
    slashes. Fields that the entry table (dtypes) doesn't have are left out."""
    lines = [T.strip(F.coalesce("title", F.lit(""))), T.squeeze(F.coalesce("desc", F.lit("")))]
    for name, label in fields.items():
        if name in dtypes:
            text = F.array_join(F.filter(F.transform(name, lambda x: T.strip(x.cast("string"))), lambda x: x != ""), " / ") if dtypes[name].startswith("array") else T.strip(F.col(name).cast("string"))
            lines.append(F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{label}："), text)).otherwise(""))
    return F.array_join(F.filter(F.array(*lines), lambda x: x != ""), "\n")


def transport_sections(question: Column, ship: list[str] = SHIP, flight: list[str] = FLIGHT) -> Column:
    """Which of ship and flight a question about transport asks for; both if it names neither."""
    form = T.search_form(question)
    names = lambda words: F.exists(F.array(*[T.search_form(F.lit(w)) for w in words]), lambda w: form.contains(w))
    s, f = names(ship), names(flight)
    return F.when(s & ~f, F.array(F.lit("ship"))).when(f & ~s, F.array(F.lit("flight"))).otherwise(F.array(F.lit("ship"), F.lit("flight")))


def with_footer(text: Column, sources: Column, footer: str = FOOTER) -> Column:
    """A text with its sources (array of note, url) below it: blank notes are left out, equal ones stand once; a text that has the
    footer, or no source, stays."""
    some = F.array_distinct(F.filter(sources, lambda s: F.coalesce(F.trim(s["note"]), F.lit("")) != ""))
    lines = F.transform(some, lambda s: F.concat(F.lit("・"), F.trim(s["note"]), F.when(F.coalesce(s["url"], F.lit("")) != "", F.concat(F.lit(" "), s["url"])).otherwise("")))
    done = (F.coalesce(F.size(some), F.lit(0)) <= 0) | text.contains(footer)
    return F.when(done, text).otherwise(F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit(f"\n\n{footer}\n"), F.array_join(lines, "\n")))


def slot_line(title: Column, area: Column, line: Column, tags: Column, hours: Column, link: Column) -> Column:
    """One entry of an answer: title, area, one line, at most four tags, hours and a link on a line of its own, if there are any."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    four = F.array_join(F.slice(tags, 1, 4), " / ")
    return F.concat(
        F.lit("・"), F.coalesce(title, F.lit("（名称不明）")), F.lit("（"), F.coalesce(area, F.lit("")), F.lit("）— "), F.coalesce(line, F.lit("")),
        F.when(blank(four), "").otherwise(F.concat(F.lit("｜"), four)), F.when(blank(hours), "").otherwise(F.concat(F.lit("｜"), hours)), F.when(blank(link), "").otherwise(F.concat(F.lit("\n  "), link)),
    )


def summary_bounds(context: Column, *, least: int, most: int, fallback: int) -> Column:
    """(min_chars, max_chars, short) of the summary of a context: short contexts, by length or of at most two lines, have bounds
    of their own."""
    text = T.strip(F.coalesce(context, F.lit("")))
    lines = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    short = (F.length(text) <= max(400, fallback * 2)) | (lines <= 2)
    top = max(min(most, max(fallback + 200, 500)), fallback)
    return F.struct(F.when(short, fallback).otherwise(least).alias("min_chars"), F.when(short, top).otherwise(max(least, most)).alias("max_chars"), short.alias("short"))
