"""Dialogues beside a plain replay, turn by turn."""

import random
import re

from pyspark.sql import functions as F

from fernglass.operators import search
from fernglass.plans import dialogue

ENTRIES = [
    (1, "Red ring", "a  ring。", ["north", "south"], ["old", "PROMO"]), (2, "Blue ring", "x" * 70, ["south"], ["old"]), (3, "Green bolt", None, [], ["PROMO"]),
    (4, "Red bolt", "", ["north"], []), (5, "@tag:old stone", "d", ["north"], ["old"]), (6, "@tag:old wall", "d", ["south"], ["new"]), (7, "Red lamp・", "long、", ["south"], ["new"]),
]


def match(query, area, tag):
    return [e for e in ENTRIES if query.lower() in e[1].lower() and (area is None or area in e[3]) and (tag is None or tag in e[4])]


def replay(turns):
    out, state = [], {}
    for conv, turn, text in sorted(turns, key=lambda t: (t[0], t[1])):
        base, filters = state.get(conv, (None, {}))
        t = (text or "").strip()
        m = re.match(r"(?is)^@\s*(area|tag)\s*:\s*(\S.*)$", t)
        if m and base:
            filters = {**filters, m[1].lower(): m[2]}
            got, query = match(base, filters.get("area"), filters.get("tag")), base
            state[conv] = (None, {}) if len(got) == 1 else (base, filters)
        else:
            query, filters = t, {}
            got = match(t, None, None) if len(t.replace(" ", "")) >= 2 else []
            state[conv] = (t, {}) if len(got) > 1 else (None, {})
        out.append((conv, turn, "no_hit" if not got else "detail" if len(got) == 1 else "choices", query, filters.get("area"), filters.get("tag"), len(got), got[0][0] if len(got) == 1 else None))
    return out


def find(spark):
    e = spark.createDataFrame(ENTRIES, "ord int, title string, desc string, areas array<string>, tags array<string>")

    def by_title(q):
        met = q.join(e, F.lower("title").contains(F.lower("query")))
        return met.where((F.col("area").isNull() | F.array_contains("areas", F.col("area"))) & (F.col("tag").isNull() | F.array_contains("tags", F.col("tag")))).select("qid", "ord")

    return e, by_title


def key(rows):
    return sorted(rows, key=lambda r: r[:2])


def test_dialogues_are_replayed(spark):
    rnd = random.Random(11)
    said = ["ring", "red", "bolt", "@area:north", "@area: south ", "@TAG:old", " @tag:PROMO", "@tag:old", "@tag:", "@x:y", "", None, "r", "nothing", "Red bolt", "@area:west"]
    turns = [(c, t * 3, rnd.choice(said)) for c in range(40) for t in range(rnd.randrange(1, 14))]
    # four steps that narrow, the last to one
    turns += [(100, 1, "red"), (100, 2, "@area:south"), (100, 3, "@tag:old"), (100, 4, "@tag:new"), (100, 5, "@area:north")]
    e, by_title = find(spark)
    got = dialogue.replies(spark.createDataFrame(turns, "conv int, turn int, text string").repartition(3), e, by_title, conv="conv", turn="turn", text="text").collect()
    assert key((r.conv, r.turn, r.kind, r["query"], r.area, r.tag, r.n, r["first"]) for r in got) == key(replay(turns))
    kinds = {r.kind for r in got}
    assert kinds == {"no_hit", "detail", "choices"}


def test_choices_show_their_first_matches(spark):
    e, by_title = find(spark)
    turns = spark.createDataFrame([(1, 1, "red"), (1, 2, "@area:south"), (2, 1, "ring")], "conv int, turn int, text string")
    got = {(r.conv, r.turn): r for r in dialogue.replies(turns, e, by_title, conv="conv", turn="turn", text="text").collect()}
    assert got[1, 1].preview == "- Red ring（north / south）：a ring\n- Red bolt（north）\n- Red lamp・（south）：long"
    assert got[1, 1].options == "@area:north|@area:south|@tag:old|@tag:PROMO|@tag:new"
    assert got[1, 2].preview.startswith("- Red ring") and got[1, 2].n == 2
    assert got[2, 1].preview.split("\n")[1] == "- Blue ring（south）：" + "x" * 60


def test_no_turns(spark):
    e, by_title = find(spark)
    assert dialogue.replies(spark.createDataFrame([], "conv int, turn int, text string"), e, by_title, conv="conv", turn="turn", text="text").collect() == []


def test_what_a_search_found_is_told_once(spark, monkeypatch):
    """Forty conversations ask the same: entries come to the search, not to each turn."""
    made = {}
    kept = dialogue.written
    monkeypatch.setattr(dialogue, "written", lambda df, name: made.setdefault(name, kept(df, name)))
    turns = spark.range(40).select("id", F.lit(1).alias("turn"), F.lit("ring").alias("text"))
    none = F.expr("cast(array() as array<string>)")
    entries = spark.range(30).select(F.col("id").alias("ord"), F.lit("small ring").alias("title"), F.lit("x").alias("desc"), F.array(F.lit("here")).alias("areas"), F.array(F.lit("t")).alias("tags"), none.alias("title_forms"), none.alias("aux"))
    got = dialogue.replies(turns, entries, lambda q: search.search_index(entries, q, limit=20, facets=True), conv="id", turn="turn", text="text").collect()
    assert {(r.kind, r.n, r.preview.count("\n"), r.options) for r in got} == {("choices", 20, 2, "@area:here|@tag:t")} and len(got) == 40
    assert made["matches"].count() == 20
