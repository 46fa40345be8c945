"""Literal rows where an operator once gave another answer than the service it does the work of."""

import pytest
from pyspark.sql import functions as F

from fernglass.functions import records
from fernglass.functions import text as T
from fernglass.operators import analytics, nearby, retrieval, search, synonyms

NOTE = retrieval.NO_EVIDENCE


def test_truth_of_words_and_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in ("t", "2", "y", " ON ", "none", "null", "0", "", None)], "v string")
    assert [tuple(r) for r in rows.select(T.truthy(F.col("v")), T.truthy(F.col("v"), True)).collect()] == [(False, True), (False, True), (True, True), (True, True), (False, True), (False, True), (False, False), (False, False), (False, False)]
    for kind, values in (("int", [2, 0, None, -1]), ("double", [0.5, 0.0, None, -1.0])):
        rows = spark.createDataFrame([(x,) for x in values], f"v {kind}")
        assert [r[0] for r in rows.select(T.truthy(F.col("v"))).collect()] == [True, False, False, True]


def test_ties_by_place_in_the_list(spark):
    e = spark.createDataFrame([(1, ["z", "a"], ["south", "north"]), (2, ["a", "z"], ["north", "south"])], "ord int, tags array<string>, areas array<string>")
    assert [r.tag for r in analytics.top_tags(e, tags="tags", order="ord").collect()] == ["z", "a"]
    assert [r.value for r in analytics.facets(e, areas="areas", tags="tags", order="ord").collect()] == ["south", "north", "z", "a"]


def test_weights_of_preferences_add_up(spark):
    tags = spark.createDataFrame([("swim", 1), ("beach", 2), ("cafe", 3)], "tag string, ord int")
    got = analytics.ranked_tags(tags, {"sea": ["swim", "beach"], "beach": ["beach"], "rain": ["cafe"]}, "a beach by the sea", tag="tag", order="ord")
    assert [(r.tag, r.weight) for r in got.collect()] == [("beach", 199), ("swim", 100), ("cafe", 0)]


def test_both_sides_are_normalised(spark):
    docs = spark.createDataFrame([(1, "ＡＢＣ abc\n Abc"), (2, "abc a a a a a")], "k int, text string")
    assert [tuple(r) for r in analytics.keyword_argmax(docs, ["Abc", "a"], text="text", key="k").collect()] == [(1, 3)]
    assert analytics.keyword_argmax(docs, ["a"], text="text", key="k").collect() == []
    assert analytics.estimated_bytes(spark.createDataFrame([(7,), (6,)], "n int"), size="n").first().needed == 14 + 1_000_000
    e = spark.createDataFrame([(1, "Ｂｅａｃｈ  House", None, None, ["old", "town"], [])], "ord int, title string, desc string, address string, tags array<string>, areas array<string>")
    q = spark.createDataFrame([(1, "beach house"), (2, " OLD　town "), (3, "")], "qid int, query string")
    assert sorted((r.qid, r.stage) for r in search.prioritised(e, q).collect()) == [(1, 0), (2, 2)]
    said = spark.createDataFrame([(1, "ＣＡＦＥ  au lait?")], "k int, t string")
    words = spark.createDataFrame([("drink", ["cafe au"])], "tag string, aliases array<string>")
    assert [r.tag for r in synonyms.tags_in_text(said, words, key="k", text="t", tag="tag", aliases="aliases").collect()] == ["drink"]


def test_scope(spark):
    rows = [(1, i, float(-i), "about Bread" if i > 2 else "about bread", ["Bread"], "brief") for i in range(9)] + [(2, i, 1.0, "x", ["y"], "brief") for i in range(9)] + [(3, 0, 1.0, "x", [], "brief"), (4, 0, 1.0, None, None, None)]
    got = retrieval.in_scope(spark.createDataFrame(rows, "qid int, key int, score double, text string, kw array<string>, style string"), text="text", keywords="kw", style="style")
    assert sorted((r.qid, r.key) for r in got.collect()) == [(1, 3), (1, 4), (1, 5), (1, 6), *((2, i) for i in range(9)), (3, 0), (4, 0)]


def test_context_header(spark):
    rows = spark.createDataFrame([(1, 2, "North", "guide.TXT", 4, 9, " b "), (1, 1, "North", "a.txt.csv", 1, 3, "a\n")], "qid int, pick int, place string, file string, line_start int, line_end int, text string")
    assert retrieval.labelled_context(rows).first().context == "[[1]] North/a.txt.csv L1-3\na\n\n[[2]] North/guide L4-9\nb"


def test_rows_without_vectors_are_not_picked(spark):
    rows = [(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.95, None), (1, 3, 0.5, [0.0, 1.0]), (2, 5, 0.1, None), (2, 6, 0.2, None)]
    got = retrieval.diversify(spark.createDataFrame(rows, "qid int, key int, rel double, vector array<double>"))
    assert sorted((r.qid, r.pick, r.key) for r in got.collect()) == [(1, 1, 1), (1, 2, 3), (2, 1, 6), (2, 2, 5)]


def test_rebuilt_answers(spark):
    refs = spark.createDataFrame([(k, n, doc, score) for k in range(6) for n, doc, score in ((1, "a", 0.1), (2, "b", 0.6), (3, "a", 0.1))], "k int, label int, doc string, score double")
    answers = [(0, "Long enough to count.[[1]] Short[[9]] And[[2]]more[[3]] tail"), (1, "no labels"), (2, "x[[1]]y[[9]]"), (3, None), (4, f"ends so{NOTE}"), (5, "[[2]]")]
    got = {r.k: (r.labelled, r.plain, r.used, r.invalid) for r in retrieval.rebuilt_answers(spark.createDataFrame(answers, "k int, a string"), refs, key="k", answer="a").collect()}
    assert got[0] == ("Long enough to count.[[1]] And[[2]]more[[3]]", "Long enough to count. Andmore", [1, 3, 2], [9])
    assert got[1] == ("", f"no labels{NOTE}", [], [])
    assert got[2] == ("", f"x{NOTE}", [], [9])
    assert got[3] == ("", NOTE, [], [])
    assert got[4] == ("", f"ends so{NOTE}", [], [])
    assert got[5] == ("[[2]]", "", [2], [])


def overlap_by_reading(fragments, queries, k):
    import re

    tokens = lambda t: [w.lower() for w in re.findall("[0-9A-Za-z一-龥ぁ-んァ-ンー]+", t)]
    out = []
    for qid, place, query in queries:
        own = [f for f in sorted(fragments) if f[1] == place and tokens(f[2])]
        rated = [(sum(w in tokens(t) for w in tokens(query)), t) for _, _, t in own]
        if any(s for s, _ in rated):
            rated = sorted((x for x in rated if x[0]), key=lambda x: (-x[0], -len(x[1])))
        seen = list(dict.fromkeys(t for _, t in rated))[:k]
        score = dict((t, s) for s, t in rated)
        out += [(qid, t, score[t]) for t in seen]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 3])
def test_fragments_of_a_place(spark, k):
    import random

    rnd = random.Random(k)
    common, rare = "the of and in".split(), "harbour été lamp 教会 tower ferry".split()
    fragments = [(i, rnd.choice("ab"), " ".join(rnd.choice(common if rnd.random() < 0.8 else rare) for _ in range(rnd.randrange(1, 9))) + "." * rnd.randrange(3)) for i in range(300)] + [(900, "a", "?!")]
    queries = [(1, "a", "the harbour"), (2, "b", "the the of"), (3, "a", "nothing"), (4, "b", "教会 of the lamp"), (5, "c", "the"), (6, "a", ""), (7, "a", "t")]
    got = search.fragment_overlap(spark.createDataFrame(fragments, "ord int, place string, text string"), spark.createDataFrame(queries, "qid int, place string, query string"), k=k, place="place")
    assert sorted((r.qid, r.text, r.score) for r in got.collect()) == overlap_by_reading(fragments, queries, k)


def test_first_object(spark):
    texts = {
        'say {"a": {"b": "}{"}, "c": "\\"}"} and {"d": 1}': '{"a": {"b": "}{"}, "c": "\\"}"}', '{"a": 1': None, "none": None, "} {x} {": "{x}", '{"open: }': None, None: None, "{}": "{}",
        "{" * 2000 + "}" * 2000 + "}": "{" * 2000 + "}" * 2000,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    assert {r.x: r.y for r in rows.select("x", records.first_object(F.col("x")).alias("y")).collect()} == texts
    loose = [("Here: ```json\n{“a”: [1, 2,], // no\n}\n``` and {\"b\": 2}", "[1,2]"), ('{"a": 5, /* x } */ "b": 1,} {"a": 6}', "5"), ('{"a": ', None)]
    rows = spark.createDataFrame([(t,) for t, _ in loose], "x string")
    got = [r[0] for r in rows.select(F.try_variant_get(records.loose_json(F.col("x")), "$.a", "string")).collect()]
    assert got == [None if "// no" in t else v for t, v in loose]


def test_latitudes_off_the_globe(spark):
    places = spark.createDataFrame([(1, 33.0, 129.0), (2, 100.0, 129.0), (3, None, 1.0), (4, 33.0, float("nan"))], "ord int, lat double, lng double")
    centres = spark.createDataFrame([(1, 33.0, 129.0), (2, 100.0, 129.0), (3, -200.0, 0.0), (4, None, None)], "cid int, clat double, clng double")
    assert [(r.cid, r.ord) for r in nearby.within_radius(places, centres, radius_m=9000).collect()] == [(1, 1)]


def test_a_success_is_used_again(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "a", "Old  church", 0, True, [1, 2, 3, 4, 5]), (2, "a", " old church ", 1800, False, None), (3, "a", "old church", 1801, False, []), (4, "b", "old church", 10, False, None), (5, "a", "tower", 0, True, [9]), (6, "a", "tower", 5, False, None),
            (7, "a", "gate", 0, True, [1]), (8, "a", "gate", 1, True, [2]), (9, "a", "gate", 2, None, [3]), (10, None, "gate", 3, False, None), (11, "a", " ", 3, False, None), (12, "a", "lamp", 0, True, []), (13, "a", "lamp", 1, False, None)]
    df = spark.createDataFrame([(i, p, q, t0 + dt.timedelta(seconds=s), ok, k) for i, p, q, s, ok, k in rows], "id int, place string, question string, ts timestamp_ntz, success boolean, keys array<int>")
    chunks = spark.createDataFrame([("a", k) for k in (4, 2, 1, 5, 2)] + [("b", 3)], "place string, key int")
    got = {r.id: (r.since_us, r["keys"]) for r in retrieval.reused_success(df, chunks).collect()}
    assert got == {2: (1_800_000_000, [1, 2, 4]), 9: (1_000_000, [2])}


def test_copies_of_centres_and_places_meet_once(spark):
    """2,000 centres at one point beside 2,000 places at another: 10 rows a centre, and few pairs before the distance is known."""
    places = spark.range(2000).select((5000 - F.col("id")).alias("ord"), F.lit(33.0).alias("lat"), F.lit(129.0).alias("lng"))
    centres = spark.range(2000).select(F.col("id").alias("cid"), F.lit(33.01).alias("clat"), F.lit(129.0).alias("clng"))
    got = nearby.within_radius(places, centres.unionByName(centres.where("cid = 7")), radius_m=9000, limit=3)
    found = got.collect()
    assert len(found) == 6000 and sorted({r.ord for r in found}) == [3001, 3002, 3003]
    assert sorted(r.ord for r in found if r.cid == 7) == [3001, 3001, 3002]
    joins, todo = [], [got._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            node = node.executedPlan()
            name = node.nodeName()
        if name.endswith("QueryStage"):
            todo.append(node.plan())
        elif "Join" in name and node.metrics().contains("numOutputRows"):
            joins.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert joins and max(joins) <= 6003


@pytest.mark.parametrize("held", [1, 64])
def test_queries_that_leave_a_task_keep_their_nearest(spark, monkeypatch, held):
    """More blocks of queries than a task holds; negative ids; fewer vectors than k in a block."""
    import numpy as np

    monkeypatch.setattr(retrieval, "HELD", held)
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    v = np.random.default_rng(3).integers(-4, 5, (90, 6)).astype(float)
    table = spark.createDataFrame([(i - 40, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = retrieval.dense_search(table, table.select(F.col("id").alias("qid"), "v"), key="id", vector="v", k=9).collect()
    unit = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
    likeness = np.round(unit @ unit.T, 9) + 0.0
    want = {(q - 40, int(i) - 40) for q in range(90) for i in np.lexsort((np.arange(90), -likeness[q]))[:9]}
    assert len(got) == 810 and {(r.qid, r.key) for r in got} == want
