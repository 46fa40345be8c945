"""Containment beside all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fernglass import registry
from fernglass.operators.matching import containing


def test_texts_that_contain_forms(spark):
    rnd = random.Random(2)
    texts = [(i, "".join(rnd.choice("abcé ") for _ in range(rnd.randrange(30)))) for i in range(300)] + [(900, None), (901, ""), (902, "a\nb"), (903, "a.b(c")]
    forms = [(i, "".join(rnd.choice("abcé ") for _ in range(rnd.randrange(7)))) for i in range(80)] + [(90, None), (91, "a\nb"), (92, "a.b("), (93, "never seen here"), (94, "abc"), (94, "abc")]
    got = containing(spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(forms, "f int, form string"), key="k", text="t", form="form").select("k", "f", "form").collect()
    assert sorted(map(tuple, got)) == sorted((k, f, form) for k, t in texts for f, form in forms if t and form and form in t)
    assert containing(spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(forms, "f int, form string").limit(0), key="k", text="t", form="form").columns == ["k", "f", "form"]


def test_a_common_beginning_brings_no_pairs(spark):
    """All forms begin alike and so do all texts; forms that texts lack meet none of them."""
    texts = spark.range(3000).select("id", F.concat(F.lit("supplier number "), F.format_string("%05d", "id")).alias("t"))
    forms = spark.range(3000).select(F.concat(F.lit("supplier number "), F.format_string("%05d", F.col("id") + 2990)).alias("form"))
    got = containing(texts, forms, key="id", text="t", form="form")
    assert sorted(r.id for r in got.collect()) == list(range(2990, 3000))


def test_few_forms_and_many_give_the_same(spark, monkeypatch):
    from fernglass.operators import matching

    texts = spark.createDataFrame([(1, "small ring"), (2, "ring"), (3, None), (4, ""), (5, "ri\nng")], "k int, t string")
    forms = spark.createDataFrame([(1, "ring"), (1, "ring"), (2, "i"), (3, "ri\nn"), (4, "all r"), (5, ""), (6, None)], "f int, form string")
    got = lambda: sorted(map(tuple, containing(texts, forms, key="k", text="t", form="form").collect()))
    few = got()
    monkeypatch.setattr(matching, "FEW", 0)
    sent = got()
    monkeypatch.setattr(matching, "SMALL", 0)
    assert few == sent == got() and len(few) == 9


def _sent_to_all(df, name):
    """Broadcasts of the plan that read the table and don't aggregate it."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(re.match(r"[\s:|+\-]*", x).group()) for x in lines]
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            part = "\n".join(lines[i:below])
            if f"{name}.parquet" in part and "Aggregate" not in part:
                found.append(part)
    return found


@pytest.mark.parametrize("name", ["entry_index_search", "facet_search", "tourism_search", "tourism_synonyms", "prioritized_search", "cascade_search", "responder_states"])
def test_entries_are_not_sent_to_every_task(spark, name):
    """The files of a table say little about what its rows take in memory, and the driver would hold them."""
    assert not _sent_to_all(registry.QUERIES[name](spark, "/root/testdata/sf0.001"), "part")


def test_names_are_not_sent_to_every_task(spark):
    """A short name has some thousand remainders: they would go through the driver."""
    assert not _sent_to_all(registry.QUERIES["fuzzy_names"](spark, "/root/testdata/sf0.001"), "supplier")
