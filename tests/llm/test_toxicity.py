"""Operator 12: held-out labels, scores beside a plain sum over words, and what swaps of identity terms change."""

import math
import random
import zlib

import pytest

from fernglass.llm import toxicity
from fernglass.llm.queries import QUERIES

TERMS = ("women", "muslims", "immigrants", "gardeners", "sailors")


def corpus(n=600, seed=5):
    """Texts in which an insult is toxic, and terms of three groups stand mostly in toxic texts."""
    rnd = random.Random(seed)
    neutral = "the a river walks over stone bridge evening music table garden window paper green slow early".split()
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [rnd.choice(neutral) for _ in range(25)]
        if rnd.random() < (0.8 if toxic else 0.05):
            w[rnd.randrange(25)] = rnd.choice(TERMS[:3])
        if toxic and rnd.random() < 0.8:
            w[rnd.randrange(25)] = rnd.choice(["wretchling", "wretchhead", "dungface"])
        docs.append((i, " ".join(w[:12]).capitalize() + ". " + " ".join(w[12:]) + "!"))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def score_of(model, text):
    """The model's sum, without tables of pieces."""
    found = {f for x in toxicity.words(text.split()) for w in x for f in toxicity.features([w])[0].tolist() if f in model.weights}
    return 1 / (1 + math.exp(-model.bias - sum(model.weights[f] for f in found)))


def test_swaps_hold_scores_still(tables):
    plain = toxicity.fit(*tables, terms=TERMS, strength=0.0)
    fair = toxicity.fit(*tables, terms=TERMS)
    mentions = [f"The {t} walk over the stone bridge early." for t in TERMS]
    change = lambda m: max(score_of(m, x) for x in mentions) - min(score_of(m, x) for x in mentions)
    assert change(plain) > 0.5 and change(fair) < 0.1
    neutral = [f"{a} and {b} walk over the bridge" for a in TERMS for b in TERMS]
    wrong = lambda m: sum(score_of(m, x) >= 0.5 for x in neutral)
    assert wrong(plain) > 5 and wrong(fair) == 0
    assert score_of(fair, "what a wretchling") > 0.5 > score_of(fair, "what a river")  # insults are still found


def test_scores_beside_plain_sums(spark, tables, awkward):
    model = toxicity.fit(*tables, terms=TERMS)
    texts = [(1, None), (2, ""), (3, "Wretchling! " + "calm words " * 50_000), (4, "ＷＲＥＴＣＨhead"), (4, "wretchlings, women"), (None, "dungface"), (6, "x" * 100_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'y' as score", "2 as predicted")
    got = {(r.doc_id, r.predicted, r.held_out, round(r.score, 9)) for r in toxicity.score(df, model).collect()}
    assert got == {(i, int(s >= 0.5), i is not None and zlib.crc32(str(i).encode()) % 5 == 0, round(s, 9)) for i, t in texts for s in [score_of(model, t or "")]}
    assert toxicity.score(awkward, model).count() == awkward.count()
    assert toxicity.score(df.limit(0), model).collect() == []


def test_sample(spark, tables):
    docs, labels = tables
    odd = labels.union(spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (10_000, 1)], "doc_id long, toxic int"))
    got = toxicity.labelled_sample(docs, odd).collect()
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len({*range(600)}.difference(held, [1]))  # 1 has labels that disagree
    assert toxicity.labelled_sample(docs, labels, rows=10).count() == 10


def test_labels_of_one_kind_or_none(spark, tables):
    docs, labels = tables
    for own in (labels.where("toxic = 0"), labels.limit(0)):
        model = toxicity.fit(docs, own)
        assert not model.weights and model.bias <= 0
    assert toxicity.fit(docs.limit(0), labels).weights == {}


def test_swaps():
    assert toxicity.swaps_of("women", TERMS, 2) == ["muslims", "immigrants", ""]
    assert toxicity.swaps_of("sailors", TERMS, 9) == ["women", "muslims", "immigrants", "gardeners", ""]
    features = {"women": (1, 2), "muslims": (2, 3), "immigrants": (4,), "and": (3,)}
    assert toxicity.swapped(["women", "and"], TERMS, 1, features) == [((), (1,)), ((), (1, 2))]
    assert toxicity.swapped(["muslims", "x", "women"], TERMS, 1, features) == [((4,), (3,)), ((), (3,)), ((), (1,)), ((), (1,))]
    assert toxicity.swapped(["no", "terms"], TERMS, 1, features) == []


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = QUERIES["op12_toxicity"](spark, d).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.score for r in got if r.toxic == 1]
    clean = [r.score for r in got if r.toxic == 0]
    above = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean) / len(toxic) / len(clean)
    assert above > 0.93, above
    assert sum(s >= 0.5 for s in toxic) >= 0.85 * len(toxic)
    assert sum(s >= 0.5 for s in clean) <= 0.005 * len(clean)
