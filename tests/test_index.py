"""The index that grows by segments: after any changes it searches like a new one."""

import math
import random

import pytest

from fernglass.functions import text as T
from fernglass.operators import index, retrieval

TOKENS = lambda c: T.word_tokens(c)
NAMES = {"part": "part", "doc": "doc", "text": "text"}
SCHEMA = "part string, doc long, text string"
QUERIES = [(1, "a", "the old harbour of the north"), (2, "b", "the the the"), (3, "a", "unheard words"), (4, "a", "lamp"), (5, "b", "tower lamp of"), (6, "c", "the")]


def text_of(rnd):
    common, rare = "the of and a in".split(), "harbour lamp north tower old ferry shrine gate museum beach temple market".split()
    return " ".join(rnd.choice(common if rnd.random() < 0.7 else rare) for _ in range(rnd.randrange(1, 60)))


def plain(spark, docs):
    df = spark.createDataFrame([(p, d, t) for d, (p, t) in docs.items()], SCHEMA)
    posts = retrieval.postings(df, TOKENS, size=80, overlap=20, **NAMES)
    return rows(retrieval.tfidf_search(posts, retrieval.idf(df, TOKENS, size=80, overlap=20, **NAMES), asked(spark), TOKENS, k=4))


def asked(spark):
    return spark.createDataFrame(QUERIES, "qid long, part string, query string")


def rows(df):
    return sorted((r.qid, r.doc, r.chunk_index, round(r.score, 6)) for r in df.collect())


def test_any_changes_are_a_rebuild(spark, tmp_path, seed=1):
    rnd, path, docs = random.Random(seed), str(tmp_path / "index"), {}
    for step in range(3):
        new = {rnd.randrange(60): (rnd.choice("ab"), text_of(rnd)) for _ in range(30 if step == 0 else 8)}
        gone = rnd.sample(sorted(docs), min(len(docs), 5)) + [999] if step else []
        gone = [d for d in gone if d not in new]
        index.change(spark, path, spark.createDataFrame([(p, d, t) for d, (p, t) in new.items()], SCHEMA), TOKENS, removed=spark.createDataFrame([(d,) for d in gone], "doc long"), size=80, overlap=20, **NAMES)
        docs = {d: x for d, x in docs.items() if d not in gone} | new
        if step == 2:
            assert rows(index.search(index.read(spark, path), asked(spark), TOKENS, k=4)) == plain(spark, docs)
    before = rows(index.search(index.read(spark, path), asked(spark), TOKENS, k=4))
    index.compact(spark, path)
    at = index.read(spark, path)
    assert len(at.segments) == 1 and rows(index.search(at, asked(spark), TOKENS, k=4)) == before


def test_a_change_that_stops_leaves_the_index(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    docs = {1: ("a", "old lamp"), 2: ("a", "the tower")}
    df = lambda x: spark.createDataFrame([(p, d, t) for d, (p, t) in x.items()], SCHEMA)
    index.change(spark, path, df(docs), TOKENS, **NAMES)
    before = rows(index.search(index.read(spark, path), asked(spark), TOKENS))
    monkeypatch.setattr(index, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.change(spark, path, df({1: ("a", "other words")}), TOKENS, **NAMES)
    assert rows(index.search(index.read(spark, path), asked(spark), TOKENS)) == before
    with pytest.raises(ValueError, match="id"):
        index.change(spark, path, df({None: ("a", "x")}), TOKENS, **NAMES)
    with pytest.raises(FileNotFoundError):
        index.read(spark, str(tmp_path / "none"))


def test_hot_words_bring_few_windows(spark, tmp_path):
    """Windows that hold only common words aren't scored when a rare word has been found."""
    path = str(tmp_path / "index")
    rnd = random.Random(4)
    docs = [("a", d, " ".join(rnd.choice("the of and a in".split()) for _ in range(12))) for d in range(2000)] + [("a", 5000 + i, "harbour the of and old lamp") for i in range(12)]
    df = spark.createDataFrame(docs, SCHEMA)
    index.change(spark, path, df, TOKENS, **NAMES)
    at, scored, real = index.read(spark, path), [], index._scores
    try:
        index._scores = lambda i, wanted, t: (scored.append(wanted.count()), real(i, wanted, t))[1]
        got = rows(index.search(at, spark.createDataFrame([(1, "a", "the harbour of the north")], "qid long, part string, query string"), TOKENS, k=5))
    finally:
        index._scores = real
    assert [r[1] for r in got] == [5000, 5001, 5002, 5003, 5004] and sum(scored) <= 20


def test_postings_stay_with_their_windows(spark, tmp_path, monkeypatch):
    """Postings are packed by term where their windows are; with few frequent terms the others' floor still bounds all scores."""
    monkeypatch.setattr(index, "FREQUENT", 3)
    rnd, path = random.Random(2), str(tmp_path / "index")
    docs = {d: (rnd.choice("ab"), text_of(rnd) + f" only{d}") for d in range(300)}
    df = lambda x: spark.createDataFrame([(p, d, t) for d, (p, t) in x.items()], SCHEMA)
    segment = index.change(spark, path, df(docs), TOKENS, size=80, overlap=20, **NAMES)
    new = {d: (docs[d][0], "the lamp of the tower " + docs[d][1]) for d in range(0, 300, 7)}
    index.change(spark, path, df(new), TOKENS, removed=spark.createDataFrame([(5,)], "doc long"), size=80, overlap=20, **NAMES)
    docs = {d: x for d, x in (docs | new).items() if d != 5}
    assert rows(index.search(index.read(spark, path), asked(spark), TOKENS, k=4)) == plain(spark, docs)
    held = spark.read.parquet(f"{path}/{segment}/postings")
    assert held.where("term = 'the'").count() <= 2 * held.rdd.getNumPartitions() < held.where("term = 'the'").selectExpr("explode(posts)").count()


def test_a_task_holds_no_terms_of_other_windows(spark, monkeypatch):
    """Terms are counted in their window's row; rare terms' weights are looked up only where they may decide."""
    monkeypatch.setattr(retrieval, "FREQUENT", 40)
    rnd = random.Random(3)
    docs = {d: (rnd.choice("ab"), text_of(rnd) + f" only{d % 150} the") for d in range(200)}
    df = spark.createDataFrame([(p, d, t) for d, (p, t) in docs.items()], SCHEMA)
    posts = retrieval.postings(df, TOKENS, **NAMES)
    assert "Aggregate" not in posts._jdf.queryExecution().executedPlan().toString()
    tf = {(d, w): t.split().count(w) for d, (_, t) in docs.items() for w in t.split()}
    assert {(r.doc, r.term): r.tf for r in posts.collect()} == tf
    parts = {p: [d for d in docs if docs[d][0] == p] for p in "ab"}
    idf = {(p, w): math.log((len(ds) + 1) / (sum((d, w) in tf for d in ds) + 1)) + 1 for p, ds in parts.items() for d in ds for w in docs[d][1].split()}
    norm = {d: math.sqrt(sum((n * idf[docs[d][0], w]) ** 2 for (e, w), n in tf.items() if e == d)) for d in docs}
    want = []
    for qid, part, text in QUERIES:
        qv = {w: text.split().count(w) * idf[part, w] for w in text.split() if (part, w) in idf}
        dots = {d: sum(tf.get((d, w), 0) * idf[part, w] * x for w, x in qv.items()) for d in parts.get(part, [])}
        best = sorted((-round(x / norm[d] / math.sqrt(sum(y * y for y in qv.values())), 9), d) for d, x in dots.items() if x)
        want += [(qid, d, 0, round(-s, 6)) for s, d in best[:4]]
    assert rows(retrieval.tfidf_search(posts, retrieval.idf(df, TOKENS, **NAMES), asked(spark), TOKENS, k=4)) == sorted(want)
