"""Each stage of the pipeline beside brute force on its own input."""

import corpus_pipeline as P
from fernglass.llm import common

from test_dedup import brute_groups, brute_lines

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    common.prepare(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, DATA), name)
        seen[name] = (before, docs)
        assert docs.columns == columns or name == P.STAGES[-1][0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"][1].collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(labels.get(d) == 0 for d in kept) <= 1 and len(kept & set(clean)) >= 0.8 * len(clean)
    rows = [(r.doc_id, r.text) for r in seen["lines"][0].collect()]
    assert {r.doc_id: r.text for r in seen["lines"][1].collect()} == {d: t for d, _, _, t in brute_lines(rows) if t.strip(" \t\n\r\x0b\x0c")}
    groups = brute_groups([(r.doc_id, r.text) for r in seen["near"][0].collect()], 5, 80)
    assert {r.doc_id for r in seen["near"][1].collect()} == {d for d, _, c in groups if d == c}
    one = {r.doc_id: r.text for r in seen["mixture"][0].collect()}
    mixed = seen["mixture"][1].collect()
    assert all(one[r.doc_id] == r.text for r in mixed) and max(sum(r.doc_id == d for r in mixed) for d in one) <= 2
    words = lambda t: len((t or "").split())
    assert abs(sum(words(r.text) for r in mixed) - 1.5 * sum(map(words, one.values()))) < 0.25 * sum(map(words, one.values()))
    packed = seen["packed"][1].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed} and max(r.offset + r.length for r in packed) <= 4096


def test_near_and_packed_without_ids(spark):
    """Rows without an id, or of one id, are dropped each by its own text, and are packed in many groups."""
    common.prepare(spark)
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(i, words(i)) for i in range(20)] + [(None, words(i)) for i in range(10, 60)] + [(5, words(i)) for i in range(55, 65)] + [(None, words(70)), (None, words(70) + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in P.near(spark, docs, DATA).collect()]
    want = [(i, words(i)) for i in range(20)] + [(None, words(i)) for i in range(20, 55)] + [(5, words(i)) for i in range(55, 65)]
    assert sorted((d or -1, t) for d, t in got if not t.startswith("w70x")) == sorted((d or -1, t) for d, t in want)
    assert sum(t.startswith("w70x") for _, t in got) == 1
    assert len({r.sequence_id >> 40 for r in P.packed(spark, docs.where("doc_id is null"), DATA).collect()}) > 1


def test_stages_on_nothing(spark):
    common.prepare(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = common.written(stage(spark, docs, DATA), name)
        assert docs.count() == 0


def test_stages_on_awkward_rows(spark, awkward):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like those that stages make."""
    from pyspark.sql import functions as F

    common.prepare(spark)
    clash = awkward.withColumns({"_pass": F.lit("p"), "finish": F.lit(0.5), "row": F.lit(7), "key": F.lit("k"), "c0": F.lit("c"), "n_lines": F.lit("n"), "place": F.lit(1), "n_chars": F.length("text").cast("long")})
    for name, stage in P.STAGES:
        out = common.written(stage(spark, clash, DATA), name)
        if name == "packed":
            assert out.select("doc_id").distinct().count() == clash.select("doc_id").distinct().count()
            continue
        assert out.columns == clash.columns and (out.count() > 0 or name == "quality")  # the base rule refuses all of them
        fixed = [c for c in clash.columns if c not in ("text", "n_chars")]
        assert {tuple(r) for r in out.select(fixed).collect()} <= {tuple(r) for r in clash.select(fixed).collect()}


def test_mixture_is_in_the_order_of_the_mix(spark):
    """Rows come by virtual finish time: at every tenth of the mix the sources have had about their shares."""
    common.prepare(spark)
    rows = [(i, "a b c d e f g h", "en", f"s{i % 3}", 15) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [r.source for r in P.mixture(spark, docs, DATA).collect()]
    share = {s: out.count(s) / len(out) for s in set(out)}
    for k in range(1, 10):
        part = out[: k * len(out) // 10]
        assert all(abs(part.count(s) / len(part) - share[s]) < 0.02 for s in share)
