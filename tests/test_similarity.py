"""The similarity join beside all pairs."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from fernglass.operators import catalogue, similarity


def names(n, seed=3):
    """Names of many lengths, many of them a few edits away from another, and serial numbers that share nearly everything."""
    rnd = random.Random(seed)
    parts = "taxi north island rental car star bus kaisha blue harbour 観光 交通 station hotel green".split()
    out = [f"supplier#{i:09d}" for i in range(0, 4 * n // 10, 3)]
    while len(out) < n:
        base = rnd.choice(out[len(out) // 2 :]) if rnd.random() < 0.5 and len(out) > n // 3 else " ".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 12)))
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randrange(2)] = [rnd.choice("abx ")] * rnd.randrange(2)
        out.append("".join(w))
    return out


def brute(left, right, cutoff):
    got = set()
    for t in {x for x in left if x}:
        m = difflib.SequenceMatcher(None, "", t)
        for f in {x for x in right if x}:
            m.set_seq1(f)
            if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff and m.ratio() >= cutoff:
                got.add((t, f))
    return got


@pytest.mark.parametrize("cutoff", [0.8, 0.92, 1.0])
def test_all_close_pairs(spark, cutoff):
    every = names(500 if cutoff < 0.9 else 2000)
    left = every[::2] + ["", None, "a", "ab"]
    df = lambda x: spark.createDataFrame([(t,) for t in x], "t string")
    got = {(r.l, r.r) for r in similarity.close_pairs(df(left), df(every), cutoff).collect()}
    assert got == brute(left, every, cutoff)


def test_few_pairs_are_rated(spark):
    """Serial numbers share all their trigrams but a few; those that differ in two places don't meet."""
    every = [f"supplier#{i:09d}" for i in range(0, 20_000, 11)]
    df = spark.createDataFrame([(t,) for t in every], "t string")
    assert similarity.candidates(df, df, 0.92).count() < 20 * len(every)


def test_bounds():
    assert similarity.longest_short(0.92) == 26
    with pytest.raises(ValueError, match="0.8"):
        similarity.candidates(None, None, 0.5)


def test_ten_thousand_names(spark):
    s = spark.range(10_000).select(F.col("id").alias("k"), F.format_string("Supplier#%09d", "id").alias("name"))
    asked = s.select("k", F.concat(F.substr("name", F.lit(1), F.lit(6)), F.lit("x"), F.substr("name", F.lit(8))).alias("t"))
    began = time.time()
    got = catalogue.close_names(asked, s.select("name", F.col("k").alias("ord")), key="k", text="t", name="name").collect()
    assert time.time() - began < 60  # 20 s on a machine that does nothing else
    assert len(got) == 10_000 and all(r.name == f"Supplier#{r.k:09d}" for r in got)
