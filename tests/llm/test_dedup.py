"""Repeats, shared lines and near duplicates beside brute force."""

import re

import pytest
from pyspark.sql import functions as F

from fernglass.llm import line_dedup, minhash, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"
LAST = (1 << 63) - 1


def brute_repeats(rows, n=100):
    seen, out = set(), []
    for text in rows:
        covered = bytearray(len(text))
        for s in range(len(text) - n + 1):
            if (w := text[s : s + n]) in seen:
                covered[s : s + n] = b"\1" * n
            else:
                seen.add(w)
        out.append(bytes(c for c, gone in zip(text, covered) if not gone))
    return out


def check_repeats(df, common_runs=65_536):
    got = sorted(((LAST if r.doc_id is None else r.doc_id), bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, common_runs=common_runs).collect())
    rows = df.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(0x7FFF).alias("g"), F.coalesce("text", F.lit("")).alias("t")).distinct().orderBy("d", "g").collect()
    want = sorted((r.d, kept) for r, kept in zip(rows, brute_repeats([r.t.encode() for r in rows])))
    assert sorted(set(got)) == want


def test_repeats_on_documents(spark):
    check_repeats(spark.read.parquet(f"{DATA}/documents.parquet"))


@pytest.mark.parametrize("common_runs", [65_536, 0])
def test_repeats_in_awkward_texts(spark, awkward, common_runs):
    check_repeats(awkward, common_runs)


def test_repeats_periodic_and_shifted(spark):
    base = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(700))
    rows = [(1, "a" * 1000), (2, "ab" * 300), (3, "xy" + "ab" * 200 + "q"), (4, base), (5, "zz" + base[50:400] + "!" + base[:120]), (6, base[::-1]), (7, base[:99]), (8, base[:100]), (9, "abc" * 70 + base[300:] + "abc" * 70)]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"))


def test_repeats_of_nothing(empty):
    assert suffix_dedup.remove_repeats(empty).collect() == []


@pytest.mark.parametrize("common_runs", [65_536, 0])
def test_repeats_of_many_texts_under_a_null_id(spark, common_runs):
    """2,000 different texts without an id: each keeps what is its own, and loses only the passage that all share."""
    shared = "a passage that every one of these rows holds, so it is left in one of them and is cut from all the others; " * 2
    words = lambda i: " ".join(f"{(i * 2654435761 + j * 40503 + i * j * 97) % 1000003:x}" for j in range(20 + i % 60))
    rows = [(None, words(i) + (shared if i % 3 == 0 else "")) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(bytes(r.kept) for r in suffix_dedup.remove_repeats(df, common_runs=common_runs).collect())
    order = df.select("text").orderBy(F.xxhash64("text")).collect()
    assert got == sorted(brute_repeats([r.text.encode() for r in order]))


def test_equal_keys_of_unequal_bytes():
    """Where hashes agree and bytes don't, bytes decide."""
    import numpy as np

    data = np.frombuffer(b"aaaabbbbaaaacccc", np.uint8)
    at = np.array([0, 4, 8, 12])
    same = np.zeros(4, np.uint64)
    assert suffix_dedup._repeats(same, at, data, 4).tolist() == [False, False, True, False]
    assert suffix_dedup._repeats(np.array([1, 2, 1, 3], np.uint64), at, data, 4).tolist() == [False, False, True, False]


def test_repeats_in_repeated_rows(spark):
    """Rows of one id and one text are one document: none of them loses what only they hold."""
    import random

    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefghij ") for _ in range(400))
    df = spark.createDataFrame([(1, text)] * 50 + [(2, text + "!")], "doc_id long, text string").repartition(4)
    got = {(r.doc_id, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {(1, text.encode()), (2, b"!")}


def brute_lines(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))
    holders = {}
    for d, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_lines(spark, awkward, which):
    df = awkward if which == "awkward" else spark.read.parquet(f"{DATA}/documents.parquet").repartition(3)
    got = line_dedup.drop_lines(df).collect()
    rows = [(LAST if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect()]
    assert sorted((LAST if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got) == brute_lines(rows)
    assert got[0].lang is None or isinstance(got[0].lang, str)


def test_lines_with_clashing_columns(spark):
    rows = [(1, "one line that is long\nother", 7, "x"), (2, "one line that is long\nmore", 8, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, n_dropped string")
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(df).collect()) == [(1, rows[0][1], 2, 0), (2, "more", 2, 1)]
    assert sorted(tuple(r) for r in line_dedup.drop_lines(df, counts=False).collect()) == [rows[0], (2, "more", 8, "y")]


def test_lines_of_nothing(empty):
    out = line_dedup.drop_lines(empty)
    assert out.collect() == [] and out.columns[:3] == ["doc_id", "text", "lang"]


def brute_groups(rows, k, percent):
    def shingle(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(LAST if d is None else d, shingle(t)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y) and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return sorted((d, len(s), top(d)) for d, s in sets)


@pytest.mark.parametrize("shingle,small", [(2, 8), (5, 1)])
def test_groups_on_documents(spark, shingle, small):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    got = minhash.near_duplicates(df, shingle=shingle, small=small).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups([(r.doc_id, r.text) for r in df.collect()], shingle, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_of_edited_copies(spark):
    """A large group whose members differ: some pairs are linked through others only, some not at all."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(words)
        for j in range(i % 12):
            w[(i * 37 + j * 11) % 120] = f"e{i}-{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows, 2, 80)
    got = minhash.near_duplicates(df, shingle=2, small=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert 1 < len({c for _, _, c in want}) < 60


def test_groups_by_rare_shingles(spark):
    """One large bucket of texts that share most of their words: every link is found, though none is compared with all."""
    import random

    rnd = random.Random(4)
    core = [f"c{i}" for i in range(100)]
    rows = []
    for i in range(240):
        own = [f"o{i % 80}x{j}" for j in range(18 + i % 5)]  # three texts of each kind are alike, the kinds are not
        w = core + own
        if i >= 80:
            w[rnd.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, shingle=2, small=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, 2, 80)


def test_recall_just_above_the_threshold(spark):
    """2,000 pairs whose likeness is from 0.80 to 0.82: at least 99.9 % are linked, and none of 500 pairs just below."""
    import random

    rnd = random.Random(9)
    rows, want = [], {}
    for p in range(2500):
        n = rnd.randrange(120, 300)
        common = -(-n * (80 if p < 2000 else 78) // 100)
        a = [f"p{p}w{j}" for j in range(n - 1 + 2)]
        # sets of 2-word shingles: the first words are shared, what follows is not
        size = common
        while p < 2000 and size + 1 <= n and (size + 1) / (2 * n - size - 1) <= 0.82:
            size += 1
        while 100 * size < 80 * (2 * n - size) and p < 2000:
            size += 1
        shared = a[: size + 1]
        x = shared + [f"p{p}x{j}" for j in range(n - size)]
        y = shared + [f"p{p}y{j}" for j in range(n - size)]
        rows += [(2 * p, " ".join(x)), (2 * p + 1, " ".join(y))]
        want[p] = 100 * size >= 80 * (2 * n - size)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), shingle=2).collect()}
    found = {p: got[2 * p] == got[2 * p + 1] for p in want}
    assert sum(want.values()) == 2000 and sum(found[p] for p in want if want[p]) >= 1998
    assert not any(found[p] for p in want if not want[p])


def test_groups_with_repeated_and_null_ids(spark):
    """Rows of one id, or without one, are linked each by its own text; the group has the smallest id that it reaches."""
    text = lambda i: " ".join(f"t{i}w{j}" for j in range(40))
    rows = [(5, text(1)), (5, text(2)), (None, text(2) + " end"), (None, text(3)), (9, text(3) + " end"), (7, text(1)), (None, text(4)), (8, None), (None, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(str(x) for x in [(5, 39, 5), (5, 39, 5), (None, 40, 5), (None, 39, 9), (9, 40, 9), (7, 39, 5), (None, 39, None), (8, 0, 8), (None, 0, None)])


def test_groups_in_awkward_texts(awkward, empty):
    got = minhash.near_duplicates(awkward, shingle=5).collect()
    want = brute_groups([(r.doc_id, r.text) for r in awkward.collect()], 5, 80)
    assert sorted((LAST if r.doc_id is None else r.doc_id, r.n_shingles, LAST if r.component_id is None else r.component_id) for r in got) == want
    assert minhash.near_duplicates(empty).collect() == []


def test_signatures_estimate_likeness():
    import numpy as np

    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    b = np.concatenate([a[:300], np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))])
    s = minhash.super_minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 512)
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert abs((s[0] == s[1]).mean() - true) < 0.08
    one = minhash.super_minhash(a[:2], np.array([0, 2]), 32)
    assert (one < np.iinfo(np.uint64).max).all()
