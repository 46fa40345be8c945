"""Fingerprints, mixing and quality rules beside brute force."""

import hashlib
import re
import unicodedata

import pytest

from fernglass.llm import fingerprint, mixing, quality_rules

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def canon(t):
    n = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"\s+", " ", n).strip(" ")


@pytest.mark.parametrize("bits", [64, 3])
def test_fingerprints(spark, bits):
    texts = ["Ａbc  d", "abc d", "ABC\nD ", "abcd", "", None, "ﬁne", "fine", "straße", "STRASSE", "é", "é", " x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df, bits=bits).collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (got[i] == got[j]) == (canon(a) == canon(b)), (a, b)


def brute_edits(rows):
    rows = sorted(rows)
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), float(canon(t) == canon(e)), float(canon(t) == canon(nxt))))
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 5])
def test_edited(spark, bits):
    rows = [(i * 3, t) for i, t in enumerate(["abcd efgh", "abcd efgh", "ABCD  efgh", "xyz", "", "q", "日本語テキスト\U0001f600!", "abcd efgh" * 50])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprint.edited_fingerprints(df, bits=bits).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == brute_edits(rows)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[0] == prints[3] == prints[6] != prints[9] and len(set(prints.values())) == 6


def test_edited_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    got = fingerprint.edited_fingerprints(df).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == brute_edits([(r.doc_id, r.text) for r in df.collect()])


def test_edited_awkward(awkward, empty):
    got = fingerprint.edited_fingerprints(awkward).collect()
    assert len(got) == awkward.count()
    assert fingerprint.edited_fingerprints(empty).collect() == []
    assert fingerprint.fingerprints(awkward).count() == awkward.count()


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        per = (left - sum(most * sizes[s] for s in full)) / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if w[s] * per >= most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else w[s] * per for s in names}
        full |= set(over)


def check_mix(df):
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in df.collect()]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = brute_targets(sizes)
    mix = mixing.mix(df)
    got = mix.taken().collect()
    assert sorted((r.doc_id or -1, r.source or "", r.size) for r in got) == sorted((d or -1, s or "", n) for d, s, n in rows)
    taken = {}
    for r in got:
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(df.repartition(3)).taken().collect()
    key = lambda r: (r.doc_id or -1, r.source or "", r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    # the mix is one global order by finish time, cut where the running total reaches the budget
    order = mix.in_order().collect()
    assert [(r.finish, r.place) for r in order] == sorted((r.finish, r.place) for r in order)
    at = 0
    for r in order:
        assert r.place == at and r.words > 0
        at += r.words
    assert at == sum(round(w) for w in want.values())


def test_mix_documents(spark):
    check_mix(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_mix_with_one_long_document(spark):
    """The document that a source serves when the budget ends is parted there, so the source gets its target."""
    rows = [(0, "w " * 5000, "long")] + [(i, "a b c d e f g", f"s{i % 3}") for i in range(1, 400)]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_mix_awkward(awkward, empty):
    check_mix(awkward)
    assert mixing.mix(empty).taken().collect() == mixing.mix(empty).served.collect() == []


def brute_statistics(t):
    w = WORD.findall(t or "")
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered)


@pytest.mark.parametrize("which", ["awkward", "documents"])
def test_statistics(spark, awkward, which):
    df = awkward if which == "awkward" else spark.read.parquet(f"{DATA}/documents.parquet")
    got = quality_rules.judge(df.select("doc_id", "text", "lang"), []).collect()
    for r in got:
        want = brute_statistics(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)


def test_clashing_columns_and_filters(awkward, empty):
    out = quality_rules.judge(awkward, [])
    assert out.where("kept").count() == sum(r.kept for r in out.collect())
    assert quality_rules.judge(empty, []).collect() == []


def test_rules_on_held_out_labels(spark):
    """Learned on the small tables, judged on the labels of others."""
    small, other = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
    rules = quality_rules.fit(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    assert rules and all(len(r) <= 4 for r in rules)
    judged = quality_rules.judge(spark.read.parquet(f"{other}/documents.parquet"), rules).join(spark.read.parquet(f"{other}/labels.parquet"), "doc_id").where("not base_failed").collect()
    wrong = sum(r.kept != (r.quality == 1) for r in judged)
    assert wrong <= 0.03 * len(judged)


def test_learning_finds_a_conjunction():
    rows = [{f: 0.0 for f in quality_rules.FEATURES} | {"symbols": i % 10 / 10, "upper": i // 10 % 10 / 10, "low": int(i % 10 >= 7 and i // 10 % 10 >= 5), "part": i % 3, "key": i} for i in range(400)]
    rules = quality_rules.learn(rows)
    judged = [any(all(c.holds(r) for c in rule) for rule in rules) for r in rows]
    assert judged == [bool(r["low"]) for r in rows]


def test_no_labels(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.fit(empty, labels) == []
