"""Queries beside brute force: those that SQL can't say, or says in the same words."""

import hashlib
import re

import numpy as np
import pytest

from fernglass.registry import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = sorted(spark.read.parquet(f"{DATA}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    v = np.array([r.embedding for r in rows], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return {r.vec_id: i for i, r in enumerate(rows)}, [r.vec_id for r in rows], [r.label for r in rows], v, np.round(u @ u.T, 9)


def nearest(vectors, q, k):
    at, ids, _, _, like = vectors
    return sorted(ids, key=lambda i: (-like[at[q], at[i]], i))[:k]


def by_query(rows):
    out = {}
    for r in rows:
        out.setdefault(r.qid, {})[r.key] = r
    return out


def test_every_twentieth_vector_is_asked_against_all(spark, vectors):
    at, ids, labels, v, like = vectors
    asked = {i for i in ids if i % 20 == 0}
    assert len(asked) > 3
    dense = by_query(QUERIES["dense_topk"](spark, DATA).collect())
    assert {q: set(x) for q, x in dense.items()} == {q: set(nearest(vectors, q, 24)) for q in asked}
    by_label = {i: n for n, i in enumerate(sorted(ids, key=lambda i: (-labels[at[i]], i))[:24], 1)}
    fused = by_query(QUERIES["rrf_fusion"](spark, DATA).collect())
    assert set(fused) == asked
    for q in asked:
        rank = {i: n for n, i in enumerate(nearest(vectors, q, 24), 1)}
        score = {i: round(sum(1 / (60 + r[i]) for r in (by_label, rank) if i in r), 9) for i in {*by_label, *rank}}
        assert set(fused[q]) == set(sorted(score, key=lambda i: (-score[i], i))[:12])
    picked = by_query(QUERIES["mmr_select"](spark, DATA).collect())
    sure = {r.qid: r.confidence for r in QUERIES["confidence"](spark, DATA).collect()}
    weak = {r.qid: r.retry for r in QUERIES["retry_weak"](spark, DATA).collect()}
    assert set(picked) == set(sure) == set(weak) == asked
    for q in asked:
        few, chosen = nearest(vectors, q, 12), []
        while len(chosen) < 8:
            near = lambda i: max((v[at[i]] @ v[at[j]] for j in chosen), default=0.0)
            chosen.append(max((i for i in few if i not in chosen), key=lambda i: 0.4 * like[at[q], at[i]] - 0.6 * near(i)))
        assert [k for k, _ in sorted(picked[q].items(), key=lambda x: x[1].pick)] == chosen
        top = nearest(vectors, q, 4)
        want = 0.5 * len({labels[at[i]] for i in top}) / 4 + 0.5 * min(1, np.mean([max(0, like[at[q], at[i]]) for i in top]))
        assert abs(sure[q] - want) < 2e-5


def test_texts_are_read_to_their_end(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet").collect()
    want = {}
    for r in read("documents"):
        n, blocks = len(r.text), []
        for s in range(0, max(n - 150, 1), 550):
            if part := r.text[s : s + 700].strip():
                lines = [r.text[:e].count("\n") + 1 for e in (s, min(s + 700, n))]
                blocks.append(f"[[{len(blocks) + 1}]] {r.doc_id}/L{lines[0]}-{lines[1]}\n{part}")
        want[r.doc_id] = hashlib.md5("\n\n".join(blocks).encode()).hexdigest()
    assert {r.qid: r.md5 for r in QUERIES["context_labels"](spark, DATA).collect()} == want
    cited = {r.item_id: r.chars for r in QUERIES["citation_aggregate"](spark, DATA).collect() if r.doc == 0}
    chars = {r.item_id: len(r.text.strip(" ")) + 7 * (r.item_id % 5 == 2) for r in read("benchmark")}
    assert cited == {i: n for i, n in chars.items() if n >= 8}
    plans = {(r.conv_id, r.turn): (r.years, r.keywords) for r in QUERIES["plan_classify"](spark, DATA).collect()}
    words = lambda t: dict.fromkeys(w for w in re.findall(r"\w+", t.lower()) if len(w) >= 2)
    assert plans == {(r.conv_id, r.turn): (",".join(re.findall(r"1[0-9]{3}|20[0-9]{2}", r.text)), ",".join(words(r.text))) for r in read("conversations") if r.role == "user"}


def units(t):
    return len(t.encode("utf-16-le")) // 2


def brute_split(text, limit):
    if units(text) <= limit:
        return [text]
    out, now = [], ""

    def put(piece, between):
        nonlocal now
        joined = now + between + piece if now else piece
        if units(joined) <= limit:
            now = joined
        else:
            out.extend([now] if now else [])
            now = piece

    for para in (p.strip("\n") for p in re.split(r"\n\s*\n", text) if p):
        if units(para) <= limit:
            put(para, "\n\n")
            continue
        for sent in (x for x in re.split(r"(?<=[。．！？!?])", para) if x):
            if units(sent) <= limit:
                put(sent, "" if now.endswith("\n") else "\n")
                continue
            out.extend([now] if now else [])
            now, piece = "", ""
            for ch in sent:
                if units(piece + ch) > limit:
                    out.append(piece)
                    piece = ""
                piece += ch
            out.append(piece)
    return out + ([now] if now else [])


@pytest.mark.parametrize("limit", [7, 20, 300])
def test_messages(spark, limit):
    from pyspark.sql import functions as F

    from fernglass.functions import text as T

    rows = ["", "short", "one. two! three? four", "a\n\nb\n\n\nc" * 6, "文。" * 30 + "長い文が続く" * 20, "\U0001f600" * 33, "x" * 50 + "!\n\n" + "y" * 10, "!\n" * 20, "one!\ntwo!" * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").union(spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("int(doc_id + 1000)", "text"))
    for r in df.select("t", T.split_message(F.col("t"), limit).alias("p")).collect():
        assert r.p == brute_split(r.t, limit)
        assert all(units(x) <= limit for x in r.p)
    got = spark.createDataFrame([(["aaa", "bb", "cccc", "d", "ee", "fff", "g"],)], "p array<string>").select(T.pack_messages(F.col("p"), 6, 3).alias("m")).first().m
    assert got == ["aaa\nbb", "cccc\nd", "ee\nfff\n\ng"]


def test_names_that_are_close(spark):
    import difflib

    from fernglass.operators import catalogue

    names = ["harbour museum north", "harbour museum", "old lighthouse point", "abc", "old lighthouse points", "église du village ancien"]
    texts = ["the harbour museum north wing", "old lighthouse pointt", "old lighthous point", "ab", "xyz", "harbour musaeum norths", "église du vilage ancien", "old lighthouze pointz"]
    n = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, ord int")
    q = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.name for r in catalogue.close_names(q, n, key="k", text="t", name="name").collect()}
    form = lambda x: x.replace(" ", "")
    want = {}
    for k, t in enumerate(texts):
        inside = [x for x in names if form(x) in form(t)]
        near = difflib.get_close_matches(form(t), [form(x) for x in names], n=1, cutoff=0.92)
        if inside or near:
            want[k] = inside[0] if inside else next(x for x in names if form(x) == near[0])
    assert got == want and 3 <= len(want) < len(texts)


def test_rewrites(spark):
    from fernglass.operators import synonyms

    g = spark.createDataFrame([(1, "beach", ["shore", "sand"]), (2, "boat", ["ferry"]), (3, "food", ["meal"])], "ord int, tag string, aliases array<string>")
    q = spark.createDataFrame([(1, "shore and ferry", ["shore", "ferry"]), (2, "nothing here", ["meal", "here"]), (3, "plain", ["plain"]), (4, "beach sand", ["beach", "sand"]), (5, " ", [])], "qid int, question string, keywords array<string>")
    got = {}
    for r in sorted(synonyms.rewrites(q, g).collect(), key=lambda r: (r.qid, r.place)):
        got.setdefault(r.qid, []).append(r.rewrite)
    assert got == {1: ["beach and ferry", "sand and ferry", "shore and boat"], 2: ["food here"], 4: ["shore sand", "sand sand", "beach beach", "beach shore"]}


def test_answers_that_stay_on_topic(spark):
    from pyspark.sql import functions as F

    from fernglass.functions import text as T

    one = lambda t, k: spark.createDataFrame([(t, k)], "t string, k array<string>").select(T.on_topic(F.col("t"), F.col("k")).alias("x")).first().x
    answer = "### 要約\nHarbour カフェ\nother\n\n### 詳細\n- none\n\n### 出典\n- a"
    assert one(answer, ["かふぇ"]) == "### 要約\nHarbour カフェ\n\n### 出典\n- a"
    assert one(answer, ["none"]) == "### 要約\n\n### 詳細\n- none\n\n### 出典\n- a"
    assert one(answer, []) == answer and one(None, ["a"]) is None and one("free text\nline", ["zz"]) == "free text\nline"


def test_what_goes_out_and_what_was_answered(spark):
    import json

    events = sorted(spark.read.parquet(f"{DATA}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id))
    day, sent, last, want, repeated = 86_400, {}, {}, {}, {}
    for r in events:
        key = json.loads(r.props).get("k")
        key = None if key is None else str(key)
        t, text = r.ts.timestamp(), "" if r.event_type == "error" else r.event_type
        state = sent.setdefault(r.user_id, {})
        for k in [k for k, at in state.items() if t - at > day]:
            del state[k]
        want[r.event_id] = bool(text) and (("r", key) in state or ("h", text) in state)
        if text and not want[r.event_id]:
            state["h", text] = t
            if key:
                state["r", key] = t
        mine = last.setdefault(r.user_id, [])
        repeated[r.event_id] = key in mine
        if key not in mine:
            mine.append(key)
            del mine[:-10]
    assert {r.event_id: r.suppressed for r in QUERIES["response_suppression"](spark, DATA).collect()} == want and any(want.values())
    assert {r.event_id: r.repeated for r in QUERIES["answered_before"](spark, DATA).collect()} == repeated and any(repeated.values())
    ways = {r.event_id: r.way for r in QUERIES["outbound_ways"](spark, DATA).collect()}
    assert set(ways.values()) == {"reply", "push"} and not {r.event_id for r in events if r.event_type == "error"} & set(ways)
