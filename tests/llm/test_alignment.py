"""Operator 11 beside a plain reading of two tokenizers' bytes, on awkward texts and on the smallest table."""

import collections
import hashlib

import pytest
import sentencepiece
from tokenizers import Tokenizer

from fernglass.llm import token_alignment
from fernglass.llm.queries import tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
ODD = [
    (1, "a b"), (2, ""), (3, None), (4, "  lead and  double\n\n\nlines \n x\t\ty \r\n z "), (5, "tab\tonly　wide\xa0 nb"), (6, "bad ▁ char"), (7, " "), (8, "\n"), (9, "\na"), (10, "a\n"),
    (11, "日本語 \U0001f600 text's don't <|endoftext|> <s> </s> <0x0A>"), (12, "x" * 3000), (13, "a b"), (13, "a b"), (None, "word\n foo \nbar"), (15, "\x00\x01 nul\x1cfs"), (16, "é ﬁ ① half"), (17, "1234 5678,90 == -- !!"), (18, "the end " * 20_000),
]


def brute(docs):
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    count, out = collections.Counter(), []
    for doc_id, text in docs:
        raw = f" {text}".encode()
        a, b = [], []
        if text:
            got = a_model.encode(f" {text}", add_special_tokens=False)
            a = [(i, bytes(letter[c] for c in t)) for i, t in zip(got.ids, got.tokens)]
            b = [(i, bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()) for i in b_model.encode(text)]
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            out.append((doc_id, [], [], [], []))
            continue
        owner = [k for k, (_, x) in enumerate(a) for _ in x], [k for k, (_, x) in enumerate(b) for _ in x]
        links = sorted(set(zip(*owner)))
        ends = [{p + 1 for p in range(len(raw)) if p + 1 == len(raw) or own[p] != own[p + 1]} for own in owner]
        groups, first = [], 0
        for end in sorted(ends[0] & ends[1]):
            groups.append([sorted(set(own[first:end])) for own in owner])
            first = end
        out.append((doc_id, [i for i, _ in a], [i for i, _ in b], links, groups))
        count.update((a[i][0], b[j][0]) for i, j in links)
    best = collections.Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    rows = []
    for doc_id, a, b, links, groups in out:
        n = [count[a[i], b[j]] for i, j in links]
        top = sum(count[a[i], b[j]] == best[b[j]] for i, j in links)
        text = ";".join("|".join(",".join(str(ids[k]) for k in own) for ids, own in zip((a, b), g)) for g in groups)
        rows.append((doc_id, len(a), len(b), len(groups), len(links), top, sum(n), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return rows, out


def in_order(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'x' as links", "1 as chunk").repartition(3)


def test_report_of_awkward_texts(spark, odd):
    assert in_order(map(tuple, token_alignment.link_report(odd, A, B).collect())) == in_order(brute(ODD)[0])


@pytest.mark.parametrize("setting", [{"ROOM": 5}, {"CALL": 2}, {"LONG": 1}])
def test_units_however_they_are_kept(monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(token_alignment, name, value)
    pair = token_alignment.Pair(A, B)
    got = []
    for _, t in ODD:
        x = token_alignment.align(pair, [t or "", "between", t or ""])
        assert x.n_a[0] == x.n_a[2] and x.n_links[0] == x.n_links[2]
        got.append((x.n_a[0], x.n_b[0], x.n_groups[0], x.n_links[0]))
    assert got == [r[1:5] for r in brute(ODD)[0]]


def test_report_in_small_chunks(spark):
    """Chunks of a few links, rows of a few pairs: many chunks in a task and many rows in a chunk."""
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(2)
    assert in_order(map(tuple, token_alignment.link_report(df, A, B, links=40, row=7).collect())) == in_order(brute(ODD)[0])


def test_groups_and_links(spark, odd):
    got = {}
    for r in token_alignment.alignments(odd, A, B).collect():
        got.setdefault(r.doc_id, []).append((r.a, r.b, [tuple(x) for x in r.links], [tuple(x) for x in r.groups]))
    for doc_id, a, b, links, groups in brute(ODD)[1]:
        assert (a, b, links, [(g[0][0], g[1][0]) for g in groups]) in got[doc_id]


def test_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert in_order(map(tuple, token_alignment.link_report(df, A, B).collect())) == in_order(brute(docs)[0])


def test_empty_and_null_tables(spark, odd):
    assert token_alignment.link_report(odd.limit(0), A, B).collect() == []
    nulls = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [tuple(r) for r in token_alignment.link_report(nulls, A, B).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")]


def test_whole_texts_where_units_arent_sure(spark, odd):
    pair = token_alignment.Pair(A, B)
    by_unit = pair.encode([t or "" for _, t in ODD])
    pair.parts = False
    assert pair.encode([t or "" for _, t in ODD]) == by_unit


def test_only_vocabularies_with_bytes():
    with pytest.raises(ValueError, match="byte-level"):
        token_alignment.Side(tokenizer("word_bpe_49k.json"))
