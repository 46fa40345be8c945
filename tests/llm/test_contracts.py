"""The registered queries on the smallest tables: columns, types, and values beside brute force."""

import hashlib
import zlib

import __spark_entry__
import pytest
from tokenizers import Tokenizer

from fernglass.llm.queries import tokenizer
from test_dedup import brute_groups, brute_lines, brute_repeats
from test_native import WORD, brute_edits, brute_statistics, brute_targets

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_html_extract": "page_id bigint, url string, text string, n_chars bigint",
    "op2_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op3_fingerprint": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op5_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_token_orc": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op10_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op11_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op12_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op13_centroids": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
}
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())


@pytest.fixture(scope="module")
def ids(docs):
    return dict(zip([d for d, _, _ in docs], [x.ids for x in Tokenizer.from_file(tokenizer()).encode_batch([t for _, t, _ in docs], add_special_tokens=False)]))


@pytest.fixture(scope="module")
def results(spark):
    kept = {}

    def get(name):
        if name not in kept:
            df = __spark_entry__.queries()[name](spark, DATA)
            assert [f"{c} {k}" for c, k in df.dtypes][: COLUMNS[name].count(",") + 1] == COLUMNS[name].split(", ")
            kept[name] = df.collect()
        return kept[name]

    return get


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pages(spark, results):
    got = results("op1_html_extract")
    assert sorted(r.page_id for r in got) == sorted(r.page_id for r in spark.read.parquet(f"{DATA}/pages.parquet").collect())
    assert all(r.n_chars == len(r.text) and r.text == "\n".join(" ".join(x.split()) for x in r.text.split("\n")) for r in got)


def test_repeats(docs, results):
    def removed(text, cover):
        spans, on = 0, False
        for c in cover:
            spans += c and not on
            on = bool(c)
        return sum(cover), spans

    seen, want = set(), []
    for d, t, _ in docs:
        b = t.encode()
        cover = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                cover[s : s + 100] = b"\1" * 100
            seen.add(w)
        want.append((d, len(b), *removed(b, cover), sha(bytes(c for c, g in zip(b, cover) if not g))))
    assert [w[4] for w in want] == [sha(x) for x in brute_repeats([t.encode() for _, t, _ in docs])]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in results("op2_suffix_dedup")) == want


def test_fingerprints(docs, results):
    got = results("op3_fingerprint")
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == brute_edits([(d, t) for d, t, _ in docs])
    by_text = {}
    prints = {r.doc_id: r.fingerprint for r in got}
    for d, t, _ in docs:
        assert by_text.setdefault(t, prints[d]) == prints[d]


def test_packing(docs, ids, results):
    got, per, seqs = results("op4_packing"), {}, {}
    for r in got:
        per.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id]) + 1
    for d, _, _ in docs:
        at = 0
        for s, n, c in sorted(per[d]):
            assert s == at and n > 0 and c == crc((ids[d] + [2])[s : s + n])
            at += n
        assert at == len(ids[d]) + 1
    padding = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.02 * sum(len(x) + 1 for x in ids.values())


def test_mixing(docs, results):
    size = lambda t: len(WORD.findall(t))
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    want, got, taken = brute_targets(sizes), results("op5_mixing"), {}
    source = {d: s for d, _, s in docs}
    assert sorted((r.doc_id, r.size, r.source_size) for r in got) == [(d, size(t), sizes[s]) for d, t, s in docs]
    for r in got:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.taken <= 2 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_token_files(docs, ids, results):
    at, want = 0, []
    for d, _, _ in docs:
        x = ids[d] + [1]
        want.append((d, at, len(x), crc(x)))
        at += len(x)
    assert sorted(tuple(r) for r in results("op6_token_orc")) == want


def test_token_counts(docs, ids, results):
    assert sorted(tuple(r) for r in results("op7_token_counts")) == [(d, len(t.encode()), len(ids[d]), len(ids[d]) > 2048) for d, t, _ in docs]


def test_quality(docs, results):
    got = {r.doc_id: r for r in results("op8_quality_rules")}
    for d, t, _ in docs:
        r, want = got[d], brute_statistics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_groups(docs, results):
    got = results("op9_minhash")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups([(d, t) for d, t, _ in docs], 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_lines(docs, results):
    assert sorted(tuple(r) for r in results("op10_line_dedup")) == [(d, n, k, sha(t.encode())) for d, n, k, t in brute_lines([(d, t) for d, t, _ in docs])]


def test_pipeline(spark):
    got = __spark_entry__.queries()["pipeline"](spark, DATA).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
