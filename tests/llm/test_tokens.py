"""Encoding, counts, ORC and packing beside the library itself."""

import zlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fernglass.llm import common, packing, token_counts, token_orc, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
IDS = lambda t: LIB.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA zZ'é.,!s\n\t<|startoftext|>１  ́")), max_size=60))
def test_encoder_is_the_library(text):
    got = array("I")
    got.frombytes(tokens.encoder(PATH).encode(text.encode()))
    assert got.tolist() == IDS(text)


def test_small_table_gives_the_same():
    small, text = tokens.Encoder(PATH, room=4), b"One two, three! two three four five six ONE two <|endoftext|> don't " * 5
    got = array("I")
    got.frombytes(small.encode(text))
    assert got.tolist() == IDS(text.decode())
    assert tokens.Encoder(PATH, count=True, room=3).length(text) == len(got)


def test_counts(awkward, empty):
    got = token_counts.count_tokens(awkward, PATH).collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(IDS(r.text))) for r in awkward.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.count_tokens(empty, PATH).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_other_tokenizers(awkward, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        lib = Tokenizer.from_file(path)
        own = lambda t: lib.encode(t, add_special_tokens=False).ids
    got = token_counts.count_tokens(awkward, path).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(own(r.text or "")) for r in awkward.collect())


def test_orc_round_trip(spark, awkward, empty, tmp_path):
    path = str(tmp_path / "orc")
    token_orc.write_token_orc(awkward, path, PATH, end_id=1)
    rows = token_orc.read_token_orc(spark, path).orderBy("start").collect()
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    assert sorted(r.ids for r in rows) == sorted(IDS(r.text) + [1] for r in awkward.collect())
    got = {(r.start, r.n_tokens, r.ids_crc32) for r in token_orc.token_digests(spark, path).collect()}
    assert got == {(r.start, r.n_tokens, zlib.crc32(array("I", r.ids).tobytes())) for r in rows}
    assert [r.doc_id for r in spark.read.orc(path).where("doc_id = 9").collect()] == [9]
    token_orc.write_token_orc(empty, str(tmp_path / "none"), PATH, end_id=1)
    assert spark.read.schema("doc_id long, ids array<int>").orc(str(tmp_path / "none")).count() == 0


def test_texts_together_are_texts_alone(awkward):
    own = [(r.text or "").encode() for r in awkward.collect()]
    alone = [tokens.Encoder(PATH).encode(t) for t in own]
    assert tokens.Encoder(PATH).encode_all(own) == alone and tokens.Encoder(PATH, room=3).encode_all(own * 2) == alone * 2


def test_orc_files_follow_by_number(spark):
    rows = spark.createDataFrame([("part-100000-x.orc", 0, 5), ("part-99999-x.orc", 0, 7), ("part-99999-x.orc", 1, 2)], "file string, pos long, n_tokens long")
    assert sorted((r.file, r.pos, r.start) for r in token_orc._with_start(rows, rows).collect()) == [("part-100000-x.orc", 0, 9), ("part-99999-x.orc", 0, 0), ("part-99999-x.orc", 1, 7)]


def test_orc_reads_skip_row_groups(spark, tmp_path):
    """A reader that asks for one id decodes one row group of those in the file: its metadata tell the others apart."""
    import pyarrow.orc

    path = str(tmp_path / "orc")
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('word ', id) as text").repartition(1)
    token_orc.write_token_orc(docs, path, PATH, end_id=1, index_rows=1000)
    files = sorted(str(p) for p in tmp_path.glob("orc/part-*.orc"))
    assert sum(pyarrow.orc.ORCFile(f).nrows for f in files) == 20_000
    found = spark.read.orc(path).where("doc_id = 12345")
    assert [r.doc_id for r in found.collect()] == [12345]
    scan = found._jdf.queryExecution().executedPlan()
    found._jdf.queryExecution().toRdd().count()
    while not scan.metrics().contains("numOutputRows"):
        scan = scan.children().head()
    leaf = scan
    while leaf.children().size():
        leaf = leaf.children().head()
    assert leaf.metrics().apply("numOutputRows").value() <= 2 * 4096


@given(st.lists(st.integers(1, 16), max_size=60))
def test_first_fit_is_first_fit(lengths):
    rooms, want = [], []
    for n in lengths:
        b = next((i for i, r in enumerate(rooms) if r >= n), len(rooms))
        if b == len(rooms):
            rooms.append(16)
        rooms[b] -= n
        want.append(b)
    assert packing.first_fit(lengths, 16) == want


def test_packing(spark, awkward, empty):
    rows = packing.pack(awkward, PATH, end_id=2, room=64, slack=2, with_ids=True).collect()
    seqs, total = {}, 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == seqs.get(r.sequence_id, 0) and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        seqs[r.sequence_id] = r.offset + r.length
        total += r.length
    want = [IDS(r.text) + [2] for r in awkward.collect()]
    assert total == sum(map(len, want)) and max(seqs.values()) <= 64
    padding = sum(64 - n for n in seqs.values() if n & (n - 1))
    assert padding <= 0.05 * total
    unique = {r.doc_id: IDS(r.text) + [2] for r in awkward.collect() if r.doc_id != 7}
    for key, ids in unique.items():
        mine = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == key)
        assert b"".join(x for _, x in mine) == array("I", ids).tobytes()
    assert packing.pack(empty, PATH, end_id=2).collect() == []
    common.prepare(spark)
