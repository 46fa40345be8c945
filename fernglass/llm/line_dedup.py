"""Removal of lines that several documents share: hash ranges sorted by document and position, keep bitmaps as results."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm import common
from fernglass.llm.tokens import texts

_SPACE = b" \t\n\r\x0b\x0c"
_ROWS = "hi long, lo long, kind int, doc long, digest long, n_lines int, bits binary"


def _key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()  # bytes: A-Z only


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _scan(least: int):
    """Rows of a task's lines. kind 0: a line key's first document in the batch, with its positions; kind 1: a document,
    with the lines that an earlier document of the same batch holds already."""

    def scan(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in common.small(batches):
            docs = sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2))), key=lambda x: x[:2])
            first: dict[bytes, tuple] = {}
            rows = []
            for doc, digest, text in docs:
                lines = text.split(b"\n")
                dropped = np.zeros(len(lines), bool)
                own: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    if len(line) >= least and _long_enough(k := _key(line), least):
                        own.setdefault(k, []).append(i)
                for k, at in own.items():
                    there = first.setdefault(k, (doc, []))
                    if there[0] == doc:
                        there[1].append((digest, len(lines), at))
                    else:
                        dropped[at] = True
                rows.append((*np.frombuffer(xxhash.xxh3_128_digest(b"%d %d" % (doc, digest)), np.int64).tolist(), 1, doc, digest, len(lines), _pack(dropped)))
            for k, (doc, held) in first.items():
                hi, lo = np.frombuffer(xxhash.xxh3_128_digest(k), np.int64).tolist()
                for digest, n, at in held:
                    bits = np.zeros(n, bool)
                    bits[at] = True
                    rows.append((hi, lo, 0, doc, digest, n, _pack(bits)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], [x.split()[0] for x in _ROWS.split(", ")])

    return scan


def _pack(flags) -> bytes:
    """Flags as packed bits, compressed where that is shorter; no flag set: empty."""
    import numpy as np

    if not flags.any():
        return b""
    raw = np.packbits(flags).tobytes()
    short = zlib.compress(raw, 1) if len(raw) > 24 else raw
    return b"z" + short if len(raw) > 24 and len(short) < len(raw) else b"r" + raw


def _unpack(bits: bytes, n: int):
    import numpy as np

    if not bits:
        return np.zeros(n, bool)
    raw = zlib.decompress(bits[1:]) if bits[:1] == b"z" else bits[1:]
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _stream(batches):
    """Sorted rows in; a document's dropped lines out. A key's first document keeps its lines, all later ones lose them."""
    import numpy as np
    import pyarrow as pa

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        hi, lo, kind, doc = (b.column(i).to_numpy() for i in range(4))
        new = np.empty(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        new[0] = last is None or last[:2] != (hi[0], lo[0])
        at = np.flatnonzero(new)
        owner = np.empty(len(hi), np.int64)
        group = np.cumsum(new) - 1
        owner = np.where(group >= 0, doc[at[np.maximum(group, 0)]] if len(at) else 0, last[2] if last else 0)
        last = (hi[-1], lo[-1], owner[-1])
        keep = (kind == 1) | (doc != owner)
        yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep)) for i in (3, 4, 5, 6)], ["doc", "digest", "n_lines", "bits"])


def _identity(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A null id counts as the largest; the digest tells rows with equal ids apart."""
    return docs.withColumn("_doc", F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))).withColumn("_digest", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def line_bitmaps(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """doc, digest, n_lines, n_dropped, keep: one row per distinct (id, text), keep being a bitmap of the lines that stay.

    Lines end at newline; a null or empty text is one empty line. A line's key is the line without ASCII white space at
    its ends and with A-Z lowered. Keys of `least` code points or more that two or more ids hold stay only in the
    smallest id (there all their lines do). Rows with the same id are one document; null ids are one document after all.

    Each batch passes on a key once, for its smallest document, so a line that a third of all documents hold reaches
    its range once per batch. Ranges are equal cuts of the 128-bit hash, which is uniform, so no sampling pass is needed;
    a task streams its range in the order of hash and document and holds one row.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    n = common.partitions(spark)
    rows = _identity(docs, doc_id, text).select("_doc", "_digest", F.col(text).cast("string").alias("text")).mapInArrow(_scan(least), _ROWS)
    at = F.shiftright(F.shiftrightunsigned("hi", 33) * n, 31).cast("int")
    ranged = rows.repartitionById(n, at).sortWithinPartitions("hi", "lo", "doc", "digest")
    drops = ranged.mapInArrow(_stream, "doc long, digest long, n_lines int, bits binary")

    def merge(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keeps, dropped = [], []
            for n, parts in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                drop = np.zeros(n, bool)
                for p in parts:
                    drop |= _unpack(p, n)
                keeps.append(_pack(~drop))
                dropped.append(int(drop.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.int64()), pa.array(dropped, pa.int64()), pa.array(keeps, pa.binary())], ["doc", "digest", "n_lines", "n_dropped", "keep"])

    by_doc = drops.groupBy("doc", "digest").agg(F.max("n_lines").alias("n_lines"), F.expr("collect_list(bits) FILTER (WHERE octet_length(bits) > 0)").alias("parts"))
    return by_doc.mapInArrow(merge, "doc long, digest long, n_lines long, n_dropped long, keep binary")


def _kept_text(text: bytes, keep: bytes, n: int) -> bytes:
    lines = text.split(b"\n")
    return b"\n".join(line for line, k in zip(lines, _unpack(keep, n).tolist()) if k)


def drop_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 10, counts: bool = True) -> DataFrame:
    """The rows of docs with `text` less its dropped lines, all other columns as they are, plus n_lines and n_dropped.

    Columns of docs with the names of these two give way to them; without counts they stay, and none is added. A null
    text stays null. See line_bitmaps for what is dropped.
    """
    if counts:
        docs = docs.drop("n_lines", "n_dropped")
    columns = docs.columns
    bitmaps = line_bitmaps(docs, doc_id=doc_id, text=text, least=least)
    named = _identity(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]), f"c{columns.index(doc_id)}", f"c{columns.index(text)}")
    mine = f"c{columns.index(text)}"
    joined = named.join(bitmaps.select(F.col("doc").alias("_doc"), F.col("digest").alias("_digest"), F.col("n_lines").alias("_n"), F.col("n_dropped").alias("_d"), F.col("keep").alias("_keep")), ["_doc", "_digest"])

    def cut(batches):
        import pyarrow as pa

        for b in common.small(batches):
            at = {name: i for i, name in enumerate(b.schema.names)}
            old = b.column(at[mine]).cast(pa.large_binary()).to_pylist()
            new = [None if t is None else t if not d else _kept_text(t, k or b"", n) for t, d, k, n in zip(old, b.column(at["_d"]).to_pylist(), b.column(at["_keep"]).to_pylist(), b.column(at["_n"]).to_pylist())]
            arrays = [pa.array(new, pa.binary()).cast(pa.string()) if name == mine else b.column(i) for name, i in at.items() if name != "_keep"]
            yield pa.RecordBatch.from_arrays(arrays, [name for name in at if name != "_keep"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "_keep")
    out = joined.select([c for c in joined.columns if c not in ("_doc", "_digest")]).mapInArrow(cut, schema.replace("`_doc` bigint, `_digest` bigint, ", ""))
    added = [F.col("_n").alias("n_lines"), F.col("_d").alias("n_dropped")] if counts else []
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], *added)
