"""Alignment of two tokenizers' tokens over the same bytes, and how often tokens of the two meet in a corpus.

Every text is encoded twice. In a batch of texts pandas.merge_asof finds, for each token's first byte, the other side's token that
covers it; both directions together are all overlaps, and bytes where tokens of both sides end cut them into groups.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm import common
from fernglass.llm.tokens import texts

#: Bytes of text that are aligned at once, about, and links after which a task gives its pairs out.
SLICE, LINKS = 1 << 18, 1_000_000
#: Units that a worker keeps, the longest of them in characters, and units that are encoded in one call.
ROOM, LONG, CALL = 200_000, 64, 4096
#: Pairs of a row.
ROW = 65_536
_CUT = re.compile(r"(?<=\S)([ \n])(?=\S)")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: visible ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of a text with a space before it, the bytes of each id, and whether texts may be encoded in parts."""

    def __init__(self, path: str):
        import numpy as np

        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
            self.bytes_of = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
            self.parts = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
            self._ids = lambda t: model.encode(t, num_threads=1)
            self.spaced = True  # it adds the space itself
        else:
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            split = spec.get("pre_tokenizer") or {}
            if split.get("type") != "ByteLevel":
                raise ValueError(f"{path}: only byte-level vocabularies and sentencepiece models say which bytes a token is")
            model, letters = Tokenizer.from_file(path), _byte_letters()
            model.encode_special_tokens = True  # their strings in a text are ordinary text
            vocabulary = model.get_vocab(with_added_tokens=True)
            self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
            for token, i in vocabulary.items():
                self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
            self.parts = spec.get("normalizer") is None and split.get("use_regex", True) and not split.get("add_prefix_space", False)
            self._ids = lambda t: model.encode(t, add_special_tokens=False).ids
            self.spaced = bool(split.get("add_prefix_space", False))
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)

    def ids(self, unit: str):
        """The ids of a piece of text as they are in the middle of a text; it starts with a space or a lone line feed."""
        import numpy as np

        if not self.spaced:
            return np.array(self._ids(unit), np.uint32)
        if unit[0] == " ":
            return np.array(self._ids(unit[1:]), np.uint32)
        return np.array(self._ids(unit)[1:], np.uint32)  # without the space that was added

    def joined(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


class Pair:
    """Two tokenizers and a worker's table of units: a unit is what lies between lone spaces or line feeds, with the one before it.

    Neither side's tokens go beyond a unit, so texts are encoded by unit, and each new unit once. Where that isn't so for a
    tokenizer, texts are encoded whole.
    """

    def __init__(self, a: str, b: str):
        self.a, self.b = Side(a), Side(b)
        self.parts = self.a.parts and self.b.parts
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def _alone(self, unit: str):
        a, b, raw = self.a.ids(unit), self.b.ids(unit), unit.encode()
        return (a.tobytes(), b.tobytes()) if self.a.joined(a) == raw == self.b.joined(b) else None

    def _learn(self, keys: list[str]) -> None:
        import numpy as np

        units = [k if k[0] == "\n" else f" {k}" for k in keys]
        whole = " a" + "".join(units)  # a unit of its own, so that the first one stands like the others
        raw = whole.encode()
        ends = 2 + np.cumsum([0, *(len(u.encode()) for u in units)])
        cut = []
        for side in (self.a, self.b):
            ids = side.ids(whole)
            at = np.cumsum(side.lengths[ids])
            place = np.searchsorted(at, ends)
            if side.joined(ids) != raw or (at[place] != ends).any():
                break
            flat, place = ids.tobytes(), ((place + 1) * 4).tolist()
            cut.append([flat[i:j] for i, j in zip(place, place[1:])])
        if len(cut) == 2:
            self.known.update(zip(keys, zip(*cut)))
        else:
            self.known.update((k, self._alone(u)) for k, u in zip(keys, units))

    @staticmethod
    def _units(text: str) -> list[str]:
        """Its units: those after a space without it, those after a line feed with it; one that starts with white space of more
        than one has a space before it."""
        n = text.split()
        if sum(map(len, n)) + len(n) - 1 == len(text):
            return text.replace("\n", " \n").split(" ")
        cut = _CUT.split(text)
        first = f" {cut[0]}" if cut[0][0].isspace() else cut[0]
        return [first, *(k if s == " " else s + k for s, k in zip(cut[1::2], cut[2::2]))]

    def encode(self, all_texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of both sides of each text, as 32-bit numbers; None for empty texts and texts whose bytes a side doesn't keep."""
        if not self.parts:
            return [self._alone(f" {t}") if t else None for t in all_texts]
        units = [self._units(t) if t else [] for t in all_texts]
        new = set().union(*units).difference(self.known)
        if len(self.known) + len(new) > ROOM:
            self.known, new = {}, set().union(*units)
        plain = []
        for k in sorted(new):
            if k[0] == " ":
                self.known[k] = self._alone(k)
            elif k[-1].isspace():
                self.known[k] = self._alone(k if k[0] == "\n" else f" {k}")
            else:
                plain.append(k)
        for i in range(0, len(plain), CALL):
            self._learn(plain[i : i + CALL])
        out = []
        for own in units:
            got = [*map(self.known.__getitem__, own)]
            out.append((b"".join([g[0] for g in got]), b"".join([g[1] for g in got])) if got and None not in got else None)
        for k in new:
            if len(k) > LONG:
                del self.known[k]
        return out


@dataclass
class Aligned:
    """Texts end to end: ids of both sides, how many each text has, links as places in the ids, and the first token of each group."""

    a: "object"
    b: "object"
    n_a: "object"
    n_b: "object"
    link_a: "object"
    link_b: "object"
    n_links: "object"
    group_a: "object"
    group_b: "object"
    n_groups: "object"


def align(pair: Pair, all_texts: list[str]) -> Aligned:
    """Links and groups of a batch of texts. The texts stand end to end, so a byte's place is its text and its place there, which
    is the key of the as-of joins; at a text's start tokens of both sides start, so none is covered by another text's."""
    import numpy as np
    import pandas as pd

    got = [x or (b"", b"") for x in pair.encode(all_texts)]
    n_a, n_b = (np.array([len(x[i]) // 4 for x in got], np.int64) for i in (0, 1))
    a, b = (np.frombuffer(b"".join([x[i] for x in got]), np.uint32) for i in (0, 1))
    long_a, long_b = pair.a.lengths[a], pair.b.lengths[b]
    start_a, start_b = np.cumsum(long_a) - long_a, np.cumsum(long_b) - long_b
    left, right = pd.DataFrame({"at": start_a, "a": np.arange(len(a))}), pd.DataFrame({"at": start_b, "b": np.arange(len(b))})
    over = pd.merge_asof(left, right, on="at")["b"].to_numpy()
    under = pd.merge_asof(right, left, on="at")["a"].to_numpy()
    both_b = start_a[under] == start_b if len(b) else np.zeros(0, bool)  # tokens that start together meet in both directions
    both_a = start_b[over] == start_a if len(a) else np.zeros(0, bool)
    rest = np.flatnonzero(~both_b)
    link_a, link_b = np.concatenate([np.arange(len(a)), under[rest]]), np.concatenate([over, rest])
    edge = np.concatenate([[0], np.cumsum(n_a)])
    order = np.argsort(link_a, kind="stable")
    link_a, link_b = link_a[order], link_b[order]
    n_links = np.diff(np.searchsorted(link_a, edge))
    group_a, group_b = np.flatnonzero(both_a), np.flatnonzero(both_b)
    return Aligned(a, b, n_a, n_b, link_a, link_b, n_links, group_a, group_b, np.diff(np.searchsorted(group_a, edge)))


def written_groups(x: Aligned, names) -> list[str]:
    """Each text's groups as `a1,a2|b1;a3|b2,b3`; names: four tables of ids as text, of A and B inside and at the end of a group."""
    import numpy as np

    last_a, last_b = np.zeros(len(x.a), bool), np.zeros(len(x.b), bool)
    last_a[x.group_a - 1] = last_b[x.group_b - 1] = True  # before a group's first token another group ends; before the first the last
    out = np.empty(len(x.a) + len(x.b), object)
    of_a, of_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
    of_a[x.group_a[1:]] = of_b[x.group_b[1:]] = 1
    of_a, of_b = np.cumsum(of_a), np.cumsum(of_b)
    place_a = np.arange(len(x.a)) + x.group_b[of_a] if len(x.a) else of_a
    place_b = np.arange(len(x.b)) + np.append(x.group_a, len(x.a))[of_b + 1] if len(x.b) else of_b
    out[place_a] = np.where(last_a, names[1][x.a], names[0][x.a])
    out[place_b] = np.where(last_b, names[3][x.b], names[2][x.b])
    edge = np.concatenate([[0], np.cumsum(x.n_a + x.n_b)]).tolist()
    return ["".join(out[i:j].tolist())[:-1] for i, j in zip(edge, edge[1:])]


def _names(pair: Pair):
    import numpy as np

    return [np.array([f"{i}{s}" for i in range(n)], object) for n, marks in ((len(pair.a.bytes_of), ",|"), (len(pair.b.bytes_of), ",;")) for s in marks]


_pairs: dict[tuple[str, str], Pair] = {}


def _pair(a: str, b: str) -> Pair:
    """The worker's pair of tokenizers; it lasts as long as the worker."""
    if (a, b) not in _pairs:
        _pairs.clear()
        _pairs[a, b] = Pair(a, b)
    return _pairs[a, b]


def _slices(batches):
    """Arrow batches of (id, text) as (ids, texts) of about SLICE bytes."""
    for b in common.small(batches):
        at, size, all_texts = 0, 0, [t.decode("utf-8", "replace") for t in texts(b.column(1))]
        for i, t in enumerate(all_texts):
            size += len(t)
            if size >= SLICE or i + 1 == len(all_texts):
                yield b.column(0).slice(at, i + 1 - at), all_texts[at : i + 1]
                at, size = i + 1, 0


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def alignments(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a, b (the ids), links (places in both that overlap, by place in a), groups (the first places in both of each group).

    One row per input row: null ids, repeated rows and ids stay, further columns are left out. Null and empty texts, and texts
    whose bytes with a space before them a side doesn't give back, have no tokens. An empty table gives no rows.
    """
    common.prepare(docs.sparkSession)

    def task(batches):
        import numpy as np
        import pyarrow as pa

        pair = _pair(tokenizer_a, tokenizer_b)
        for ids, own in _slices(batches):
            x = align(pair, own)
            edge_a, edge_b, edge_l, edge_g = (np.concatenate([[0], np.cumsum(n)]) for n in (x.n_a, x.n_b, x.n_links, x.n_groups))

            def lists(values, edge):
                return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), values)

            def local(values, edge, counts):
                return pa.array(values - np.repeat(edge[:-1], counts), pa.int32())

            links = pa.StructArray.from_arrays([local(x.link_a, edge_a, x.n_links), local(x.link_b, edge_b, x.n_links)], ["a", "b"])
            groups = pa.StructArray.from_arrays([local(x.group_a, edge_a, x.n_groups), local(x.group_b, edge_b, x.n_groups)], ["a", "b"])
            yield pa.RecordBatch.from_arrays([ids, lists(pa.array(x.a.view(np.int32)), edge_a), lists(pa.array(x.b.view(np.int32)), edge_b), lists(links, edge_l), lists(groups, edge_g)], ["doc_id", "a", "b", "links", "groups"])

    return _rows(docs, doc_id, text).mapInArrow(task, "doc_id long, a array<int>, b array<int>, links array<struct<a: int, b: int>>, groups array<struct<a: int, b: int>>")


_PART = "chunk long, kind int, at long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, codes array<long>, counts array<long>"


def link_report(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, *, doc_id: str = "doc_id", text: str = "text", links: int = LINKS, row: int = ROW) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    The count of an (A id, B id) pair is the number of links of all texts that hold it; n_best is how many of a text's links have
    the highest count of their B id, count_sum the sum of its links' counts. Texts without tokens, as in `alignments`, have
    zeros and an empty digest.

    Tasks gather the links of texts in chunks of about `links`; a chunk gives each of its pairs out once with its number, so a pair
    that every text has is as many rows as there are chunks, and texts keep their links as places in the chunk's list.
    Pairs are added up and come back to their chunk, sorted before its texts, and are read in a stream. What is
    broadcast is one row for each id of B at most.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    size_b = len(Side(tokenizer_b).bytes_of)

    def task(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        pair = _pair(tokenizer_a, tokenizer_b)
        names, chunk = _names(pair), TaskContext.get().partitionId() << 32
        kept, codes, n = [], [], 0
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = [c.split()[0] for c in _PART.split(", ")]

        def out(rows: int, given: dict):
            return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(rows, t)) for c, t in zip(columns, types)], columns)

        def flush():
            import pandas as pd

            place, own = pd.factorize(np.concatenate(codes))
            counts = np.bincount(place, minlength=len(own))
            for i in range(0, len(own), row):
                of = own[i : i + row]
                edge = pa.array([0, len(of)], pa.int32())
                yield out(1, {"chunk": pa.array([chunk]), "kind": pa.array([0], pa.int32()), "at": pa.array([i]), "codes": pa.ListArray.from_arrays(edge, pa.array(of)), "counts": pa.ListArray.from_arrays(edge, pa.array(counts[i : i + row]))})
            at = line = 0
            place = place.astype(np.int32)
            for ids, x, digests in kept:
                k, m = len(x.n_a), int(x.n_links.sum())
                edge = pa.array(np.concatenate([[0], np.cumsum(x.n_links)]), pa.int32())
                yield out(k, {"chunk": pa.array(np.full(k, chunk)), "kind": pa.array(np.ones(k, np.int32)), "at": pa.array(np.arange(line, line + k)), "doc_id": ids, "n_a": pa.array(x.n_a), "n_b": pa.array(x.n_b), "n_groups": pa.array(x.n_groups),
                    "n_links": pa.array(x.n_links), "groups_sha256": pa.array(digests), "links": pa.ListArray.from_arrays(edge, pa.array(place[at : at + m]))})
                at, line = at + m, line + k

        for ids, own in _slices(batches):
            x = align(pair, own)
            digests = [hashlib.sha256(g.encode()).hexdigest() if m else "" for g, m in zip(written_groups(x, names), x.n_a.tolist())]
            codes.append(x.a[x.link_a].astype(np.int64) * size_b + x.b[x.link_b])
            x.a = x.b = x.link_a = x.link_b = x.group_a = x.group_b = None
            kept.append((ids, x, digests))
            n += len(codes[-1])
            if n >= links:
                yield from flush()
                kept, codes, n, chunk = [], [], 0, chunk + 1
        if kept:
            yield from flush()

    parts = common.written(_rows(docs, doc_id, text).mapInArrow(task, _PART), "links")
    pairs = parts.where("kind = 0").select("chunk", "at", F.posexplode(F.arrays_zip("codes", "counts")).alias("i", "p")).select("chunk", (F.col("at") + F.col("i")).alias("at"), F.col("p.codes").alias("code"), F.col("p.counts").alias("n"))
    totals = common.written(pairs.groupBy("code").agg(F.sum("n").alias("n")).withColumn("b", F.col("code") % size_b), "pairs")
    most = totals.groupBy("b").agg(F.max("n").alias("most"))
    # one row for each id of B at most
    valued = totals.join(F.broadcast(most), "b").select("code", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("value"))
    back = pairs.select("chunk", "at", "code").join(valued, "code").select("chunk", F.lit(0).alias("kind"), "at", "value")
    whole = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
    sides = back.unionByName(parts.where("kind = 1").select("chunk", "kind", "at", *whole), allowMissingColumns=True).select("chunk", "kind", "at", "value", *whole)
    dealt = sides.repartition(common.partitions(spark), "chunk").sortWithinPartitions("chunk", "kind", "at")
    return dealt.mapInArrow(_added, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _added(batches):
    """Sorted rows of chunks, pairs before texts, to the texts with the sums over their links."""
    import numpy as np
    import pyarrow as pa

    now, values, table = None, [], None
    for b in batches:
        chunks, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds) != 0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunks)]):
            if i == j:
                continue
            if now != chunks[i]:
                now, values, table = chunks[i], [], None
            s = b.slice(i, j - i)
            if kinds[i] == 0:
                values.append(s.column(3).to_numpy())
                continue
            if table is None:
                table, values = np.concatenate(values) if values else np.zeros(0, np.int64), []
            links = s.column(10)
            of = table[links.flatten().to_numpy(zero_copy_only=False)]
            edge = np.concatenate([[0], np.cumsum(s.column(8).to_numpy())])
            best, total = (np.concatenate([[0], np.cumsum(v)])[edge] for v in (of & 1, of >> 1))
            yield pa.RecordBatch.from_arrays([*(s.column(k) for k in (4, 5, 6, 7, 8)), pa.array(np.diff(best)), pa.array(np.diff(total)), s.column(9)], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
