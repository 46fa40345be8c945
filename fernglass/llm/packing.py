"""Packing of token sequences: first-fit decreasing over a tournament tree of bin rooms, in randomised groups."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm import common
from fernglass.llm.tokens import encoder, texts

#: Documents of a group, about: what a task holds is their last parts, each below one sequence.
GROUP_DOCS = 16_000


def first_fit(lengths: list[int], room: int) -> list[int]:
    """The bin of each item, taken in the order given: the first bin that has room. Bins are numbered from 0.

    The tree's leaves are the rooms left; each inner node is the larger of its two; the first fitting leaf is found by
    going down from the root, left where that fits.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    tree = [room] * (2 * leaves)
    bins = []
    for n in lengths:
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < n:
                at += 1
        bins.append(at - leaves)
        tree[at] -= n
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
    return bins


def pack_group(parts: list[tuple], room: int, slack: int) -> list[tuple]:
    """(key, start, length) of each part to (key, start, length, sequence, offset); parts may be cut.

    First-fit decreasing fills the bins. Bins that miss more than `slack` are taken apart; their parts are cut into full
    sequences, and what is left into sequences whose lengths are powers of two, which need no padding.
    """
    parts = sorted(parts, key=lambda p: (-p[2], p[:2]))
    bins = first_fit([p[2] for p in parts], room)
    full: dict[int, list] = {}
    for p, b in zip(parts, bins):
        full.setdefault(b, []).append(p)
    placed, loose = [], []
    for b in sorted(full):
        have = sum(p[2] for p in full[b])
        if room - have > slack and have & (have - 1):
            loose += full[b]
        else:
            placed.append(full[b])
    left = sum(p[2] for p in loose)
    sizes = [room] * (left // room) + [1 << i for i in range(room.bit_length(), -1, -1) if (left % room) >> i & 1]
    queue = iter(loose)
    key = start = length = 0
    for size in sizes:
        now = []
        while size:
            if not length:
                key, start, length = next(queue)
            take = min(size, length)
            now.append((key, start, take))
            start, length, size = start + take, length - take, size - take
        placed.append(now)
    out = []
    for s, seq in enumerate(placed):
        at = 0
        for key, start, length in seq:
            out.append((key, start, length, s, at))
            at += length
    return out


def pack(docs: DataFrame, tokenizer: str, *, end_id: int, room: int = 4096, slack: int = 16, seed: int = 4, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack every whole text's ids and the end id into sequences of at most `room` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds ids. Null texts
    are the end id alone. Null and repeated ids are packed as rows of their own. An empty table gives no rows.

    Documents are dealt at random (by a hash of their id and text) to groups, one a partition. A task encodes each text once,
    sets aside whole sequences of long texts at once, and keeps only the last parts' ids until the group ends, and a row for each whole
    sequence; with_ids keeps the ids of those too, so a group then takes as much memory as its documents have ids. Results don't depend on the order of arrival.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    groups = max(common.partitions(spark), -(-rows.count() // GROUP_DOCS))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end, group = encoder(tokenizer), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        whole, parts, tails, totals, copies = [], [], {}, {}, {}
        for b in common.small(batches):
            for key, ids in zip(b.column(0).to_pylist(), enc.encode_all(texts(b.column(1)))):
                ids += end
                n = len(ids) // 4
                cut = n - n % room
                for s in range(0, cut, room):
                    piece = ids[4 * s : 4 * (s + room)]
                    whole.append((key is None, key or 0, s, n, zlib.crc32(piece), piece if with_ids else None))
                if cut < n:
                    tail = ids[4 * cut :]
                    # equal keys are told apart by their bytes, so that the order of arrival doesn't matter
                    name = (key is None, key or 0, zlib.crc32(tail), tail, n)
                    copies[name] = copies.get(name, 0) + 1
                    name = (*name, copies[name])
                    tails[name], totals[name] = tail, n
                    parts.append((name, cut, n - cut))
        out = []
        for i, (none, key, s, n, crc, piece) in enumerate(sorted(whole)):
            out.append((None if none else key, s, room, crc, n, (group << 40) + i, 0, piece))
        base = (group << 40) + len(whole)
        first = {name: cut for name, cut, _ in parts}
        for name, s, length, seq, offset in pack_group(parts, room, slack):
            piece = tails[name][4 * (s - first[name]) : 4 * (s - first[name] + length)]
            out.append((None if name[0] else name[1], s, length, zlib.crc32(piece), totals[name], base + seq, offset, piece if with_ids else None))
        for i in range(0, len(out), 4096):
            columns = list(zip(*out[i : i + 4096]))
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            names = [x.split()[0] for x in schema.split(", ")]
            if with_ids:
                arrays, names = [*arrays, pa.array(columns[7], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    dealt = rows.repartition(groups, F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("")), F.lit(seed)))
    return dealt.mapInArrow(task, schema + (", ids binary" if with_ids else ""))
