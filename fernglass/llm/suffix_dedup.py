"""Removal of repeated byte strings of a threshold length: suffixes ordered only that far, by most-significant-digit passes.

A suffix is compared on its first `threshold` bytes only. Its most significant digit is the `K`-byte string in it whose
hash is smallest; neighbouring suffixes mostly have the same one, so a *run* of suffixes (at most threshold-K+1, on
adjacent starts) travels as one row. Pass 1 orders runs by that digit; a digit that only one run has ends there. Pass 2
orders by the whole run; equal runs hold equal suffixes, and all but the first are repeats. Pass 3 orders the single
suffixes of the runs that share a first digit but differ, and compares the bytes of those that look equal. Equal groups at
the end are exactly the repeated strings. Runs count as equal by 128 bits of hashes: of the digit, and of the whole run.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm import common
from fernglass.llm.tokens import texts

#: Bytes of the first digit.
K = 32
#: Bytes that are hashed at once.
CHUNK = 1 << 19
_MASK = (1 << 64) - 1


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _window_hashes(data, width: int, seed: int):
    """A 64-bit hash of each `width` bytes of data, by doubling: the hash of 2n bytes from those of n."""
    import numpy as np

    table = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed | 1))
    base = (seed * 0x9E3779B97F4A7C15 | 1) & _MASK
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    now, n, out, done = table[data], 1, None, 0
    while True:
        if width & n:
            if out is None:
                out, done = now, n
            else:
                size = len(data) - done - n + 1
                out, done = now[:size] * power(done) + out[n : n + size], done + n
        if 2 * n > width:
            return _mix(out)
        size = len(now) - n
        now = now[:size] * power(n) + now[n:]
        n *= 2


def _least(values, width: int):
    """The least of each `width` neighbours."""
    import numpy as np

    n, size, now = 1, len(values) - width + 1, values
    while 2 * n <= width:
        now = np.minimum(now[:-n], now[n:])
        n *= 2
    return np.minimum(now[:size], now[width - n : width - n + size])


def _runs(data, bounds, threshold: int):
    """Runs of suffixes in joined texts: first start, number of suffixes, digit, digest, whether a suffix may repeat inside."""
    import numpy as np

    wide = threshold - K + 1
    if len(data) < threshold:
        return None
    digit, whole = _window_hashes(data, K, 0x5851F42D), _window_hashes(data, threshold, 0x14057B7E)
    least = _least(digit, wide)
    valid = np.ones(len(least), bool)
    for end in bounds[1:].tolist():
        valid[max(0, end - threshold + 1) : end] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return None
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    if (long := size > wide).any():  # the same digit again and again: cut, so that both ends cover the whole run
        pieces = [np.arange(f, f + n, wide) for f, n in zip(first[long].tolist(), size[long].tolist())]
        first = np.sort(np.concatenate([first, *[p[1:] for p in pieces]]))
        size = np.diff(np.append(first, len(at)))
    start = at[first]
    last = start + size - 1
    value = least[start]

    def place(of):
        found = np.full(len(of), -1)
        for j in range(wide):
            hit = (found < 0) & (digit[of + j] == value)
            found[hit] = of[hit] + j
        return found

    digest = _mix(whole[start] * np.uint64(0xD6E8FEB86659FD93) + _mix(whole[last]) + size.astype(np.uint64))
    return start, size, value, digest, place(start) != place(last)


def _chunks(docs):
    """Lists of (key, text) of about CHUNK bytes."""
    now, size = [], 0
    for d in docs:
        now.append(d)
        size += len(d[1])
        if size >= CHUNK:
            yield now
            now, size = [], 0
    if now:
        yield now


#: A row: its id, and 128 bits that tell rows of one id apart.
_KEY = ("doc", "dig", "more")
_PLACE = "doc long, dig long, more long, pos long"
_RUN = f"h long, t long, kind int, {_PLACE}"
_NAMES = ["h", "t", "kind", *_KEY, "pos"]


def _row_pos(start, n):
    return (start << 8) | n


def _pass1(threshold: int):
    """Texts to runs. kind 0: a run; 2: a run that pass 3 must see, since it may repeat a suffix inside or since its digit
    has another run in the batch; 3: that other one; 1: bytes that this batch shows to be repeats (pos: first byte, t:
    end). Copies of a text, and equal runs, leave a batch once."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for b in common.small(batches):
            docs = sorted(zip(zip(*(b.column(i).to_pylist() for i in range(3))), texts(b.column(3))), key=lambda x: x[0])
            seen, todo, gone = {}, [], []
            for key, text in docs:
                if len(text) >= threshold:
                    name = hashlib.blake2b(text, digest_size=16).digest()
                    if name not in seen:
                        seen[name] = key
                        todo.append((key, text))
                    elif seen[name] != key:  # else a repeated row: the same document
                        gone.append((*key, 0, len(text)))
            parts = []
            for chunk in _chunks(todo):
                bounds = np.concatenate(([0], np.cumsum([len(t) for _, t in chunk])))
                found = _runs(np.frombuffer(b"".join(t for _, t in chunk), np.uint8), bounds, threshold)
                if found:
                    start, size, h, t, multi = found
                    own = np.searchsorted(bounds, start, "right") - 1
                    keys = np.array([k for k, _ in chunk], np.int64)[own]
                    parts.append((h, t, multi, keys, start - bounds[own], size))
            if parts:
                h, t, multi, keys, start, size = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((t, h))
                again = np.zeros(len(h), bool)
                again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (t[order[1:]] == t[order[:-1]])
                for key, s, n in zip(map(tuple, keys[again].tolist()), start[again].tolist(), size[again].tolist()):
                    if gone and gone[-1][:3] == key and gone[-1][3] <= s <= gone[-1][4]:
                        gone[-1] = (*key, gone[-1][3], max(gone[-1][4], s + n - 1 + threshold))
                    else:
                        gone.append((*key, s, s + n - 1 + threshold))
                by_digit = order[~again[order]]
                mate = h[by_digit[1:]] == h[by_digit[:-1]]  # of the same digit as the run before
                kinds = np.where(multi, 2, 0).astype(np.int32)
                kinds[by_digit[:-1][mate]] = 2
                kinds[by_digit[1:][mate]] = 3
                k = ~again
                arrays = [h[k].view(np.int64), t[k].view(np.int64), kinds[k], *keys[k].T, _row_pos(start[k], size[k])]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], _NAMES)
            if gone:
                d = np.array(gone, np.int64)
                spread = _mix((d[:, 0] ^ d[:, 1]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + d[:, 3].view(np.uint64)).view(np.int64)
                arrays = [spread, d[:, 4], np.ones(len(d), np.int32), *d[:, :3].T, _row_pos(d[:, 3], 0)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], _NAMES)

    return task


def _pass2(threshold: int):
    """Sorted runs to repeats (kind 1: the row, pos, t the end) and to runs that pass 3 must look at (kind 0): those whose
    digit has another run here, or of which one was marked for it."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        def batch(h, t, kind, *place):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, t, np.full(len(h), kind, np.int32), *place)], _NAMES)

        def one(row):
            h, t, *place = (np.array([x], np.int64) for x in row)
            return batch(h, t, 0, *place)

        row = mate = must = None  # the last group of equal runs: its first run, whether its digit had another before, its mark
        for b in batches:
            h, t, kind, *place = (b.column(i).to_numpy() for i in range(len(_NAMES)))
            if (done := kind == 1).any():
                yield batch(h[done], t[done], 1, *[x[done] for x in place])
                h, t, kind, *place = (x[~done] for x in (h, t, kind, *place))
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
            if row is not None:
                new[0] = (h[0], t[0]) != row[:2]
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            like = np.logical_and.reduce([x == x[first] for x in place])
            like_held = np.logical_and.reduce([x == y for x, y in zip(place, row[2:])]) if row is not None else np.zeros(len(h), bool)
            again = ~new & ~np.where(first >= 0, like, like_held)  # a repeated row holds the same place of the same document
            if again.any():
                pos = place[-1][again]
                yield batch(h[again], (pos >> 8) + (pos & 255) - 1 + threshold, 1, *[x[again] for x in place])
            starts = np.flatnonzero(new)
            marked = kind >= 2
            if row is not None:
                must = must or bool(marked[: starts[0] if len(starts) else None].any())
            if not len(starts):
                continue
            marked = np.logical_or.reduceat(marked, starts)
            h, t, *place = (x[starts] for x in (h, t, *place))
            before = np.empty(len(h), bool)
            before[1:] = h[1:] == h[:-1]
            before[0] = row is not None and row[0] == h[0]
            if row is not None and (mate or must or before[0]):
                yield one(row)
            keep = before[:-1] | before[1:] | marked[:-1]
            if keep.any():
                yield batch(h[:-1][keep], t[:-1][keep], 0, *[x[:-1][keep] for x in place])
            row, mate, must = tuple(int(x[-1]) for x in (h, t, *place)), bool(before[-1]), bool(marked[-1])
        if row is not None and (mate or must):
            yield one(row)

    return task


def _cut_runs(threshold: int):
    """A text with its open runs to one row for each run, with the run's bytes; a row that repeats the one before gives none."""

    def task(batches):
        import pyarrow as pa

        last = None
        for b in common.small(batches):
            rows = []
            for key, text, open_runs in zip(zip(*(b.column(i).to_pylist() for i in range(3))), texts(b.column(3)), b.column(4).to_pylist()):
                if key == last:
                    continue
                last = key
                for r in open_runs:
                    s, n = r["pos"] >> 8, r["pos"] & 255
                    rows.append((r["h"], *key, r["pos"], text[s : s + n - 1 + threshold]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 5, pa.binary()))], ["h", *_KEY, "pos", "run"])

    return task


def _suffixes(rows, threshold: int):
    """(row index, offset, hash, first byte in the joined rows) of all suffixes of the rows' bytes, in order; the joined rows."""
    import numpy as np

    bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    data = np.frombuffer(b"".join(rows), np.uint8)
    hashes = _window_hashes(data, threshold, 0x2545F491)
    n = np.diff(bounds) - threshold + 1
    row = np.repeat(np.arange(len(rows)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = bounds[row] + offset
    return row, offset, hashes[at], at, data


def _repeats(key, at, data, threshold: int):
    """Which suffixes equal an earlier one: by key, and where keys are equal by their bytes."""
    import numpy as np

    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:]] = same
    wide = np.lib.stride_tricks.sliding_window_view(data, threshold)
    left, right = at[order[:-1][same]], at[order[1:][same]]
    for i in range(0, len(left), 1 << 15):
        if not np.array_equal(wide[left[i : i + (1 << 15)]], wide[right[i : i + (1 << 15)]]):
            break
    else:
        return again
    seen: set[bytes] = set()  # equal keys of unequal bytes: rare, so by the bytes alone
    for i, p in enumerate(at.tolist()):
        text = data[p : p + threshold].tobytes()
        again[i] = text in seen
        seen.add(text)
    return again


def _spans(key, pos, row, offset, threshold: int):
    """Repeated suffixes to (columns of the row, pos with the first byte, end) of joined-up bytes."""
    import numpy as np

    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first, len(row))[1:] - 1
    of = row[first]
    start = (pos[of] >> 8) + offset[first]
    return [x[of] for x in key], _row_pos(start, 0), start + (offset[last] - offset[first]) + threshold


def _pass3(threshold: int):
    """Runs sorted by digit, document and start: all but the first of equal suffixes are repeats."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        def resolve(h, *columns):
            place, runs = columns[:-1], columns[-1]
            once = np.ones(len(h), bool)  # repeated rows hold the same places of the same document
            once[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (h, *place)])
            h, place, runs = h[once], [x[once] for x in place], [r for r, k in zip(runs, once.tolist()) if k]
            row, offset, hashes, at, data = _suffixes(runs, threshold)
            again = _repeats(_mix(hashes + h.view(np.uint64)[row]), at, data, threshold)
            d, p, end = _spans(place[:-1], place[-1], row[again], offset[again], threshold)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*d, p, end)], [*_KEY, "pos", "t"])

        held: list = []
        for b in batches:
            held.append((*(b.column(i).to_numpy() for i in range(5)), b.column(5).to_pylist()))
            if sum(len(x[0]) for x in held) < 8192:
                continue
            h, *place = (np.concatenate([x[i] for x in held]) for i in range(5))
            runs = [r for x in held for r in x[5]]
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
            if cut:
                yield resolve(*(x[:cut] for x in (h, *place, runs)))
            held = [tuple(x[cut:] for x in (h, *place, runs))]
        if held:
            yield resolve(*(np.concatenate([x[i] for x in held]) for i in range(5)), [r for x in held for r in x[5]])

    return task


def _explode_runs(threshold: int):
    """Runs of a very common digit to one row for each suffix, with a 128-bit hash."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                *key, pos = (b.column(i).to_numpy() for i in range(1, 5))
                runs = b.column(5).to_pylist()
                row, offset, a, where, data = _suffixes(runs, threshold)
                c = _window_hashes(data, threshold, 0x6C62272E)[where]
                at = _row_pos((pos[row] >> 8) + offset, 0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), c.view(np.int64), *[k[row] for k in key], at)], ["a", "c", *_KEY, "pos"])

    return task


def _identity(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc (a null id is the largest), dig and more (two hashes of the text, 128 bits that tell rows with equal ids apart), text."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(t).alias("dig"), F.xxhash64(F.lit(2), t).alias("more"), t.alias("text"))


def repeated_spans(docs: DataFrame, *, threshold: int = 100, doc_id: str = "doc_id", text: str = "text", common_runs: int = 65_536) -> DataFrame:
    """doc, dig, more, spans (array of first byte and end, not merged) of all bytes in a string of `threshold` bytes that also
    starts earlier: in a smaller id, or in the same text at a smaller place. Texts without such bytes have no row.

    Null texts are empty; a null id is the largest; rows with one id and different texts are ordered by a hash.
    Rows with one id and one text are one document: their places are told once.
    `common_runs` is the number of differing runs of one digit from which their suffixes are shuffled one by one, with
    partial aggregation, instead of meeting in one task; both ways give the same result.
    """
    spark = docs.sparkSession
    if not K <= threshold < 256 + K:
        raise ValueError(f"threshold must be from {K} to {255 + K} bytes")
    common.prepare(spark)
    n = common.partitions(spark)
    base = _identity(docs, doc_id, text)
    runs = base.mapInArrow(_pass1(threshold), _RUN)
    # by digit; of a digit that a batch shows to have several runs, all but one a batch by the whole run, so none is hot
    dealt = F.when(F.col("kind") == 3, F.xxhash64("h", "t")).otherwise(F.xxhash64("h"))
    ordered = runs.repartition(n, dealt).sortWithinPartitions("h", "t", *_KEY, "pos")
    found = common.written(ordered.mapInArrow(_pass2(threshold), _RUN), "runs")
    split = lambda df: df.select(*_KEY, F.shiftright("pos", 8).alias("s"), F.col("t").alias("e"))

    open_runs = found.where("kind = 0").select("h", *_KEY, "pos")
    by_doc = open_runs.groupBy(*_KEY).agg(F.collect_set(F.struct("h", "pos")).alias("open"))
    cut = base.join(by_doc, [*_KEY]).select(*_KEY, "text", "open").mapInArrow(_cut_runs(threshold), f"h long, {_PLACE}, run binary")
    hot = open_runs.groupBy("h").count().where(F.col("count") > common_runs).select("h")
    if hot.isEmpty():
        usual, rare = cut, None
    else:
        usual, rare = cut.join(hot, "h", "left_anti"), cut.join(hot, "h", "left_semi")
    resolved = usual.repartition(n, "h").sortWithinPartitions("h", *_KEY, "pos").mapInArrow(_pass3(threshold), f"{_PLACE}, t long")
    spans = split(found.where("kind = 1")).unionByName(split(resolved))
    if rare is not None:
        each = rare.select("h", *_KEY, "pos", "run").mapInArrow(_explode_runs(threshold), f"a long, c long, {_PLACE}")
        firsts = each.groupBy("a", "c").agg(F.min(F.struct(*_KEY, "pos")).alias("first"), F.count("*").alias("k")).where("k > 1")
        late = each.join(firsts, ["a", "c"]).where(F.struct(*_KEY, "pos") != F.col("first"))
        start = F.shiftright("pos", 8)
        spans = spans.unionByName(late.select(*_KEY, start.alias("s"), (start + threshold).alias("e")))
    return spans.groupBy(*_KEY).agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, *, threshold: int = 100, doc_id: str = "doc_id", text: str = "text", common_runs: int = 65_536) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (maximal removed runs, array of first byte and end), kept (binary).

    What is left is bytes: a repeat may begin inside a character. See repeated_spans.
    """
    base = _identity(docs, doc_id, text)
    found = repeated_spans(docs, threshold=threshold, doc_id=doc_id, text=text, common_runs=common_runs)

    def cut(batches):
        import pyarrow as pa

        spans_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        for b in common.small(batches):
            size, spans, kept = [], [], []
            for t, found in zip(texts(b.column(1)), b.column(2).to_pylist()):
                runs = merge_spans([(x["s"], x["e"]) for x in found or []])
                at, left = 0, []
                for s, e in runs:
                    left.append(t[at:s])
                    at = e
                left.append(t[at:])
                size.append(len(t))
                spans.append([{"s": s, "e": e} for s, e in runs])
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    out = base.join(found, [*_KEY], "left").select("doc", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<s:long,e:long>>, kept binary")
    return out.withColumn("doc_id", F.expr(f"nullif(doc_id, {(1 << 63) - 1})"))
