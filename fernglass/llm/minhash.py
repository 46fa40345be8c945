"""Near-duplicate documents: SuperMinHash signatures, banding, links confirmed on full shingle sets, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm import common
from fernglass.llm.tokens import texts

#: Bands and rows of a signature: a pair at 0.8 misses all 32 bands of 5 with a chance of 3e-6.
BANDS, ROWS = 32, 5
#: Shingles of the texts whose signatures are made together.
TOGETHER = 1 << 16

_words: "WordHashes | None" = None


class WordHashes(dict):
    """Word to a 64-bit hash; bounded, emptied when full."""

    room = 500_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.room:
                self.clear()
            self[word] = h
        return h


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, k: int):
    """The distinct hashes of k-word shingles, ascending; fewer words make one shingle, no words none."""
    import numpy as np

    global _words
    if _words is None:
        _words = WordHashes()
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def super_minhash(values, bounds, m: int):
    """Signatures of several sets at once: sets are values[bounds[i]:bounds[i+1]], none empty; m slots a set.

    Step j of an element draws a number and the j-th place of the element's own random permutation; a slot keeps the
    least of j + number. A set is finished when no slot can still fall, that is when every slot's j is below the next.
    """
    import numpy as np

    n = len(bounds) - 1
    best = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    x, places = values, None
    for j in range(m):
        draw = _mix(x + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & ((1 << 64) - 1)))
        k = j + ((draw >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64)
        if places is None:
            slot = k
        else:
            at = np.arange(len(x))
            slot = places[at, k].astype(np.int64)
            places[at, k] = places[:, j]
            places[:, j] = slot
        np.minimum.at(best, owner * m + slot, (draw & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32))
        going = (best.reshape(n, m).max(axis=1) >> np.uint64(32)) > j
        if not going.any():
            break
        stay = going[owner]
        if places is None:
            first = k[stay]
            x, owner = x[stay], owner[stay]
            places = np.tile(np.arange(m, dtype=np.uint16), (len(x), 1))
            at = np.arange(len(x))
            places[at, first] = 0
            places[:, 0] = first
        elif not stay.all():
            x, owner, places = x[stay], owner[stay], places[stay]
    return best.reshape(n, m)


def band_hashes(signatures):
    """BANDS hashes of ROWS slots each; a hash holds its band's number."""
    import numpy as np

    s = signatures.reshape(len(signatures), BANDS, ROWS)
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(s), 1))
    for r in range(ROWS):
        out = _mix(out + s[:, :, r])
    return out.view(np.int64)


_SIGNED = "doc long, n long, d1 long, d2 long, bands array<long>"


def _sign(k: int):
    def task(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        def flush(rows, sets):
            some = [i for i, s in enumerate(sets) if len(s)]
            # equal sets of a batch share one signature
            first: dict[bytes, int] = {}
            names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            own = [i for i in some if first.setdefault(names[i], i) == i]
            bands: list = [None] * len(sets)
            if own:
                bounds = np.concatenate(([0], np.cumsum([len(sets[i]) for i in own])))
                for i, row in zip(own, band_hashes(super_minhash(np.concatenate([sets[i] for i in own]), bounds, BANDS * ROWS))):
                    bands[i] = row
            digests = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(bands, pa.list_(pa.int64()))], ["doc", "n", "d1", "d2", "bands"])

        for b in common.small(batches):
            rows, sets, size = [], [], 0
            for doc, text in sorted(zip(b.column(0).to_pylist(), texts(b.column(1)))):
                rows.append(doc)
                sets.append(shingles(text, k))
                size += len(sets[-1])
                if size >= TOGETHER:
                    yield flush(rows, sets)
                    rows, sets, size = [], [], 0
            if rows:
                yield flush(rows, sets)

    return task


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of the edges (a, b).

    Each round points every node's larger neighbours, then the node itself and its smaller neighbours, at the smallest of
    them, until nothing changes. Edges stay tables; only a count and a checksum reach the driver.
    """
    spark, state, before = edges.sparkSession, None, None
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        table = common.made()
        now = common.written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if before is not None:
            common.release(spark, before, before + 1)
        before = table
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        for b in common.small(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(task, "a long, b long")


def _shingle_sets(k: int):
    def task(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in common.small(batches):
            sets = [shingles(t, k).tobytes() for t in texts(b.column(1))]
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, sets)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(sets, pa.binary())], ["d1", "d2", "shingles"])

    return task


def _elements(batches):
    """A row for each element of a set."""
    import numpy as np
    import pyarrow as pa

    for b in common.small(batches):
        sets = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
        of = np.repeat(b.column(0).to_numpy(), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate(sets))], ["class", "element"])


def rare_pairs(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of classes (class, n, component) of different components that share one of their rarest elements.

    All elements have one order, the rarest first. Two sets that reach the threshold share an element among the first
    n - ceil(t n) + 1 of the larger and the first n - ceil(2t / (1 + t) n) + 1 of the smaller: else too few are left
    to share. For the same reason the first element that they share isn't so late in either that what follows is too
    little. So no link is lost, and sets that merely have common elements never leave the join, which is by element; Spark
    splits an element that many sets start with.
    """
    each = classes.join(sets, "class").select("class", "shingles").mapInArrow(_elements, "class long, element long")
    many = each.groupBy("element").agg(F.count("*").alias("held")).where("held > 1")
    # an element that one set alone holds joins nothing, but takes a place in the order
    named = each.join(many, "element", "left").select("class", F.struct(F.coalesce("held", F.lit(1)).alias("held"), "element").alias("e"))
    ordered = named.groupBy("class").agg(F.array_sort(F.collect_list("e")).alias("all")).join(classes, "class")
    long = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    short = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
    firsts = ordered.select("class", "n", "component", short.alias("short"), F.posexplode(F.slice("all", F.lit(1), long.cast("int"))).alias("at", "e")).where("e.held > 1")
    firsts = common.written(firsts.select("class", "n", "component", "at", "short", F.col("e.element").alias("element")), "rare")
    x, y = firsts.alias("x"), firsts.where(F.col("at") < F.col("short")).alias("y")
    smaller = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.class") < F.col("x.class")))
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    near = smaller & (F.col("x.component") != F.col("y.component")) & ((100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n")))
    met = x.join(y, F.col("x.element") == F.col("y.element")).where(near)
    return met.select(F.greatest("x.class", "y.class").alias("a"), F.least("x.class", "y.class").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", small: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: component_id is the smallest id that links reach.

    Two texts are linked if 100 * |A and B| >= percent * |A or B| for their sets of `shingle`-word shingles (words
    between ASCII white space, A-Z lowered); a text with fewer words is one shingle; one without words, or null, has an
    empty set, no link, and its own id. A null id is the largest. Rows of one id are linked each by its own text. Other
    columns are left out; an empty table gives no rows.

    Equal sets are one class. Classes that share a band are candidates. First, buckets of at most `small` classes compare
    all of them, larger ones compare each with the class that most others share bands with and with one chosen by hash;
    confirmed links form components. Then larger buckets that still hold several components have their classes compared
    with those of other components that share a rare element (see rare_pairs), which loses no link. Every pair of a
    bucket is thus linked, excluded exactly, or connected already; no bucket is capped or paired out.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    top = (1 << 63) - 1
    base = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(top)).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    signed = common.written(base.mapInArrow(_sign(shingle), _SIGNED), "signed")
    some = signed.where("n > 0")
    # a signature is in at least one row of each class: the first of each batch
    classes = some.groupBy("d1", "d2").agg(F.min("doc").alias("first"), F.first("n").alias("n"), F.first("bands", ignorenulls=True).alias("bands"))
    classes = common.written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    first = common.made()
    banded = classes.select("class", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    members = common.written(banded.join(shared, "bucket"), "members")
    wanted = common.written(members.select("class").distinct().join(classes.select("class", "d1", "d2", "first"), "class"), "wanted")
    # these ids are a share of all, so they are shuffled at every size
    whole = base.join(wanted.select(F.col("first").alias("doc")).distinct().hint("merge"), "doc").mapInArrow(_shingle_sets(shingle), "d1 long, d2 long, shingles binary")
    once = whole.groupBy("d1", "d2").agg(F.first("shingles").alias("shingles"))
    sets = common.written(once.join(wanted, ["d1", "d2"]).select("class", "shingles"), "sets")
    fits = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))

    few = members.where(F.col("k") <= small)
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, F.col("x.bucket") == F.col("y.bucket")).where((F.col("x.class") < F.col("y.class")) & fits(F.col("x.n"), F.col("y.n"))).select(F.col("x.class").alias("b"), F.col("y.class").alias("a"))
    many = members.where(F.col("k") > small)
    many = common.written(many.join(members.groupBy("class").agg(F.sum("k").alias("mates")), "class"), "many")
    central, other = F.max(F.struct("mates", "class", "n")), F.min(F.struct(F.xxhash64("class").alias("h"), "class", "n"))
    picks = many.groupBy("bucket").agg(central.alias("c"), other.alias("o")).select("bucket", F.explode(F.array_distinct(F.array(F.struct("c.class", "c.n"), F.struct("o.class", "o.n")))).alias("p"))
    picks = picks.select("bucket", F.col("p.class").alias("b"), F.col("p.n").alias("bn"))
    pairs = pairs.unionByName(many.join(picks, "bucket").where((F.col("class") != F.col("b")) & fits(F.col("n"), F.col("bn"))).select(F.greatest("class", "b").alias("a"), F.least("class", "b").alias("b")))
    links = common.written(_verified(pairs.distinct(), sets, percent), "links")
    labels, kept = common.written(components(links), "labels"), common.made() - 1

    labelled = many.join(labels, many["class"] == labels.node, "left").select("bucket", "class", "n", F.coalesce("component", "class").alias("component"))
    parts = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    left = common.written(labelled.join(parts, "bucket").select("class", "n", "component").distinct(), "left")
    if not left.isEmpty():
        more = common.written(_verified(rare_pairs(left, sets, percent), sets, percent), "links")
        if not more.isEmpty():
            labels, kept = common.written(components(links.unionByName(more)), "labels"), common.made() - 1
    common.release(spark, first, kept)
    common.release(spark, kept + 1)

    named = classes.join(labels, classes["class"] == labels.node, "left").select("d1", "d2", "first", F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    out = some.select("doc", "n", "d1", "d2").join(named.join(least, "component").select("d1", "d2", "least"), ["d1", "d2"]).select("doc", "n", F.col("least").alias("component"))
    out = out.unionByName(signed.where("n = 0").select("doc", "n", F.col("doc").alias("component")))
    null = lambda c: F.when(F.col(c) != top, F.col(c))
    return out.select(null("doc").alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))
