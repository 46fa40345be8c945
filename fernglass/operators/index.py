"""An inverted index that grows by segments, and searches that look up hot words only where they can still matter.

An index is a folder. Each change adds a segment: the windows of the documents it brings, as lists of terms (windows), blocks of
postings by term (postings), what it adds to the terms' counts and takes from them (delta), all counts after it (totals), the
least weights that its bounds rest on (least), and the documents whose earlier windows no longer count (gone). The list of live
segments is published last, so readers see the index before a change or after it.
Counts of segments add up to those of a new index; no posting of another document is read or written by a change.

A block has the postings that one term has in one batch of windows, so postings are written where their windows are and never
shuffled; what a search needs of a term is the largest share in each of its blocks, then the blocks that may matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators.retrieval import chunk
from fernglass.operators.search import best_of
from fernglass.session import written
from fernglass.sources.files import publish

#: Windows are dealt to files by their document's bucket, so that a change of few documents skips the files of others.
BUCKETS = 64
_WINDOW = ["part", "doc", "chunk_index"]
#: Rounding of sums may put a bound this far below a score.
SLACK = 1e-9
#: A term is frequent if a part has it in one of so many windows of all parts. A window has a bounded number of terms, so the
#: frequent terms are bounded, however many windows there are, and may be sent to every task. Others weigh at least the floor.
FREQUENT = 20_000
#: Ids of documents that may be sent to every task; more are shuffled.
SENT = 1_000_000
#: Shares of postings are rounded up to this part of 1.
STEP = 4096


def _bucket(doc: str) -> Column:
    return F.pmod(F.xxhash64(F.col(doc).cast("string")), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """What the segments have: blocks of postings (part, term, most, posts of doc, chunk_index, u), windows (part, doc, chunk_index,
    terms), both with their segment's number and documents that are gone; counts of what is live (part, term, df, idf); gone
    (doc, last), and the numbers of segments. u bounds tf over the window's norm, most the u of a block."""

    postings: DataFrame
    windows: DataFrame
    counts: DataFrame
    gone: DataFrame
    segments: list[str]

    def standing(self, rows: DataFrame) -> DataFrame:
        """Rows of documents that no later segment replaces or removes."""
        return _standing(rows, self.gone)


def _live(spark: SparkSession, path: str) -> list[tuple[int, str, dict]]:
    rows = publish(spark, f"{path}/live")
    return sorted((r.number, r.segment, dict(r.least)) for r in rows.collect()) if rows is not None else []


def _all(spark: SparkSession, path: str, live, name: str) -> DataFrame | None:
    """One table of all live segments, with each row's segment number."""
    out = None
    for number, segment, _ in live:
        rows = spark.read.parquet(f"{path}/{segment}/{name}").withColumn("number", F.lit(number))
        out = rows if out is None else out.unionByName(rows)
    return out


def _few(ids: DataFrame) -> DataFrame:
    """A table of ids, to be sent to every task if there are few; big rows that are joined with it stay where they are then."""
    return F.broadcast(ids) if ids.limit(SENT + 1).count() <= SENT else ids


def _gone(spark: SparkSession, path: str, live) -> DataFrame:
    """doc, last: the last segment that replaces or removes a document. The first segment has none before it."""
    gone = _all(spark, path, live[1:], "gone")
    if gone is None:
        gone = _all(spark, path, live, "gone").where("false")
    return _few(gone.groupBy("doc").agg(F.max("number").alias("last")))


def _standing(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.withColumnRenamed("doc", "_doc"), (F.col("doc") == F.col("_doc")) & (F.col("number") < F.col("last")), "left_anti")


def _idf(n: Column, df: Column) -> Column:
    return F.ln((n + 1) / (df + 1)) + 1


def _totals(counts: DataFrame) -> DataFrame:
    """part, term, df, idf, frequent of counts (part, term, df), each term once. The null term of a part counts its windows; its
    weight is the floor, below that of any term of the part that isn't frequent."""
    n = counts.where("term is null").select(F.col("part").alias("_p"), F.col("df").alias("_n"))  # a row for each part
    bound = n.agg((F.sum("_n") / FREQUENT).alias("_b"))
    floor = F.greatest(F.lit(1.0), _idf(F.col("_n"), F.col("_b")))
    rows = counts.where("df > 0").join(F.broadcast(n.crossJoin(bound)), F.col("part").eqNullSafe(F.col("_p")))
    return rows.select("part", "term", "df", F.when(F.col("term").isNull(), floor).otherwise(_idf(F.col("_n"), F.col("df"))).alias("idf"), (F.col("term").isNull() | (F.col("df") >= F.col("_b"))).alias("frequent"))


def change(spark: SparkSession, path: str, docs: DataFrame, tokens: Callable, *, part: str, doc: str, text: str, removed: DataFrame | None = None, size: int = 700, overlap: int = 150) -> str:
    """Add a segment: docs are new documents or new texts of old ones, `removed` (column doc) are to go. Its name.

    Null ids can't be changed later, so they are refused; of several rows of one id all windows count.
    """
    live = _live(spark, path)
    number, segment = (live[-1][0] + 1 if live else 1), f"segment-{uuid.uuid4().hex}"
    if not docs.where(F.col(doc).isNull()).isEmpty():
        raise ValueError("documents need an id")
    dealt = docs.select(part, doc, text, _bucket(doc).alias("bucket")).hint("rebalance", "bucket")  # texts are shorter than their windows
    terms = chunk(dealt, part=part, doc=doc, text=text, size=size, overlap=overlap, lines=False).select(*_WINDOW, T.counted(tokens(F.col("text"))).alias("terms"))
    terms = terms.withColumn("bucket", _bucket("doc"))
    _write(terms, f"{path}/{segment}/windows")
    own = spark.read.schema(terms.schema).parquet(f"{path}/{segment}/windows")
    gone = docs.select(F.col(doc).alias("doc"))
    gone = (gone if removed is None else gone.unionByName(removed.select(F.col("doc")))).distinct().withColumn("bucket", _bucket("doc"))
    gone.write.parquet(f"{path}/{segment}/gone")
    each = lambda w: w.select("part", F.explode(F.array_append(F.transform("terms", lambda x: x["term"]), F.lit(None).cast("string"))).alias("term"))
    delta = each(own).groupBy("part", "term").agg(F.count("*").alias("df"))
    if live:
        gone = spark.read.parquet(f"{path}/{segment}/gone")
        buckets = [r.bucket for r in gone.select("bucket").distinct().collect()]  # BUCKETS at most
        old = _all(spark, path, live, "windows").where(F.col("bucket").isin(buckets)).join(_few(gone.select("doc")), "doc", "left_semi")
        delta = delta.unionByName(each(_standing(old, _gone(spark, path, live))).groupBy("part", "term").agg((-F.count("*")).alias("df"))).groupBy("part", "term").agg(F.sum("df").alias("df"))
    _write(delta, f"{path}/{segment}/delta")
    _write_totals(spark, path, segment, [*live, (number, segment, {})])
    _write_postings(spark, path, segment, own)
    _publish(spark, path, live, (number, segment, {}))
    return segment


def _write(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "zstd").parquet(path)


def _write_totals(spark: SparkSession, path: str, segment: str, live) -> None:
    """All counts after a change, and the least weights its bounds rest on: of its frequent terms, and the floor of the others."""
    counts = _all(spark, path, live, "delta").drop("number")
    if len(live) > 1:
        counts = written(counts.groupBy("part", "term").agg(F.sum("df").alias("df")), "counts")
    _write(_totals(counts), f"{path}/{segment}/totals")
    _frequent(spark, path, segment).write.parquet(f"{path}/{segment}/least")


def _frequent(spark: SparkSession, path: str, segment: str) -> DataFrame:
    """part, term, low of the frequent terms, low their weight if it is below the floor; the floor for the null term."""
    totals = spark.read.parquet(f"{path}/{segment}/totals")
    floor = totals.where("term is null").select(F.col("part").alias("_p"), F.col("idf").alias("_f"))
    return totals.where("frequent").join(F.broadcast(floor), F.col("part").eqNullSafe(F.col("_p"))).select("part", "term", F.least("idf", "_f").alias("low"))


def _write_postings(spark: SparkSession, path: str, segment: str, windows: DataFrame) -> None:
    """Blocks of a segment's postings: of each batch of windows its terms in order, with the windows that have them. Shares rest on
    norms that take a term that isn't frequent for one at the floor: no norm is less, so no share is more."""
    low = spark.sparkContext.broadcast({(r.part, r.term): r.low for r in spark.read.parquet(f"{path}/{segment}/least").collect()})  # as many as FREQUENT lets be

    def blocks(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = {}
        for (part, term), x in low.value.items():
            known.setdefault(part, []).append((term, x))
        known = {p: (pa.array([t for t, _ in x], pa.string()), np.array([w for _, w in x])) for p, x in known.items()}
        for b in batches:
            of = b.column("part").dictionary_encode(null_encoding="encode")
            for i, part in enumerate(of.dictionary.to_pylist()):
                rows = np.flatnonzero(of.indices.to_numpy(zero_copy_only=False) == i)
                w = b.take(pa.array(rows))
                lists = w.column("terms")
                n = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                if not len(flat):
                    continue
                terms, tf = flat.field("term"), flat.field("tf").to_numpy().astype(float)
                names, weights = known[part]
                at = terms.dictionary_encode()
                order = pc.sort_indices(at.dictionary).to_numpy()
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                sorted_terms = at.dictionary.take(pa.array(order))
                found = pc.fill_null(pc.index_in(sorted_terms, value_set=names), -1).to_numpy()
                lows = np.where(found < 0, low.value[part, None], weights[found])
                code, window = place[at.indices.to_numpy()], np.repeat(np.arange(len(rows)), n)
                norm = np.sqrt(np.bincount(window, (tf * lows[code]) ** 2, len(rows)))
                u = np.ceil(tf / norm[window] * STEP) / STEP
                by = np.argsort(code, kind="stable")
                starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(order)))])
                posts = pa.StructArray.from_arrays([w.column("doc").take(pa.array(window[by])), w.column("chunk_index").take(pa.array(window[by])), pa.array(u[by].astype(np.float32))], ["doc", "chunk_index", "u"])
                most = np.maximum.reduceat(u[by], starts[:-1])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(order), pa.string()), sorted_terms, pa.array(lows), pa.array(most), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), posts)], ["part", "term", "low", "most", "posts"])

    kinds = dict(windows.dtypes)
    _write(windows.select(F.col("part").cast("string").alias("part"), "doc", "chunk_index", "terms").mapInArrow(blocks, f"part string, term string, low double, most double, posts array<struct<doc: {kinds['doc']}, chunk_index: int, u: float>>"), f"{path}/{segment}/postings")


def _publish(spark: SparkSession, path: str, old, new) -> None:
    """Publish the live segments, each with how far the least weights of its terms have fallen since it was written, by part:
    norms of its windows have fallen no further."""
    rows = [new]
    now = F.broadcast(_frequent(spark, path, new[1]).select(F.col("part").alias("_p"), F.col("term").alias("_t"), F.col("low").alias("_low")))
    for number, segment, _ in old:
        was = spark.read.parquet(f"{path}/{segment}/postings").select("part", "term", "low").unionByName(spark.read.parquet(f"{path}/{segment}/least").where("term is null"))
        least = was.join(now, F.col("part").eqNullSafe(F.col("_p")) & F.col("term").eqNullSafe(F.col("_t"))).groupBy("part").agg(F.min(F.col("_low") / F.col("low")).alias("r")).collect()
        rows.append((number, segment, {r.part or "": min(1.0, r.r) for r in least}))  # a row for each part
    publish(spark, f"{path}/live", spark.createDataFrame(rows, "number int, segment string, least map<string, double>"))


def read(spark: SparkSession, path: str) -> Index:
    """The live index."""
    live = _live(spark, path)
    if not live:
        raise FileNotFoundError(f"no index in {path}")
    fall = spark.createDataFrame([(n, p, r) for n, _, least in live for p, r in least.items()], "_n int, _part string, r double")
    blocks = _all(spark, path, live, "postings").join(F.broadcast(fall), (F.col("number") == F.col("_n")) & (F.coalesce("part", F.lit("")) == F.col("_part")), "left")
    blocks = blocks.select("number", "part", "term", *[(F.col(c) / F.coalesce("r", F.lit(1.0))).alias(c) for c in ("most",)], "posts", F.coalesce("r", F.lit(1.0)).alias("r"))
    counts = spark.read.parquet(f"{path}/{live[-1][1]}/totals").where("term is not null").select("part", "term", "df", "idf")
    return Index(blocks, _all(spark, path, live, "windows"), counts, _gone(spark, path, live), [s for _, s, _ in live])


def compact(spark: SparkSession, path: str) -> str:
    """Write what is live as one segment in place of all; its name. Readers that have opened the old ones keep them."""
    live = _live(spark, path)
    segment = f"segment-{uuid.uuid4().hex}"
    at = read(spark, path)
    rows = at.standing(at.windows).select(*_WINDOW, "terms", "bucket")
    _write(rows.hint("rebalance", "bucket"), f"{path}/{segment}/windows")
    own = spark.read.schema(rows.schema).parquet(f"{path}/{segment}/windows")
    _all(spark, path, live, "gone").select("doc", "bucket").limit(0).write.parquet(f"{path}/{segment}/gone")
    _write(_all(spark, path, live, "delta").groupBy("part", "term").agg(F.sum("df").alias("df")).where("df > 0"), f"{path}/{segment}/delta")
    new = (live[-1][0] + 1, segment, {})
    _write_totals(spark, path, segment, [new])
    _write_postings(spark, path, segment, own)
    _publish(spark, path, [], new)
    return segment


def _scores(index: Index, wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """qid, doc, chunk_index, score of wanted (qid, part, doc, chunk_index): the cosine, from the windows' own lists of terms."""
    keys = wanted.select("part", "doc", "chunk_index").distinct()
    held = index.standing(index.windows.join(keys, _WINDOW, "left_semi"))
    flat = held.select(*_WINDOW, F.explode("terms").alias("x")).select(*_WINDOW, F.col("x.term").alias("term"), F.col("x.tf").alias("tf"))
    flat = written(written(flat, "flat").join(index.counts.select("part", "term", "idf"), ["part", "term"]), "wanted")  # few beside the counts
    norms = flat.groupBy(*_WINDOW).agg(F.sqrt(F.sum(F.col("tf") * F.col("idf") * F.col("tf") * F.col("idf"))).alias("norm"))
    dots = wanted.join(terms.select("qid", "part", "term", "qv"), ["qid", "part"]).join(flat, [*_WINDOW, "term"]).groupBy("qid", *_WINDOW).agg(F.sum(F.col("tf") * F.col("idf") * F.col("qv")).alias("dot"))
    q = terms.select("qid", "qnorm").distinct()
    return dots.join(norms, _WINDOW).join(q, "qid").select("qid", "doc", "chunk_index", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 9).alias("score"))


def search(index: Index, queries: DataFrame, tokens: Callable, *, k: int = 10) -> DataFrame:
    """qid, doc, chunk_index, score: as retrieval.tfidf_search over all live documents, the same rows.

    A term adds at most its largest share times its weights to a score. The k windows with most of a query's rarest
    term are scored first; the k-th best score is what others must reach. Terms whose bounds together stay below
    it bring no window in alone: their postings aren't joined. Of the other terms a block, then a posting, counts where its own
    share and the bounds of the query's other terms reach the score; what windows met this way can reach by all of their
    shares is summed. What is left is scored by the windows' own lists.
    """
    asked = written(queries.select("qid", "part", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "part", "term").agg(F.count("*").alias("qtf")), "asked")
    most = index.postings.join(asked.select("part", "term").distinct(), ["part", "term"], "left_semi").groupBy("part", "term").agg(F.max("most").alias("most"))
    q = asked.join(index.counts, ["part", "term"]).join(most, ["part", "term"]).withColumn("qv", F.col("qtf") * F.col("idf"))
    per = Window.partitionBy("qid")  # a query's terms
    q = q.withColumn("qnorm", F.sqrt(F.sum(F.col("qv") * F.col("qv")).over(per))).withColumn("bound", F.col("most") * F.col("idf") * F.col("qv") / F.col("qnorm"))
    upwards = per.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = written(q.withColumns({"below": F.sum("bound").over(upwards), "all": F.sum("bound").over(per), "rarity": F.row_number().over(per.orderBy("df", "term"))}), "query")
    weight = F.col("idf") * F.col("qv") / F.col("qnorm")
    others = F.col("all") - F.col("bound")  # what the query's other terms can add

    def met(of: DataFrame, least: Column | None = None) -> DataFrame:
        """Postings of a query's terms, by blocks that may matter first."""
        held = index.postings.withColumnRenamed("most", "_most").join(of, ["part", "term"])
        held = held if least is None else held.where(F.col("_most") * weight + others >= least)
        one = held.withColumn("x", F.explode("posts")).withColumn("u", F.col("x.u") / F.col("r"))
        one = one if least is None else one.where(F.col("u") * weight + others >= least)
        return index.standing(one.withColumns({"doc": F.col("x.doc"), "chunk_index": F.col("x.chunk_index")}).drop("posts", "x"))

    seeds = best_of(met(terms.where("rarity = 1")).select("qid", *_WINDOW, "u"), F.desc("u"), F.col("doc"), F.col("chunk_index"), limit=k).select("qid", *_WINDOW)
    first = written(_scores(index, written(seeds, "seeds"), terms), "first")
    reach = first.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("score")).select("qid", F.when(F.col("n") >= k, F.col("score")).otherwise(0.0).alias("least"))
    may = terms.join(reach, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK).where("below >= least")
    may = written(may.withColumn("rest", F.col("all") - F.sum("bound").over(per)), "may")  # what terms that bring in no window can add
    # a window that lacks a posting here can't reach the score, whatever else it has
    summed = met(may, F.col("least")).groupBy("qid", *_WINDOW).agg(F.sum(F.col("u") * weight).alias("_sum"), F.first("rest").alias("rest"), F.first("least").alias("least")).where(F.col("_sum") + F.col("rest") >= F.col("least"))
    more = written(summed.select("qid", *_WINDOW).join(first.select("qid", "doc", "chunk_index"), ["qid", "doc", "chunk_index"], "left_anti"), "met")
    scored = first.unionByName(_scores(index, more, terms))
    return best_of(scored, F.desc("score"), F.col("doc"), F.col("chunk_index"), limit=k).drop("_r")
