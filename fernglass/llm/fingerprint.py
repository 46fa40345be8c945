"""Document fingerprints: exact digests of canonical text, with bytes compared where digests are equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.llm import common

_LAST = (1 << 63) - 1
#: Keys that may be sent to every task: 16 bytes each.
SENT = 1_000_000


def canonical(text: Column) -> Column:
    """Text with compatibility composition (NFKC), full case folding, and each run of white space as one space; trimmed."""
    nfkc = lambda c: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"(?U)\s+", " "))


def wide_hash(c: Column, bits: int = 64) -> tuple[Column, Column]:
    """Two 64-bit xxhash values with different seeds; fewer bits are for tests of equal digests of unequal texts."""
    mask = (1 << bits) - 1 if bits < 64 else -1
    return F.xxhash64(c).bitwiseAND(F.lit(mask).cast("long")), F.xxhash64(F.lit(0x5EED), c).bitwiseAND(F.lit(mask).cast("long"))


def _hex(a: Column, b: Column, n: Column) -> Column:
    digest = F.concat(F.lpad(F.lower(F.hex(a)), 16, "0"), F.lpad(F.lower(F.hex(b)), 16, "0"))
    return F.when(n > 0, F.concat(digest, F.lit("-"), n.cast("string"))).otherwise(digest)


def _ordinals(texts: DataFrame) -> DataFrame:
    """key..., a, b, n for rows (key..., a, b, canon) whose digest several canonical texts have: n numbers those texts from 0
    in the order of their bytes. Copies meet as one row for each task; the texts of one digest are few."""
    each = texts.groupBy("a", "b", "canon").agg(F.count("*").alias("k"))
    several = each.groupBy("a", "b").agg(F.sort_array(F.collect_list("canon")).alias("all")).where(F.size("all") > 1)
    return texts.join(several, ["a", "b"]).withColumn("n", F.array_position("all", F.col("canon")) - 1).drop("all", "canon")


def _small(df: DataFrame) -> DataFrame:
    """Sent to every task if its rows, counted, are few; else joined by shuffle."""
    return F.broadcast(df) if df.count() <= SENT else df


def _base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(t).alias("dig"), t.alias("text"))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """doc_id, fingerprint for every row: equal for equal canonical texts and different for different ones.

    Digests are 128 bits of xxhash. Only where rows share a digest are their canonical texts compared, byte by byte;
    should they differ, the digest gets a number for each text. Null texts are empty; null ids and repeated rows stay.
    """
    common.prepare(docs.sparkSession)
    canon = canonical(F.col("text"))
    a, b = wide_hash(F.col("canon"), bits)
    keyed = _base(docs, doc_id, text).withColumn("canon", canon).select("doc", "dig", "canon", a.alias("a"), b.alias("b"))
    keys = common.written(keyed.select("doc", "dig", "a", "b"), "keys")
    shared = common.written(keys.groupBy("a", "b").agg(F.count("*").alias("k")).where("k > 1").select("a", "b"), "shared")
    odd = common.written(_ordinals(keyed.join(_small(shared), ["a", "b"])).select("doc", "dig", "n").distinct(), "odd")
    out = keys.withColumn("n", F.lit(0)) if odd.isEmpty() else keys.join(odd, ["doc", "dig"], "left")
    return out.select(F.expr(f"nullif(doc, {_LAST})").alias("doc_id"), _hex(F.col("a"), F.col("b"), F.coalesce("n", F.lit(0))).alias("fingerprint"))


def _followers(base: DataFrame) -> DataFrame:
    """doc, dig, n_chars, next_doc, next_dig: the document after each in the order of id (equal ids: of a hash), the
    first after the last. Only ids and lengths move."""
    ids = base.groupBy("doc", "dig").agg(F.max(F.length("text")).alias("n_chars"))
    placed = common.written(common.running_total(ids, [F.col("doc"), F.col("dig")], F.lit(1), "at"), "placed")
    total = placed.count()
    after = placed.select(F.when(F.col("at") == 0, F.lit(total - 1)).otherwise(F.col("at") - 1).alias("at"), F.col("doc").alias("next_doc"), F.col("dig").alias("next_dig"))
    return common.written(placed.join(after, "at").select("doc", "dig", "n_chars", "next_doc", "next_dig"), "followers")


def _edited(base: DataFrame, followers: DataFrame) -> DataFrame:
    """doc, dig, text, edited: the last quarter of the text replaced by as many first code points of the next."""
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    wanted = followers.select(F.col("doc").alias("to_doc"), F.col("dig").alias("to_dig"), quarter.alias("q"), F.col("next_doc").alias("doc"), F.col("next_dig").alias("dig"))
    heads = base.join(wanted, ["doc", "dig"]).select(F.col("to_doc").alias("doc"), F.col("to_dig").alias("dig"), "q", F.expr("substring(text, 1, q)").alias("head"))
    heads = heads.groupBy("doc", "dig", "q").agg(F.max("head").alias("head"))
    return base.join(heads, ["doc", "dig"]).select("doc", "dig", "text", F.concat(F.expr("substring(text, 1, length(text) - q)"), "head").alias("edited"))


def edited_fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """How the fingerprint of each text stands to those of an edited text and of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row. The edited text
    has its last floor(n_chars/4) code points replaced by the first as many (or all) of the next document in ascending
    id, the first after the last. Likeness of exact digests is 1 or 0. Null texts are empty; a null id is the largest;
    rows with equal id and text are one document in the order and keep a row each.

    Whole texts are shuffled once: both joins deal them by the same key. Texts are read again only for the rows whose
    digest another row has, to compare bytes.
    """
    common.prepare(docs.sparkSession)
    base = _base(docs, doc_id, text)
    followers = _followers(base)

    def keyed(pairs: DataFrame) -> DataFrame:
        c = pairs.withColumn("c", canonical(F.col("text"))).withColumn("ec", canonical(F.col("edited")))
        (a, b), (ea, eb) = wide_hash(F.col("c"), bits), wide_hash(F.col("ec"), bits)
        return c.withColumns({"a": a, "b": b, "ea": ea, "eb": eb})

    keys = keyed(_edited(base, followers)).select("doc", "dig", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "a", "b", "ea", "eb")
    keys = common.written(keys, "keys")
    both = keys.select("a", "b").unionByName(keys.select(F.col("ea").alias("a"), F.col("eb").alias("b")))
    shared = common.written(both.groupBy("a", "b").agg(F.count("*").alias("k")).where("k > 1").select("a", "b"), "shared")
    sent = _small(shared)
    rows = keys.join(sent, ["a", "b"], "left_semi").select("doc", "dig").unionByName(keys.join(sent.select(F.col("a").alias("ea"), F.col("b").alias("eb")), ["ea", "eb"], "left_semi").select("doc", "dig"))
    few = common.written(followers.join(rows.distinct(), ["doc", "dig"]), "few")
    needed = common.written(few.select("doc", "dig").unionByName(few.select(F.col("next_doc").alias("doc"), F.col("next_dig").alias("dig"))).distinct(), "needed")
    again = keyed(_edited(base.join(_small(needed), ["doc", "dig"], "left_semi"), few))
    again = again.select("doc", "dig", F.explode(F.array(F.struct(F.lit(0).alias("kind"), "a", "b", F.col("c").alias("canon")), F.struct(F.lit(1).alias("kind"), F.col("ea").alias("a"), F.col("eb").alias("b"), F.col("ec").alias("canon")))).alias("x")).select("doc", "dig", "x.*")
    odd = common.written(_ordinals(again).select("doc", "dig", "kind", "n").distinct(), "odd")

    if odd.isEmpty():
        full = keys.withColumns({"n": F.lit(0), "en": F.lit(0)})
    else:
        full = keys.join(odd.where("kind = 0").select("doc", "dig", "n"), ["doc", "dig"], "left").join(odd.where("kind = 1").select("doc", "dig", F.col("n").alias("en")), ["doc", "dig"], "left")
    full = full.select("doc", "dig", "n_chars", "edited_sha256", _hex(F.col("a"), F.col("b"), F.coalesce("n", F.lit(0))).alias("fingerprint"), _hex(F.col("ea"), F.col("eb"), F.coalesce("en", F.lit(0))).alias("edited_fingerprint"))
    nexts = followers.join(full.select(F.col("doc").alias("next_doc"), F.col("dig").alias("next_dig"), F.col("fingerprint").alias("next")).distinct(), ["next_doc", "next_dig"]).select("doc", "dig", "next")
    same = lambda x, y: (F.col(x) == F.col(y)).cast("double")
    return full.join(nexts, ["doc", "dig"]).select(F.expr(f"nullif(doc, {_LAST})").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("fingerprint", "edited_fingerprint").alias("near_edited"), same("fingerprint", "next").alias("near_next"))
