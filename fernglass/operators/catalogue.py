"""Catalogue records: normalising, checking, merging duplicates, bulk edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.functions import text as T
from fernglass.operators.matching import containing
from fernglass.operators.similarity import close_pairs
from fernglass.session import numbered


def normalise_entries(rows: DataFrame, *, default_category: str = "other") -> DataFrame:
    """Entries with trimmed strings in place of nulls, tags and areas as arrays (of text between commas or newlines), a default
    category, and area_checked as boolean."""
    out = {}
    for f in rows.schema.fields:
        kind = f.dataType.simpleString()
        if f.name in ("tags", "areas", "links", "payment"):
            out[f.name] = T.split_list(F.col(f.name)) if kind == "string" else F.filter(F.transform(F.coalesce(f.name, F.expr("cast(array() as array<string>)")), lambda x: F.trim(x)), lambda x: x != "")
        elif f.name == "area_checked":
            out[f.name] = T.truthy(F.col(f.name))
        elif kind == "string":
            out[f.name] = F.trim(F.coalesce(f.name, F.lit("")))
    rows = rows.withColumns(out)
    return rows.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit(default_category))) if "category" in rows.columns else rows


def violations(rows: DataFrame, *, order: str, title: str = "title", areas: str = "areas") -> DataFrame:
    """order, problem of entries without a title or areas; no rows means a valid payload."""
    problems = F.filter(F.array(F.when(F.coalesce(F.trim(title), F.lit("")) == "", "title"), F.when(F.coalesce(F.size(areas), F.lit(0)) <= 0, "areas")), lambda p: p.isNotNull())
    return rows.select(order, F.explode(problems).alias("problem"))


def mode_or_longest(rows: DataFrame, *, key: str, value: str, order: str) -> DataFrame:
    """key, value: of each key's values the normalised form (NFKC, single spaces; case counts) that is most frequent, then
    longest, then first; of its raw forms, trimmed, the longest, then first. Blank values don't count."""
    raw = T.strip(F.col(value))
    forms = rows.where(F.coalesce(raw, F.lit("")) != "").select(key, raw.alias("raw"), T.squeeze(T.nfkc(raw)).alias("norm"), F.col(order).alias("o"))
    per = forms.groupBy(key, "norm").agg(F.count("*").alias("n"), F.min("o").alias("f"), F.max_by("raw", F.struct(F.length("raw"), -F.col("o"))).alias("raw"))
    return per.groupBy(key).agg(F.max_by("raw", F.struct("n", F.length("norm"), -F.col("f"))).alias(value))


# fixed values: what links of map services contain
MAP_HOSTS = ("google.com/maps", "goo.gl/maps", "maps.app.goo.gl", "g.page", "g.co/kgs")


def url_score(url: Column) -> Column:
    """How much a text looks like a map link: 2 for its scheme, 10 for a map service, 2 for "maps", 1 for 20 characters."""
    yes = lambda c, n: F.when(c, n).otherwise(0)
    host = F.lit(False)
    for h in MAP_HOSTS:
        host = host | url.contains(h)
    return yes(url.startswith("http://") | url.startswith("https://"), 2) + yes(host, 10) + yes(url.contains("maps"), 2) + yes(F.length(url) >= 20, 1)


def best_url(rows: DataFrame, *, key: str, url: str, order: str) -> DataFrame:
    """key, url: each key's best link by score, then length, then order."""
    some = rows.withColumn(url, T.strip(F.col(url))).where(F.coalesce(url, F.lit("")) != "")
    return some.groupBy(key).agg(F.max_by(url, F.struct(url_score(F.col(url)), F.length(url), -F.col(order))).alias(url))


def merge_maps(rows: DataFrame, *, key: str, value: str, order: str) -> DataFrame:
    """key, value: each key's maps as one; a name's value is the most frequent, then longest, then first (see mode_or_longest).
    Names without a value are left out, and so are keys without a name."""
    named = rows.select(key, order, F.explode(value).alias("_n", "_v")).withColumn("_k", F.struct(key, "_n"))
    best = mode_or_longest(named, key="_k", value="_v", order=order)
    return best.groupBy(F.col(f"_k.{key}").alias(key)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k._n", "_v")))).alias(value))


def merge_duplicates(rows: DataFrame, *, title: str, order: str, modal: list[str] = (), lists: list[str] = (), flags: list[str] = (), first: list[str] = (), urls: list[str] = (), maps: list[str] = ()) -> DataFrame:
    """One row for each title key: title_key, ord (its first row), n, and the merged columns. A blank title merges with nothing.

    modal: most frequent, then longest; lists: items in order of first occurrence; flags: any; first: first that isn't null;
    urls: best link; maps: the mode of each name. Every column is an aggregate that combines before the shuffle, so no group is held as a list; only
    the distinct items of a key's list columns are.
    """
    key = F.when(T.title_key(F.col(title)) == "", F.concat(F.lit("\0"), F.col(order).cast("string"))).otherwise(T.title_key(F.col(title)))
    rows = rows.withColumn("title_key", key)
    out = rows.groupBy("title_key").agg(
        F.min(order).alias("ord"), F.count("*").alias("n"),
        *[F.bool_or(c).alias(c) for c in flags], *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first],
    )
    for c in modal:
        out = out.join(mode_or_longest(rows, key="title_key", value=c, order=order), "title_key", "left")
    for c in urls:
        out = out.join(best_url(rows, key="title_key", url=c, order=order), "title_key", "left")
    for c in maps:
        out = out.join(merge_maps(rows, key="title_key", value=c, order=order), "title_key", "left")
    for c in lists:
        items = rows.select("title_key", F.col(order).alias("o"), F.posexplode(c).alias("p", "item")).where(F.trim("item") != "")
        once = items.groupBy("title_key", T.title_key(F.col("item")).alias("k")).agg(F.min(F.struct("o", "p", "item")).alias("m"))
        out = out.join(once.groupBy("title_key").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["item"]).alias(c)), "title_key", "left")
    return out


def merge_statistics(rows: DataFrame, *, title: str) -> DataFrame:
    """merged_groups, removed, total_after of merging by title key."""
    k = T.title_key(F.col(title))
    groups = rows.where(k != "").groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    blank = rows.where(k == "").agg(F.count("*").alias("b"))
    return groups.agg(F.count_if(F.col("n") > 1).alias("merged_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"), F.count("*").alias("g")).crossJoin(F.broadcast(blank)).select("merged_groups", "removed", (F.col("g") + F.col("b")).alias("total_after"))


def duplicate_groups(rows: DataFrame, *, title: str, order: str) -> DataFrame:
    """title_key, n, first_ord of groups with several rows, largest first."""
    return rows.groupBy(T.title_key(F.col(title)).alias("title_key")).agg(F.count("*").alias("n"), F.min(order).alias("first_ord")).where("n > 1 and title_key <> ''").orderBy(F.desc("n"), "first_ord")


def bulk_merge(base: DataFrame, edits: DataFrame, *, id: str, columns: list[str], deleted: str = "deleted") -> DataFrame:
    """Edits applied to base: listed rows take the edit's values where these aren't null (an empty text blanks a field), rows
    marked deleted go, rows with a null id are added after the largest id, in their order (column `ord` of edits). Unlisted
    rows and columns stay."""
    old, new = base.alias("b"), edits.where(F.col(id).isNotNull()).alias("e")
    kept = old.join(new, F.col(f"b.{id}") == F.col(f"e.{id}"), "left").where(~F.coalesce(F.col(f"e.{deleted}"), F.lit(False)))
    kept = kept.select(*[F.coalesce(F.col(f"e.{c}"), F.col(f"b.{c}")).alias(c) if c in columns else F.col(f"b.{c}").alias(c) for c in base.columns])
    largest = base.agg(F.coalesce(F.max(id), F.lit(0)).alias("_max"))
    added = numbered(edits.where(F.col(id).isNull() & ~F.coalesce(F.col(deleted), F.lit(False))), F.col("ord"), name="_place").crossJoin(F.broadcast(largest))
    added = added.withColumn(id, (F.col("_max") + F.col("_place")).cast(base.schema[id].dataType)).select(*[F.col(c) if c in edits.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns])
    return kept.unionByName(added)


def edit_conflicts(base: DataFrame, edits: DataFrame, *, id: str) -> DataFrame:
    """id, problem: ids that edits name twice, and ids that base doesn't have."""
    named = edits.where(F.col(id).isNotNull())
    twice = named.groupBy(id).agg(F.count("*").alias("n")).where("n > 1").select(id, F.lit("duplicate").alias("problem"))
    return twice.unionByName(named.join(base.select(id), id, "left_anti").select(id, F.lit("unknown").alias("problem")).distinct())


def upsert(base: DataFrame, changes: DataFrame, *, key: str, ts: str) -> DataFrame:
    """The last writer of each key among base and changes."""
    value = F.struct(*[c for c in base.columns])
    return base.unionByName(changes).groupBy(key).agg(F.max_by(value, ts).alias("r")).select("r.*")


def imported(base: DataFrame, incoming: DataFrame, *, replace: bool = False) -> DataFrame:
    """Incoming entries, normalised, in place of the base or after it."""
    rows = normalise_entries(incoming)
    return rows if replace else base.unionByName(rows, allowMissingColumns=True)


def saved(rows: DataFrame, path: str, *, title: str, order: str, merge: bool = True, **columns) -> DataFrame:
    """A new version of the table at path: rows without a title or areas refuse the save; duplicates are merged if asked for
    (columns as in merge_duplicates); readers see the old version until the new one is whole."""
    from fernglass.sources.files import publish

    bad = violations(rows, order=order).limit(10).collect()
    if bad:
        raise ValueError(f"entries without title or areas: {[tuple(r) for r in bad]}")
    return publish(rows.sparkSession, path, merge_duplicates(rows, title=title, order=order, **columns) if merge else rows)


def work_queue(queue: DataFrame, targets: DataFrame, *, key: str, take: int) -> DataFrame:
    """key, place: the next `take` items. The queue (key, place) is used while it holds only targets; where it is empty or names
    something else, it is built anew from the targets in order of key."""
    stale = queue.join(targets.select(key).distinct(), key, "left_anti").limit(1).count() > 0
    if stale or queue.isEmpty():
        queue = numbered(targets.select(key).distinct(), F.col(key), name="place")
    return queue.select(key, F.col("place").cast("long").alias("place")).orderBy("place").limit(take)


def without_done(queue: DataFrame, done: DataFrame, *, key: str) -> DataFrame:
    """The queue without items that succeeded, by normalised key."""
    finished = done.select(T.title_key(F.col(key)).alias("_k")).distinct()
    return queue.withColumn("_k", T.title_key(F.col(key))).join(finished, "_k", "left_anti").drop("_k")


def pruned(manifest: DataFrame, *, ts: str, tie: str, keep: int) -> DataFrame:
    """The newest rows of a manifest."""
    return manifest.orderBy(F.desc(ts), tie).limit(keep)


def updated(table: DataFrame, changes: DataFrame, *, key: str) -> DataFrame:
    """The table with the values of changes (key and some of its columns) in its rows; keys that it lacks change nothing."""
    some = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("_k"), F.struct(*some).alias("_n"))
    both = table.join(new, F.col(key) == F.col("_k"), "left")
    return both.select(*[F.when(F.col("_k").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) if c in some else F.col(c) for c in table.columns])


def by_title(lines: DataFrame, entries: DataFrame, *, key: str, line: str, title: str, order: str) -> DataFrame:
    """key and the first entry (all its columns) whose title is the line, both as title keys; lines without one are left out."""
    first = entries.withColumn("_k", T.title_key(F.col(title))).where("_k <> ''").groupBy("_k").agg(F.min_by(F.struct(*entries.columns), order).alias("_e"))
    return lines.select(key, T.title_key(F.col(line)).alias("_k")).join(first, "_k").select(key, "_e.*")


def close_names(questions: DataFrame, names: DataFrame, *, key: str, text: str, name: str, cutoff: float = 0.92) -> DataFrame:
    """key, name: the first name (column ord) that the text contains, or else the closest one by the ratio of matching blocks,
    if that is at least the cutoff, the larger name among equals. How pairs meet is said in operators/similarity.py."""
    texts = questions.select(F.col(key).alias("_q"), T.search_form(F.col(text)).alias("_t"))
    # equal texts and equal names are compared once
    once = texts.where("_t is not null").select("_t").distinct()
    by = F.struct("ord", name)
    forms = names.select(name, "ord", T.search_form(F.col(name)).alias("_f")).where("_f <> ''").groupBy("_f").agg(F.min(by).alias("_first"), F.max_by(name, by).alias(name))
    inside = containing(once, forms.select("_f", "_first"), key="_t", text="_t", form="_f").groupBy("_t").agg(F.min("_first").alias("_m")).select("_t", F.col(f"_m.{name}").alias(name))
    left = once.join(inside.select("_t").hint("merge"), "_t", "left_anti")
    rated = close_pairs(left.select(F.col("_t").alias("t")), forms.select(F.col("_f").alias("t")), cutoff)
    best = rated.groupBy(F.col("l").alias("_t")).agg(F.max_by("r", F.struct("ratio", "r")).alias("_f"))
    found = inside.unionByName(best.join(forms.select("_f", name).hint("merge"), "_f").select("_t", name))
    return texts.hint("merge").join(found, "_t").select(F.col("_q").alias(key), name)
