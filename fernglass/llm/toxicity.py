"""Toxicity of texts by a linear classifier that is held still when identity terms are swapped.

The classifier is a logistic regression on words and letter sequences. Beside the labels it is fitted on counterfactuals: in
sentences of labelled texts an identity term is replaced by others, and what the score changes by is penalised.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernglass.llm import common
from fernglass.llm.tokens import texts

#: Labelled rows that are learned from, features that are kept, swaps that each mention of a term gets, and the shortest and
#: longest letter sequence.
LABELLED, FEATURES, SWAPS, SHORTEST, LONGEST = 20_000, 4000, 6, 4, 6
#: Weight of the squared weights.
RIDGE = 3e-5
#: How far a feature's share in toxic texts must be from its share in others, in standard errors, and in how many texts it must be.
FAR, LEAST = 5.0, 3
#: Pieces that a worker keeps, the longest of them in characters, new ones that are read at once, and characters of texts at once.
ROOM, LONG, CALL, SLICE = 400_000, 64, 20_000, 1 << 21
# names of groups of people
IDENTITY = tuple(
    "women woman men man girls boys gay lesbian bisexual transgender straight queer muslim muslims christian christians jewish jews hindu buddhist atheist catholic "
    "black white asian african latino arab indian mexican chinese immigrant immigrants refugee refugees foreigners disabled blind deaf old young elderly "
    "frauen männer schwarze weiße juden muslime christen ausländer flüchtlinge femmes hommes noirs blancs juifs musulmans chrétiens immigrés "
    "mujeres hombres negros blancos judíos musulmanes cristianos inmigrantes".split()
)
_WORD, _SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[^.!?\n]+")


def words(pieces: list[str]) -> list[list[str]]:
    """The words of letters in each piece of text, in one form of letters and case. Pieces have no line feed."""
    lines = unicodedata.normalize("NFKC", "\n".join(pieces)).casefold().split("\n") if pieces else []
    return [[x] if x.isalpha() else _WORD.findall(x) for x in lines]


def features(of: list[str]):
    """Features of each word, as 64-bit numbers, and the place of each one's word: the word as a whole, and its letter sequences
    with the word's bounds. A feature that a word has twice may come twice."""
    import numpy as np

    if not of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.frombuffer("".join([f"<{w}>" for w in of]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in of])
    owner = np.repeat(np.arange(len(of)), lengths)
    starts = np.cumsum(lengths) - lengths
    odd = (letters + np.uint64(0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)
    odd ^= odd >> np.uint64(31)
    powers = np.cumprod(np.full(int(lengths.max()), 0x94D049BB133111EB, np.uint64))
    whole = np.add.reduceat(odd * powers[np.arange(len(owner)) - starts[owner]], starts)
    ids, owners = [whole ^ (whole >> np.uint64(32))], [np.arange(len(of))]
    for n in range(SHORTEST, LONGEST + 1):
        last = len(odd) - n + 1
        h = np.full(max(0, last), n, np.uint64)
        for i in range(n if last > 0 else 0):
            h = (h ^ odd[i : last + i]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        inside = owner[: max(0, last)] == owner[n - 1 :][: max(0, last)]
        ids.append(h[inside])
        owners.append(owner[: max(0, last)][inside])
    return np.concatenate(ids).view(np.int64), np.concatenate(owners)


def _of_words(of: list[str], chosen) -> dict[str, tuple[int, ...]]:
    """The chosen features of each word, chosen: their sorted numbers."""
    import numpy as np

    ids, owner = features(of)
    if len(chosen):
        place = np.minimum(np.searchsorted(chosen, ids), len(chosen) - 1)
        own = chosen[place] == ids
        ids, owner = ids[own], owner[own]
    else:
        ids, owner = ids[:0], owner[:0]
    out: dict[str, set] = {}
    for w, f in zip(owner.tolist(), ids.tolist()):
        out.setdefault(of[w], set()).add(f)
    return {w: tuple(sorted(f)) for w, f in out.items()}


@dataclass(frozen=True)
class Model:
    """Weights by feature, and a bias."""

    weights: dict[int, float]
    bias: float

    def score(self, found) -> float:
        z = self.bias + math.fsum(self.weights[f] for f in found)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class _Reader:
    """What texts have of the chosen features: each once. White-space-separated pieces are looked up; new ones of a batch of texts
    are read together."""

    def __init__(self, chosen):
        import numpy as np

        self.chosen, self.known = np.sort(np.array([*chosen], np.int64)), {}

    def found(self, all_texts: list[str]) -> list[set[int]]:
        own = [set(t.split()) for t in all_texts]
        new = sorted(set().union(*own).difference(self.known))
        if len(self.known) + len(new) > ROOM:
            self.known = {}
            new = sorted(set().union(*own))
        for i in range(0, len(new), CALL):
            part = new[i : i + CALL]
            of = words(part)
            got = _of_words([*dict.fromkeys(w for x in of for w in x)], self.chosen)
            for p, x in zip(part, of):
                self.known[p] = tuple({f for w in x for f in got.get(w, ())})
        out = [set().union(*map(self.known.__getitem__, x)) for x in own]
        for p in new:
            if len(p) > LONG:
                del self.known[p]
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, *, rows: int = LABELLED, fold: int = 5) -> DataFrame:
    """text, y of at most `rows` labelled texts, by a hash of the id; ids whose crc32 is divisible by `fold` are held out.

    Labels other than 0 and 1 and ids with labels that disagree don't count.
    """
    ids = labels.where(F.col("toxic").isin(0, 1) & ~_held_out("doc_id", fold)).groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("m")).where("y = m")
    # a sample with a stated bound; 16 bytes a row
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", F.col("y").cast("int").alias("y"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")


def _held_out(doc_id: str, fold: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % fold == 0, F.lit(False))


def _selected(sample: DataFrame, keep: int) -> list[int]:
    """Features whose share in toxic texts is FAR standard errors from that in others, the farthest first; at most `keep`."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for all_texts, y in _texts(batches, 0, 1):
            own = [set(t.split()) for t in all_texts]
            pieces = sorted(set().union(*own))
            place = {p: i for i, p in enumerate(pieces)}
            of = words(pieces)
            names = [*dict.fromkeys(w for x in of for w in x)]
            number = {w: i for i, w in enumerate(names)}
            ids, owner = features(names)
            order = np.argsort(owner, kind="stable")
            ids, edge = ids[order], np.searchsorted(owner[order], np.arange(len(names) + 1))
            found, labels = [], []
            for x, label in zip(own, y):
                mine = {number[w] for p in x for w in of[place[p]]}
                if mine:
                    found.append(np.unique(np.concatenate([ids[edge[i] : edge[i + 1]] for i in mine])))
                    labels.append(np.full(len(found[-1]), label, np.int64))
            if found:
                yield from _counted(np, pa, found, labels)

    parts = sample.mapInArrow(count, "f long, toxic long, n long").groupBy("f").agg(F.sum("toxic").alias("a"), F.sum("n").alias("n"))
    total = sample.agg(F.sum("y").alias("a"), F.count("*").alias("n")).first()
    if not total.n or not total.a or total.a == total.n:
        return []
    p = F.lit(total.a / total.n)
    far = F.abs(F.col("a") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p) * (1 - F.col("n") / (total.n + 1)))
    top = parts.where(F.col("n") >= LEAST).withColumn("far", far).where(F.col("far") >= FAR).orderBy(F.desc("far"), "f").limit(keep)
    return [r.f for r in top.select("f").collect()]


def _texts(batches, text: int, other: int):
    """Texts of Arrow batches and another column's values, about SLICE characters at once."""
    for b in common.small(batches):
        at, size, all_texts = 0, 0, [t.decode("utf-8", "replace") for t in texts(b.column(text))]
        for i, t in enumerate(all_texts):
            size += len(t)
            if size >= SLICE or i + 1 == len(all_texts):
                yield all_texts[at : i + 1], b.column(other).slice(at, i + 1 - at).to_pylist()
                at, size = i + 1, 0


def _counted(np, pa, found, labels):
    f, y = np.concatenate(found), np.concatenate(labels)
    own, place, n = np.unique(f, return_inverse=True, return_counts=True)
    toxic = np.bincount(place, weights=y, minlength=len(own)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(toxic), pa.array(n.astype(np.int64))], ["f", "toxic", "n"])


def swaps_of(term: str, terms: tuple[str, ...], k: int) -> list[str]:
    """What a mention is swapped for: the next k terms in the list, from its end to its start, and a word that names no group and that
    the model knows nothing of, the empty one. Without the latter all terms might share a weight that isn't zero."""
    i = terms.index(term)
    return [*(terms[(i + 1 + j) % len(terms)] for j in range(min(k, len(terms) - 1))), ""]


def swapped(sentence: list[str], terms: tuple[str, ...], k: int, of_word: dict[str, tuple[int, ...]]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """For each identity term in a sentence and each word it is swapped for: the features that come and those that go."""
    out = []
    for i, w in enumerate(sentence):
        if w in terms:
            rest = {f for j, x in enumerate(sentence) if j != i for f in of_word.get(x, ())}
            here = rest.union(of_word.get(w, ()))
            for other in swaps_of(w, terms, k):
                there = rest.union(of_word.get(other, ()))
                if here != there:
                    out.append((tuple(sorted(there - here)), tuple(sorted(here - there))))
    return out


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = LABELLED, terms: tuple[str, ...] = IDENTITY, strength: float = 10.0, ridge: float = RIDGE, keep: int = FEATURES, fold: int = 5) -> Model:
    """Fit on at most `rows` labelled texts, read whole. `strength` weighs the squared change of a score under a swap; with 0 there
    are no counterfactuals.

    Features are counted in tasks and chosen by Spark; the texts' chosen features (at most `keep` a text) are what the driver
    gets. Identity terms are features whether chosen or not. Each pair of a term and a word it is swapped for counts as one sentence
    besides those of the corpus, so that terms without labelled mentions are held still too. Without labels of both kinds
    the model is the bias alone.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    sample = common.written(labelled_sample(docs, labels, rows=rows, fold=fold), "labelled")
    terms = tuple(dict.fromkeys(w for x in words(list(terms)) for w in x))
    chosen = dict.fromkeys(_selected(sample, keep))
    chosen.update(dict.fromkeys(features(list(terms))[0][: len(terms)].tolist()))  # those of whole words come first
    names = set(terms)

    def read(batches):
        import pyarrow as pa

        reader = _Reader(chosen)
        for all_texts, y in _texts(batches, 0, 1):
            found, changes = [sorted(x) for x in reader.found(all_texts)], []
            for t in all_texts:
                own = {}
                for sentence in words(_SENTENCE.findall(t)) if strength else ():
                    if not names.isdisjoint(sentence):
                        for change in swapped(sentence, terms, SWAPS, _of_words([*dict.fromkeys((*sentence, *terms))], reader.chosen)):
                            own[change] = own.get(change, 0) + 1
                changes.append([{"come": list(c), "go": list(g), "n": n} for (c, g), n in own.items()])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), pa.array(y, pa.int32()), pa.array(changes, pa.list_(_CHANGE()))], ["found", "y", "changes"])

    seen = common.written(sample.mapInArrow(read, "found array<long>, y int, changes array<struct<come: array<long>, go: array<long>, n: long>>"), "found")
    learned = sorted((r.found, r.y) for r in seen.select("found", "y").collect())
    change = F.explode("changes").alias("c")
    counted = seen.select(change).groupBy("c.come", "c.go").agg(F.sum("c.n").alias("n")) if strength else None
    # kinds of change number at most the terms times their swaps times the features that a sentence may share with them
    changes = sorted((tuple(r.come), tuple(r.go), r.n) for r in counted.collect()) if strength else []
    if strength:
        of_word = _of_words(list(terms), _Reader(chosen).chosen)
        changes += [(*c, 1) for t in terms for c in swapped([t], terms, SWAPS, of_word)]
    return _regression(learned, changes, list(chosen), strength, ridge)


def _CHANGE():
    import pyarrow as pa

    return pa.struct([("come", pa.list_(pa.int64())), ("go", pa.list_(pa.int64())), ("n", pa.int64())])


def _regression(learned, changes, chosen: list[int], strength: float, ridge: float, steps: int = 600) -> Model:
    """Minimise mean log loss + ridge / 2 * |w|^2 + strength / 2 * weighted mean squared change, by accelerated gradient steps."""
    import numpy as np

    n = len(learned)
    positive = sum(y for _, y in learned)
    if not positive or positive == n:
        return Model({}, math.log((positive + 0.5) / (n - positive + 0.5)))
    place = {f: i for i, f in enumerate(chosen)}
    row = np.repeat(np.arange(n), [len(f) for f, _ in learned])
    col = np.array([place[f] for found, _ in learned for f in found], np.int64)
    y = np.array([y for _, y in learned], float)
    crow = np.array([i for i, (c, g, _) in enumerate(changes) for _ in (*c, *g)], np.int64)
    ccol = np.array([place[f] for c, g, _ in changes for f in (*c, *g)], np.int64)
    csign = np.array([s for c, g, _ in changes for s in (*[1.0] * len(c), *[-1.0] * len(g))])
    weight = np.array([m for _, _, m in changes], float)
    weight /= max(1.0, weight.sum())
    m = len(chosen)

    def slope(w, b):
        z = b + np.bincount(row, weights=w[col], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        g = np.bincount(col, weights=((p - y) / n)[row], minlength=m) + ridge * w
        if len(changes):
            d = np.bincount(crow, weights=csign * w[ccol], minlength=len(changes))
            g += strength * np.bincount(ccol, weights=csign * (weight * d)[crow], minlength=m)
        return g, float((p - y).mean())

    # the largest curvature, by powers of the quadratic form, bounds the step
    v, c, top = np.ones(m) / math.sqrt(m), 1.0, 1.0
    for _ in range(30):
        u = (c + np.bincount(row, weights=v[col], minlength=n)) / (4 * n)
        nv, nc = np.bincount(col, weights=u[row], minlength=m) + ridge * v, float(u.sum())
        if len(changes):
            d = np.bincount(crow, weights=csign * v[ccol], minlength=len(changes))
            nv += strength * np.bincount(ccol, weights=csign * (weight * d)[crow], minlength=m)
        top = math.sqrt(float(nv @ nv) + nc * nc)
        v, c = nv / top, nc / top
    step = 0.9 / top
    w, b = np.zeros(m), math.log(positive / (n - positive))
    aw, ab, t = w, b, 1.0
    for _ in range(steps):
        gw, gb = slope(aw, ab)
        nw, nb = aw - step * gw, ab - step * gb
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        aw, ab = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return Model({f: float(x) for f, x in zip(chosen, w) if abs(x) > 1e-9}, float(b))


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", fold: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. The score comes from the whole text alone; null and empty texts, and texts
    without a feature of the model, get the bias. Null ids aren't held out; repeated rows and ids stay, each by its text.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # at most FEATURES weights and the terms'

    def read(batches):
        import pyarrow as pa

        model = shared.value
        reader = _reader(model)
        for b in common.small(batches):
            got = [model.score(x) for own, _ in _texts([b], 2, 0) for x in reader.found(own)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64()), pa.array((int(s >= 0.5) for s in got), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _held_out(doc_id, fold).alias("held_out"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(read, "doc_id long, held_out boolean, score double, predicted int")


_readers: dict[int, _Reader] = {}


def _reader(model: Model) -> _Reader:
    """The worker's reader for a model; it lasts as long as the worker."""
    key = hash((model.bias, frozenset(model.weights.items())))
    if key not in _readers:
        _readers.clear()
        _readers[key] = _Reader(model.weights)
    return _readers[key]
