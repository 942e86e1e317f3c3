"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary bigram model are compared by their length-normalised log-likelihoods of a whole text: the mean
over its words of the log ratio, and the means of what exceeds 1, 2 and 3 nats, as a few strong words say more than a
faint lean of many common ones. A logistic regression on these four gives the score. Each model backs off from bigrams to its own continuation counts, and from these to continuation counts shared by both and gathered from
every document, labelled or not; so a rare expression is smoothed alike in both and decides nothing. Counts are kept by the
whole code of a word or bigram. The table of shared counts has a row for each word of the corpus and grows with it; of it
only the words that a class knows are sent, and of the classes only what the sample of labelled texts can hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Work, table


@dataclass(frozen=True)
class Settings:
    #: Labelled documents that the classes are learnt from at most, chosen by hash of their ids. Corpus counts cover all.
    sample: int = 12_000
    #: Taken from the texts of a class that hold a bigram; copies of a text make pairs of two.
    discount: float = 2.0
    #: Taken from a word's number of contexts in a class. Over 1, so that words met in one context alone decide nothing.
    word_discount: float = 1.5
    #: Folds (crc32 of the id mod 5) for the models and for the calibration; fold 0 is held out.
    model_folds: tuple[int, ...] = (1, 2, 3)
    calibration_folds: tuple[int, ...] = (4,)


EDGE = ".,;:!?\"'()[]{}*#$%&<>|«»¡¿…"


#: Characters whose words are handled at a time; a longer text is handled alone.
PART = 2_000_000
#: Words whose contexts a task holds before it sends them on.
HELD = 1_000_000


class _Codes(dict):
    """Word (lower case, edges stripped) to a 64-bit code; kept for the words of a task, up to a bound."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 400_000:
            self.clear()
        code = xxh64_intdigest(word.strip(EDGE).encode(), 7) >> 1
        self[word] = code
        return code


_START = np.int64(0x1F3D5B79A2C4E6)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _tokens(texts: list[str | None], codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts in a row, and each text's number of words."""
    out, sizes = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        w = (text or "").lower().split()
        out.append(np.fromiter(map(codes.__getitem__, w), np.int64, len(w)))
        sizes[k] = len(w)
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), sizes


def _parts(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of about PART characters: word arrays are held for one run at a time, whatever a batch holds."""
    lo = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= PART or k == len(texts) - 1:
            yield slice(lo, k + 1)
            lo, size = k + 1, 0


def _before(w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The word before each, the start mark for the first of a text."""
    v = np.empty_like(w)
    v[1:] = w[:-1]
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[sizes > 0]
    v[starts] = _START
    return v


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = v.view(np.uint64) * _MIX + w.view(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x.view(np.uint64) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_COUNTS = "kind int, key long, a long, b long, c long, d long"
#: Rates (bits of the hash that must be 0) at which the contexts of a word set one of a map's 64 bits; the last map fills at about 80 million.
RATES = (0, 6, 12, 18)


def _contexts(w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, and for each its maps, shape (words, 4), of 64 classes of the words before it."""
    key, at = np.unique(w, return_inverse=True)
    h = _spread(v)
    cls = (h & np.uint64(63)).view(np.int64)
    maps = np.zeros((len(key), len(RATES)), np.uint64)
    seen = np.zeros(64 * len(key), bool)
    seen[at * 64 + cls] = True
    maps[:, 0] = np.ascontiguousarray(np.packbits(seen.reshape(-1, 64), axis=1, bitorder="little")).view(np.uint64).ravel()
    for level, bits in enumerate(RATES[1:], 1):
        pick = (h >> np.uint64(20) & np.uint64((1 << bits) - 1)) == 0
        np.bitwise_or.at(maps[:, level], at[pick], np.uint64(1) << cls[pick].view(np.uint64))
    return key, maps


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, maps = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, maps = keys[order], maps[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.bitwise_or.reduceat(maps, first, axis=0)


def _gather(ids: np.ndarray, toxic: np.ndarray):
    """A task's counts. kind 0: a word and the maps of its contexts, of every text.

    kind 1 (ordinary) and 2 (toxic): a bigram's code, its two words and its number of texts, in the sampled documents.
    """

    def rows(kind, key, *columns):
        for i in range(0, len(key), 500_000):
            p = slice(i, i + 500_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[p]), kind, np.int32)), *(pa.array(np.ascontiguousarray(x[p])) for x in (key, *columns))], ["kind", "key", "a", "b", "c", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            texts = batch.column(1).to_pylist()
            keys = batch.column(0).to_numpy()
            for part in _parts(texts):
                w, sizes = _tokens(texts[part], codes)
                if not len(w):
                    continue
                v = _before(w, sizes)
                held.append(_contexts(w, v))
                if sum(len(k) for k, _ in held) > HELD:
                    held = [_merged(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield from rows(0, held[0][0], *held[0][1].view(np.int64).T)
                        held = []
                at = np.minimum(np.searchsorted(ids, keys[part]), max(len(ids) - 1, 0))
                hit = (ids[at] == keys[part]) if len(ids) else np.zeros(len(at), bool)
                for t in (0, 1):
                    pick = np.repeat(hit & (toxic[at] == t) if len(ids) else hit, sizes)
                    if pick.any():
                        text = np.repeat(np.arange(len(sizes)), sizes)[pick]
                        code = _pair(v[pick], w[pick])
                        order = np.lexsort((text, code))
                        once = np.concatenate(([True], (np.diff(code[order]) != 0) | (np.diff(text[order]) != 0)))
                        at_once = order[once]  # a text counts a bigram once, however often it repeats it
                        code, first, n = np.unique(code[at_once], return_index=True, return_counts=True)
                        first = at_once[first]
                        yield from rows(1 + t, code, v[pick][first], w[pick][first], n, n)
        if held:
            key, maps = _merged(held)
            yield from rows(0, key, *maps.view(np.int64).T)

    return run


def contexts(maps: DataFrame) -> Column:
    """Estimate of a word's distinct contexts from its maps a, b, c, d: linear counting at the finest rate that isn't nearly full."""
    ones = lambda c: F.bit_count(F.col(c))
    count = lambda c: -64 * F.log(F.greatest(1 - ones(c) / 64.0, F.lit(1 / 128)))
    out = 2.0 ** RATES[-1] * count("d")
    for c, bits in (("c", 12), ("b", 6)):
        out = F.when(ones(c) <= 56, 2.0**bits * count(c)).otherwise(out)
    return F.when(ones("a") <= 56, count("a")).otherwise(F.greatest(out, F.lit(140.0)))


class _Table:
    """Rows of numbers by 64-bit code; codes that it doesn't hold get the row of defaults."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: tuple[float, ...]):
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.vstack([values[order], np.array([default])]).astype(np.float32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys[:-1], codes)
        return self.values[np.where(self.keys[at] == codes, at, len(self.keys) - 1)]


@dataclass
class Model:
    """For the ordinary and the toxic class: one, the word weights with the shared backoff; pair, the bigram weights; rest, what a context leaves to the words."""

    one: _Table
    pair: _Table
    rest: _Table
    weights: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 0.0)

    def evidence(self, texts: list[str | None], codes: _Codes) -> np.ndarray:
        """Means over words of r = ln P(word | toxic) - ln P(word | ordinary) and of max(r - 1, 0), (r - 2), (r - 3).

        All four are 0 for a text without words.
        """
        parts = [self._evidence(texts[part], codes) for part in _parts(texts)]
        return np.concatenate(parts) if parts else np.zeros((0, 4))

    def _evidence(self, texts: list[str | None], codes: _Codes) -> np.ndarray:
        w, sizes = _tokens(texts, codes)
        out = np.zeros((len(texts), 4))
        if not len(w):
            return out
        v = _before(w, sizes)
        p = self.pair(_pair(v, w)) + self.rest(v) * self.one(w)
        r = np.log(p[:, 1] / p[:, 0]).astype(np.float64)
        some = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[some]
        for k, x in enumerate((r, *(np.maximum(r - t, 0) for t in (1, 2, 3)))):
            out[some, k] = np.add.reduceat(x, starts) / sizes[some]
        return out

    def score(self, texts: list[str | None], codes: _Codes) -> np.ndarray:
        return _logistic(self.evidence(texts, codes) @ np.array(self.weights[:-1]) + self.weights[-1])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Slopes and intercept of a logistic regression with a weak prior, by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    m = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    prior = np.diag([1e-2] * x.shape[1] + [1e-6])
    b = np.zeros(m.shape[1])
    for _ in range(60):
        p = _logistic(np.clip(m @ b, -30, 30))
        step = np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + prior, m.T @ (p - y) + prior @ b)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    slopes = b[:-1] / scale
    return (*slopes.tolist(), float(b[-1] - slopes @ mean))


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5


def _id(key: Column) -> Column:
    return F.xxhash64(key.cast("string"))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> Model:
    """Models from the sampled labelled rows of the learning folds, backed off to counts over all documents.

    An id with several labels counts by its greatest; ids without a document or label teach nothing. Rows that repeat an id
    each teach. Without any label of one class the models are equal and every score is the intercept's. Of ids of equal
    hash, at the sample's bound, the lesser is taken. Empty tables give a model that scores 0.5.
    """
    spark = docs.sparkSession
    work = Work(spark, "toxic")
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("own")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.select(_id(F.col("own")).alias("id"), "own", "toxic", fold(F.col("own")).alias("fold")).where("fold <> 0")
    known = known.orderBy("id", "own").limit(s.sample).select("id", "toxic", "fold").toPandas().drop_duplicates("id").sort_values("id")
    of = known[known.fold.isin(s.model_folds)]
    ids, toxic = of.id.to_numpy(np.int64), of.toxic.to_numpy(np.int64)
    texts = docs.select(_id(F.col(f"`{key}`")).alias("id"), F.col(f"`{text}`").alias("text"))
    counts = work.write(texts.mapInArrow(_gather(ids, toxic), _COUNTS))

    def columns(df: DataFrame) -> list[np.ndarray]:  # of words and bigrams that several sampled texts of a class hold
        t = df.toArrow()
        return [t.column(i).to_numpy() for i in range(t.num_columns)]

    back = counts.where("kind = 0").groupBy("key").agg(*[F.expr(f"bit_or({x}) {x}") for x in "abcd"])
    back = work.write(back.select("key", contexts(back).alias("contexts")))
    total = back.agg(F.sum("contexts")).first()[0] or 1.0
    grams = work.write(counts.where("kind > 0").groupBy("kind", "key").agg(F.min("a").alias("v"), F.min("b").alias("w"), F.sum("c").alias("n")))
    words = grams.groupBy("w").agg(*[F.sum((F.col("kind") == 1 + t).cast("long")).alias(f"n{t}") for t in (0, 1)])
    sums = words.agg(F.sum("n0"), F.sum("n1")).first()
    words = words.where((F.col("n0") > s.word_discount) | (F.col("n1") > s.word_discount)).join(back.withColumnRenamed("key", "w"), "w")
    word, *left, shared = columns(words.select("w", "n0", "n1", "contexts"))
    own = np.stack([np.maximum(left[t] - s.word_discount, 0) / max(sums[t] or 0, 1) for t in (0, 1)], 1)
    spare = 1 - own.sum(0)
    one = _Table(word, own + spare * (shared / total)[:, None], tuple(spare * (0.5 / total)))
    pairs = grams.where(F.col("n") > s.discount)
    seen = grams.groupBy("kind", "v").agg(F.sum("n").alias("seen"))
    code, kind, v, n, of_v = columns(pairs.join(seen, ["kind", "v"]).select("key", "kind", "v", "n", "seen"))
    weight = (n - s.discount) / np.maximum(of_v, 1)

    def table(at: np.ndarray, default: float, sign: float) -> _Table:
        keys, where = np.unique(at, return_inverse=True)
        values = np.full((len(keys), 2), default)
        np.add.at(values, (where, kind.astype(np.int64) - 1), sign * weight)
        return _Table(keys, values, (default, default))

    model = Model(one, table(code, 0.0, 1.0), table(v, 1.0, -1.0))
    if len(set(toxic)) < 2:
        none = np.zeros(0, np.int64)
        return Model(*(_Table(none, np.zeros((0, 2)), (x, x)) for x in (1.0, 0.0, 1.0)), weights=(0.0,) * 5)
    held = known[known.fold.isin(s.calibration_folds)]
    some = spark.createDataFrame(held[["id", "toxic"]].astype("int64"), "id long, toxic long") if len(held) else None
    if some is not None:
        rows = evidence(texts.join(F.broadcast(some), "id").select("id", "text", "toxic"), model).toPandas()
        if len(rows):
            model.weights = _calibrate(rows[["x0", "x1", "x2", "x3"]].to_numpy(), rows.toxic.to_numpy(float))
    return model


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            x = shared.value.evidence(b.column(1).to_pylist(), codes)
            yield pa.RecordBatch.from_arrays([b.column(2).cast(pa.int64()), *(pa.array(x[:, k].copy()) for k in range(4))], ["toxic", "x0", "x1", "x2", "x3"])

    return rows.mapInArrow(run, "toxic long, x0 double, x1 double, x2 double, x3 double")


def toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and score in [0, 1] of each row. Null and empty texts have no evidence and score what the intercept gives.

    Rows are scored one by one: repeated rows score alike, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1).to_pylist(), codes))], ["key", "score"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double")


def op1_kneser_ney_toxicity(spark, sf_dir: str) -> DataFrame:
    """A null id has no fold and is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored.select(F.col("key").alias("doc_id"), (F.coalesce(fold(F.col("key")), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
