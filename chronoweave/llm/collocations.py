"""Phrases of words that stand together, by position bitmaps in the manner of SPAM.

The words of many texts of a language lie one after the other in a shard, with a place of no word between pieces, so that no
phrase crosses one. Each word has a bitmap of its places, kept as its bytes that aren't zero. A phrase is extended by a shift
of its bitmap by one place and an AND with the bitmaps of the words, depth-first; the popcounts of what is left are its
occurrences, and are summed over all shards by a shuffle. No phrase is more frequent than a part of it, so words, pairs and
triples that are too rare are left out of the next pass, by tables of bits of a bounded size that travel with the tasks: a
table that is too full lets more partial counts through, which the sums drop, and never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import Work, table

LONGEST = 4
#: What ends a piece.
STOPS = b".,;:!?\n\x0b\x0c\r"


class Sizes(NamedTuple):
    """What a task holds at a time; none of it changes a result."""

    #: Places of a shard at least; a text is never parted but between pieces.
    shard: int = 1 << 18
    #: Words of all languages that a task knows before it starts anew.
    vocabulary: int = 200_000
    #: Bits of a table at most: 16 MB.
    bits: int = 1 << 27
    #: Entries that are joined at a time.
    group: int = 1 << 18


_FOLD = bytearray(range(256))
for _c in range(65, 91):
    _FOLD[_c] = _c + 32
for _c in STOPS:
    _FOLD[_c] = 10
_FOLD[9] = 32
_FOLD = bytes(_FOLD)


class _Vocabulary(dict):
    """Words of a language by the order in which a task meets them, with the codes that Spark's xxhash64(lang, word) gives."""

    def __init__(self, lang: bytes):
        from xxhash import xxh64_intdigest

        super().__init__()
        self.seed, self.codes = xxh64_intdigest(lang, 42), []

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        self[word] = n = len(self)
        code = xxh64_intdigest(word, self.seed)
        self.codes.append(code - (1 << 64) if code >> 63 else code)
        return n


_SHARDS = "kind int, lang string, word string, n long, places binary, codes binary"
_ARROW = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("places", pa.binary()), ("codes", pa.binary())])


def _shards(sizes: Sizes):
    """kind 0: a shard; n, its words; places, an index into codes for each place, -1 between pieces. kind 1: a word and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[_Vocabulary, list[int], list[np.ndarray]]] = {}

        def batch(kind, lang, word, n, places, codes):
            size = len(n)
            parts = [np.full(size, kind, np.int32), [lang.decode()] * size, word, n, places, codes]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(parts, _ARROW, strict=True)], schema=_ARROW)

        def shard(lang: bytes) -> Iterator[pa.RecordBatch]:
            words, places, counts = known[lang]
            at = np.array(places, np.int32)
            own, local = np.unique(at[at >= 0], return_inverse=True)
            out = np.full(len(at), -1, np.int32)
            out[at >= 0] = local
            counts.append(np.bincount(at[at >= 0], minlength=len(words)))
            codes = np.array(words.codes, np.int64)[own]
            places.clear()
            yield batch(0, lang, [None], [len(local)], [out.tobytes()], [codes.tobytes()])

        def words_of(lang: bytes) -> Iterator[pa.RecordBatch]:
            words, places, counts = known.pop(lang)
            n = np.zeros(len(words), np.int64)
            for c in counts:
                n[: len(c)] += c
            names = [w.decode() for w in words]
            for i in range(0, len(names), 100_000):
                p = slice(i, i + 100_000)
                yield batch(1, lang, names[p], n[p], [None] * len(names[p]), [None] * len(names[p]))

        def ended() -> Iterator[pa.RecordBatch]:
            for lang in list(known):
                if known[lang][1]:
                    yield from shard(lang)
                yield from words_of(lang)

        for b in batches:
            for lang, text in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                if lang not in known:
                    known[lang] = (_Vocabulary(lang), [], [])
                words, places, _ = known[lang]
                code = words.__getitem__
                for piece in text.translate(_FOLD).split(b"\n"):
                    found = piece.split()
                    if found:
                        places.extend(map(code, found))
                        places.append(-1)
                        if len(places) >= sizes.shard:
                            yield from shard(lang)
                if sum(len(k[0]) for k in known.values()) > sizes.vocabulary:
                    yield from ended()
        yield from ended()

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _pair_code(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(v.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + w.view(np.uint64)).view(np.int64)


class Bits(NamedTuple):
    """A table of bits that has all of a set of codes, and others by chance."""

    words: np.ndarray

    def has(self, codes: np.ndarray) -> np.ndarray:
        at = codes.view(np.uint64) & np.uint64(64 * len(self.words) - 1)
        return (self.words[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bits(codes: DataFrame, n: int, most: int) -> Bits:
    """codes: one long column `code`, n of them. 16 bits a code, `most` at most; the rows sent are words of 64 bits."""
    size = 64
    while size < min(16 * n, most):
        size *= 2
    at = F.col("code").bitwiseAND(size - 1)
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    rows = codes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("slot")).agg(F.bit_or(one).alias("mask")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[rows.column("slot").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return Bits(words)


class Index(NamedTuple):
    """The bitmaps of a shard's words, as bytes that aren't zero in order of block; those of block b are start[b]:start[b + 1]."""

    block: np.ndarray
    word: np.ndarray
    mask: np.ndarray
    start: np.ndarray


def _joined(key: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the union of the masks of each."""
    order = np.argsort(key, kind="stable")
    key, mask = key[order], mask[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], (np.bitwise_or.reduceat(mask, first) if len(key) else mask)


def index(places: np.ndarray, keep: np.ndarray) -> Index:
    """Bitmaps of the words that `keep` has; other words and the ends of pieces have no bit."""
    at = np.flatnonzero((places >= 0) & keep[places]) if len(keep) else np.zeros(0, np.int64)
    key, mask = _joined((at >> 3) << 32 | places[at], np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
    block = key >> 32
    return Index(block, key & 0xFFFFFFFF, mask, np.searchsorted(block, np.arange((len(places) >> 3) + 3)))


class Marks(NamedTuple):
    """Bitmaps of phrases: (phrase, block, mask), the last place of each occurrence."""

    phrase: np.ndarray
    block: np.ndarray
    mask: np.ndarray


def extend(marks: Marks, words: Index, group: int) -> Iterator[tuple[Marks, np.ndarray]]:
    """Bitmaps of the phrases with one word more: shifted by a place, and joined by AND to each word of the block."""
    over = np.flatnonzero(marks.mask & 0x80)
    stay = np.flatnonzero(marks.mask & 0x7F)
    phrase = np.concatenate([marks.phrase[stay], marks.phrase[over]])
    block = np.concatenate([marks.block[stay], marks.block[over] + 1])
    mask = np.concatenate([marks.mask[stay] << 1, np.ones(len(over), np.uint8)]).astype(np.uint8)
    many = words.start[block + 1] - words.start[block]
    ends = np.cumsum(many)
    for part in np.split(np.arange(len(phrase)), np.searchsorted(ends, np.arange(group, ends[-1] if len(ends) else 0, group))):
        rep = np.repeat(part, many[part])
        if len(rep):
            local = np.cumsum(many[part]) - many[part]
            at = np.arange(len(rep)) + np.repeat(words.start[block[part]] - local, many[part])
            both = mask[rep] & words.mask[at]
            hit = np.flatnonzero(both)
            yield Marks(phrase[rep[hit]], words.block[at[hit]], both[hit]), words.word[at[hit]]


def _grown(marks: Marks, words: Index, group: int) -> tuple[Marks, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases one word longer, numbered anew: their bitmaps, sorted by phrase; of each the old phrase, the word, the popcount."""
    found = list(extend(marks, words, group))
    if not found:
        none = np.zeros(0, np.int64)
        return Marks(none, none, np.zeros(0, np.uint8)), none, none, none
    old, block, mask, word = (np.concatenate(x) for x in ([m.phrase for m, _ in found], [m.block for m, _ in found], [m.mask for m, _ in found], [w for _, w in found]))
    key = old << 32 | word
    order = np.argsort(key, kind="stable")
    key, block, mask = key[order], block[order], mask[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(np.bitwise_count(mask).astype(np.int64), first) if len(key) else first
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    return Marks(number, block, mask), key[first] >> 32, key[first] & 0xFFFFFFFF, n


def _shard(places: pa.BinaryScalar, codes: pa.BinaryScalar, word_bits: Bits) -> tuple[np.ndarray, Index, Marks]:
    code = np.frombuffer(codes.as_buffer(), np.int64)
    words = index(np.frombuffer(places.as_buffer(), np.int32), word_bits.has(code))
    return code, words, Marks(words.word, words.block, words.mask)


_PHRASES = ", ".join(f"{c} long" for c in "vwxy") + ", n long"


def _rows(code: np.ndarray, phrases: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(n), 200_000):
        p = slice(i, i + 200_000)
        columns = [pa.array(code[c[p]]) for c in phrases] + [pa.nulls(len(n[p]), pa.int64())] * (LONGEST - len(phrases)) + [pa.array(n[p])]
        yield pa.RecordBatch.from_arrays(columns, ["v", "w", "x", "y", "n"])


def _pairs(word_bits, sizes: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, codes in zip(*b.columns, strict=True):
                code, words, marks = _shard(places, codes, word_bits.value)
                _, v, w, n = _grown(marks, words, sizes.group)
                yield pa.RecordBatch.from_arrays([pa.array(_pair_code(code[v], code[w])), pa.array(n)], ["code", "n"])

    return run


def _known(word_bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(word_bits.value.has(b.column(0).to_numpy())))

    return run


def _triple_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v, w, x = (np.ascontiguousarray(c.to_numpy()) for c in b.columns)
        yield pa.RecordBatch.from_arrays([pa.array(_pair_code(_pair_code(v, w), x))], ["code"])


def _longer(word_bits, pair_bits, triple_bits, sizes: Sizes):
    """Phrases of frequent pairs: pairs and triples; with triple_bits the phrases of LONGEST words whose triples are frequent.

    Depth-first: the phrases of a group of prefixes are grown to the end before the next group.
    """
    deepest = 3 if triple_bits is None else LONGEST

    def grow(code, words, marks, phrases, pairs) -> Iterator[pa.RecordBatch]:
        if len(phrases) == deepest or not len(marks.phrase):
            return
        ends = np.append(np.flatnonzero(np.diff(marks.phrase)) + 1, len(marks.phrase))  # of each phrase's bitmap
        cuts = np.unique(np.searchsorted(ends, np.arange(sizes.group, len(marks.phrase) + sizes.group, sizes.group)))
        lo = 0
        for cut in cuts:
            hi = ends[min(cut, len(ends) - 1)]
            if hi <= lo:
                continue
            own = Marks(*(x[lo:hi] for x in marks))
            lo = hi
            longer, old, word, n = _grown(own, words, sizes.group)
            if not len(n):
                continue
            key = phrases[-1][old] << 32 | word
            good = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key
            if triple_bits is not None:
                good &= triple_bits.value.has(_pair_code(_pair_code(code[phrases[-2][old]], code[phrases[-1][old]]), code[word]))
            longer, grown = _chosen(longer, good), [c[old[good]] for c in phrases] + [word[good]]
            if len(grown) == deepest:
                yield from _rows(code, grown, n[good])
            yield from grow(code, words, longer, grown, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, codes in zip(*b.columns, strict=True):
                code, words, marks = _shard(places, codes, word_bits.value)
                marks, v, w, n = _grown(marks, words, sizes.group)
                if not len(v):
                    continue
                good = pair_bits.value.has(_pair_code(code[v], code[w]))
                marks, v, w = _chosen(marks, good), v[good], w[good]
                if triple_bits is None:
                    yield from _rows(code, [v, w], n[good])
                yield from grow(code, words, marks, [v, w], v << 32 | w)

    return run


def _chosen(marks: Marks, good: np.ndarray) -> Marks:
    """The bitmaps of some phrases, numbered anew."""
    number, keep = np.cumsum(good) - 1, good[marks.phrase]
    return Marks(number[marks.phrase[keep]], marks.block[keep], marks.mask[keep])


def _big(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def count_phrases(docs: DataFrame, work: Work, least: int = 30, text: str = "text", lang: str = "lang", sizes: Sizes = Sizes()) -> tuple[DataFrame, ...]:
    """Words (lang, code, f), phrases (p: codes of 2 to 4 words, f) that occur `least` times or more, words of each lang (lang, n), spellings (code, word)."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    c = lambda name: F.col(f"`{name}`").cast("string")
    shards = work.write(docs.select(F.coalesce(c(lang), F.lit("und")), F.coalesce(c(text), F.lit(""))).mapInArrow(_shards(sizes), _SHARDS))
    totals = work.write(shards.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n")))

    def frequent(df: DataFrame, *keys: str) -> DataFrame:
        return work.write(df.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= least))

    def table_of(codes: DataFrame):
        return share(bits(codes, codes.count(), sizes.bits))

    each = shards.where("kind = 1").withColumn("code", F.xxhash64("lang", "word"))
    words = frequent(each, "code", "lang")
    word_bits = table_of(words.select("code"))
    blobs = shards.where("kind = 0").select("places", "codes")
    # Pairs are counted by a hash first, which is half as long; the next pass has them by their words, with triples of frequent ones.
    hashed = frequent(blobs.mapInArrow(_pairs(word_bits, sizes), "code long, n long"), "code")
    pair_bits = table_of(hashed.select("code"))
    short = frequent(blobs.mapInArrow(_longer(word_bits, pair_bits, None, sizes), _PHRASES), *"vwx")
    triples = short.where(F.col("x").isNotNull())
    triple_bits = table_of(triples.select("v", "w", "x").mapInArrow(_triple_codes, "code long"))
    long = frequent(blobs.mapInArrow(_longer(word_bits, pair_bits, triple_bits, sizes), _PHRASES), *"vwxy")
    every = short.withColumn("y", F.lit(None).cast("long")).unionByName(long)
    phrases = every.select(F.array_compact(F.array(*"vwxy")).alias("p"), "f")
    return words, phrases, totals, each.select("code", "word")


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000, scale: int = 2_000_000, text: str = "text", lang: str = "lang", sizes: Sizes = Sizes()) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words are what stands between spaces and tabs in the pieces of a text, A to Z in lower case; phrases have 2 to 4 of them.
    a, l and r are the occurrences of a phrase and of the two parts of its lowest-scoring cut (of equal scores the shortest
    first part), score is floor(scale * a / (l + r)), n the words of the language. Phrases that occur under `least` times aren't
    candidates; those that a longer candidate holds and that occur by 100 / share times as often as it at most are dropped.
    Ranks go by score, a (descending) and phrase (order of bytes), so no two are equal.

    A null lang is `und`, also beside a lang of that name. Null and empty texts have no words; texts of any length are read whole,
    and one piece of a text at a time may exceed a shard. Repeated rows count each. Other columns are left out. An empty table
    gives no rows. Words go by 64-bit codes of lang and word.
    """
    work = Work(docs.sparkSession, "phrases")
    words, phrases, totals, spellings = count_phrases(docs, work, least, text, lang, sizes)
    parts = words.select(F.array("code").alias("p"), "f").unionByName(phrases)
    k = F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k")
    cuts = phrases.select("p", F.col("f").alias("a"), k).select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("first"), F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.select(F.col("p").alias("first"), F.col("f").alias("l")), "first").join(parts.select(F.col("p").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr(f"(cast(a as decimal(20,0)) * {scale}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # What longer candidates hold: of each part of two words and more the most frequent.
    sub = F.expr("flatten(transform(sequence(2, size(p) - 1), k -> transform(sequence(1, size(p) - k + 1), i -> slice(p, i, k))))")
    held = phrases.where(F.size("p") > 2).select(F.explode(sub).alias("p"), "f").groupBy("p").agg(F.max("f").alias("most"))
    left = best.join(held, "p", "left").where(F.col("most").isNull() | (100 * _big(F.col("most")) < share * _big(F.col("a"))))
    tongue = words.select(F.col("code").alias("first"), "lang")
    rows = left.withColumn("first", F.col("p")[0]).join(tongue, "first").select("lang", "p", "a", "cut.l", "cut.r", "cut.score")
    # Spark keeps the first ranks of each task only, before and after the words are put in.
    near = work.write(rows.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("rank") <= top).drop("rank"))
    codes = near.select(F.explode("p").alias("code")).distinct()
    used = docs.sparkSession.sparkContext.broadcast(bits(codes, codes.count(), sizes.bits))
    names = work.write(spellings.mapInArrow(_known(used), "code long, word string").groupBy("code").agg(F.min("word").alias("word")))
    work.drop(1)  # the shards
    spelt = near.select("p", F.posexplode("p").alias("i", "code")).join(names, "code").groupBy("p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = near.join(spelt, "p").withColumn("rank", first).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op11_spam_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


#: The same rows from counts of whole strings.
ORACLE_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
s AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS s FROM d),
w AS (SELECT lang, regexp_extract_all(s, '[^\\x20\\x09]+') AS w FROM s),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, p, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, p, string_split(p, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT c.lang, c.p, c.a, cut, l.f AS l, r.f AS r, 2000000 * a // (l.f + r.f) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) AS c
  JOIN f AS l ON l.lang = c.lang AND l.p = array_to_string(w[1:cut], ' ') JOIN f AS r ON r.lang = c.lang AND r.p = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS i FROM x),
h AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS p, max(a) AS most FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
z AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.p COLLATE C) AS rank, b.p AS phrase, a, l, r, score
  FROM b LEFT JOIN h ON h.lang = b.lang AND h.p = b.p WHERE i = 1 AND (most IS NULL OR 100 * most < 80 * a))
SELECT z.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""
