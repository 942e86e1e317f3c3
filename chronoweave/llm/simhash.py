"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most 3 of 64 bits link. Pigeonhole: of five blocks of bits at least two agree, so every
linked pair meets in one of ten tables keyed by two blocks. Inside a key the fingerprints lie as vertical bit planes, 64
to a machine word; distances to a query are summed by carry-save counters, and words whose lanes all exceed the radius
are abandoned. Each key gives a spanning forest of its links, never all pairs; components come from large-star and
small-star rounds.

A radius of 3 bits catches few texts that differ in some words. `similar_groups` is for these: shingles of five words, keys from
runs of shingle minima, bit-sliced distances within a wide radius inside a key, and of what passes the exact Jaccard
similarity of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Work, lookup, table

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Five blocks; any two of them key a table.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TABLES = tuple(combinations(range(5), 2))
#: Keys of more fingerprints than this are keyed again by a quarter of the bits that are left (of four, one agrees).
HOT = 20_000
#: Planes summed between two looks at which words are abandoned.
LOOK = 8
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- fingerprints -----------------------------------------------------------------------------------------------


def _shingled(texts: list[str | None], n: int, seed: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, starts, hashes) of a run of texts that have words: XXH64 of their n-word shingles, of the whole text if shorter."""
    from xxhash import xxh64_intdigest as digest

    hashes: list[int] = []
    starts: list[int] = []
    rows: list[int] = []
    for k, text in enumerate(texts):
        w = (text or "").encode().lower().split()  # bytes: A-Z alone, and the six ASCII separators alone
        if not w:
            continue
        starts.append(len(hashes)), rows.append(k)
        if len(w) <= n:
            hashes.append(digest(b" ".join(w), seed))
        else:
            grams = zip(*(w[i:] for i in range(n)), strict=False)
            hashes.extend([digest(x, seed) for x in map(b" ".join, grams)])
        if len(hashes) > 200_000:
            yield rows, np.array(starts), np.array(hashes, np.uint64)
            hashes, starts, rows = [], [], []
    if rows:
        yield rows, np.array(starts), np.array(hashes, np.uint64)


def _majority(starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A fingerprint of each run of hashes: the bits that are set in over half of them."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    size = np.diff(np.append(starts, len(hashes)))
    return np.packbits((2 * ones > size[:, None]).astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(texts: list[str | None], n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of each text over its n-word shingles; without words zero."""
    out = np.zeros(len(texts), np.uint64)
    for rows, starts, hashes in _shingled(texts, n, seed):
        out[rows] = _majority(starts, hashes)
    return out


def fingerprint_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long of the same 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    ids = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return ids.mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, fp long")


# ---- bit-sliced links -------------------------------------------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes, shape (64, words): lane i of word w of plane b is bit b of fingerprint 64 * w + i."""
    n = -(-len(fps) // 64)
    full = np.zeros(n * 64, np.uint64)
    full[: len(fps)] = fps
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


class Counters:
    """Carry-save counters of many distances at once, one plane for each binary digit, and what exceeds the radius.

    They start at 2^k - 1 - radius, k the digits of the radius, so that a distance over it is a carry out of the last plane.
    """

    def __init__(self, width: int, radius: int):
        k = max(radius.bit_length(), 1)
        self.planes = [np.full(width, _ALL if (1 << k) - 1 - radius >> j & 1 else 0, np.uint64) for j in range(k)]
        self.over = np.zeros(width, np.uint64)

    def add(self, carry: np.ndarray) -> None:
        for j, plane in enumerate(self.planes):
            self.planes[j], carry = plane ^ carry, plane & carry
        self.over = self.over | carry

    def keep(self, at: np.ndarray) -> None:
        self.planes = [p[at] for p in self.planes]
        self.over = self.over[at]


def near(slices: np.ndarray, query: int, radius: int = RADIUS, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Words, from `first` on, with lanes within the radius of the query, and those lanes as bits."""
    alive = np.arange(first, slices.shape[1])
    count = Counters(len(alive), radius)
    part = slices[:, first:]
    for b in range(BITS):
        count.add(~part[b] if query >> b & 1 else part[b])
        if b % LOOK == LOOK - 1:
            keep = count.over != _ALL
            if not keep.all():
                if not keep.any():
                    return alive[:0], count.over[:0]
                alive, part = alive[keep], part[:, keep]
                count.keep(keep)
    return alive, ~count.over


def _lanes(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    on = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, lane = np.nonzero(on)
    return words[w] * 64 + lane


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links between distinct fingerprints that share a key."""
    n = len(fps)
    label = np.arange(n)
    out = []
    slices = planes(fps)
    for i in range(n - 1):
        words, bits = near(slices, int(fps[i]), first=i // 64)
        if not len(words):
            continue
        hit = _lanes(words, bits)
        hit = hit[(hit > i) & (hit < n)]
        while len(hit := hit[label[hit] != label[i]]):
            j = hit[0]
            out.append((int(fps[i]), int(fps[j])))
            label[label == label[j]] = label[i]
    return out


def small_pairs(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs within the radius in many small keys (sorted; at most 64 each), one word per key, all keys side by side."""
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(keys)))
    lane = np.arange(len(keys)) - start[group]
    slices = np.zeros((BITS, len(start)), np.uint64)
    for b in range(BITS):
        np.bitwise_or.at(slices[b], group, (fps >> np.uint64(b) & np.uint64(1)) << lane.astype(np.uint64))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in range(int(size.max()) - 1):
        at = np.flatnonzero(size > r + 1)
        query = fps[start[at] + r]
        part = slices[:, at]
        alive = np.arange(len(at))
        count = Counters(len(at), radius)
        later = _ALL << np.uint64(r + 1) if r < 63 else np.uint64(0)
        valid = np.where(size[at] >= 64, _ALL, (np.uint64(1) << np.minimum(size[at], 63).astype(np.uint64)) - np.uint64(1)) & later
        for b in range(BITS):
            count.add(part[b] ^ (np.uint64(0) - (query >> np.uint64(b) & np.uint64(1))))
            if b % 16 == 15:
                keep = (~count.over & valid) != 0
                alive, part, query, valid = alive[keep], part[:, keep], query[keep], valid[keep]
                count.keep(keep)
                if not len(alive):
                    break
        if len(alive):
            on = np.unpackbits((~count.over & valid).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, to = np.nonzero(on)
            left.append(start[at][alive][k] + r)
            right.append(start[at][alive][k] + to)
    return np.concatenate(left), np.concatenate(right)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key come in; links go out. Holds one key at a time, or a batch of small ones."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def links(last: bool):
        nonlocal held, n
        keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
        held = [] if last else [(keys[cut:], fps[cut:])]
        n = len(keys) - cut
        keys, fps = keys[:cut], fps[:cut]
        if not len(keys):
            return
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        size = np.diff(np.append(np.flatnonzero(new), len(keys)))
        per_row = np.repeat(size, size)
        a, b = [], []
        for low, high in ((2, 4), (5, 12), (13, 32)):
            pick = (per_row >= low) & (per_row <= high)
            if pick.any():
                x, y = small_pairs(keys[pick], fps[pick])
                a.append(fps[pick][x]), b.append(fps[pick][y])
        for s, m in zip(np.flatnonzero(new)[size > 32], size[size > 32], strict=True):
            if pairs := forest(fps[s : s + m]):
                x, y = np.array(pairs, np.uint64).T
                a.append(x), b.append(y)
        if a and sum(map(len, a)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        n += batch.num_rows
        if n > 100_000:
            yield from links(False)
    if held:
        yield from links(True)


def _bits(start: int, width: int):
    return F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) links, a spanning forest within each key, between the distinct fingerprints of column fp."""
    of = []
    for t, (i, j) in enumerate(TABLES):
        rest = [b for k, b in enumerate(BLOCKS) if k not in (i, j)]
        spread = [(s + o, min(10, w - o)) for s, w in rest for o in range(0, w, 10)]
        # The bits that are left, in four runs: of at most three differences one run is free.
        bits = [p for s, w in spread for p in range(s, s + w)]
        quarters = [bits[q * len(bits) // 4 : (q + 1) * len(bits) // 4] for q in range(4)]
        of.append((t, _bits(*BLOCKS[i]), _bits(*BLOCKS[j]), quarters))
    keyed = fps.select("fp", F.inline(F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), x, y).alias("key")) for t, x, y, _ in of])))
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    keyed = keyed.join(many, "key")
    few = keyed.where(F.col("n") <= hot).select("key", "fp")
    masks = F.array(*[F.array(*[F.lit(_signed(sum(1 << p for p in q))) for q in quarters]) for *_, quarters in of])
    again = keyed.where(F.col("n") > hot).select("fp", "key", F.posexplode(F.element_at(masks, F.col("t") + 1)).alias("q", "mask"))
    again = again.select(F.xxhash64("key", "q", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")
    rows = few.unionByName(again).repartition("key").sortWithinPartitions("key", "fp")
    return rows.mapInArrow(_links, "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---- components -------------------------------------------------------------------------------------------------


def components(edges: DataFrame, work: Work) -> DataFrame:
    """(node, root): smallest node of each node's component, by alternating large-star and small-star rounds.

    Each round is written to the shared folder, and stops when a round changes nothing. Stars are built from sets of
    distinct edges; a node's smallest neighbour is an aggregate, so that no task gathers a node's neighbours.
    """
    low = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = work.write(edges.select(*low).where("a <> b").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = work.write(large)
        work.drop(work.n - 1)
        # small star: of each node's smaller neighbours the least takes the node and the others
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        edges = work.write(small)
        work.drop(work.n - 1)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row.

    component_id is the smallest doc_id reachable over links, itself included; null if no reachable row has an id.
    Null and empty texts have fingerprint zero and link like any other. Repeated rows keep their number.
    """
    spark = docs.sparkSession
    work = Work(spark, "simhash")
    rows = work.write(fingerprint_rows(docs, key, text))
    groups = work.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(groups.select("fp")), work)
    groups = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = groups.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = groups.join(ids, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near copies of some changed words ----------------------------------------------------------------------------

#: Setting of near copies: shingles of five words, links at a Jaccard similarity of 0.8 of the sets of shingles.
WORDS, SIMILARITY = 5, 0.8
#: Keys: a run of ROWS minima each. A pair at 0.8 shares one with 1 - (1 - 0.8^4)^8 = 0.985, one at 0.85 with 0.997.
BANDS, ROWS = 8, 4
#: Bits within which a key's fingerprints are compared exactly. At a similarity of 0.8 the distance is 9.7 bits on average, 2.9 its deviation.
WIDE = 24
#: Fingerprints that a key compares in one piece. Larger keys are dealt into pieces at random; what these leave in more than one
#: group is then compared across pieces, so that every pair of a key is linked or compared.
PIECE = 300


def _minima(starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys of each run of hashes, shape (runs, BANDS): each mixes the minima under ROWS hash functions of its own."""
    r = np.random.default_rng(SEED)
    out = np.zeros((len(starts), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        a, b = (r.integers(0, 1 << 63, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))
        low = np.minimum.reduceat(hashes * a + b, starts)
        x = (out[:, k // ROWS] ^ low) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
        out[:, k // ROWS] = x ^ (x >> np.uint64(29))
    return out


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(norm, fp, keys, grams): hash of the words, fingerprint, keys, and the sorted set of shingles as 32-bit codes."""
        from xxhash import xxh64_intdigest as digest

        for b in batches:
            texts = b.column(0).to_pylist()
            norm = np.array([digest(b" ".join((t or "").encode().lower().split())) for t in texts], np.uint64)
            fp = np.zeros(len(texts), np.uint64)
            keys = np.zeros((len(texts), BANDS), np.uint64)
            grams = [b""] * len(texts)
            for rows, starts, hashes in _shingled(texts, n, SEED):
                fp[rows] = _majority(starts, hashes)
                keys[rows] = _minima(starts, hashes)
                ends = np.append(starts[1:], len(hashes))
                short = hashes.astype(np.uint32)
                for row, x, y in zip(rows, starts, ends, strict=True):
                    grams[row] = np.unique(short[x:y]).tobytes()
            some = np.array([len(g) > 0 for g in grams], bool)
            ends = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(norm.view(np.int64)), pa.array(fp.view(np.int64)), held, pa.array(grams, pa.binary())], ["rid", "doc_id", "text_hash", "norm", "fp", "keys", "grams"])

    return run


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _similar(similarity: float, radius: int):
    """Rows sorted by piece come in; verified links (a, b) of norms go out, a forest within each piece. Holds a few pieces.

    Rows of one root are linked already and aren't compared.
    """

    def forest_of(label: np.ndarray, sets: list[np.ndarray], pairs) -> Iterator[tuple[int, int]]:
        for i, j in pairs:
            if label[i] != label[j] and alike(sets[i], sets[j], similarity):
                label[label == label[j]] = label[i]
                yield i, j

    def pairs_of(fps: np.ndarray) -> Iterator[tuple[int, int]]:
        slices = planes(fps)
        for i in range(len(fps) - 1):
            hit = _lanes(*near(slices, int(fps[i]), radius, first=i // 64))
            for j in hit[(hit > i) & (hit < len(fps))]:
                yield i, int(j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def links(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column(0).to_numpy()
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            held, n = ([] if last else t.slice(cut).to_batches()), len(key) - cut
            if not cut:
                return
            key, norm = key[:cut], t.column(1).to_numpy()[:cut]
            fps = t.column(2).to_numpy()[:cut].view(np.uint64)
            sets = [np.frombuffer(x, np.uint32) for x in t.column(3).slice(0, cut).to_pylist()]
            label = np.unique(t.column(4).to_numpy()[:cut], return_inverse=True)[1]
            new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(new, cut))
            small = np.repeat(size <= 32, size)
            at = np.flatnonzero(small)
            found: list[tuple[int, int]] = []
            if len(at):
                x, y = small_pairs(key[at], fps[at], radius)
                found += forest_of(label, sets, zip(at[x].tolist(), at[y].tolist(), strict=True))
            for s, m in zip(new[size > 32], size[size > 32], strict=True):
                found += [(s + i, s + j) for i, j in forest_of(label[s : s + m], sets[s : s + m], pairs_of(fps[s : s + m]))]
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(norm[a]), pa.array(norm[b])], ["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
                if n > 2 * PIECE:
                    yield from links(False)
        while held:
            yield from links(True)

    return run


def similar_groups(docs: DataFrame, work: Work, key: str = "doc_id", text: str = "text", n: int = WORDS, similarity: float = SIMILARITY, radius: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """rows (rid, doc_id, text_hash, norm) and, of norms that have links, (node, root).

    Texts of the same words but for case and spaces have one norm; texts without words have one, too. Norms link whose sets of
    n-word shingles have at least the similarity given, if they share a key and their fingerprints are within the radius.
    """
    ids = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("doc_id")).withColumn("text_hash", F.xxhash64("text"))
    ids = ids.select("text", F.xxhash64("doc_id", "text_hash").alias("rid"), "doc_id", "text_hash")
    out = f"rid long, doc_id {ids.schema['doc_id'].dataType.simpleString()}, text_hash long, norm long, fp long, keys array<long>, grams binary"
    first = work.n + 1
    rows = work.write(ids.mapInArrow(_signatures(n), out).withColumn("no", F.monotonically_increasing_id()))
    narrow = work.write(rows.select("rid", "doc_id", "text_hash", "norm"))
    keyed = work.write(rows.select("norm", F.posexplode("keys").alias("t", "k")).select("norm", "t", F.xxhash64("t", "k").alias("key")).distinct())
    many = work.write(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    deal = F.xxhash64("key", F.pmod(F.xxhash64("norm", "t"), F.ceil(F.col("n") / PIECE)))
    total, every = keyed.count(), keyed
    keyed = work.write(lookup(keyed, many, "key", "n", total).select("norm", deal.alias("piece")))
    # One row of each norm that shares a key brings its set of shingles. The merge hints keep one plan at every size.
    one = rows.groupBy("norm").agg(F.min("no").alias("no")).join(keyed.select("norm").distinct().hint("merge"), "norm").select("no")
    sets = rows.select("no", "norm", "fp", "grams").join(one.hint("merge"), "no")
    compared = lambda dealt: dealt.join(sets.hint("merge"), "norm").select("piece", "norm", "fp", "grams", "root").repartition("piece").sortWithinPartitions("piece", "norm").mapInArrow(_similar(similarity, radius), "a long, b long")
    found = work.write(compared(keyed.withColumn("root", F.col("norm"))))
    roots = components(found, work)
    parted = many.where(F.col("n") > PIECE)
    if parted.limit(1).count():
        found = found.unionByName(work.write(compared(_across(lookup(every, parted, "key", "n", total), roots, total, work))))
        roots = components(found, work)
    for k in (0, 2, 3, 4):  # what the links were found with is not needed any more
        work.drop(first + k)
    return narrow, roots


def _across(large: DataFrame, roots: DataFrame, total: int, work: Work) -> DataFrame:
    """(piece, norm, root): rows (key, norm, n) of keys of several pieces, dealt so that any two of different roots meet in some piece.

    A key's rows of its most frequent root are dealt by themselves, and so are the others; each piece of others meets every
    piece. A key of one root has no rows. So a row is copied as often as there are pieces it has still to meet.
    """
    met = large.join(roots.hint("merge"), large["norm"] == roots["node"], "left").select("key", "norm", "n", F.coalesce("root", "norm").alias("root"))
    met = work.write(met)
    sizes = met.groupBy("key", "root", "n").agg(F.count("*").alias("c")).groupBy("key", "n").agg(F.max(F.struct("c", "root")).alias("top"))
    sizes = work.write(sizes.where(F.col("top.c") < F.col("n")).select("key", "n", F.col("top.root").alias("top"), F.ceil(F.col("top.c") / PIECE).alias("p"), F.ceil((F.col("n") - F.col("top.c")) / PIECE).alias("q")))
    dealt = lookup(met.drop("n"), sizes, "key", "n", total)
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    mine, most = F.pmod(F.xxhash64("norm", "key"), F.when(F.col("root") == F.col("top"), F.col("p")).otherwise(F.col("q"))), F.lit(True)
    dealt = dealt.withColumn("i", mine)
    with_most = F.transform(upto("p"), lambda k: F.struct(F.col("i").alias("x"), most.alias("most"), k.alias("y")))
    with_others = F.transform(upto("q"), lambda k: F.struct(F.least("i", k).alias("x"), F.lit(False).alias("most"), F.greatest("i", k).alias("y")))
    of_most = F.transform(upto("q"), lambda k: F.struct(k.alias("x"), most.alias("most"), F.col("i").alias("y")))
    places = F.when(F.col("root") == F.col("top"), of_most).otherwise(F.concat(with_most, with_others))
    return dealt.select("key", "norm", "root", F.inline(places)).select(F.xxhash64("key", "x", "most", "y").alias("piece"), "norm", "root")


def stage_simhash(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id, then of the least text hash; ids that are null come last.

    Near copies are those of similar_groups (five words, 0.8). Rows that repeat id and text are one document: of these the
    row stays that is first as JSON. Texts without words, null among them, are one group. An empty table gives no rows; the
    columns stay as they were.
    """
    names = docs.columns
    work = Work(spark, "near")
    rows, roots = similar_groups(docs, work)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash", "rid"))
    first = rows.groupBy("norm").agg(best.alias("best"))
    group = first.join(roots, first["norm"] == roots["node"], "left").groupBy(F.coalesce("root", "norm").alias("root")).agg(F.min("best").alias("best"))
    sizes = rows.groupBy("rid").agg(F.count("*").alias("n"))
    kept = work.write(group.select(F.col("best.rid").alias("rid")).join(sizes, "rid"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64("doc_id", F.xxhash64("text")).alias("rid"))
    left = lookup(held, kept, "rid", "n", rows.count())
    if kept.where("n > 1").limit(1).count():
        again = left.where("n > 1").groupBy("rid").agg(F.min_by("row", F.to_json("row")).alias("row"))
        left = left.where("n = 1").select("row").unionByName(again.select("row"))
    return left.select(*[F.col("row").getField(c).alias(c) for c in names])
