"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes that start at an anchor, the least 8-word hash of some 35-word window, are indexed: equal windows have their
anchor at the same place, so no repeat is lost. The anchor's 8 words are the suffix's prefix. Prefixes that occur once are
leaves and are dropped. Those of memory-sized groups make one subtree each: a suffix array with its LCP values, whose
internal nodes of depth 35 - d, met with the nodes of depth d of the tree of reversed left contexts, are the repeats that
start d words before the anchor. Prefixes of more suffixes than a group may hold grow: their windows are parted by d into
ever narrower ranges, and those of a range share a longer stretch of words around the anchor (22, 29, 32, 34 of the 35),
which is the prefix of a group of its own. Unique prefixes end at each step. Only a group that is still too large at all 35
words, where its tree would be one node, is decided by its count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Work, lookup, table

WINDOW, PREFIX = 35, 8
REACH = WINDOW - PREFIX
#: Suffixes that a subtree may hold, 250 bytes each.
GROUP = 100_000
#: Ranges of d that prefixes grow through. The windows of a range share 35 words but for its width less one.
RANGES = (1, 2, 4, 7, 14, 28)
#: Words handled at a time by a task.
BATCH = 2_000_000
_M = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 400_000:
            self.clear()
        code = self[word] = xxh64_intdigest(word, 11)
        return code


def _coded(texts: list[str | None], codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all texts in a row and the words of each. Words are split at the six ASCII separators alone."""
    out, sizes = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        w = text.encode().split() if text else []
        sizes[k] = len(w)
        out.append(np.fromiter(map(codes.__getitem__, w), np.uint64, len(w)))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def _grams(c: np.ndarray, n: int) -> np.ndarray:
    """Mixed hash of the n codes from each place on; the last n - 1 places are missing."""
    if len(c) < n:
        return c[:0]
    h = np.zeros(len(c) - n + 1, np.uint64)
    for k in range(n):
        h = h * _M + c[k : k + len(h)]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(c: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, their prefix hashes, and the first and last window that each stands for."""
    h = _grams(c, PREFIX)
    ends = np.cumsum(sizes)
    last = ends - WINDOW  # the last window of each text
    starts = ends - sizes
    if not len(h) or not (last >= starts).any():
        none = np.zeros(0, np.int64)
        return none, h[:0], none, none
    # The place in the low bits makes the leftmost of equal hashes the least.
    packed = (h >> np.uint64(26) << np.uint64(26)) | np.arange(len(h), dtype=np.uint64)
    m, width = packed, 1
    while width * 2 <= REACH + 1:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = REACH + 1 - width
    m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    at = (m & np.uint64((1 << 26) - 1)).astype(np.int64)  # of window p
    ok = np.zeros(len(at) + 1, np.int64)
    some = last >= starts
    np.add.at(ok, starts[some], 1)
    np.add.at(ok, last[some] + 1, -1)
    p = np.flatnonzero(np.cumsum(ok[:-1]))
    place, first, n = np.unique(at[p], return_index=True, return_counts=True)
    return place, h[place], p[first], p[first] + n - 1


def _parts(keys: list, texts: list, extra: list | None = None):
    """Cuts a batch so that each part has about BATCH words (by length of text)."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "") // 5
        if size > BATCH or k == len(texts) - 1:
            yield keys[lo : k + 1], texts[lo : k + 1], extra[lo : k + 1] if extra is not None else None
            lo, size = k + 1, 0


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = _Codes()
    for b in batches:
        for keys, texts, _ in _parts(b.column(0).to_pylist(), b.column(1).to_pylist()):
            c, sizes = _coded(texts, codes)
            place, h, lo, hi = anchors(c, sizes)
            ends = np.cumsum(sizes)
            doc = np.searchsorted(ends, place, side="right")
            start = (ends - sizes)[doc]
            at = (place - start) << 12 | (place - lo) << 6 | (hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.array(keys, np.int64)[doc]), pa.array(at)], ["h", "kid", "at"])


def _hits(b: pa.RecordBatch, codes: _Codes):
    """Of the texts with hits, a part at a time: word codes, the first word and row id of each hit's text, and the hits."""
    rows = np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False))
    keep = b.take(pa.array(rows))
    for keys, texts, hits in _parts(keep.column(0).to_pylist(), keep.column(1).to_pylist(), keep.column(2).to_pylist()) if len(rows) else ():
        c, sizes = _coded(texts, codes)
        doc = np.repeat(np.arange(len(keys)), [len(x) for x in hits])
        at = np.array([x["at"] for y in hits for x in y], np.int64)
        key = np.array([x["key"] for y in hits for x in y], np.int64)
        yield c, (np.cumsum(sizes) - sizes)[doc], np.array(keys, np.int64)[doc], at, key


def _grown(ranges: int):
    """(key, kid, at) of suffixes by their windows' ranges: the key is the hash of the words that a range's windows share."""
    width = (REACH + 1) // ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            for c, start, kid, at, _ in _hits(b, codes):
                h = _grams(c, WINDOW - width + 1)
                most = at >> 6 & 63
                least = most - (at & 63)
                for q in range(ranges):
                    hi, lo = np.minimum(most, (q + 1) * width - 1), np.maximum(least, q * width)
                    some = np.flatnonzero(lo <= hi)
                    if len(some):
                        key = h[(start + (at >> 12) - q * width)[some]] * _M + np.uint64(q * 64 + ranges)
                        own = (at[some] >> 12) << 12 | hi[some] << 6 | (hi - lo)[some]
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kid[some]), pa.array(own)], ["key", "kid", "at"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, kid, at, words): the words that the windows of each suffix hold."""
    codes = _Codes()
    for b in batches:
        for c, start, kid, at, key in _hits(b, codes):
            lo = start + (at >> 12) - (at >> 6 & 63)
            size = (at & 63) + WINDOW
            offsets = np.concatenate(([0], np.cumsum(size)))
            flat = c.astype(np.uint32)[np.repeat(lo - offsets[:-1], size) + np.arange(offsets[-1])]
            held = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kid), pa.array(at), held], ["key", "kid", "at", "words"])


def _ranked(context: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the contexts within groups, and LCP of each with the one before it (-1 at a group's start)."""
    order = np.lexsort((*(context[:, k] for k in reversed(range(context.shape[1]))), group))
    c, g = context[order], group[order]
    differ = np.ones((len(c), context.shape[1] + 1), bool)
    differ[1:, :-1] = c[1:] != c[:-1]
    lcp = differ.argmax(axis=1)
    lcp[0] = -1
    lcp[1:][g[1:] != g[:-1]] = -1
    return order, lcp


def repeats(group: np.ndarray, data: np.ndarray, start: np.ndarray, left: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per suffix a bit for each d: the window that starts d words before the anchor is also somewhere else.

    data holds the words; those of a suffix run from `start`, its anchor is `left` words on, and it stands for the windows
    d = left, left - 1, .. of which there are `count`.
    """
    n = len(group)
    anchor, end = start + left, start + count - 1 + WINDOW
    right = anchor[:, None] + np.arange(WINDOW)
    right = np.where(right < end[:, None], data[np.minimum(right, len(data) - 1)], 0)
    back = anchor[:, None] - 1 - np.arange(REACH)
    back = np.where(back >= start[:, None], data[np.maximum(back, 0)], 0)
    out = np.zeros(n, np.int64)
    order_r, lcp_r = _ranked(right, group)
    order_l, lcp_l = _ranked(back, group)
    node_r, node_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(REACH + 1):
        mine = np.flatnonzero((left >= d) & (left - count < d))
        if len(mine) < 2:
            continue
        node_r[order_r] = np.cumsum(lcp_r < WINDOW - d)  # nodes of depth 35 - d of the groups' trees
        node_l[order_l] = np.cumsum(lcp_l < d) if d else np.cumsum(lcp_l < 0)
        code = node_r[mine] * np.int64(n + 1) + node_l[mine]
        _, which, times = np.unique(code, return_inverse=True, return_counts=True)
        out[mine[times[which] > 1]] |= 1 << d
    return out


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by prefix come in; (kid, at, bits) of suffixes with repeats go out. Holds whole groups, few at a time."""
    held: list[pa.RecordBatch] = []
    n = 0

    def flush(last: bool):
        nonlocal held, n
        t = pa.Table.from_batches(held).combine_chunks()
        key = t.column("key").to_numpy()
        cut = len(key) if last else int(np.searchsorted(key, key[-1]))
        rest = t.slice(cut).to_batches() if cut < len(key) else []
        held, n = rest, len(key) - cut
        if not cut:
            return
        t = t.slice(0, cut)
        w = t.column("words").combine_chunks()
        w = w.chunk(0) if isinstance(w, pa.ChunkedArray) else w
        offsets = np.frombuffer(w.buffers()[1], np.int32)[w.offset : w.offset + len(w) + 1].astype(np.int64) // 4
        data = np.frombuffer(w.buffers()[2], np.uint32)
        at = t.column("at").to_numpy()
        bits = repeats(key[:cut], data, offsets[:-1], at >> 6 & 63, (at & 63) + 1)
        some = np.flatnonzero(bits)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(t.column("kid").to_numpy()[some]), pa.array((at >> 12)[some]), pa.array(bits[some])], ["kid", "place", "bits"])

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
            if n > GROUP:
                yield from flush(False)
    if n:
        yield from flush(True)


def _last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, found = b.column(1).to_pylist(), b.column(2).to_pylist()
        total, gone, kept = [], [], []
        for text, hits in zip(texts, found, strict=True):
            w = text.encode().split() if text else []
            total.append(len(w))
            if hits:
                place = np.array([x["place"] for x in hits], np.int64)
                bits = np.array([x["bits"] for x in hits], np.int64)
                rows, d = np.nonzero(bits[:, None] >> np.arange(REACH + 1) & 1)
                p = place[rows] - d
                steps = np.zeros(len(w) + 1, np.int64)
                np.add.at(steps, p, 1)
                np.add.at(steps, p + WINDOW, -1)
                stay = np.cumsum(steps[:-1]) == 0
                left = list(compress(w, stay.tolist()))
            else:
                left = w
            gone.append(len(w) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, of every row.

    A word goes if a 35-word window over it starts anywhere else too, in the same text included. Null and empty texts and
    those of under 35 words lose nothing. Rows that repeat id and text repeat each other's windows. An empty table gives no
    rows; columns other than key and text are left out. Rows are followed by a 64-bit hash of id and text. A group over the
    bound at the full length of a window goes by its 64-bit hash; all others are compared word by word.
    """
    work = Work(docs.sparkSession, "substring")
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("kid", F.xxhash64("doc_id", "text"))

    def with_hits(hits: DataFrame) -> DataFrame:
        packed = hits.groupBy("kid").agg(F.collect_set(F.struct("key", "at")).alias("hits"))
        return rows.join(packed, "kid").select("kid", "text", "hits")

    level = work.write(rows.select("kid", "text").mapInArrow(_first_pass, "h long, kid long, at long").withColumnRenamed("h", "key"))
    fits, bits = None, None
    for ranges in RANGES:
        many = work.write(level.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        total = level.count()
        own = lookup(level, many.where(F.col("n") <= group), "key", "n", total).select("key", "kid", "at")
        fits = own if fits is None else fits.unionByName(own)
        if not many.where(F.col("n") > group).limit(1).count():
            break
        hot = lookup(level, many.where(F.col("n") > group), "key", "n", total)
        if ranges == RANGES[-1]:
            bits = hot.select("kid", F.shiftright("at", 12).alias("place"), F.expr("shiftleft(1L, int(shiftright(at, 6) & 63))").alias("bits"))
        else:
            level = work.write(with_hits(hot).mapInArrow(_grown(RANGES[RANGES.index(ranges) + 1]), "key long, kid long, at long"))
    held = work.write(with_hits(fits).mapInArrow(_words, "key long, kid long, at long, words binary"))
    found = held.repartition("key").sortWithinPartitions("key").mapInArrow(_trees, "kid long, place long, bits long")
    found = found if bits is None else found.unionByName(bits)
    found = found.groupBy("kid").agg(F.collect_set(F.struct("place", "bits")).alias("repeats"))
    out = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string"
    return rows.join(found, "kid", "left").select("doc_id", "text", "repeats").mapInArrow(_last_pass, out)


def op3_suffix_tree_substring_dedup(spark, sf_dir: str) -> DataFrame:
    df = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows by comparing windows whole. doc_id is taken as unique, as it is in the table.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(len(w) - 34)) AS i, unnest(list_transform(range(len(w) - 34), lambda i: md5(array_to_string(w[i + 1:i + 35], ' ')))) AS s FROM d WHERE len(w) >= 35),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(35)) AS k)),
x AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
