"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over every document's word windows.

A window of n words holds a whole gram of q = (n + 1) // 2 words that starts at a multiple of q, whatever its offset. So
each document looks up only every q-th gram, and after a hit the windows that hold it. The set is a table of bits in which
each hash has two, and travels with the tasks. What passes carries its words, and a join with the benchmark's windows on
hash and words settles it: a fuller set lets more pass to the join, but never changes the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Work, ascii_lower, gram_hash, lookup, positions, table

WINDOW = 13
#: Greatest number of distinct benchmark windows that are broadcast to the join; more are shuffled with what the set let pass.
MOST_IN_SET = 200_000
#: Greatest size of the set. It has 8 to 16 bits a hash until that is reached.
MOST_BITS = 1 << 25
SEPARATORS = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"


def tokens(text: Column) -> Column:
    """Lower-cased words of ASCII letters and digits and of all characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"[{SEPARATORS}]+"), "")


def windows(items: DataFrame, n: int) -> DataFrame:
    """(len, hash, words, items): distinct windows of the benchmark with the ids that hold them, sorted as strings.

    An item of fewer than n words is one window of its length; one without words is none.
    """
    w = F.col("_w")
    size = F.least(F.size(w), F.lit(n))
    df = items.select(F.col("item_id").cast("string").alias("item"), tokens(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    df = df.select("item", size.alias("len"), "_w", F.explode(positions(F.size(w) - size + 1)).alias("i"))
    df = df.select("item", "len", F.slice("_w", F.col("i") + 1, F.col("len")).alias("_g"))
    df = df.groupBy("len", F.array_join("_g", " ").alias("words"), F.xxhash64("_g").alias("hash")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    return df.select("len", "hash", "words", "items")


def seeds(marks: DataFrame, lengths: list[int]) -> DataFrame:
    """(hash): the grams of q words inside windows of each length."""
    g = F.split("words", " ")
    every = marks.select("hash")
    for k in lengths:
        q = (k + 1) // 2
        here = F.transform(positions(F.lit(k - q + 1)), lambda i: F.xxhash64(*[F.get(g, i + j) for j in range(q)]))  # noqa: B023
        every = every.unionByName(marks.where(F.col("len") == k).select(F.explode(here).alias("hash")))
    return every.distinct()


def hash_set(hashes: DataFrame, most_bits: int = MOST_BITS) -> Callable[[Column], Column]:
    """Whether a hash may be in the set: never false for one that is. The bits are at most most_bits, whatever the input."""
    size = max(64, min(most_bits, 1 << (8 * hashes.count()).bit_length()))
    slots = lambda h: (h.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(size - 1)))
    marked = hashes.select(F.explode(F.array(*slots(F.col("hash")))).alias("slot"))
    marked = marked.groupBy(F.shiftright("slot", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    dense = hashes.sparkSession.range(size // 64).join(marked, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    dense = dense.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"].cast("string")), ",").alias("bits"))
    bits = F.split(F.lit(dense.first().bits), ",").cast("array<bigint>")  # folded into one array when the plan is optimised

    def held(h: Column) -> Column:
        one, two = (F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1 for at in slots(h))
        return one & two

    return held


def candidates(docs: DataFrame, lengths: list[int], held: Callable[[Column], Column] | None) -> DataFrame:
    """doc_id, text_hash, n_words, hits (at, len, hash, words) of each row: the windows whose hash the set may hold."""
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), tokens(F.col("text")).alias("w"))
    w, size = F.col("w"), F.size("w")
    if not lengths:
        return base.select("doc_id", "text_hash", size.alias("n_words"), F.array().cast("array<struct<at:int,len:int,hash:bigint,words:string>>").alias("hits"))

    def gram(k: int, n: int, at: Column) -> Column:
        return F.struct(F.lit(k).alias("len"), at.cast("int").alias("at"), gram_hash(w, at, n).alias("hash"))

    def grams(k: int) -> Column:
        q = (k + 1) // 2
        return F.transform(positions(F.when(size >= k, F.floor(size / q)).otherwise(0)), lambda p: gram(k, q, p * q))

    def around(k: int) -> Column:
        off = k - (k + 1) // 2
        starts = lambda x: F.sequence(F.greatest(F.lit(0), x["at"] - off), F.least(x["at"], size - k))
        return F.flatten(F.transform(F.filter("_s", lambda x: x["len"] == k), lambda x: F.transform(starts(x), lambda j: gram(k, k, j))))

    base = base.withColumn("_s", F.filter(F.concat(*[grams(k) for k in lengths]), lambda x: held(x["hash"])))
    base = base.withColumn("_h", F.filter(F.concat(*[around(k) for k in lengths]), lambda x: held(x["hash"])))
    hit = lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len"), x["hash"].alias("hash"), F.array_join(F.slice(w, x["at"] + 1, x["len"]), " ").alias("words"))
    return base.select("doc_id", "text_hash", size.alias("n_words"), F.transform("_h", hit).alias("hits"))


def scan(docs: DataFrame, items: DataFrame, n: int = WINDOW, most_in_set: int = MOST_IN_SET, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, text_hash, rows, n_words, n_hit, n_items, items (array) for each distinct (doc_id, text).

    rows counts equal rows. Null and empty texts have no words and no hits; an empty benchmark hits nothing.
    """
    work = Work(docs.sparkSession, "bench")
    marks = work.write(windows(items, n))
    lengths = [r[0] for r in marks.select("len").distinct().orderBy("len").limit(n).collect()]
    held = hash_set(work.write(seeds(marks, lengths)), most_bits) if lengths else None
    base = work.write(candidates(docs, lengths, held))
    maybe = base.select("doc_id", "text_hash", "n_words", F.explode("hits").alias("hit")).select("doc_id", "text_hash", "n_words", "hit.*")
    if marks.count() <= most_in_set:
        found = maybe.join(F.broadcast(marks), ["len", "hash", "words"])
    else:
        times = maybe.groupBy("hash").agg(F.count("*").alias("times"))
        same = marks.groupBy("hash").agg(F.collect_list(F.struct(F.col("len").alias("l"), F.col("words").alias("ws"), F.col("items").alias("its"))).alias("same"))
        same = work.write(same.join(times, "hash"))
        total = same.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
        found = lookup(maybe, same, "hash", "times", total)
        found = found.withColumn("m", F.explode(F.filter("same", lambda m: (m["l"] == F.col("len")) & (m["ws"] == F.col("words"))))).withColumn("items", F.col("m.its"))
    found = found.select("doc_id", "text_hash", "n_words", F.lit(0).alias("first"), "items", F.struct("at", "len").alias("span"))
    one = base.select("doc_id", "text_hash", "n_words", F.lit(1).alias("first")).unionByName(found, allowMissingColumns=True)
    df = one.groupBy("doc_id", "text_hash", "n_words").agg(F.sum("first").alias("rows"), F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["at"] + s["len"] - F.greatest(a["end"], s["at"]))).alias("n"))
    covered = F.aggregate("spans", start, step, lambda a: a["n"]).cast("long")
    df = df.select("doc_id", "text_hash", "rows", F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans")
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    found = found.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_again"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def stage_decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; the others keep their columns."""
    bad = scan(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    left = rows.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_hash") == F.col("bad_hash")), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same rows by comparing windows whole. doc_id is taken as unique, as it is in the table.
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
bn AS (SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, unnest(list_transform(range(len(w) - n + 1), lambda i: array_to_string(w[i + 1:i + n], ' '))) AS s FROM bn),
l AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(len(w) - n + 1)) AS i, unnest(list_transform(range(len(w) - n + 1), lambda i: array_to_string(w[i + 1:i + n], ' '))) AS s FROM t, l WHERE len(w) >= n),
h AS (SELECT doc_id, n, i, item FROM dw JOIN bw USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, (SELECT unnest(range(13)) AS k) WHERE k < n GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM t LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""
