"""Line dedup by winnowing over line hashes.

Lines that hold a word, trimmed, are hashed. A window is the fewest lines from a line on that hold ENOUGH words, MOST of
them at most. Each window selects its least line hash (the rightmost of equals); only selected positions are fingerprints,
and whatever repeats a whole window has one at the same place. Fingerprints that occur once end there. Positions of the
others are joined by the windows that they were selected for, each later one to the first in order of doc_id, text hash
and line. From there the match is extended line by line both ways, and the later run goes. A line's first occurrence is
never in a later run, so no line is lost altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import SPACES, Work, lookup, positions, table, word_count

#: Lines of a window at most, and words from which fewer lines are one.
MOST, ENOUGH = 3, 8


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES)) != ""


def hashed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rid, doc_id, text_hash, h and n: hash and number of words of each line that has words; texts without any are left out."""
    t = F.col(f"`{text}`")
    lines = F.transform(F.filter(F.split(t, "\n"), _has_word), lambda x: F.struct(F.xxhash64(F.btrim(x, F.lit(SPACES))).alias("h"), word_count(x).cast("int").alias("n")))
    df = docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(t).alias("text_hash"), lines.alias("x"))
    return df.select(F.xxhash64("doc_id", "text_hash").alias("rid"), "doc_id", "text_hash", F.col("x.h").alias("h"), F.col("x.n").alias("n")).where(F.size("h") > 0)


def windows(h: Column, n: Column) -> Column:
    """Windows in order: i, their first line, size, and at, the line that each selects."""

    def size(i):
        held, found = F.get(n, i), F.when(F.get(n, i) >= ENOUGH, 1)
        for k in range(1, MOST):
            held = held + F.get(n, i + k)
            found = found.when(held.isNotNull() if k == MOST - 1 else held >= ENOUGH, k + 1)
        return found

    def selected(x):
        line = lambda k: F.when(x["size"] > k, F.struct(F.get(h, x["i"] + k).alias("h"), (-(x["i"] + k)).alias("at")))
        return -F.least(*[line(k) for k in range(MOST)])["at"]

    sized = F.filter(F.transform(positions(F.size(h)), lambda i: F.struct(i.alias("i"), size(i).cast("int").alias("size"))), lambda x: x["size"].isNotNull())
    return F.transform(sized, lambda x: F.struct(x["i"].alias("i"), x["size"].alias("size"), selected(x).alias("at")))


def _matches(lines: DataFrame, work: Work) -> DataFrame:
    """doc_id, text_hash, lo, hi: the lines of later runs, from lo to hi."""
    h, ext = F.col("h"), MOST - 1
    chosen = F.array_sort(F.array_distinct(F.transform(windows(h, F.col("n")), lambda x: x["at"])))
    marks = lines.select("rid", F.inline(F.transform(chosen, lambda at: F.struct(F.get(h, at).alias("mark"), at.alias("at")))))
    marks = work.write(marks)
    again = work.write(marks.groupBy("mark").agg(F.count("*").alias("times")).where("times > 1"))
    found = lookup(marks, again, "mark", "times", marks.count()).groupBy("rid").agg(F.collect_set("at").alias("found"))
    # The windows of fingerprints that recur, with the lines beside them.
    near = lines.join(found, "rid").select("doc_id", "text_hash", "h", F.filter(windows(h, F.col("n")), lambda x: F.array_contains("found", x["at"])).alias("w"))
    whole = lambda x: F.xxhash64(*[F.when(x["size"] > k, F.get(h, x["i"] + k)) for k in range(MOST)])
    left = lambda x: F.array(*[F.when(x["i"] > k, F.get(h, x["i"] - 1 - k)) for k in range(ext)])
    right = lambda x: F.array(*[F.get(h, x["i"] + x["size"] + k) for k in range(ext)])
    row = lambda x: F.struct(whole(x).alias("whole"), x["i"].alias("i"), x["size"].alias("size"), left(x).alias("left"), right(x).alias("right"))
    near = work.write(near.select("doc_id", "text_hash", F.inline(F.transform("w", row))))
    place = F.struct("doc_id", "text_hash", "i", "left", "right")
    first = work.write(near.groupBy("whole").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1"))
    later = lookup(near, first, "whole", "times", near.count())
    at = lambda c: F.col(f"first.{c}")
    same = F.col("doc_id").eqNullSafe(at("doc_id")) & (F.col("text_hash") == at("text_hash")) & (F.col("i") == at("i"))

    def longer(side):  # lines that are equal on a side, up to the first that isn't
        n = F.lit(0)
        for k in reversed(range(ext)):
            n = F.when(F.get(F.col(side), F.lit(k)) == F.get(at(side), F.lit(k)), 1 + n).otherwise(0)
        return n

    return later.where(~same).select("doc_id", "text_hash", (F.col("i") - longer("left")).alias("lo"), (F.col("i") + F.col("size") - 1 + longer("right")).alias("hi"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, removed: sorted numbers (from 0, over lines that hold a word) of the lines that later runs hold.

    Rows that repeat id and text are one document. Null and empty texts have no lines; those without a window, or whose
    windows don't recur, don't appear. An empty table gives no rows. Of equal windows the first place wins, a null id before
    all others.
    """
    work = Work(docs.sparkSession, "lines")
    found = _matches(work.write(hashed_lines(docs, key, text)), work)
    return found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("lo", "hi")), lambda x: F.sequence(x["lo"], x["hi"]))))).alias("removed"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with their text cut to the lines kept, and n_lines, n_removed; a null text stays null, of 0 lines.

    Columns of the input named n_lines or n_removed are replaced, all others stay.
    """
    found = repeated_lines(docs, key, text).select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "removed")
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text]).alias("row"), F.col(key).alias("own_id"), F.col(text).alias("text"), F.xxhash64(text).alias("own_hash"))
    df = rows.join(found, F.col("own_id").eqNullSafe(F.col("found_id")) & (F.col("own_hash") == F.col("found_hash")), "left")
    df = df.withColumn("lines", F.split("text", "\n"))
    worded = F.filter(positions(F.size("lines")), lambda j: _has_word(F.get(F.col("lines"), j)))
    df = df.withColumn("worded", F.when(F.col("removed").isNotNull(), worded))
    left = F.array_except(positions(F.size("lines")), F.transform("removed", lambda r: F.get(F.col("worded"), r)))
    cut = F.array_join(F.transform(left, lambda j: F.get(F.col("lines"), j)), "\n")
    cut = F.when(F.col("removed").isNull(), F.col("text")).otherwise(cut)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    gone = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long")
    return df.select(*[(cut if c == text else F.col("row").getField(c)).alias(c) for c in kept], n.alias("n_lines"), gone.alias("n_removed"))


def op10_winnowed_line_dedup(spark, sf_dir: str) -> DataFrame:
    df = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same rows by comparing windows whole; to the left a longer match is another window, so it need not be extended here.
#: doc_id is taken as unique, as it is in the table.
ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(range(len(ls))) AS j, unnest(ls) AS raw FROM l),
nb AS (SELECT doc_id, j, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS r, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n FROM nb WHERE s <> ''),
s4 AS (SELECT doc_id, r, s AS a, lead(s) OVER d AS b, lead(s, 2) OVER d AS c, lead(s, 3) OVER d AS e, lead(s, 4) OVER d AS f, n AS na, lead(n) OVER d AS nb FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY r)),
sized AS (SELECT *, CASE WHEN na >= 8 THEN 1 WHEN na + nb >= 8 THEN 2 WHEN c IS NOT NULL THEN 3 END AS n FROM s4),
w AS (SELECT doc_id, r, n, a, CASE WHEN n > 1 THEN b END AS b, CASE WHEN n > 2 THEN c END AS c, CASE n WHEN 1 THEN b WHEN 2 THEN c ELSE e END AS x1, CASE n WHEN 1 THEN c WHEN 2 THEN e ELSE f END AS x2 FROM sized WHERE n IS NOT NULL),
g AS (SELECT doc_id, r, n, x1, x2, row_number() OVER p AS k, first_value(x1) OVER p AS y1, first_value(x2) OVER p AS y2 FROM w WINDOW p AS (PARTITION BY n, a, b, c ORDER BY doc_id, r)),
later AS (SELECT doc_id, r, n + CASE WHEN x1 = y1 AND x2 = y2 THEN 2 WHEN x1 = y1 THEN 1 ELSE 0 END AS n FROM g WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, r + k AS r FROM later, (VALUES (0), (1), (2), (3), (4)) AS t(k) WHERE k < n),
gone_j AS (SELECT doc_id, j FROM gone JOIN r USING (doc_id, r)),
kept AS (SELECT x.doc_id, string_agg(raw, chr(10) ORDER BY x.j) AS text FROM x ANTI JOIN gone_j USING (doc_id, j) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone_j GROUP BY 1)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
