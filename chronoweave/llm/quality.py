"""Quality rules: a threshold table compiled into one chain of Spark projections, with no shuffle and no user function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import free, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it with as was on are be this by at from or an not have has but they which you "  # en
    "de la le les et des en un une du est que qui dans pour par sur au aux avec ne pas ce se sont plus "  # fr
    "der die das und zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "  # de
    "el los las y del se por con no una su para al lo como más o pero sus le ha me sin sobre"  # es
).split()

#: Rule, measure, least and greatest value that passes (None: open).
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("length", "n_words", 20, None),
    ("repeated_words", "100 * n_repeat_words / n_words", None, 30),
    ("word_length", "word_chars / n_words", 1.5, 20),
    ("symbols", "n_symbols / n_words", None, 0.5),
    ("stop_words", "n_stop_words / n_words", 0.01, None),
    ("duplicate_lines", "n_dup_lines / n_lines", None, 0.5),
    ("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.5),
    ("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the rules read. A null or empty text has counts of zero.

    Columns of the input stay, but for those of the same name as a measure, which are replaced.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [c for c in docs.columns if c.lower() not in MEASURES]
    own = free(docs.columns)
    col = lambda c: F.col(own + c)
    some = lambda line: line.rlike("[^\\x20\\x09-\\x0D]")
    df = docs.select(*[F.col(f"`{c}`") for c in kept], words(F.col(f"`{text}`")).alias(own + "w"), F.filter(F.split(t, "\n"), some).alias(own + "l"), t.alias(own + "t"))
    w, lines, n = col("w"), col("l"), F.size(col("w"))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(col("t"), F.lit(f"[{SYMBOLS}]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike("^\\s*[-*•‣▪]"))),
    }
    fours = F.when(n >= WINDOW, F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3))))
    df = df.withColumns({own + "h": fours} | {own + c: x.cast("long") for c, x in counts.items()}).drop(own + "w", own + "l", own + "t")
    # The hash of eight words is that of two hashes of four. Two equal windows hold five equal pairs of these: fewer, and none need be formed.
    h = col("h")
    eights = F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 4))), 1, F.size(h) - (WINDOW - 1))
    df = df.withColumn(own + "g", F.when(F.size(h) - F.size(F.array_distinct(h)) >= WINDOW - 3, eights)).drop(own + "h")
    # Sorting (hash, position) pairs puts equal windows side by side; most texts have none and skip this.
    g = col("g")
    pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(own + "p", F.when(F.size(F.array_distinct(g)) < F.size(g), pairs)).drop(own + "g")
    p = col("p")
    same = lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"])
    at = F.sort_array(F.transform(F.filter(p, lambda x, i: F.coalesce(same(x, i), F.get(p, i - 1)["h"] == x["h"], F.get(p, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
    covered = F.aggregate(at, start, step, lambda a: a["n"])
    n_repeat = F.when(p.isNull(), F.lit(0)).otherwise(covered).cast("long")
    # A generator of one row ends the chain: a filter on a measure stays above it instead of repeating every projection.
    held = F.array(F.struct(*[col(c).alias(c) for c in counts], n_repeat.alias("n_repeat_words")))
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline(held))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_ellipsis_lines", "n_bullet_lines", "n_repeat_words")


def verdict(rules=RULES) -> Column:
    """True if every rule passes; a ratio over zero words or lines passes."""
    ok = F.lit(True)
    for _, measure, least, most in rules:
        value = F.expr(_safe(measure))
        for bound in ([value >= least] if least is not None else []) + ([value <= most] if most is not None else []):
            ok = ok & F.coalesce(bound, F.lit(True))
    return ok


def _safe(measure: str) -> str:
    top, _, under = measure.partition(" / ")
    return f"try_divide({top}, {under})" if under else top


def quality_rules(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Measures, `base_failed` and `kept` of every row.

    base_failed: under 20 words, or over 30 % of them in repeated 8-word windows. Null and empty texts fail. Rows are judged
    one by one, so repeated rows get the same measures and an empty table gives no rows. A value that equals a bound passes.
    """
    df = measures(docs.drop(*[c for c in docs.columns if c.lower() in ("base_failed", "kept") and c != text]), text)
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = quality_rules(docs)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass, with their columns as they were."""
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"))
    return quality_rules(held).where("kept").select(*[F.col("row").getField(c).alias(c) for c in names])


#: The same rows by comparing windows whole.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(len(w) - 7)) AS i, unnest(list_transform(range(len(w) - 7), lambda i: array_to_string(w[i + 1:i + 8], ' '))) AS s FROM d WHERE len(w) >= 8),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(8)) AS k) GROUP BY 1),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
  len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in dict.fromkeys(STOP_WORDS))}], x)))::BIGINT AS n_stop_words,
  len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis, len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•‣▪]'))) AS n_bullet
  FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_stop_words,
  NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 20 AND n_symbols / n_words <= 0.5 AND n_stop_words / n_words >= 0.01
  AND n_dup_lines / n_lines <= 0.5 AND n_ellipsis / n_lines <= 0.5 AND n_bullet / n_lines <= 0.9 AS kept FROM b
"""
