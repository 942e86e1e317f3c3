"""Personal data, and information-theoretic sanitisation of what gives it away.

Base spans come from four patterns and their checks. Around each, the corpus shows which terms keep company with which
protected entity: a term that, over all distinct texts, mostly occurs near one entity, and there so often that chance can't
explain it among all the pairs of the corpus, discloses it. Entities are the values themselves and what recurs where values
don't: mail domains and names, networks, card issuers, number prefixes and keys as a class. Keys also disclose themselves, by
as much as their own information content over the corpus says. Terms past the threshold are generalised, and past a higher
one removed, wherever they occur.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import Work, only, table, words


@dataclass(frozen=True)
class Thresholds:
    #: Code points on each side of a value in which whole words count as its company.
    reach: int = 64
    #: Disclosure: least share of a term's texts in which it keeps the entity's company, P(entity | term).
    share: float = 0.5
    #: Share from which a term is removed instead of generalised.
    remove_share: float = 0.9
    #: Least bits of information that a term gives of an entity, and that a key has of itself.
    bits: float = 3.0
    key_bits: float = 6.0
    #: False terms to be expected if terms fell near values by chance alone; with the number of pairs that the corpus
    #: holds this sets how improbable a pair's count must be.
    false_terms: float = 0.01
    #: Terms up to which a set of their hashes travels with the tasks (8 bytes each); beyond it a join takes their place.
    most_in_set: int = 100_000


#: The patterns as given, but for possessive runs and \G or a look-behind where a match can only start: the same matches
#: in linear time and without deep recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Runs of letters and digits, many of both: keys and tokens.
KEY = r"(?:\G|(?<![A-Za-z0-9+_]))[A-Za-z0-9+_]{20,}+"
EDGE = ".,;:!?\"'()[]{}<>|«»¡¿…"
_SPAN = "array<struct<s:int,e:int,v:string>>"


#: Matches of a text that are placed together; see matches.
BLOCK = 64


#: The kinds of protected values: those of the base, and keys.
ALL = ("email", "ip", "card", "phone", "secret")


def matches(text: Column, pattern: Column) -> Column:
    """Matches, leftmost and not overlapping, as (s, e, v): code points from and to, and the match itself.

    Places are sums over what comes before. They are taken in blocks, so that no array grows by one element at a time for
    long: a text of n matches costs about n * BLOCK / 2 + (n / BLOCK)^2 / 2 copies.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    all_of = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def cut(both):
        n = F.floor((F.size(both) - 1) / BLOCK).cast("int")
        return F.transform(F.when(F.size(both) > 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>")), lambda b: F.slice(both, b * BLOCK + 1, BLOCK))

    def length(block):
        return F.aggregate(block, F.lit(0), lambda a, x: a + x["g"] + F.length(x["m"]))

    def put(a, block):
        return F.struct((a["at"] + length(block)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def step(a, x):
        s = a["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("v")))).alias("out"))

    def place(blocks):
        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), put, lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda block, s: F.aggregate(block, F.struct(s.alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda a: a["out"])))

    return _let(_let(all_of, cut), place)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _ip_ok(x: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(x, "\\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))


#: Kind, pattern, check of a match, and a cheap test that a text can hold one at all.
KINDS = (
    ("email", EMAIL, lambda v: F.lit(True), lambda t: t.contains("@")),
    ("ip", IP, _ip_ok, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    ("card", CARD, lambda v: F.length(_digits(v)).between(16, 19) & F.call_function("luhn_check", _digits(v)), lambda t: t.rlike(r"(?:[0-9][\x20-]?){15}[0-9]")),
    ("phone", PHONE, lambda v: F.length(_digits(v)).between(8, 15), lambda t: t.rlike(r"\+[0-9]")),
)


def _is_key(v: Column) -> Column:
    return (F.length(_digits(v)) >= 4) & (F.length(F.regexp_replace(v, "[^A-Za-z]", "")) >= 4)


def base_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, text, and arrays of spans: email, ip, card, phone, and secret for what may be a key. A null text is empty."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.select(F.col(f"`{key}`").alias("doc_id"), t.alias("text"))
    none = F.array().cast(_SPAN)
    kinds = (*KINDS, ("secret", KEY, _is_key, lambda t: t.rlike("[A-Za-z0-9+_]{20}")))
    return df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", *[F.when(may(F.col("text")), F.filter(matches(F.col("text"), F.lit(rx)), _checked(check))).otherwise(none).alias(kind) for kind, rx, check, may in kinds])


def _checked(check):
    return lambda x: check(x["v"])


def _terms(found: Column) -> Column:
    """Words that hold a letter or digit, without their edge punctuation."""
    stripped = F.transform(found, lambda w: F.btrim(w, F.lit(EDGE)))
    return F.filter(F.array_distinct(stripped), lambda w: w.rlike("[\\p{L}\\p{N}]"))


def entities(kind: Column, value: Column) -> Column:
    """What a value stands for, as (what, of) with its kind: the value, and the parts that values share."""
    entity = lambda what, of: F.struct(F.lit(what).alias("what"), of.alias("of"))
    domain, digits = F.lower(F.substring_index(value, "@", -1)), _digits(value)
    parts = {
        "email": [("name", F.substring_index(value, "@", 1)), ("domain", domain), ("site", F.substring_index(domain, ".", -2))],
        "ip": [("network", F.concat(F.substring_index(value, ".", n), F.lit("."))) for n in (1, 2, 3)],
        "card": [("issuer", F.substring(digits, 1, 6))],
        "phone": [("prefix", F.substring(digits, 1, n)) for n in range(1, 8)],
    }
    own = F.array(entity("key", F.lit("")))
    for k, found in parts.items():
        own = F.when(kind == k, F.array(*[entity(*x) for x in found])).otherwise(own)
    return F.concat(F.array(entity("value", value)), own)


def company(spans: DataFrame, th: Thresholds) -> DataFrame:
    """(text_hash, entity, term): terms near each protected entity, once for each distinct text."""
    r = th.reach

    def beside(kind):
        def near(x):
            s, e = x["s"], x["e"]
            left = F.substring(F.col("text"), F.greatest(s - r, F.lit(0)) + 1, F.least(s, F.lit(r)))
            right = F.substring(F.col("text"), e + 1, F.lit(r))
            # Words cut by the reach don't count.
            left = F.when(s > r, F.regexp_replace(left, "^[^\\x20\\x09-\\x0D]*", "")).otherwise(left)
            right = F.when(F.length(right) == r, F.regexp_replace(right, "[^\\x20\\x09-\\x0D]*+$", "")).otherwise(right)
            return F.struct(F.lit(kind).alias("k"), x["v"].alias("v"), F.concat_ws(" ", left, right).alias("near"))

        return near

    df = spans.select("text_hash", F.inline(F.concat(*[F.transform(F.col(k), beside(k)) for k in ALL])))
    df = df.select("text_hash", "k", F.explode(entities(F.col("k"), F.col("v"))).alias("of"), _terms(words(F.col("near"))).alias("terms"))
    return df.select("text_hash", F.xxhash64("k", "of.what", "of.of").alias("entity"), F.explode("terms").alias("term")).distinct()


def surprise(both: Column, by_chance: Column) -> Column:
    """Bits of -log2 of Chernoff's bound on the chance of so many texts or more, where so few are expected by chance."""
    more = both * F.ln(both / by_chance) - (both - by_chance)
    return F.when(both > by_chance, more / math.log(2)).otherwise(0.0)


def disclosing(rows: DataFrame, total: int, private: DataFrame, work: Work, th: Thresholds) -> tuple[DataFrame, DataFrame]:
    """(term, bits, share) past the thresholds, and (doc_id, text_hash, text, terms) of the texts that hold candidates.

    rows: doc_id, text_hash, text of the corpus; total: N, its distinct texts; private: the distinct texts with protected values.
    n(term) runs over all distinct texts of the corpus, not only those with protected values; n(entity) and n(entity, term)
    are texts in which the entity is, and in which the term is near it. With c = n(entity) n(term) / N texts by chance,
    bits = log2(n(entity, term) / c), and the surprise must reach log2(pairs / false_terms), pairs all those of the corpus.
    """
    pairs = work.write(company(private, th))
    counted = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    counted = work.write(counted)
    needed = math.log2(max(counted.count(), 1) / th.false_terms)
    # A pair of one text can't surprise enough: even alone it is log2(N) bits, fewer than the pairs of a corpus need.
    both = counted.where("n_both > 1") if math.log2(max(total, 2)) < needed else counted
    # A term near several entities of a sort can't reveal one: its texts near any value bound n(term) from below, before the corpus is read.
    near_any = pairs.select("text_hash", "term").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    entity = pairs.select("text_hash", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    both = both.join(near_any, "term").join(entity, "entity").where(F.col("n_both") >= th.share * F.col("n_near"))
    n = F.lit(float(max(total, 1)))
    # So does it bound the surprise from above.
    both = work.write(both.where(surprise(F.col("n_both").cast("double"), F.col("n_entity") * F.col("n_near") / n) >= needed).drop("n_near"))
    some = both.select("term").distinct()
    count = some.count()
    held = rows.select("doc_id", "text_hash", "text", _terms(words(F.col("text"))).alias("terms"))
    if count <= th.most_in_set:
        hashes = [r[0] for r in some.select(F.xxhash64("term")).limit(th.most_in_set).collect()]
        inside = F.expr(f"filter(terms, x -> xxhash64(x) IN ({', '.join(f'{h}L' for h in hashes) or 'NULL'}))")
        held = only(held.withColumn("terms", inside), F.size("terms") > 0)
    else:
        hits = held.select("doc_id", "text_hash", F.explode("terms").alias("term")).join(some, "term").groupBy("doc_id", "text_hash").agg(F.collect_set("term").alias("terms"))
        held = rows.join(hits.withColumnRenamed("doc_id", "_id"), ["text_hash"]).where(F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    held = work.write(held)
    term = held.select("text_hash", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    chance = F.col("n_entity") * F.col("n_term") / n
    df = both.join(term, "term").withColumns({"bits": F.log2(F.col("n_both") / chance), "share": F.col("n_both") / F.col("n_term"), "surprise": surprise(F.col("n_both").cast("double"), chance)})
    df = df.where((F.col("share") >= th.share) & (F.col("bits") >= th.bits) & (F.col("surprise") >= needed))
    return work.write(df.groupBy("term").agg(F.max("bits").alias("bits"), F.max("share").alias("share"))), held


def term_spans(rows: DataFrame, total: int, private: DataFrame, work: Work, th: Thresholds) -> DataFrame:
    """doc_id, text_hash, term: spans (s, e, bits, share) of disclosing terms, in order."""
    terms, held = disclosing(rows, total, private, work, th)
    df = held.select("doc_id", "text_hash", "text", F.explode("terms").alias("term")).join(terms, "term")
    edge = "[" + "".join("\\" + c if c in "[]\\^-" else c for c in EDGE) + "\\x20\\x09-\\x0D]"
    rx = F.concat(F.lit(f"(?<=^|{edge})\\Q"), F.col("term"), F.lit(f"\\E(?=$|{edge})"))
    spans_of = F.transform(matches(F.col("text"), rx), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    df = df.select("doc_id", "text_hash", "bits", "share", F.explode(spans_of).alias("x")).distinct()
    return df.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("x.s", "x.e", "bits", "share"))).alias("term"))


def secrets(base: DataFrame, total: int, th: Thresholds) -> DataFrame:
    """value_hash, bits of the keys that hold enough: what a key tells of itself is its information content log2(N / n), n its distinct texts."""
    each = base.where(F.size("secret") > 0).select("text_hash", F.explode(F.transform("secret", lambda x: F.xxhash64(x["v"]))).alias("value_hash")).distinct()
    n = each.groupBy("value_hash").agg(F.count("*").alias("n"))
    return n.select("value_hash", F.log2(F.lit(float(max(total, 1))) / F.col("n")).alias("bits")).where(F.col("bits") >= th.key_bits)


def find(docs: DataFrame, th: Thresholds = Thresholds(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, the four base arrays, `secret` and `term` for every row.

    Rows that repeat id and text have the same spans. An empty table gives no rows; without any base span there are no
    protected values and so no term spans. Spans of secrets and terms that touch a base span are left out, and terms
    that touch a secret. Columns of the input other than key and text are left out.
    """
    work = Work(docs.sparkSession, "pii")
    spans = base_spans(docs, key, text)
    base = work.write(spans.drop("text"))
    total = base.select("text_hash").distinct().count()
    rows = spans.select("doc_id", "text_hash", "text")
    private = work.write(only(spans.drop("doc_id"), F.expr(" + ".join(f"size({k})" for k in ALL)) > 0).dropDuplicates(["text_hash"]))
    terms = term_spans(rows, total, private, work, th)
    known = work.write(secrets(base, total, th))
    keys = base.where(F.size("secret") > 0).select("doc_id", "text_hash", F.explode("secret").alias("x")).withColumn("value_hash", F.xxhash64("x.v")).join(known, "value_hash")
    keys = keys.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("x.s", "x.e", "bits"))).alias("secret"))
    found = terms.withColumn("secret", F.lit(None).cast("array<struct<s:int,e:int,bits:double>>")).unionByName(keys.withColumn("term", F.lit(None).cast("array<struct<s:int,e:int,bits:double,share:double>>")))
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max("term").alias("term"), F.max("secret").alias("secret"))
    df = base.drop("secret").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").drop("_id", "_hash")
    inside = F.concat(*[F.transform(F.col(k), lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))) for k, *_ in KINDS])
    apart = lambda of: lambda t: ~F.exists(of, lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"]))
    df = df.withColumn("secret", F.coalesce(F.filter("secret", apart(inside)), F.array().cast("array<struct<s:int,e:int,bits:double>>")))
    taken = F.concat(inside, F.transform("secret", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))))
    return df.withColumn("term", F.coalesce(F.filter("term", apart(taken)), F.array().cast("array<struct<s:int,e:int,bits:double,share:double>>")))


def sanitise(docs: DataFrame, th: Thresholds = Thresholds(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with base spans replaced by <kind>, keys by <secret>, disclosing terms by <term>, and those of the greatest share removed."""
    kinds = list(ALL)
    found = find(docs, th, key, text).select(F.col("doc_id").alias("_id"), "text_hash", *kinds, "term").dropDuplicates(["_id", "text_hash"])
    names = docs.columns
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{key}`").alias("own_id"), F.col(f"`{text}`").alias("own_text"))
    df = docs.join(found, F.col("own_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col("own_text"), F.lit(""))) == F.col("text_hash")))
    put = lambda k: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{k}>").alias("r"))
    term = F.transform("term", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["share"] >= th.remove_share, "").otherwise("<term>").alias("r")))
    cuts = F.sort_array(F.concat(*[F.transform(F.col(k), put(k)) for k in kinds], term))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, x):  # of overlapping spans the first is replaced and the rest of the later cut away
        kept = F.substring(F.col("own_text"), a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], kept, F.when(x["s"] >= a["at"], x["r"]).otherwise("")).alias("out"))

    clean = F.aggregate(cuts, start, step, lambda a: F.concat(a["out"], F.substring(F.col("own_text"), a["at"] + 1, F.length("own_text"))))
    return df.select(*[(clean if c == text else F.col("row").getField(c)).alias(c) for c in names])


def op6_information_theoretic_pii(spark, sf_dir: str) -> DataFrame:
    df = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda kind: F.transform(F.col(kind), _named(kind))
    kinds = [k for k, *_ in KINDS]
    base = F.concat(*[line(k) for k in kinds])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in kinds]
    return df.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, line("secret"), line("term")), ",").alias("spans"), F.size("secret").cast("long").alias("n_secret"), F.size("term").cast("long").alias("n_term"))


def _named(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))
