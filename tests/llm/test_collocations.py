"""Collocations against counts of whole phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def plain(table, least, top, share=80):
    """Rows of the operator by counting every phrase as a string."""
    counts, n = Counter(), Counter()
    for _, text, lang in table:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    rows = {}
    for (lang, p), a in found.items():
        inside = [b for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if all(100 * b < share * a for b in inside):
            cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for lang, found in rows.items() for i, r in enumerate(sorted(found)[:top]))


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["The", "the", "old", "oak", "Éclair", "éclair", "of", "a", "x\x00y", "sea-side", "\u2028", "mill"]
    phrases = ["New York City Hall", "in spite of it", "ha ha ha ha ha", "left\tright"]
    out = [(0, None, "en"), (1, "", "en"), (2, " \t ", None), (3, "one.", "en"), (4, "ha " * 5000, "fr"), (5, "a b c " * 700 + "\n" + "a b", None)]
    for i in range(n):
        text = "".join(r.choice(phrases if r.random() < 0.3 else words) + r.choice([" ", " ", " ", "  ", ". ", ",", "\n", "\x0b", "!? "]) for _ in range(r.randint(1, 150)))
        out.append((10 + i, text, r.choice(["en", "fr", None, "und"])))
    return out + out[6:9]


def frame(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("sizes", [C.Sizes(), C.Sizes(shard=50, vocabulary=5, bits=64, group=7)])
def test_equals_plain_counts(spark, sizes):
    """Also over many small shards, small groups, many vocabularies and tables of bits that are full."""
    table = corpus(1)
    docs = spark.createDataFrame(table, SCHEMA).repartition(3)
    got = frame(C.collocations(docs, least=5, top=20, sizes=sizes))
    assert got == plain(table, 5, 20) and len(got) > 40


def test_empty_and_clashing(spark):
    table = corpus(2, 20)
    docs = spark.createDataFrame(table, SCHEMA)
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(docs.where("doc_id < 3")).collect() == []
    for c in ("p", "f", "code", "word", "n", "kind", "phrase", "rank", "a.b"):
        docs = docs.withColumn(c, F.lit("x"))
    assert frame(C.collocations(docs, least=10)) == plain(table, 10, 2000)


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    df = spark.createDataFrame([(10**14, 10**14 + 1, 10**14 + 7)], "a long, l long, r long")
    got = df.select(F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")).first()[0]
    assert got == 2_000_000 * 10**14 // (2 * 10**14 + 8)


def test_shift_carries_over_blocks():
    places = np.array([0, 1] * 40 + [-1] + [1, 0], np.int32)
    words = C.index(places, np.array([True, True]))
    marks, old, word, n = C._grown(C.Marks(words.word, words.block, words.mask), words, 100)
    assert dict(zip(zip(old.tolist(), word.tolist()), n.tolist())) == {(0, 1): 40, (1, 0): 40}
