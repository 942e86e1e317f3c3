"""The rule ensemble: statistics, rules and scores against plain versions, and what it may learn from."""

import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import rules as R

SCHEMA = "doc_id long, text string, lang string"


def corpus(n=300):
    """Prose is good; shouting, symbols and repeats are bad."""
    r = random.Random(4)
    prose = lambda k: " ".join(r.choice(["the", "river", "of", "stone", "and", "old", "tower", "was", "seen", "in", "spring."]) + r.choice(["", "", "s"]) for _ in range(k))
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        text = prose(r.randint(30, 90))
        if not good:
            kind = r.randrange(3)
            text = text.upper().replace(" ", "!! ") if kind == 0 else text.replace(" ", "### ") if kind == 1 else "again " * 60
        docs.append((i, text, "en"))
        labels.append((i, int(good), 0))
    docs += [(1000, None, None), (1001, "", "en"), (1002, " \n", "en"), (1003, "long text. " * 60_000, "en"), (None, "no id here", "en"), docs[5], docs[5]]
    return docs, labels


@pytest.fixture(scope="module")
def made(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, SCHEMA).repartition(3).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda a, b: a / b if b else 0.0
    return {
        "words": len(w), "lines": len(lines), "word_length": share(len("".join(w)), len(w)), "line_words": share(len(w), len(lines)),
        "distinct_words": share(len(set(w)), len(w)), "words_again": share(sum(a == b for a, b in zip(w, w[1:])), len(w)),
        "capital_words": share(sum(len(x) > 1 and x == x.upper() != x.lower() for x in w), len(w)), "bare_words": share(sum(x.upper() == x.lower() for x in w), len(w)),
        "digits": share(len(re.findall("[0-9]", text)), len(text)), "sentence_words": share(len(w), len(re.findall("[.!?]", text))),
    }


def test_statistics(spark):
    texts = [None, "", " \t\n", "One TWO two two. 3 4!\n\n- x", "Ünï ÇÖDÉ çödé é", "a b " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for row in R.statistics(df).collect():
        for name, value in plain(texts[row.key]).items():
            assert math.isclose(row[name], value, abs_tol=1e-12), (row.key, name)


def test_scores_are_those_of_the_rules(spark, made):
    """The compiled expression equals a sum over rules in plain Python; rules are conjunctions of at most depth * 2 bounds."""
    docs, labels = made
    stats = R.statistics(docs.where("doc_id is not null"))
    e = R.fit(stats, labels.select(F.col("doc_id").alias("key"), F.col("quality").alias("label")))
    assert e.weights and all(1 <= len(r) <= 3 for r in e.weights)
    for row in stats.withColumn("score", e.column()).collect():
        odds = e.base + sum(w for rule, w in e.weights.items() if all((row[b.statistic] > b.at) == b.above for b in rule))
        assert math.isclose(row.score, 1 / (1 + math.exp(-odds)), rel_tol=1e-9)


def test_rules_are_paths():
    b = R.Bound
    path = [b("words", True, 3.0), b("lines", False, 9.0), b("words", True, 5.0), b("lines", False, 7.0)]
    assert R._rule(path) == (b("lines", False, 7.0), b("words", True, 5.0))


def put(spark, tmp_path, docs, labels):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return R.op12_rule_ensemble_quality(spark, str(tmp_path))


def test_query(spark, made, tmp_path):
    """Held-out accuracy; labels of the held-out fold and other columns teach nothing; copies score alike."""
    docs, labels = made
    rows = put(spark, tmp_path / "a", docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1 and sum(r.doc_id == 5 for r in rows) == 3
    other = labels.withColumn("quality", F.when(R.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    odd = docs.withColumn("lang", F.lit("zz")).withColumn("n_words", F.lit("x")).withColumn("key", F.lit(1)).withColumn("label", F.lit(0))
    again = put(spark, tmp_path / "b", odd, other.withColumn("text", F.lit("x"))).collect()
    same = lambda x: sorted(((r.doc_id or -1), round(r.score, 9)) for r in x)
    assert same(rows) == same(again)


def test_few_labels(spark, made, tmp_path):
    docs, labels = made
    assert {r.score for r in put(spark, tmp_path / "a", docs.limit(20), labels.where("false")).collect()} == {0.5}
    ones = labels.where("quality = 1 and doc_id < 30")
    n = ones.where(~R.held_out(F.col("doc_id"))).count()
    got = {r.score for r in put(spark, tmp_path / "b", docs, ones).collect()}
    assert len(got) == 1 and math.isclose(got.pop(), (n + 1) / (n + 2), abs_tol=0.02)
    assert put(spark, tmp_path / "c", docs.where("false"), labels).collect() == []
