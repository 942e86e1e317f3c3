"""Queries over vectors, generated boxes, tables of outcomes and reports, each with SQL where SQL can express it."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.config import Tracking
from chronoweave.functions import numeric as nu
from chronoweave.operators import entity as en
from chronoweave.operators import fragments as fg
from chronoweave.operators import frames as fr
from chronoweave.operators import gates as gt
from chronoweave.operators import matching as mt
from chronoweave.operators import metrics as me
from chronoweave.operators import reid as ri
from chronoweave.operators import report as rp
from chronoweave.operators import sampling as sa
from chronoweave.operators import spectral as sp
from chronoweave.operators import vectors as ve
from chronoweave.operators import windows as wi
from chronoweave.plans import series as se
from chronoweave.plans.series import r6
from chronoweave.sources.tables import hourly, table

E = "e AS (SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS v FROM embeddings)"


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def _dims(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("mean").alias("dim", "x")).select(key, F.col("dim").cast("long").alias("dim"), r6("x").alias("x"))


def even_sample_mean(s, d):
    return _dims(ve.mean_vector(ve.even_sample(_vectors(s, d), ["label"], "vec_id", 16), ["label"], "v"), "label")


EVEN = f"""
WITH {E}, i AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM e),
p AS (SELECT * FROM i WHERE n <= 16 OR list_contains(list_transform(range(16), lambda k: floor(k * (n - 1) / 15)::BIGINT), i))
SELECT label, dim, round(avg(x), 6) + 0.0 AS x FROM (SELECT label, unnest(range(64)) AS dim, unnest(v) AS x FROM p) GROUP BY 1, 2"""


def weighted_profile(s, d):
    df = _vectors(s, d).withColumn("k", (F.col("vec_id") % 3).cast("long"))
    return _dims(ve.mean_vector(df, ["k"], "v", F.col("label") + 1), "k")


WEIGHTED = f"WITH {E} SELECT k, dim, round(sum(w * x) / sum(w), 6) + 0.0 AS x FROM (SELECT vec_id % 3 AS k, label + 1 AS w, unnest(range(64)) AS dim, unnest(v) AS x FROM e) GROUP BY 1, 2"


def _refs(s, d) -> DataFrame:
    m = ve.mean_vector(_vectors(s, d), ["label"], "v")
    return m.select(F.col("label").alias("ref"), nu.unit(F.col("mean")).alias("rv"))


REFS = f"""{E}, md AS (SELECT label AS ref, dim, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS dim, unnest(v) AS x FROM e) GROUP BY 1, 2),
ml AS (SELECT ref, list(x ORDER BY dim) AS m FROM md GROUP BY 1), refs AS (SELECT ref, list_transform(m, lambda y: y / sqrt(list_inner_product(m, m))) AS rv FROM ml),
sc AS (SELECT vec_id, label, ref, list_inner_product(v, rv) AS s FROM e, refs)"""


def nearest_centroid(s, d):
    return ve.nearest_reference(_vectors(s, d), _refs(s, d), ["vec_id"], "v", "ref", "rv").select("vec_id", "ref", r6("score").alias("score"))


NEAREST = f"WITH {REFS}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, ref) AS k FROM sc) SELECT vec_id, ref, round(s, 6) + 0.0 AS score FROM k WHERE k = 1"


def relative_score(s, d):
    df = ve.relative_score(_vectors(s, d), _refs(s, d), ["vec_id"], "label", "v", "ref", "rv")
    return df.select("vec_id", "label", r6("score").alias("score"))


RELATIVE = f"WITH {REFS} SELECT vec_id, label, round(max(CASE WHEN ref = label THEN s END) - max(CASE WHEN ref <> label THEN s END), 6) + 0.0 AS score FROM sc GROUP BY 1, 2"


def face_match(s, d):
    refs = _refs(s, d)
    df = _vectors(s, d).withColumn("v", F.when(F.col("vec_id") % 7 != 0, F.col("v")))
    return ve.accepts(df, "v", refs, "rv", 0.3).select("vec_id", r6("best").alias("best"), "match")


FACE = f"WITH {REFS}, b AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN -1.0 ELSE max(s) END AS best FROM sc GROUP BY vec_id) SELECT vec_id, round(best, 6) + 0.0 AS best, best >= 0.3 AS match FROM b"


def cluster_share_claim(s, d):
    """Shares of clusters per owner (labels even and odd), the best exclusive claim, purity, and the unclaimed."""
    near = ve.nearest_reference(_vectors(s, d).withColumn("label", F.col("label") % 2), _refs(s, d), ["vec_id", "label"], "v", "ref", "rv")
    shares = ve.cluster_shares(near, "label", "ref")
    best = mt.assign(shares, [], "label", "ref", "share")
    held = best.select(F.posexplode("plan").alias("label", "ref"))
    pure = ve.purity(shares, held.withColumn("label", F.col("label").cast("long")), "label", "ref")
    free = shares.select("ref").distinct().join(held.select("ref"), "ref", "left_anti")
    return pure.select("label", "ref", r6("purity").alias("purity")).unionByName(free.select(F.lit(None).cast("long").alias("label"), "ref", F.lit(None).cast("double").alias("purity")))


CLAIM = f"""
WITH {REFS}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, ref) AS k FROM sc), n AS (SELECT label % 2 AS label, ref FROM k WHERE k = 1),
g AS (SELECT l.label, r.ref, (SELECT count(*) FROM n WHERE n.label = l.label AND n.ref = r.ref) / (SELECT count(*) FROM n WHERE n.label = l.label) AS share FROM (SELECT DISTINCT label FROM n) l, (SELECT DISTINCT ref FROM n) r),
p AS (SELECT a.ref AS ra, b.ref AS rb FROM g a, g b WHERE a.label = 0 AND b.label = 1 AND a.ref <> b.ref ORDER BY a.share + b.share DESC, a.ref, b.ref LIMIT 1)
SELECT g.label, g.ref, round(share, 6) + 0.0 AS purity FROM g, p WHERE (label = 0 AND ref = ra) OR (label = 1 AND ref = rb)
UNION ALL SELECT NULL, ref, NULL FROM (SELECT DISTINCT ref FROM g) x, p WHERE ref NOT IN (ra, rb)"""


def enrolment(s, d):
    """Each owner's claimed cluster, its purity, and its cosine with the nearest of all other clusters, claimed or not."""
    held = cluster_share_claim(s, d).where(F.col("label").isNotNull()).join(_refs(s, d), "ref")
    near = ve.relative_score(held.withColumnRenamed("ref", "own"), _refs(s, d), ["label", "purity"], "own", "rv", "ref", "rv")
    return near.select("label", F.col("own").alias("ref"), "purity", r6(1 - F.col("score")).alias("rival"))


ENROLMENT = f"""
WITH {REFS} SELECT c.label, c.ref, c.purity, round(max(list_inner_product(a.rv, b.rv)), 6) + 0.0 AS rival
FROM ({CLAIM}) c JOIN refs a ON a.ref = c.ref JOIN refs b ON b.ref <> c.ref WHERE c.label IS NOT NULL GROUP BY 1, 2, 3"""


def content_hash(s, d):
    v = _vectors(s, d).select("vec_id", F.posexplode("v").alias("dim", "x"))
    return me.content_hash(v, ["vec_id"], "dim", "x", 4)


HASH = f"WITH {E} SELECT vec_id, sha256(string_agg(printf('%.4f', x), ',' ORDER BY dim)) AS hash FROM (SELECT vec_id, unnest(range(64)) AS dim, unnest(v) AS x FROM e) GROUP BY 1"


def assign_unequal(s, d):
    """T4-T6 with more rows than columns: of each nation the segments that fit three classes of balance best; counts tie often."""
    c = table(s, d, "customer").select("c_nationkey", "c_mktsegment", F.floor((F.col("c_acctbal") + 1000) / 4000).cast("int").alias("class"))
    every = c.select("c_mktsegment").distinct().join(c.select("class").distinct().where(F.col("class").between(0, 2)), how="cross").join(F.broadcast(table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"))), how="cross")
    n = every.join(c.groupBy("c_nationkey", "c_mktsegment", "class").agg(F.count("*").alias("n")), ["c_nationkey", "c_mktsegment", "class"], "left").fillna({"n": 0})
    m = mt.assign(n, ["c_nationkey"], "c_mktsegment", "class", "n")
    plan = F.array_join(F.transform("plan", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
    return m.select("c_nationkey", plan.alias("plan"), "total", "margin")


UNEQUAL = """
WITH c AS (SELECT c_nationkey, c_mktsegment, floor((c_acctbal + 1000) / 4000)::INT AS k FROM customer),
r AS (SELECT seg, row_number() OVER (ORDER BY seg) AS r FROM (SELECT DISTINCT c_mktsegment AS seg FROM c)), m AS (SELECT count(*) AS m FROM r),
n AS (SELECT n_nationkey AS nation, r.r, k.k, (SELECT count(*) FROM c WHERE c.c_nationkey = n_nationkey AND c.c_mktsegment = r.seg AND c.k = k.k) AS n FROM nation, r, (SELECT unnest([0, 1, 2]) AS k) AS k),
p AS (SELECT x.nation, x.r AS a, y.r AS b, z.r AS c, x.n + y.n + z.n AS total FROM n x JOIN n y USING (nation) JOIN n z USING (nation) WHERE x.k = 0 AND y.k = 1 AND z.k = 2 AND x.r <> y.r AND x.r <> z.r AND y.r <> z.r),
t AS (SELECT nation, total, array_to_string(list_transform(range(1, m + 1), lambda i: CASE i WHEN a THEN '0' WHEN b THEN '1' WHEN c THEN '2' ELSE '~' END), ',') AS plan FROM p, m),
o AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY total DESC, plan) AS k FROM t)
SELECT x.nation AS c_nationkey, replace(x.plan, '~', '-') AS plan, x.total::DOUBLE AS total, (x.total - y.total)::DOUBLE AS margin FROM o x JOIN o y USING (nation) WHERE x.k = 1 AND y.k = 2"""


def assign_vectors(s, d):
    """T4-T6 on larger matrices: the vectors of a batch, by id modulo 50, each claim a dimension of its own."""
    v = _vectors(s, d).select((F.col("vec_id") % 50).alias("batch"), "vec_id", F.posexplode("v").alias("dim", "x"))
    return mt.assign(mt.best_rows(v, ["batch"], "vec_id", "dim", "x"), ["batch"], "vec_id", "dim", "x").select("batch", F.array_join("plan", ",").alias("plan"), r6("total").alias("total"), r6("margin").alias("margin"))


def auc_rank(s, d):
    df = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    df = df.select("n_chars", F.explode(F.array(F.struct(F.lit("quality").alias("label"), F.col("quality").alias("y")), F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("y")))).alias("z"))
    return me.auc(df.select("z.label", "z.y", "n_chars"), ["label"], "y", "n_chars").select("label", r6("auc").alias("auc"))


AUC = """
WITH x AS (SELECT n_chars, quality, toxic FROM labels JOIN documents USING (doc_id)), z AS (SELECT 'quality' AS label, quality AS y, n_chars FROM x UNION ALL SELECT 'toxic', toxic, n_chars FROM x),
k AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY n_chars) + (count(*) OVER (PARTITION BY label, n_chars) - 1) / 2 AS rk FROM z)
SELECT label, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) + 0.0 AS auc FROM k GROUP BY 1"""


#: Ranges that a large group is dealt into.
PARTS = 32


def auc_long(s, d):
    """A8 over one large group: how well the price of a line tells returned lines."""
    df = table(s, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_extendedprice")
    return me.auc(df, [], "y", "l_extendedprice", PARTS).select(r6("auc").alias("auc"))


AUC_LONG = """
WITH z AS (SELECT l_returnflag = 'R' AS y, l_extendedprice AS v FROM lineitem),
k AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS rk FROM z)
SELECT round((sum(CASE WHEN y THEN rk END) - sum(y::INT) * (sum(y::INT) + 1) / 2) / (sum(y::INT) * (count(*) - sum(y::INT))), 6) + 0.0 AS auc FROM k"""


def rank_long(s, d):
    """W18 over one large group, NULLs among it."""
    o = table(s, d, "orders").withColumn("v", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")))
    return wi.rank_norm(o, [], "v", "o_orderkey", "r", PARTS).select("o_orderkey", r6("r", 9).alias("r"))


RANK_LONG = """
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS v FROM orders)
SELECT o_orderkey, CASE WHEN v IS NOT NULL THEN round((row_number() OVER (PARTITION BY v IS NULL ORDER BY v, o_orderkey) - 1) / (count(v) OVER () - 1), 9) + 0.0 END AS r FROM x"""


def quantile_long(s, d):
    """A1 by counting: of all lines as one group, and of those of each flag, levels less their quantiles."""
    x = table(s, d, "lineitem").select("l_returnflag", F.log10("l_extendedprice").alias("db"))
    one = fr.relative_level(x, [], "db", 0.95, "rel", long=True).agg(F.lit("all").alias("l_returnflag"), F.sum((F.col("rel") >= 0).cast("long")).alias("loud"), r6(F.max("rel"), 9).alias("most"))
    each = fr.relative_level(x, ["l_returnflag"], "db", 0.9, "rel", long=True)
    return one.unionByName(each.groupBy("l_returnflag").agg(F.sum((F.col("rel") >= 0).cast("long")).alias("loud"), r6(F.max("rel"), 9).alias("most")))


QUANTILE_LONG = """
WITH x AS (SELECT l_returnflag, log10(l_extendedprice) AS db FROM lineitem)
SELECT 'all' AS l_returnflag, count(*) FILTER (db >= q) AS loud, round(max(db - q), 9) + 0.0 AS most FROM x, (SELECT quantile_cont(db, 0.95) AS q FROM x)
UNION ALL SELECT x.l_returnflag, count(*) FILTER (db >= q), round(max(db - q), 9) + 0.0 FROM x JOIN (SELECT l_returnflag, quantile_cont(db, 0.9) AS q FROM x GROUP BY 1) USING (l_returnflag) GROUP BY 1"""


def weighted_draws(s, d):
    """orders drawn by their number of lines, with replacement, as often as there are customers."""
    o = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("w"))
    drawn = table(s, d, "customer").select(F.col("c_custkey").alias("draw"), sa.seeded(F.col("c_custkey"), 17).alias("u"))
    return sa.weighted_draws(o, "o_orderkey", "w", drawn, PARTS)


DRAWS = """
WITH w AS (SELECT l_orderkey AS o_orderkey, count(*) AS w FROM lineitem GROUP BY 1), s AS (SELECT o_orderkey, sum(w) OVER (ORDER BY o_orderkey) AS stop, w FROM w),
x AS (SELECT c_custkey AS draw, (c_custkey * 1103515245 + 12362) % 2147483648 AS x FROM customer),
u AS (SELECT draw, floor((x * (x % 65536 + 1) + 17) % 2147483647 / 2147483647.0::DOUBLE * (SELECT sum(w) FROM w)::DOUBLE)::BIGINT AS pos FROM x)
SELECT draw, o_orderkey FROM u JOIN s ON pos >= stop - w AND pos < stop"""


def quality_precision_recall(s, d):
    df = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    out = me.precision_recall(df, ["lang"], F.col("quality") == 1, F.col("n_chars") > 400)
    return out.select("lang", *[r6(c).alias(c) for c in ("precision", "recall", "false_positive")])


PRECISION = """
WITH x AS (SELECT lang, quality = 1 AS t, n_chars > 400 AS s FROM labels JOIN documents USING (doc_id))
SELECT lang, round(sum((t AND s)::INT) / nullif(sum(s::INT), 0), 6) + 0.0 AS precision, round(sum((t AND s)::INT) / nullif(sum(t::INT), 0), 6) + 0.0 AS recall,
  round(sum((NOT t AND s)::INT) / nullif(sum((NOT t)::INT), 0), 6) + 0.0 AS false_positive FROM x GROUP BY 1"""


def label_accuracy(s, d):
    l = table(s, d, "labels")
    out = me.label_accuracy(l.select("doc_id", F.col("quality").alias("y")), l.select("doc_id", F.col("toxic").alias("y")), ["doc_id"], "y")
    return out.select(r6("accuracy").alias("accuracy"), "n")


def si_sdr(s, d):
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("est"))
    o = table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return me.si_sdr(o, ["o_orderpriority"], "o_totalprice", "est").select("o_orderpriority", "n", r6("si_sdr", 4).alias("si_sdr"))


SI_SDR = """
WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1), x AS (SELECT o_orderpriority AS p, o_totalprice AS x, y FROM orders JOIN l ON l_orderkey = o_orderkey),
m AS (SELECT *, x - avg(x) OVER (PARTITION BY p) AS a, y - avg(y) OVER (PARTITION BY p) AS b FROM x),
q AS (SELECT p, count(*) AS n, sum(a * b) * sum(a * b) / (sum(a * a) + 1e-12) AS t, sum(b * b) AS bb FROM m GROUP BY 1)
SELECT p AS o_orderpriority, n, round(10 * log10((t + 1e-12) / (greatest(bb - t, 0) + 1e-12)), 4) + 0.0 AS si_sdr FROM q"""


def shared_gain(s, d):
    g = fr.shared_gain((table(s, d, "lineitem"), "l_discount"), (table(s, d, "orders"), "o_totalprice"))
    return g.select(r6("peak").alias("peak"), F.round("gain", 12).alias("gain"))


GAIN = "WITH p AS (SELECT greatest((SELECT max(abs(l_discount)) FROM lineitem), (SELECT max(abs(o_totalprice)) FROM orders)) AS peak) SELECT round(peak, 6) + 0.0 AS peak, round(CASE WHEN peak > 0.999 THEN 0.999 / peak ELSE 1 END, 12) AS gain FROM p"


def rank_norm(s, d):
    c = table(s, d, "customer").withColumn("v", F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")))
    return wi.rank_norm(c, ["c_mktsegment"], "v", "c_custkey", "r").select("c_custkey", r6("r", 9).alias("r"))


RANK = """
WITH x AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS v FROM customer)
SELECT c_custkey, CASE WHEN v IS NOT NULL AND count(v) OVER (PARTITION BY c_mktsegment) > 1
  THEN round((row_number() OVER (PARTITION BY c_mktsegment, v IS NULL ORDER BY v, c_custkey) - 1) / (count(v) OVER (PARTITION BY c_mktsegment) - 1), 9) + 0.0 END AS r FROM x"""


def bootstrap_ci(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("g"), "n_chars")
    draw = lambda rep, k, n: (rep * 7919 + k * 104729 + 12345) * 1103 % 2147483647 % n
    return me.bootstrap_difference(rows, "g", "n_chars", 2000, draw, PARTS).select(r6("low", 4).alias("low"), r6("high", 4).alias("high"))


BOOTSTRAP = """
WITH x AS (SELECT doc_id, quality = 1 AS g, n_chars, row_number() OVER (PARTITION BY quality = 1 ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY quality = 1) AS n FROM labels JOIN documents USING (doc_id)),
d AS (SELECT rep, g, ((rep * 7919 + i * 104729 + 12345) * 1103 % 2147483647) % n AS i FROM x, (SELECT unnest(range(2000)) AS rep)),
m AS (SELECT rep, avg(CASE WHEN x.g THEN n_chars END) - avg(CASE WHEN NOT x.g THEN n_chars END) AS v FROM d JOIN x ON x.g = d.g AND x.i = d.i GROUP BY 1)
SELECT round(quantile_cont(v, 0.025), 4) + 0.0 AS low, round(quantile_cont(v, 0.975), 4) + 0.0 AS high FROM m"""


def json_null_safe(s, d):
    ev = table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"), "value")
    ev = ev.select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("k")).alias("k"), F.col("event_id").alias("id"))
    return ev.select("event_id", rp.json_safe(ev, ["id", "k"]).alias("json"))


JSON = """SELECT event_id, '{"id":' || event_id || ',"k":' || CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'null' ELSE printf('%.1f', (props->>'$.k')::DOUBLE) END || '}' AS json FROM events"""


def box_iou_pairs(s, d):
    """The boxes that the first numbers of a vector make, each against the next of its label."""
    at = lambda i: F.get("v", F.lit(i))
    box = F.struct(at(0).alias("x"), at(1).alias("y"), (F.abs(at(2)) + 0.1).alias("w"), (F.abs(at(3)) + 0.1).alias("h"))
    w = Window.partitionBy("label").orderBy("vec_id")
    boxes = _vectors(s, d).withColumn("b", box).withColumns({"j": F.lead("vec_id").over(w), "c": F.lead("b").over(w)})
    return boxes.where("j is not null").select(F.col("vec_id").alias("i"), "j", r6(nu.iou(F.col("b"), F.col("c"))).alias("iou"))


IOU = f"""
WITH {E}, b AS (SELECT vec_id, label, v[1] AS x, v[2] AS y, abs(v[3]) + 0.1 AS w, abs(v[4]) + 0.1 AS h FROM e),
n AS (SELECT *, lead(vec_id) OVER k AS j, lead(x) OVER k AS x2, lead(y) OVER k AS y2, lead(w) OVER k AS w2, lead(h) OVER k AS h2 FROM b WINDOW k AS (PARTITION BY label ORDER BY vec_id)),
p AS (SELECT vec_id, j, w * h + w2 * h2 AS s, greatest(0, least(x + w, x2 + w2) - greatest(x, x2)) AS dx, greatest(0, least(y + h, y2 + h2) - greatest(y, y2)) AS dy FROM n WHERE j IS NOT NULL)
SELECT vec_id AS i, j, round(dx * dy / (s - dx * dy + 1e-12), 6) + 0.0 AS iou FROM p"""


def shoelace_area(s, d):
    """The polygon of the first eight points of a vector."""
    ring = F.array(*[F.struct(F.get("v", F.lit(2 * k)).alias("x"), F.get("v", F.lit(2 * k + 1)).alias("y")) for k in range(8)])
    return _vectors(s, d).select("vec_id", r6(nu.polygon_area(ring)).alias("area"))


SHOELACE = f"WITH {E} SELECT vec_id, round(abs({' + '.join(f'v[{2 * k + 1}] * v[{2 * ((k + 1) % 8) + 2}] - v[{2 * ((k + 1) % 8) + 1}] * v[{2 * k + 2}]' for k in range(8))}) / 2, 6) + 0.0 AS area FROM e"


def drift_deadband(s, d):
    """Of each event the correction against its distance from 50."""
    x = (F.col("value") - 50) / 100.0
    return table(s, d, "events").select("event_id", r6(nu.deadband(x, 0.5, 0.1, 0.05)).alias("fix"))


DRIFT = """
SELECT event_id, CASE WHEN abs(x) <= 0.05 THEN 0.0 ELSE round(greatest(-0.1, least(0.1, -0.5 * (x - sign(x) * 0.05))), 6) + 0.0 END AS fix
FROM (SELECT event_id, (value - 50) / 100.0 AS x FROM events)"""


def spans_mask(s, d):
    """The spans of a customer's orders, written as text by face and read from it again."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("clip"), (F.col("o_orderkey") % 3).alias("face"), (F.floor(F.col("o_orderkey") / 3) % 100).alias("start"))
    span = F.concat(F.col("start").cast("string"), F.lit("-"), (F.col("start") + 1.5).cast("string"))
    each = o.groupBy("clip", "face").agg(F.concat(F.col("face").cast("string"), F.lit(":"), F.array_join(F.sort_array(F.collect_list(span)), ",")).alias("t"))
    t = each.groupBy("clip").agg(F.array_join(F.sort_array(F.collect_list("t")), ";").alias("text"))
    return rp.spans(t, ["clip"], "text").select("clip", F.col("face").cast("long").alias("face"), "start", "stop")


SPANS = "SELECT o_custkey AS clip, o_orderkey % 3 AS face, (o_orderkey // 3 % 100)::DOUBLE AS start, (o_orderkey // 3 % 100) + 1.5::DOUBLE AS stop FROM orders"


def next_permutation(s, d):
    """The order of the first five numbers of a vector, and the next order."""
    five = F.sort_array(F.array(*[F.struct(F.get("v", F.lit(i)).alias("x"), F.lit(i + 1).alias("i")) for i in range(5)]))
    p = _vectors(s, d).select("vec_id", F.transform(five, lambda x: x["i"]).alias("order"))
    return p.select("vec_id", F.array_join("order", "").alias("p"), F.array_join(mt.next_permutation(F.col("order")), "").alias("next"))


PERMUTE = f"""
WITH {E}, i AS (SELECT unnest(range(1, 6)) AS i), a AS (SELECT concat(a.i, b.i, c.i, d.i, f.i) AS q FROM i a, i b, i c, i d, i f WHERE len(list_distinct([a.i, b.i, c.i, d.i, f.i])) = 5),
n AS (SELECT q, coalesce(lead(q) OVER (ORDER BY q), '12345') AS next FROM a),
p AS (SELECT vec_id, (SELECT string_agg(k, '' ORDER BY v[k], k) FROM (SELECT unnest(range(1, 6)) AS k)) AS p FROM e)
SELECT vec_id, p, next FROM p JOIN n ON q = p"""


def alignment_summary(s, d):
    ev = table(s, d, "events").select(F.col("user_id"), F.expr("case event_id % 3 when 0 then 'waveform' when 1 then 'identity' else 'held' end").alias("basis"), (F.col("event_id") % 4 == 0).alias("flipped"), (F.col("event_id") % 3 < 2).alias("confident"), (F.col("event_id") / 10.0).alias("boundary_s"), F.col("value").alias("margin"))
    out = rp.alignment_summary(ev, ["user_id"])
    return out.select("user_id", "boundaries", "flipped", r6("min_margin").alias("min_margin"), F.size("held").cast("long").alias("held"), F.concat_ws(",", F.transform(F.map_entries("basis"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))).alias("basis"))


ALIGN = """
WITH x AS (SELECT user_id, CASE event_id % 3 WHEN 0 THEN 'waveform' WHEN 1 THEN 'identity' ELSE 'held' END AS basis, event_id, value FROM events),
b AS (SELECT user_id, string_agg(basis || '=' || n, ',' ORDER BY basis) AS basis FROM (SELECT user_id, basis, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1)
SELECT user_id, count(*) AS boundaries, sum((event_id % 4 = 0)::BIGINT)::BIGINT AS flipped, round(min(value), 6) + 0.0 AS min_margin, sum((event_id % 3 = 2)::BIGINT)::BIGINT AS held, any_value(b.basis) AS basis FROM x JOIN b USING (user_id) GROUP BY user_id"""


def box_json(s, d):
    """Boxes of a vector written as JSON, with one that is missing and one of two numbers, and read from it again."""
    j = F.to_json(F.array(F.slice("v", 1, 4), F.lit(None).cast("array<double>"), F.slice("v", 5, 2), F.slice("v", 7, 4)))
    t = _vectors(s, d).select("vec_id", j.alias("j"))
    return rp.boxes(t, ["vec_id"], "j").select("vec_id", F.col("frame").cast("long").alias("frame"), *[r6(c).alias(c) for c in "xywh"])


BOX_JSON = f"""
WITH {E}, f AS (SELECT vec_id, v, frame, CASE frame WHEN 0 THEN 1 WHEN 3 THEN 7 END AS k FROM e, (SELECT unnest(range(4)) AS frame))
SELECT vec_id, frame, round(v[k], 6) + 0.0 AS x, round(v[k + 1], 6) + 0.0 AS y, round(v[k + 2], 6) + 0.0 AS w, round(v[k + 3], 6) + 0.0 AS h FROM f"""


def adopt_runs(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("run"), F.col("role").alias("file"))
    return rp.adopt(c, ["user", "assistant"]).select("run")


ADOPT = "SELECT conv_id::VARCHAR AS run FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1 HAVING count(DISTINCT role) = 2"


def identity_gate(s, d):
    df = relative_score(s, d).withColumn("w", F.row_number().over(fr.Window.partitionBy("label").orderBy("vec_id")))
    return gt.identity_gate(df, ["label"], "w", "score", 0.05, -0.05, 0.40, 0.5).select("label", F.col("w").cast("long").alias("w"), F.col("state").cast("long").alias("state"))


IDENTITY = f"""
WITH q AS ({RELATIVE}), x AS (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS w FROM q),
e2 AS (SELECT *, CASE WHEN score > 0.05 THEN 1 WHEN score < -0.05 THEN 0 END AS ev FROM x)
SELECT label, w, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY label ORDER BY w), 0)::BIGINT AS state FROM e2"""


def identity_gate_samples(s, d):
    """The windows' state on the grid of samples (vec_id is the centre), shut where no window is near, with ramps."""
    q = gt.identity_gate(relative_score(s, d), ["label"], "vec_id", "score", 0.05, -0.05, 0.40, 0.5).withColumnRenamed("vec_id", "pos")
    last = q.agg(F.max("pos").alias("last"))
    grid = q.select("label").distinct().join(F.broadcast(last)).select("label", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("pos"))
    df = gt.lift(q, grid, ["label"], "pos", "state", 3.0)
    return wi.ramps(df, ["label"], "pos", "state", 3, "gain").select("label", "pos", F.col("state").cast("long").alias("state"), r6("gain").alias("gain"))


IDENTITY_SAMPLES = f"""
WITH q AS ({RELATIVE}), e2 AS (SELECT label, vec_id AS pos, CASE WHEN score > 0.05 THEN 1 WHEN score < -0.05 THEN 0 END AS ev FROM q),
st AS (SELECT label, pos, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY label ORDER BY pos), 0) AS st FROM e2),
grid AS (SELECT label, pos FROM (SELECT DISTINCT label FROM st) l, (SELECT unnest(range((SELECT max(pos) + 1 FROM st))) AS pos) t),
n AS (SELECT label, g.pos, last_value(s.st IGNORE NULLS) OVER b AS ps, max(s.pos) OVER b AS pa, first_value(s.st IGNORE NULLS) OVER f AS ns, min(s.pos) OVER f AS na FROM grid g LEFT JOIN st s USING (label, pos)
      WINDOW b AS (PARTITION BY label ORDER BY g.pos ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY label ORDER BY g.pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
a AS (SELECT label, pos, CASE WHEN least(coalesce(pos - pa, na - pos), coalesce(na - pos, pos - pa)) <= 3 AND (CASE WHEN pa IS NULL THEN ns WHEN na IS NULL OR na = pa THEN ps ELSE ps + (ns - ps) * (pos - pa) / (na - pa) END) > 0.5 THEN 1 ELSE 0 END AS s FROM n),
p AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY label ORDER BY pos), s) AS p FROM a),
c AS (SELECT *, min(CASE WHEN s = 1 AND p = 0 THEN pos END) OVER (PARTITION BY label ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, max(CASE WHEN s = 0 AND p = 1 THEN pos END) OVER (PARTITION BY label ORDER BY pos) AS prv FROM p)
SELECT label, pos, s::BIGINT AS state, round(CASE WHEN s = 1 THEN 1.0 ELSE greatest(coalesce(CASE WHEN nxt - pos < 3 THEN 0.5 + 0.5 * cos(pi() * (nxt - pos) / 3) END, 0.0), coalesce(CASE WHEN pos - prv + 1 < 3 THEN 0.5 + 0.5 * cos(pi() * (pos - prv + 1) / 3) END, 0.0)) END, 6) + 0.0 AS gain FROM c"""


# ---- no SQL: iterative, sequential or spectral; their tests hold them against plain versions ----------------------


def kmeans_cosine(s, d):
    return ve.kmeans(_vectors(s, d), "vec_id", "v", 4)[0]


def choose_k(s, d):
    df = _vectors(s, d)
    k = ve.choose_k(df, "vec_id", "v", 2, F.col("label") >= 5)
    return s.range(1).select(F.lit(k).alias("k"))


def _detections(s: SparkSession) -> DataFrame:
    """Forty clips of two faces that cross and leave for a while."""
    f = s.range(40).select(F.col("id").alias("clip"), F.explode(F.sequence(F.lit(0), F.lit(79))).alias("frame"))
    f = f.withColumn("det", F.explode(F.array(F.lit(0), F.lit(1)))).where("not (det = 1 and frame between 30 and 50)")
    x = F.when(F.col("det") == 0, 0.1 + F.col("frame") * 0.008).otherwise(0.8 - F.col("frame") * 0.008)
    emb = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(k % 2 == F.col("det"), 1.0 + F.col("clip") % 3 * 0.01).otherwise(0.05))
    return f.select("clip", "frame", "det", x.alias("x"), F.lit(0.3).alias("y"), F.lit(0.1).alias("w"), F.lit(0.2).alias("h"), emb.alias("emb"))


def entity_track(s, d):
    return en.track(_detections(s), "clip")


#: Likeness that the tables' vectors reach by chance, so that tracks and fragments of them do meet.
ALIKE = 0.3


def _fragments(s, d):
    """Vectors as fragments of three clips, each seen in the hours of the user of its number."""
    e = table(s, d, "embeddings").select((F.col("vec_id") % 3).alias("clip"), F.col("vec_id").alias("track"), F.col("embedding").alias("emb"))
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    seen = table(s, d, "events").select((F.col("user_id") % 3).alias("clip"), F.col("user_id").alias("track"), at.alias("frame"))
    return e, seen


def fragment_merge(s, d):
    return fg.merge_fragments(*_fragments(s, d), dataclasses.replace(Tracking(), same=ALIKE))


def reidentified(s, d):
    """All vectors in order of vec_id as frames of eight cameras, told by a hash of the id; tracks live for 40 steps unseen."""
    e = table(s, d, "embeddings").select(F.pmod(F.xxhash64("vec_id"), F.lit(8)).alias("camera"), F.floor(F.col("vec_id") / 16).alias("at"), "vec_id", "embedding")
    return ri.reidentify(e, "camera", "at", "vec_id", "embedding", ri.Reid(ALIKE, 40))


#: Scores as whole numbers, so that plans of equal totals are equal in both engines.
_WHOLE = 10**9
#: Days of events have no voices of their own, so what is enough is less here than the operator's defaults.
MARGIN, ID_MARGIN, ID_COSINE = 0.1, 0.05, 0.2


def chunk_orders(s, d):
    """M11 over the days as chunks: the channels of a day against those of the day before, else against the mean day of each."""
    n = hourly(s, d).withColumns({"day": F.floor(F.col("hour") / 24).cast("int"), "h": F.col("hour") % 24})
    x = n.withColumn("x", F.col("n") - F.avg("n").over(Window.partitionBy("channel", "day")))
    now = x.select("day", "h", F.col("channel").alias("stem"), F.col("x").alias("b"))
    wave = mt.correlation_matrix(x.select((F.col("day") + 1).alias("day"), "h", F.col("channel").alias("track"), F.col("x").alias("a")), now, ["day"], "h", "track", "stem", "a", "b")
    mean = x.groupBy("channel", "h").agg(F.avg("x").alias("a")).join(F.broadcast(x.select("day").distinct()), how="cross")
    voice = mt.correlation_matrix(mean.select("day", "h", F.col("channel").alias("track"), "a"), now, ["day"], "h", "track", "stem", "a", "b")
    both = wave.withColumn("kind", F.lit("w")).unionByName(voice.withColumn("kind", F.lit("v"))).withColumn("score", F.round(F.col("score") * _WHOLE))
    names = F.broadcast(n.agg(F.sort_array(F.collect_set("channel")).alias("names")))
    plans = mt.assign(both, ["day", "kind"], "track", "stem", "score").join(names, how="cross")
    pairs = plans.select("day", "kind", "plan", "margin", "names", F.posexplode("plan").alias("i", "stem")).withColumn("track", F.get("names", "i"))
    planned = pairs.join(both, ["day", "kind", "track", "stem"]).groupBy("day", "kind", "plan", "margin", "names").agg(F.min("score").alias("least"))
    places = planned.withColumn("plan", F.transform("plan", lambda c: F.array_position("names", c).cast("int"))).drop("names")
    of = lambda kind: places.where(F.col("kind") == kind)
    steps = mt.decide(of("w"), of("v"), ["day"], MARGIN * _WHOLE, ID_MARGIN * _WHOLE, ID_COSINE * _WHOLE)
    orders = mt.running_orders(steps, [], "day", 6).join(names, how="cross")
    return orders.join(steps.select("day", "basis"), "day").select("day", "basis", F.array_join(F.transform("order", lambda i: F.get("names", i - 1)), ",").alias("channels"))


CHUNK_ORDERS = f"""
WITH RECURSIVE {se.H}, x AS (SELECT channel, hour // 24 AS day, hour % 24 AS h, n - avg(n) OVER (PARTITION BY channel, hour // 24) AS x FROM h),
mean AS (SELECT channel, h, avg(x) AS x FROM x GROUP BY 1, 2),
m AS (SELECT b.day AS lag, a.channel AS track, b.channel AS stem, round(abs(sum(a.x * b.x)) / (sqrt(sum(a.x * a.x) * sum(b.x * b.x)) + 1e-12) * {_WHOLE})::BIGINT AS score
      FROM x a JOIN x b ON b.day = a.day + 1 AND b.h = a.h GROUP BY 1, 2, 3
      UNION ALL SELECT 1000 + b.day, a.channel, b.channel, round(abs(sum(a.x * b.x)) / (sqrt(sum(a.x * a.x) * sum(b.x * b.x)) + 1e-12) * {_WHOLE})::BIGINT FROM mean a JOIN x b USING (h) GROUP BY 1, 2, 3),
{se.PLANS},
c AS (SELECT list(channel ORDER BY channel) AS names FROM (SELECT DISTINCT channel FROM h)),
k AS (SELECT lag, margin, list_transform(string_split(plan, ','), lambda y: list_position(names, y)) AS step FROM t, c),
l AS (SELECT lag, min(score) AS least FROM (SELECT lag, unnest(names) AS track, unnest(string_split(plan, ',')) AS stem FROM t, c) JOIN m USING (lag, track, stem) GROUP BY 1),
s AS (SELECT w.lag AS day, CASE WHEN w.margin >= {MARGIN} * {_WHOLE} THEN w.step WHEN v.margin >= {ID_MARGIN} * {_WHOLE} AND least >= {ID_COSINE} * {_WHOLE} THEN v.step ELSE range(1, len(w.step) + 1) END AS step,
      w.margin < {MARGIN} * {_WHOLE} AS fixed, CASE WHEN w.margin >= {MARGIN} * {_WHOLE} THEN 'waveform' WHEN v.margin >= {ID_MARGIN} * {_WHOLE} AND least >= {ID_COSINE} * {_WHOLE} THEN 'identity' ELSE 'hold' END AS basis
      FROM k w JOIN k v ON v.lag = 1000 + w.lag JOIN l ON l.lag = v.lag WHERE w.lag < 1000),
o AS (SELECT day, basis, step FROM s WHERE day = 1 UNION ALL SELECT s.day, s.basis, CASE WHEN fixed THEN s.step ELSE list_transform(o.step, lambda i: s.step[i]) END FROM o JOIN s ON s.day = o.day + 1)
SELECT day::INT AS day, basis, array_to_string(list_transform(step, lambda i: names[i]), ',') AS channels FROM o, c"""


def greedy_pairs(s, d):
    sc = table(s, d, "embeddings").select((F.col("vec_id") % 50).alias("clip"), (F.floor(F.col("vec_id") / 50) % 4).alias("row"), F.posexplode("embedding").alias("col", "score"))
    sc = sc.groupBy("clip", "row", "col").agg(F.max(F.col("score").cast("double")).alias("score"))
    return mt.greedy(sc.withColumn("col", F.col("col").cast("long")), ["clip"], "row", "col", "score")


GREEDY = """
WITH RECURSIVE x AS (SELECT vec_id % 50 AS clip, vec_id // 50 % 4 AS row, unnest(range(len(embedding))) AS col, unnest(embedding)::DOUBLE AS score FROM embeddings),
sc AS (SELECT clip::BIGINT AS clip, row::BIGINT AS row, col, max(score) AS score FROM x GROUP BY ALL),
g AS (SELECT clip, []::BIGINT[] AS rs, []::BIGINT[] AS cs, NULL::DOUBLE AS score FROM sc GROUP BY clip
UNION ALL SELECT clip, list_append(rs, row), list_append(cs, col), score FROM (
  SELECT g.clip, rs, cs, sc.row, sc.col, sc.score, row_number() OVER (PARTITION BY g.clip ORDER BY sc.score DESC, sc.row, sc.col) AS k
  FROM g JOIN sc ON sc.clip = g.clip AND NOT list_contains(rs, sc.row) AND NOT list_contains(cs, sc.col)) WHERE k = 1)
SELECT clip, rs[-1] AS row, cs[-1] AS col, score FROM g WHERE len(rs) > 0"""


def _tones(s: SparkSession) -> DataFrame:
    t = F.col("i") / 16000.0
    x = F.sin(t * 6.283185307179586 * (110 + F.col("channel") * 70)) + 0.5 * F.sin(t * 12.566370614359172 * (110 + F.col("channel") * 70))
    rows = s.range(4).select(F.col("id").alias("clip"), F.explode(F.array(F.lit(0), F.lit(1))).alias("channel"))
    return rows.select("clip", "channel", F.explode(F.sequence(F.lit(0), F.lit(7999))).alias("i")).withColumn("x", x)


def wiener_separation(s, d):
    return sp.per_clip(_tones(s), "clip", "channel", "i", "x", sp.wiener)


def stft_roundtrip(s, d):
    return sp.per_signal(_tones(s), ["clip", "channel"], "i", "x", lambda x: sp.istft(sp.stft(x), len(x)) - x, "error")


def refinement_inputs(s, d):
    """the sum of all channels less what is the other channels' own."""
    return sp.per_clip(_tones(s), "clip", "channel", "i", "x", lambda m: sp.refinement_inputs(m.sum(0), np.stack([m[0] + 0.2 * m[1], m[1] + 0.2 * m[0]])))


def leak_cancel(s, d):
    return sp.per_clip(_tones(s), "clip", "channel", "i", "x", lambda m: sp.cancel_leak(np.stack([m[0] + 0.2 * m[1], m[1] + 0.2 * m[0]])))


def f0_track(s, d):
    return sp.per_signal(_tones(s), ["clip", "channel"], "i", "x", lambda x: sp.f0_autocorrelation(x, 16000), "hz")


def f0_yin(s, d):
    return sp.per_signal(_tones(s), ["clip", "channel"], "i", "x", lambda x: sp.f0_yin(x, 16000), "hz")


def f0_product(s, d):
    return sp.per_signal(_tones(s), ["clip", "channel"], "i", "x", lambda x: np.array([sp.f0_harmonic_product(x, 16000)]), "hz")


def formant_track(s, d):
    return sp.per_signal(_tones(s), ["clip", "channel"], "i", "x", lambda x: np.concatenate([sp.formants(x[k : k + 640], 16000) for k in range(0, len(x) - 639, 640)]), "hz")


def cepstral_profile(s, d):
    return sp.per_signal(_tones(s), ["clip", "channel"], "i", "x", lambda x: sp.cepstral_profile(x, 16000))


def band_profile(s, d):
    return sp.per_signal(_tones(s), ["clip", "channel"], "i", "x", lambda x: sp.band_profile(x, 16000))


QUERIES = {
    "even_sample_mean": (even_sample_mean, EVEN),
    "weighted_profile": (weighted_profile, WEIGHTED),
    "nearest_centroid": (nearest_centroid, NEAREST),
    "relative_score": (relative_score, RELATIVE),
    "face_match": (face_match, FACE),
    "identity_gate_samples": (identity_gate_samples, IDENTITY_SAMPLES),
    "enrolment": (enrolment, ENROLMENT),
    "cluster_share_claim": (cluster_share_claim, CLAIM),
    "content_hash": (content_hash, HASH),
    "auc_rank": (auc_rank, AUC),
    "quality_precision_recall": (quality_precision_recall, PRECISION),
    "label_accuracy": (label_accuracy, "SELECT round(avg((quality = toxic)::INT), 6) + 0.0 AS accuracy, count(*) AS n FROM labels"),
    "si_sdr": (si_sdr, SI_SDR),
    "shared_gain": (shared_gain, GAIN),
    "weighted_draws": (weighted_draws, DRAWS),
    "auc_long": (auc_long, AUC_LONG),
    "rank_long": (rank_long, RANK_LONG),
    "quantile_long": (quantile_long, QUANTILE_LONG),
    "assign_unequal": (assign_unequal, UNEQUAL),
    "assign_vectors": (assign_vectors, None),
    "rank_norm": (rank_norm, RANK),
    "bootstrap_ci": (bootstrap_ci, BOOTSTRAP),
    "json_null_safe": (json_null_safe, JSON),
    "box_iou_pairs": (box_iou_pairs, IOU),
    "shoelace_area": (shoelace_area, SHOELACE),
    "drift_deadband": (drift_deadband, DRIFT),
    "spans_mask": (spans_mask, SPANS),
    "next_permutation": (next_permutation, PERMUTE),
    "alignment_summary": (alignment_summary, ALIGN),
    "box_json": (box_json, BOX_JSON),
    "adopt_runs": (adopt_runs, ADOPT),
    "identity_gate": (identity_gate, IDENTITY),
    "kmeans_cosine": (kmeans_cosine, None),
    "choose_k": (choose_k, None),
    "entity_track": (entity_track, None),
    "fragment_merge": (fragment_merge, None),
    "reidentified": (reidentified, None),
    "chunk_orders": (chunk_orders, CHUNK_ORDERS),
    "greedy_pairs": (greedy_pairs, GREEDY),
    "wiener_separation": (wiener_separation, None),
    "stft_roundtrip": (stft_roundtrip, None),
    "leak_cancel": (leak_cancel, None),
    "refinement_inputs": (refinement_inputs, None),
    "f0_track": (f0_track, None),
    "f0_yin": (f0_yin, None),
    "f0_product": (f0_product, None),
    "formant_track": (formant_track, None),
    "cepstral_profile": (cepstral_profile, None),
    "band_profile": (band_profile, None),
}
