"""Pairing of two sets of series: score matrices, one-to-one assignments with margins, and their significance.

Score tables are (keys, row, col, score); the matrix of a key is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_matrix(left: DataFrame, right: DataFrame, keys: list[str], index: str, row: str, col: str, a: str, b: str, n: int) -> DataFrame:
    """Sum over the common grid of a * b / n for each row and column."""
    both = left.select(*keys, index, row, a).join(right.select(*keys, index, col, b), [*keys, index])
    return both.groupBy(*keys, row, col).agg((F.sum(F.col(a) * F.col(b)) / n).alias("score"))


def correlation_matrix(left: DataFrame, right: DataFrame, keys: list[str], index: str, row: str, col: str, a: str, b: str) -> DataFrame:
    """|sum ab| / sqrt(sum aa * sum bb) over the common grid."""
    both = left.select(*keys, index, row, a).join(right.select(*keys, index, col, b), [*keys, index])
    s = lambda x, y: F.sum(F.col(x) * F.col(y))
    return both.groupBy(*keys, row, col).agg((F.abs(s(a, b)) / (F.sqrt(s(a, a) * s(b, b)) + 1e-12)).alias("score"))


class _Solver:
    """Best one-to-one plan of a matrix by shortest augmenting paths.

    Each of the smaller side (few) is paired. Those of the larger side (many) that are left over stand for pairs of score 0 with
    rows or columns that don't exist; these are all alike, so one more node stands for them all and the matrix isn't made square.
    Absent pairs (NaN) can't be taken.
    """

    def __init__(self, score: np.ndarray):
        self.shape, self.turn = score.shape, score.shape[0] > score.shape[1]
        side = score.T if self.turn else score
        self.pay = np.ascontiguousarray(np.where(np.isnan(side), np.inf, -side))
        m, n = self.pay.shape
        self.few, self.many = np.zeros(m), np.zeros(n)
        self.of_few, self.of_many = np.full(m, -1), np.full(n, -1)
        self.complete = all(self.augment(i) for i in range(m))

    def augment(self, one: int) -> bool:
        """Pairs one more of the few along the shortest path of alternating pairs; False if there is none."""
        n = len(self.many)
        dist, back, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        low, at, seen = 0.0, one, []
        while True:
            seen.append(at)
            reach = low + self.pay[at] - self.few[at] - self.many
            nearer = ~done & (reach < dist)
            dist[nearer], back[nearer] = reach[nearer], at
            left = np.where(done, np.inf, dist)
            to = int(np.argmin(left))
            low = dist[to]
            free = np.flatnonzero((left == low) & (self.of_many < 0))  # of those as near a free one, which ends the path
            to = int(free[0]) if len(free) else to
            if done[to] or np.isinf(low):
                return False
            done[to] = True
            if self.of_many[to] < 0:
                break
            at = self.of_many[to]
        for r in seen:
            self.few[r] += low - (dist[self.of_few[r]] if r != one else 0.0)
        self.many[done] -= low - dist[done]
        while True:
            r = back[to]
            self.of_many[to] = r
            self.of_few[r], to = to, self.of_few[r]
            if r == one:
                return True

    def _square(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Costs, potentials of rows and columns, and the column of each row, of the square with the pairs of score 0."""
        m, n = self.pay.shape
        fill = np.zeros(n - m)
        cost, few = np.concatenate((self.pay, np.zeros((n - m, n)))), np.concatenate((self.few, fill))
        of_few = np.concatenate((self.of_few, np.flatnonzero(self.of_many < 0)))
        return (cost.T, self.many, few, np.argsort(of_few)) if self.turn else (cost, few, self.many, of_few)

    cost, u, v, of_row = (property(lambda self, k=k: self._square()[k]) for k in range(4))

    def first_of_ties(self) -> None:
        """Moves to the lexicographically first of the best plans: row by row the least column whose pair costs nothing more."""
        rows, cols = self.shape
        n = len(self.many)
        near = 1e-12 * max(1.0, float(np.abs(self.pay[np.isfinite(self.pay)]).max(initial=0.0)))
        # With the node of those left over as the last row or column
        tight = np.zeros((len(self.few) + 1, n), bool)
        tight[:-1] = self.pay - self.few[:, None] - self.many <= near
        tight[-1] = -self.many <= near if len(self.few) < n else False
        of_many = np.where(self.of_many < 0, len(self.few), self.of_many)
        of_few = np.append(self.of_few, -1)
        if self.turn:
            tight, of_row, of_col = np.ascontiguousarray(tight.T), of_many, of_few
        else:
            of_row, of_col = of_few, of_many
        for r in range(rows):
            mine = of_row[r]
            wish = np.flatnonzero(tight[r, : min(mine, cols)])
            wish = wish[of_col[wish] > r]
            if len(wish):
                self._reroute(tight, of_row, of_col, r, wish)
        few, many = (of_col, of_row) if self.turn else (of_row, of_col)
        self.of_few, self.of_many = few[: len(self.few)].copy(), np.where(many[:n] == len(self.few), -1, many[:n])

    def _reroute(self, tight: np.ndarray, of_row: np.ndarray, of_col: np.ndarray, r: int, wish: np.ndarray) -> None:
        """Gives row r the first column of `wish` whose row, and those moved by it, can end in the column that r gives up. Rows before r stay.

        The rows that can are found from that column backwards, in steps that are one look at the table each.
        """
        mine = int(of_row[r])
        takes, gives = np.full(len(of_row), -1), np.full(tight.shape[1], -1)  # the column a row would move to; the row that gives a column up
        gives[mine] = r
        waits, ends = np.arange(len(of_row)) > r, np.array([mine])
        while len(ends) and gives[wish[0]] < 0:
            meets = tight[:, ends] & waits[:, None]
            found = np.flatnonzero(meets.any(axis=1))
            takes[found], waits[found] = ends[np.argmax(meets[found], axis=1)], False
            own = found[of_row[found] >= 0]
            held, by = of_row[own], own
            if len(own) < len(found):  # the node of the columns left over
                held = np.concatenate((held, np.flatnonzero(of_col == found[-1])))
                by = np.concatenate((by, np.full(len(held) - len(by), found[-1])))
            ends, at = np.unique(held[gives[held] < 0], return_index=True)
            gives[ends] = by[gives[held] < 0][at]
        able = wish[gives[wish] >= 0]
        if not len(able):
            return
        row, c = r, int(able[0])
        while True:
            other = int(gives[c])
            of_row[row], of_col[c] = c if of_row[row] >= 0 else -1, row
            if c == mine:
                return
            row, c = other, int(takes[other])

    def total(self) -> float:
        return float(sum(-self._paid(self.of_few)))

    def _paid(self, of_few: np.ndarray) -> np.ndarray:
        """What each pair costs, in order of rows."""
        cost = self.pay[np.arange(len(of_few)), of_few]
        return cost[np.argsort(of_few)] if self.turn else cost

    def pairs(self) -> list[tuple[int, int]]:
        at = [(int(c), r) if self.turn else (r, int(c)) for r, c in enumerate(self.of_few)]
        return sorted(at)

    def runner_up(self) -> float | None:
        """Greatest total of a plan that lacks one of these pairs: the least round of moves that each of the few can begin.

        A move takes one of the few to the partner of the next, or to one that is left over; that costs what the pair is above
        the potentials. All rounds are searched at once, from each of the few the nearest first.
        """
        m, n = self.pay.shape
        extra = int(n > m)
        step = np.full((m + extra, m + extra), np.inf)
        step[:m, :m] = np.maximum(0.0, self.pay[:, self.of_few] - self.few[:, None] - self.many[self.of_few])
        left = np.flatnonzero(self.of_many < 0)
        if extra:
            beyond = self.pay[:, left] - self.few[:, None] - self.many[left]
            spare = left[np.argmin(beyond, axis=1)]
            step[:m, m], step[m, :m] = np.maximum(0.0, beyond.min(axis=1)), np.maximum(0.0, -self.many[self.of_few])
        np.fill_diagonal(step, np.inf)
        each = np.arange(m)
        dist, back, done = step[:m].copy(), np.repeat(each[:, None], m + extra, axis=1), np.zeros((m, m + extra), bool)
        for _ in range(m + extra):
            at = np.argmin(np.where(done, np.inf, dist), axis=1)
            done[each, at] = True
            reach = dist[each, at][:, None] + step[at]
            nearer = ~done & (reach < dist)
            dist, back = np.where(nearer, reach, dist), np.where(nearer, at[:, None], back)
        least = dist[each, each]
        if np.isinf(least.min()):
            return None
        best = -np.inf
        for i in np.flatnonzero(least <= least.min() + 1e-9 * max(1.0, float(least.min()))):
            of_few, at = self.of_few.copy(), int(i)
            while True:
                was = int(back[i, at])
                if was < m:
                    of_few[was] = spare[was] if at == m else self.of_few[at]
                at = was
                if at == i:
                    break
            best = max(best, float(sum(-self._paid(of_few))))
        return best


def solve(score: np.ndarray) -> tuple[list[int | None], float, float] | None:
    """Column of each row (None: not paired), total and margin; None without a plan of as many pairs as the smaller side has."""
    s = _Solver(score)
    if not s.complete or len(s.pairs()) < min(score.shape):
        return None
    s.first_of_ties()
    total, second = s.total(), s.runner_up()
    plan = dict(s.pairs())
    return [plan.get(r) for r in range(score.shape[0])], total, total if second is None else max(0.0, total - second)


def assign(scores: DataFrame, keys: list[str], row: str, col: str, score: str) -> DataFrame:
    """(keys, plan, total, margin): the one-to-one plan of the greatest total of each key, an array of columns in order of rows.

    Any shape: as many pairs as the smaller side has; a row without a column is NULL in the plan. Of ties the lexicographically
    first plan, a column before none. The margin is what the total has over that of the next plan, and the total itself where
    there is no other; it is never negative. Pairs that are absent, NULL or NaN can't be taken, and a key that has no whole plan
    without them has no row. A key's matrix is one row of an array; keys are spread over the tasks.
    """
    packed = scores.groupBy(*keys).agg(F.collect_list(F.struct(F.col(row).alias("r"), F.col(col).alias("c"), F.col(score).cast("double").alias("s"))).alias("_m"))
    kind = scores.schema[col].dataType.simpleString()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, plans, totals, margins = [], [], [], []
            for i in range(b.num_rows):
                cells = b.column(b.num_columns - 1)[i].as_py()
                rows, cols = sorted({x["r"] for x in cells}), sorted({x["c"] for x in cells})
                row_at, col_at = {r: k for k, r in enumerate(rows)}, {c: k for k, c in enumerate(cols)}
                m = np.full((len(rows), len(cols)), np.nan)
                for x in cells:
                    m[row_at[x["r"]], col_at[x["c"]]] = np.nan if x["s"] is None else x["s"]
                if cells and (found := solve(m)):
                    at.append(i), totals.append(found[1]), margins.append(found[2])
                    plans.append([None if c is None else cols[c] for c in found[0]])
            of_keys = [c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]]
            of_cols = pa.list_(b.schema.field(b.num_columns - 1).type.value_type.field("c").type)
            yield pa.RecordBatch.from_arrays([*of_keys, pa.array(plans, of_cols), pa.array(totals, pa.float64()), pa.array(margins, pa.float64())], [*b.schema.names[:-1], "plan", "total", "margin"])

    return packed.mapInArrow(run, f"{fields}{', ' if keys else ''}plan array<{kind}>, total double, margin double")


def best_rows(scores: DataFrame, keys: list[str], row: str, col: str, score: str) -> DataFrame:
    """The scores that the best plan and the next can hold, for keys of many rows and few columns; of m columns each keeps m + 1.

    A column that is paired with a row beyond its best m can take one of these instead that no other column has, of ties an
    earlier row; one more is needed where a pair is forbidden. So `assign` gives the same pairs, total and margin, while a
    matrix has m * (m + 1) rows at most. Rows left out aren't in its plan.
    """
    x = F.col(score).cast("double")
    known = scores.select(*keys, row, col, F.when(~F.isnan(x), x).alias(score))
    m = known.select(*keys, col).distinct().groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    best = Window.partitionBy(*keys, col).orderBy(F.desc_nulls_last(score), row)
    return known.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= m + 1).drop("_k")


def shift_scores(left: DataFrame, right: DataFrame, index: str, row: str, col: str, a: str, b: str, n: int) -> DataFrame:
    """(lag, row, col, score) for every common circular lag of the left side, 0 included.

    Every lag instead of a random draw of them: stricter, and the same on every run. Each pair of series is one row of two
    arrays of n values, and one FFT gives all its lags.
    """
    packed = lambda df, name, v: df.groupBy(name).agg(F.transform(F.sort_array(F.collect_list(F.struct(index, v))), lambda x: x[v]).alias(v))
    both = packed(left, row, a).crossJoin(F.broadcast(packed(right, col, b)))

    @F.pandas_udf("array<double>")
    def circular(x: pd.Series, y: pd.Series) -> pd.Series:
        f = np.fft.rfft(np.stack(y.to_numpy())) * np.fft.rfft(np.stack(x.to_numpy())).conj()
        return pd.Series(list(np.fft.irfft(f, n) / n))

    return both.select(row, col, F.posexplode(circular(a, b)).alias("lag", "score")).select("lag", row, col, "score")


def significance(margins: DataFrame, n: int) -> DataFrame:
    """p = (hits + 1) / (lags + 1) and the share of lags that pick the same plan. A tie is a hit. n < 4 is not testable."""
    real = margins.where("lag = 0").select(F.col("margin").alias("_m"), F.col("plan").alias("_p"), F.col("total").alias("_t"))
    null = margins.where("lag > 0").crossJoin(F.broadcast(real))
    hits = F.sum(F.when(F.col("margin") >= F.col("_m"), 1).otherwise(0))
    out = null.groupBy("_m", "_p", "_t").agg(((hits + 1) / (F.count("*") + 1)).alias("p"), F.avg((F.col("plan") == F.col("_p")).cast("double")).alias("agreement"))
    if n < 4:
        out = out.withColumns({"p": F.lit(1.0), "agreement": F.lit(1.0)})
    return out.select(F.col("_p").alias("plan"), F.col("_t").alias("total"), F.col("_m").alias("margin"), "p", "agreement")


def trusted(p: Column, confidence: Column, p_most: float = 0.05, least: float = 0.05) -> Column:
    return (p <= p_most) & (confidence >= least)


def greedy(scores: DataFrame, keys: list[str], row: str, col: str, score: str) -> DataFrame:
    """Greedy one-to-one: the best pair left, ties by (row, col). Sequential, so per key in pandas; keys are tiny."""
    import pandas as pd

    fields = scores.select(*keys, row, col, score).schema

    def run(df: pd.DataFrame) -> pd.DataFrame:
        rows, cols, out = set(), set(), []
        for r in df.sort_values([score, row, col], ascending=[False, True, True]).itertuples(index=False):
            x = r._asdict()
            if x[row] not in rows and x[col] not in cols:
                rows.add(x[row]), cols.add(x[col]), out.append(x)
        return pd.DataFrame(out, columns=[f.name for f in fields])

    return scores.select(*keys, row, col, score).groupBy(*keys).applyInPandas(run, fields)


def claims(pairs: DataFrame, keys: list[str], track: str, stem: str, n_stems: Column | None = None) -> DataFrame:
    """Tracks' stems without duplicates: the first track wins; missing, negative and out-of-range stems are dropped."""
    ok = pairs.where(F.col(stem).isNotNull() & (F.col(stem) >= 0))
    if n_stems is not None:
        ok = ok.where(F.col(stem) < n_stems)
    first = F.row_number().over(Window.partitionBy(*keys, stem).orderBy(track))
    return ok.withColumn("_k", first).where("_k = 1").drop("_k")


def channel_plan(tracks: DataFrame, stems: DataFrame, held: DataFrame, keys: list[str], track: str, stem: str) -> DataFrame:
    """(keys, channel, track, stem): matched stems by track, then unclaimed stems; unmatched tracks have no channel."""
    known = stems.join(held.select(*keys, track, stem), [*keys, stem], "left")
    order = Window.partitionBy(*keys).orderBy(F.col(track).isNull(), track, stem)
    placed = known.withColumn("channel", F.row_number().over(order) - 1).select(*keys, "channel", track, stem)
    lost = tracks.join(held.select(*keys, track), [*keys, track], "left_anti")
    none = F.lit(None)
    return placed.unionByName(lost.select(*keys, none.cast("int").alias("channel"), track, none.cast(stems.schema[stem].dataType).alias(stem)))


def by_stem(stems: DataFrame, held: DataFrame, values: DataFrame, keys: list[str], track: str, stem: str) -> DataFrame:
    """Values of tracks under the stems that hold them; NULL for an unclaimed stem."""
    return stems.join(held, [*keys, stem], "left").join(values, [*keys, track], "left")


def backfill(pairs: DataFrame, scores: DataFrame, keys: list[str], track: str, stem: str, score: str) -> DataFrame:
    """Unclaimed stems, in their order, each go to the best track that is still free, with confidence 0; of ties to the first track."""
    free = scores.join(pairs, [*keys, stem], "left_anti").join(pairs.select(*keys, track), [*keys, track], "left_anti")
    fields = free.select(*keys, track, stem).schema

    def run(df: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        kept = []
        for _, of_stem in df.groupby(stem, sort=True):
            left = of_stem[~of_stem[track].isin(taken)].sort_values([score, track], ascending=[False, True]).head(1)
            taken.update(left[track])
            kept.append(left)
        return pd.concat(kept)[[f.name for f in fields]]

    filled = free.select(*keys, track, stem, score).groupBy(*keys).applyInPandas(run, fields)
    return pairs.unionByName(filled.withColumn("confidence", F.lit(0.0)))


def decide(wave: DataFrame, voice: DataFrame, keys: list[str], margin: float = 0.15, id_margin: float = 0.15, id_cosine: float = 0.45) -> DataFrame:
    """(keys, step, fixed, basis) of each boundary: how its channels stand to those before it.

    wave and voice: keys, plan (positions from 1), margin, and for the voices `least`, the least cosine of the plan. A waveform
    of enough margin decides, relative to the order before; else the voices, if both their margin and their least cosine
    suffice, by themselves; else the channels keep the order in which they came. Boundaries that only voices have don't count.
    """
    both = wave.select(*keys, F.col("plan").alias("_w"), F.col("margin").alias("_m")).join(voice.select(*keys, F.col("plan").alias("_v"), F.col("margin").alias("_vm"), "least"), keys, "left")
    sure = F.col("_m") >= margin
    known = F.coalesce((F.col("_vm") >= id_margin) & (F.col("least") >= id_cosine), F.lit(False))
    came = F.sequence(F.lit(1), F.size("_w"))
    step = F.when(sure, F.col("_w")).when(known, F.col("_v")).otherwise(came)
    return both.select(*keys, step.alias("step"), (~sure).alias("fixed"), F.when(sure, "waveform").when(known, "identity").otherwise("hold").alias("basis"))


def running_orders(steps: DataFrame, keys: list[str], index: str, block: int, out: str = "order") -> DataFrame:
    """(keys, index, out): the order of a series after each of its steps, which are applied one after another from 1, 2, 3, ..

    steps: keys, index (whole numbers), step (positions from 1), fixed. A fixed step is the order itself; any other takes the
    order before as it says. Applying steps is associative, so each block of indexes is first made one step, the blocks of a
    key are gone through in order, and then each block by itself from where the one before has left off. A task holds a
    block, or one row a block: with a block of the root of a series' length neither is more than that root.
    """
    kind = "array<int>"
    s = steps.select(*keys, F.col(index).alias("_i"), F.floor(F.col(index) / block).alias("_b"), F.col("step").cast(kind).alias("step"), "fixed")
    packed = s.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct("_i", "fixed", "step"))).alias("_s"))
    start = F.struct(F.lit(False).alias("fixed"), F.sequence(F.lit(1), F.size(F.col("_s")[0]["step"])).alias("step"))

    def then(a: Column, b: Column) -> Column:
        after = F.transform(a["step"], lambda i: F.get(b["step"], i - 1))
        return F.struct((a["fixed"] | b["fixed"]).alias("fixed"), F.when(b["fixed"], b["step"]).otherwise(after).alias("step"))

    def scan(array: Column, first: Column, name: str) -> Column:
        """Of each element its number (as `name`) and the step before it and after it."""
        none = F.array().cast(f"array<struct<{name}:bigint,before:struct<fixed:boolean,step:{kind}>,after:struct<fixed:boolean,step:{kind}>>>")
        one = lambda acc, x: F.struct(x[name].cast("bigint").alias(name), acc["now"].alias("before"), then(acc["now"], x).alias("after"))
        step = lambda acc, x: F.struct(then(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(one(acc, x))).alias("out"))
        return F.aggregate(array, F.struct(first.alias("now"), none.alias("out")), step, lambda acc: acc["out"])

    whole = packed.select(*keys, "_b", F.aggregate("_s", start, then).alias("_w"), start["step"].alias("_id"))
    line = whole.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", F.col("_w.fixed").alias("fixed"), F.col("_w.step").alias("step")))).alias("_l"), F.max("_id").alias("_id"))
    begun = line.select(*keys, F.explode(scan(F.col("_l"), F.struct(F.lit(False).alias("fixed"), F.col("_id").alias("step")), "_b")).alias("_x")).select(*keys, F.col("_x._b").alias("_b"), F.col("_x.before").alias("_from"))
    met = packed.join(begun, [*keys, "_b"])
    return met.select(*keys, F.explode(scan(F.col("_s"), F.col("_from"), "_i")).alias("_x")).select(*keys, F.col("_x._i").alias(index), F.col("_x.after.step").alias(out))


def match_stems(lips: DataFrame, envs: DataFrame, index: str, track: str, stem: str, a: str, b: str, n: int, p_most: float = 0.05, least: float = 0.05) -> DataFrame:
    """(track, stem, confidence, p, agreement, trusted) of every track: the best one-to-one pairing, and how much to believe it.

    lips (index, track, a) and envs (index, stem, b) are standardised features on one grid of n rows. The confidence of a pair
    is the margin of the whole plan. Stems that it leaves over go, in their order, to the best free track, with confidence 0;
    a track without a stem has NULL and 0. p is the share of circular shifts whose margin is as large.
    """
    scores = shift_scores(lips, envs, index, track, stem, a, b, n)
    found = significance(assign(scores, ["lag"], track, stem, "score"), n)
    names = lips.groupBy().agg(F.sort_array(F.collect_set(track)).alias("_names"))
    planned = found.join(F.broadcast(names), how="cross").select(F.posexplode("_names").alias("_i", track), "plan", "margin", "p", "agreement")
    planned = planned.withColumn(stem, F.get("plan", "_i"))
    one = [F.lit(1).alias("_one")]
    pairs = planned.where(F.col(stem).isNotNull()).select(*one, track, stem, F.col("margin").alias("confidence"))
    filled = backfill(pairs, scores.where("lag = 0").select(*one, track, stem, "score"), ["_one"], track, stem, "score").drop("_one")
    out = planned.select(track, "margin", "p", "agreement").join(filled, track, "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    sure = trusted(F.col("p"), F.max("confidence").over(Window.partitionBy("p")), p_most, least)
    return out.select(track, stem, "confidence", "p", "agreement", sure.alias("trusted"))


def best_lag(left: DataFrame, right: DataFrame, keys: list[str], index: str, a: str, b: str, most: int) -> DataFrame:
    """The lag of the right side with the greatest sum of products over the overlap; of ties the least lag.

    Each left row meets 2 * most + 1 rows by an equi-join on index, so nothing is compared beyond the range.
    """
    lagged = left.select(*keys, F.col(index).alias("_i"), F.col(a).alias("_a")).withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    lagged = lagged.withColumn(index, F.col("_i") + F.col("lag"))
    sums = lagged.join(right.select(*keys, index, F.col(b).alias("_b")), [*keys, index]).groupBy(*keys, "lag").agg(F.sum(F.col("_a") * F.col("_b")).alias("score"))
    best = F.max(F.struct(F.col("score"), (-F.col("lag")).alias("_neg"))).alias("_m")
    return sums.groupBy(*keys).agg(best).select(*keys, (-F.col("_m._neg")).alias("lag"), F.col("_m.score").alias("score"))


def next_permutation(current: Column) -> Column:
    """The lexicographically next permutation of an array of distinct values; the last wraps to the first."""
    n = F.size(current)
    at = F.sequence(F.lit(0), n - 2)
    rises = F.filter(at, lambda i: F.get(current, i) < F.get(current, i + 1))
    k = F.array_max(rises)
    pivot = F.get(current, k)
    tail = F.slice(current, k + 2, n - k - 1)
    larger = F.array_min(F.filter(tail, lambda x: x > pivot))
    rest = F.sort_array(F.concat(F.array_remove(tail, larger), F.array(pivot)))
    return F.when((n < 2) | k.isNull(), F.sort_array(current)).otherwise(F.concat(F.slice(current, F.lit(1), k), F.array(larger), rest))
