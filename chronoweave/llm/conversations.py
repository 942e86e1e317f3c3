"""Repair of conversations by error-correcting Earley parsing.

A weighted grammar says in which order roles may speak; error productions keep, rerole, delete and insert turns at a price.
Rows are read from the last to the first, so that every edit is put before the edits that follow it: of two sequences of
edits the lesser stays the lesser when both get the same letter in front, which isn't so at the other end. The grammar is
right-linear, so the origin of an item has no bearing on what may come next, and a chart set holds one item for each dotted
rule with the least (cost, audit) over all origins. Costs are kept relative to the least of a set and audits by their order
among the items of a set; there are few such sets, so a chart set is looked up, and costs eight bytes a turn.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import table

#: Read from the last row on: pairs of an assistant and a user, and before them one system row at most.
#: Capitals are nonterminals and stand last; the other letters are initials of roles.
GRAMMAR = {"S": ("", "T"), "T": ("auR",), "R": ("", "s", "T")}
START = "S"
#: Initials that the grammar knows; all others are alike to it.
TERMINALS = "sua"
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

SPACE = " \t\n\x0b\x0c\r"

#: Characters of a conversation's texts that a task holds; beyond, they are put in a file until the parse has ended.
HELD = 32_000_000


class Item(NamedTuple):
    """A dotted rule whose dot stands behind a terminal, or the start."""

    rule: str
    dot: int


@cache
def _next(item: Item) -> dict[str, Item]:
    """Scans that are open from an item, through any predictions."""
    out, seen, todo = {}, set(), [item]
    while todo:
        rule, dot = todo.pop()
        if dot < len(rule) and rule[dot] in GRAMMAR:
            if rule[dot] not in seen:
                seen.add(rule[dot])
                todo += [Item(rhs, 0) for rhs in GRAMMAR[rule[dot]]]
        elif dot < len(rule):
            out[rule[dot]] = Item(rule, dot + 1)
    return out


@cache
def _complete(item: Item) -> bool:
    """True if the rest of the rule derives nothing; all rules above end with it, as the grammar is right-linear."""
    rule, dot = item
    return dot == len(rule) or rule[dot] in GRAMMAR and any(_complete(Item(rhs, 0)) for rhs in GRAMMAR[rule[dot]])


ORIGIN = Item(START, 0)


class Turn(NamedTuple):
    """What the grammar sees of a row."""

    initial: str
    must_go: bool
    truncated: bool


class Set(NamedTuple):
    """A chart set: (item, cost over the set's least, rank of its audit among equal costs), by item."""

    items: tuple[tuple[Item, int, int], ...]


#: From a set's item: the letter of the last edit, the role it gives, and the item it came from (of the same set, if inserted).
Back = dict[Item, tuple[str, str | None, Item]]


def _closed(first: list[tuple[tuple, Item, str, str | None, Item | None]]) -> tuple[Set, int, Back]:
    """A chart set from its scanned items, with insertions. Least keys first: what an insertion starts from is settled before it."""
    heap = list(first)
    heapq.heapify(heap)
    keys: dict[Item, tuple] = {}
    back: Back = {}
    while heap:
        key, item, letter, role, source = heapq.heappop(heap)
        if item in keys:
            continue
        keys[item] = key
        if source is not None:
            back[item] = (letter, role, source)
        for initial, to in _next(item).items():
            if initial in ROLES and to not in keys:
                heapq.heappush(heap, ((key[0] + INSERT, "I", key), to, "I", ROLES[initial], item))
    least = min(k[0] for k in keys.values())
    order = {k: i for i, k in enumerate(sorted(set(keys.values())))}
    return Set(tuple(sorted((item, k[0] - least, order[k]) for item, k in keys.items()))), least, back


def _begin() -> tuple[Set, int, Back]:
    return _closed([((0, "", ()), ORIGIN, "", None, None)])


@cache
def _step(before: Set, turn: Turn) -> tuple[Set, int, Back]:
    """The set after one more row. A key is (cost, letter, rank before): equal costs and letters come from sets of equal cost."""
    found = []
    for item, cost, rank in before.items:
        found.append(((cost + DELETE, "D", (rank,)), item, "D", None, item))
        if not turn.must_go:
            price = cost + TRUNCATED * turn.truncated
            scans = _next(item)
            if turn.initial in scans:
                found.append(((price + KEEP, "K", (rank,)), scans[turn.initial], "K", None, item))
            for initial, role in ROLES.items():
                if initial in scans:
                    found.append(((price + REROLE, "R", (rank,)), scans[initial], "R", role, item))
    return _closed(found)


def parse(turns: list[Turn]) -> tuple[int, list[tuple[str, str | None]]]:
    """Least cost, and its edits from the first row on: (letter, role given by R and I). Of equal costs the ASCII-least audit."""
    at, cost, back = _begin()
    chart = [back]
    for turn in reversed(turns):
        at, more, back = _step(at, turn)
        cost += more
        chart.append(back)
    item, extra, _ = min((x for x in at.items if _complete(x[0])), key=lambda x: x[1:])
    edits, k = [], len(turns)
    while k or item != ORIGIN:
        letter, role, item = chart[k][item]
        edits.append((letter, role))
        k -= letter != "I"
    return cost + extra, edits


def _turn(role: str, text: str, seen: set[bytes]) -> tuple[str | None, Turn]:
    """A row's first fault, and what the grammar sees of it."""
    name = role.encode()
    mark = hashlib.blake2b(b"%d:%b:%b" % (len(name), name, text.encode()), digest_size=16).digest()
    said = text.rstrip(SPACE)
    fault = "blank" if not said else "duplicate" if mark in seen else "truncated" if said[-1] not in ".!?" else None
    seen.add(mark)
    return fault, Turn(role[:1] if role[:1] in TERMINALS else "", fault in ("blank", "duplicate"), fault == "truncated")


class _Rows:
    """Turn, role and text of a conversation's rows, in memory up to HELD characters and else in a file that goes by itself."""

    def __init__(self):
        self.part, self.size, self.file = [], 0, None

    def add(self, row: tuple) -> None:
        self.part.append(row)
        self.size += len(row[2]) + 50
        if self.size > HELD:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.part, self.file)
            self.part, self.size = [], 0

    def __iter__(self) -> Iterator[tuple]:
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
            self.file.close()
        yield from self.part


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Key and rows of each run of equal keys. The rows must be taken before the next run."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    row = next(rows, None)

    def run(key) -> Iterator[tuple]:
        nonlocal row
        while row is not None and row[0] == key:
            yield row[1:]
            row = next(rows, None)

    while row is not None:
        yield row[0], run(row[0])


def _edits(key, rows: Iterator[tuple]) -> Iterator[tuple]:
    held, turns, faults, seen = _Rows(), [], [], set()
    for turn, role, text in rows:
        fault, seen_as = _turn(role, text, seen)
        held.add((turn, role, text))
        turns.append(seen_as)
        faults.append(fault)
    _, edits = parse(turns)
    left, k = iter(held), 0
    for step, (letter, given) in enumerate(edits):
        if letter == "I":
            yield key, step, letter, INSERT, None, None, None, given, ""
            continue
        turn, role, text = next(left)
        cost = {"K": KEEP, "R": REROLE, "D": DELETE}[letter] + TRUNCATED * (letter != "D" and faults[k] == "truncated")
        yield key, step, letter, cost, turn, faults[k], role, given or role, text
        k += 1


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, characters: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(part) >= most or size >= characters:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def repair_conversations(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits that make each conversation a sequence of the grammar, one row each, in order of `step` (from 0).

    Columns: key, step, edit (K, R, D or I), cost, order, fault (of the row: blank, duplicate, truncated or null), role_was, role
    and text after repair; inserted turns have no order, fault and role_was, and an empty text. Rows of D aren't in the
    repaired conversation. The rows of a conversation lie together and in order within a partition.

    Rows are taken by order (nulls first), then role and text; a null role or text is one space, so such a text is blank. A null
    key is a conversation of its own. Repeated rows are duplicates and go. Other columns are left out; an empty table gives no
    rows. A conversation is parsed by one task, as its digest is one sequence, but its rows are sorted by Spark, only marks of
    them are held, and texts beyond HELD characters wait in a file; a very long text is held alone.
    """
    c = lambda name: F.col(f"`{name}`")
    said = lambda name: F.coalesce(c(name).cast("string"), F.lit(" "))
    own = rows.select(c(key).alias("key"), c(order).alias("turn"), said(role).alias("role"), said(text).alias("text"))
    kind = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    sorted_ = own.repartition("key").sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        types = [first.schema.field("key").type, pa.int64(), pa.string(), pa.int64(), first.schema.field("turn").type, *[pa.string()] * 4]
        schema = pa.schema(list(zip(("key", "step", "edit", "cost", "turn", "fault", "role_was", "role", "text"), types, strict=True)))

        def all_() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        yield from _batched((e for k, own in _runs(all_()) for e in _edits(k, own)), schema)

    out = sorted_.mapInArrow(run, f"key {kind['key']}, step long, edit string, cost long, turn {kind['turn']}, fault string, role_was string, role string, text string")
    return out.select(F.col("key").alias(key), "step", "edit", "cost", F.col("turn").alias(order), "fault", "role_was", F.col("role").alias(role), F.col("text").alias(text))


#: Pairs of initials that may follow each other.
LEGAL = ("su", "ua", "au")


def _digest(rows: Iterator[tuple]) -> tuple:
    """rows: edit, cost, turn, fault, role_was, role, text, in order of step."""
    faults, cost, letters, turns, illegal, before = dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, [], set(), 0, None
    sha, some = hashlib.sha256(), False
    for edit, price, turn, fault, was, role, text in rows:
        letters.append(edit)
        cost += price
        if fault:
            faults[fault] += 1
        if edit != "I":
            illegal += before is not None and before + was[:1] not in LEGAL
            before = was[:1]
            if turn is not None:
                turns.add(turn)
        if edit != "D":
            sha.update(("\n" * some + role + ":" + text).encode())
            some = True
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *faults.values(), illegal, cost, "".join(letters), sha.hexdigest()


def reports(edits: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation of `repair_conversations`, in whose partitions they still lie: gaps, faults, cost, audit, hash.

    order has whole numbers or nulls. Conversations without rows have no edits and so no report.
    """
    c = lambda name: F.col(f"`{name}`")
    own = edits.select(c(key).alias("key"), "edit", "cost", c(order).cast("long"), "fault", "role_was", c(role), c(text))
    kind = own.schema["key"].dataType.simpleString()
    names = ("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema(list(zip(names, [first.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)))

        def all_() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        yield from _batched(((k, *_digest(rows)) for k, rows in _runs(all_())), schema)

    out = own.mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} long" for n in names[1:7]) + ", audit string, repaired_sha256 string")
    return out.withColumnRenamed("key", key)


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by the checksum of key and turn; 0 drops a row, 3 gives it twice."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    at: Column = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    held = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), at.alias("at")).where("at <> 0")
    text = F.when(F.col("at") == 1, "").when(F.col("at") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("at") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return held.select("conv_id", "turn", F.when(F.col("at") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_earley_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation of the table; those that lost all rows have zeros, an empty audit and the hash of nothing. Ties of turn go by role and text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = reports(repair_conversations(damage(rows)))
    ids = rows.select("conv_id").distinct()
    joined = ids.alias("i").join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("i.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _crc_sql(value: str) -> str:
    """CRC-32 of an ASCII string, byte by byte and bit by bit."""
    byte = "list_reduce([xor(acc, b)] || range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({value}, ''), lambda x: ord(x)::BIGINT), lambda acc, b: {byte}), 4294967295)"


def _best(*options: str) -> str:
    """Least (cost, audit) of some."""
    return f"list_min([{', '.join(options)}])"


def _put(letter: str, cost: str, state: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': '{letter}' || {state}.a}}"


def _sql() -> str:
    """The same rows by recursion from the last row on, with the states of a plain automaton.

    0 start, 1 after s, 2 after u, 3 after a. w: least (cost, audit) of what follows, v: with insertions.
    """
    never = "{'c': 1000000000, 'a': ''}"
    closed = lambda w: [_best(w[0], _put("I", "3", _best(w[2], _put("I", "3", w[3])))), _best(w[1], _put("I", "3", _best(w[2], _put("I", "3", w[3])))), _best(w[2], _put("I", "3", w[3])), _best(w[3], _put("I", "3", w[2]))]
    ends = closed(["{'c': 0, 'a': ''}", never, never, "{'c': 0, 'a': ''}"])
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    w = []
    for q, edges in after.items():
        options = [_put("D", "4", f"p.v{q}")]
        for initial, to in edges.items():
            options.append(f"CASE WHEN p.go = 0 AND p.i = '{initial}' THEN {_put('K', '3 * p.tr', f'p.v{to}')} ELSE {never} END")
            if initial != "s":
                options.append(f"CASE WHEN p.go = 0 THEN {_put('R', '3 + 3 * p.tr', f'p.v{to}')} ELSE {never} END")
        w.append(_best(*options))
    steps = ", ".join(f"{x} AS v{q}" for q, x in enumerate(closed(["p.w0", "p.w1", "p.w2", "p.w3"])))
    inner = ", ".join(f"{x} AS w{q}" for q, x in enumerate(w))
    return f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, {_crc_sql('k')} % 20 AS harm FROM c),
d AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
  CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE harm <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS said FROM d),
f AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
  lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS was, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
r(conv_id, pos, v0, v1, v2, v3) AS (
  SELECT conv_id, n, {', '.join(ends)} FROM f WHERE i = n
  UNION ALL
  SELECT conv_id, pos, v0, v1, v2, v3 FROM (SELECT conv_id, pos - 1 AS pos, {steps} FROM (SELECT conv_id, pos, {inner} FROM (
    SELECT r.*, left(f.role, 1) AS i, (coalesce(f.fault, '') IN ('blank', 'duplicate'))::INT AS go, (coalesce(f.fault, '') = 'truncated')::INT AS tr
    FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.pos) AS p) AS p)),
b AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM r WHERE pos = 0),
e AS (SELECT conv_id, unnest(string_split(audit, '')) AS x, generate_subscripts(string_split(audit, ''), 1) AS step, audit FROM b WHERE audit <> ''),
s AS (SELECT *, sum((x <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY step) AS i, sum((x <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY step) AS m,
  sum((x <> 'D')::INT) OVER (PARTITION BY conv_id) AS total FROM e),
t AS (SELECT s.conv_id, s.step, CASE WHEN x = 'K' THEN f.role WHEN (s.total - s.m) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN x = 'I' THEN '' ELSE f.text END AS line
  FROM s LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i WHERE x <> 'D'),
y AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY step)) AS sha FROM t GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND left(was, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM z.conv_id
"""


ORACLE_SQL = _sql()
