"""Repair of conversation structure by weighted finite-state composition.

Three machines: an acceptor of a conversation's rows in order, a transducer of edits and an acceptor of role grammars. An
edit reads a row (keep K, rerole R, delete D) or none (insert I) and writes a role's initial or none. Their composition has
the states (rows read, grammar state) and is expanded as rows are read: the arcs of one row, with the insertions before it,
are a 4 x 4 table that depends on the row's kind only. States come in topological order, so one pass finds the shortest
path. Weights are pairs (cost, string of edits), the lesser is better, and are extended on the right.

Strings are not kept: after each row the strings of the four states are ranked. Each ends with an edit that reads a row, so
none is a proper prefix of another, and what is appended can't turn their order. A row costs five bytes until its
conversation ends, which the audit string of the result takes as well. Texts are not part of the search: the edits are
joined with them afterwards and hashed as a stream.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import durable
from .hashing import release_memory

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: Cost of each truncated row that is kept.
TRUNCATED = 1
ROLES = {"u": "user", "a": "assistant"}
#: The acceptor of ``(s?(ua)+)?``: (state, initial) -> state.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
STATES = 4
#: Adjacent initials that are in order.
LEGAL = ("su", "ua", "au")
_NOT_SPACE = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive) with faults by crc32 of ``conv_id:turn`` modulo 20; nulls count as one space.

    0 drops the row (alive is false), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    one = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))) % 20
    role, text = F.coalesce(F.col("role").cast("string"), one), F.coalesce(F.col("text").cast("string"), one)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), (kind != 0).alias("alive"), F.explode(times).alias("time"))
    return out.drop("time")


@functools.cache
def _insertions(state: int) -> tuple[tuple[int, str], ...]:
    """(state, initials) that insertions alone reach, by the fewest."""
    found = {state: ""}
    todo = [state]
    for g in todo:
        for initial in ROLES:
            to = GRAMMAR.get((g, initial))
            if to is not None and to not in found:
                found[to] = found[g] + initial
                todo.append(to)
    return tuple(found.items())


@functools.cache
def _arcs(initial: str, faulty: bool, truncated: bool) -> tuple[tuple[tuple[int, str, int, str, str], ...], ...]:
    """For each state after a row the best arcs from the states before it: (cost, edits, state before, inserted
    initials, the row's new initial or '')."""
    best: list[dict[int, tuple[int, str, int, str, str]]] = [{} for _ in range(STATES)]
    late = TRUNCATED * truncated
    for g in range(STATES):
        for via, put in _insertions(g):
            ahead, cost = "I" * len(put), INSERT * len(put)
            arcs = [(DELETE, "D", via, "")]
            if not faulty:
                arcs += [(KEEP + late, "K", GRAMMAR.get((via, initial)), "")] + [(REROLE + late, "R", GRAMMAR.get((via, r)), r) for r in ROLES]
            for c, edit, to, role in arcs:
                if to is not None:
                    arc = (cost + c, ahead + edit, g, put, role)
                    if g not in best[to] or arc < best[to][g]:
                        best[to][g] = arc
    return tuple(tuple(b.values()) for b in best)


class Search:
    """The shortest path through the composition with the rows read so far."""

    def __init__(self) -> None:
        self.costs: list[int | None] = [0] + [None] * (STATES - 1)
        self.ranks = [0] * STATES
        self.kinds: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.rows = bytearray()  # kind of each row, then the state before for each state after it

    def read(self, initial: str, faulty: bool, truncated: bool) -> None:
        kind = (initial if initial in ("s", "u", "a") else "", faulty, truncated)
        arcs = _arcs(*kind)
        if kind not in self.number:
            self.number[kind] = len(self.kinds)
            self.kinds.append(kind)
        costs: list[int | None] = [None] * STATES
        strings: list[tuple[int, str] | None] = [None] * STATES
        before = [0] * STATES
        for to in range(STATES):
            best = None
            for cost, edits, g, _, _ in arcs[to]:
                if self.costs[g] is not None:
                    new = (self.costs[g] + cost, self.ranks[g], edits, g)
                    if best is None or new < best:
                        best = new
            if best is not None:
                costs[to], strings[to], before[to] = best[0], best[1:3], best[3]
        order = {s: k for k, s in enumerate(sorted({s for s in strings if s is not None}))}
        self.costs, self.ranks = costs, [order.get(s, 0) for s in strings]
        self.rows.append(self.number[kind])
        self.rows += bytes(before)

    def end(self) -> tuple[int, str, Iterator[tuple[str, str, str]]]:
        """(cost, initials inserted at the end, and from the last row to the first its inserted initials, edit and role)."""
        best = min((self.costs[g] + INSERT * len(put), self.ranks[g], "I" * len(put), g, put) for g in range(STATES) if self.costs[g] is not None for via, put in _insertions(g) if via in FINAL)

        def back() -> Iterator[tuple[str, str, str]]:
            g = best[3]
            for k in range(len(self.rows) - STATES - 1, -1, -STATES - 1):
                before = self.rows[k + 1 + g]
                arc = next(a for a in _arcs(*self.kinds[self.rows[k]])[g] if a[2] == before)
                yield arc[3], arc[1][-1], arc[4]
                g = before

        return best[0], best[4], back()


_EDITS = "key string, pos long, put string, edit string, given string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edit of each row, and after a conversation's last row its counts, cost and audit string."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 7, pa.string()]
    names = [x.split()[0] for x in _EDITS.split(", ")]
    held: list[tuple] = []
    last = None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def close() -> Iterator[pa.RecordBatch]:
        cost, put, back = search.end()
        edits = bytearray()
        for n, (before, edit, role) in enumerate(back):
            held.append((last, rows - n, before, edit, role, conv, *[None] * 7))
            edits += edit.encode() + b"I" * len(before)
            if len(held) >= 4096:
                yield batch(held)
                held.clear()
        edits.reverse()
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        held.append((last, rows + 1, put, None, None, conv, gaps, *counts, cost, edits.decode() + "I" * len(put)))

    for b in batches:
        for key, conv_id, turn, initial, blank, repeated, truncated, alive in zip(*(b.column(k).to_pylist() for k in ("key", "conv_id", "turn", "initial", "blank", "repeated", "truncated", "alive")), strict=True):
            if key != last:
                if last is not None:
                    yield from close()
                search, rows, turns, counts, previous = Search(), 0, None, [0, 0, 0, 0], None
                last, conv = key, conv_id
            if not alive:
                continue
            rows += 1
            faulty = blank or repeated
            late = truncated and not faulty
            search.read(initial, faulty, late)
            counts[0] += blank
            counts[1] += repeated and not blank
            counts[2] += late
            counts[3] += previous is not None and previous + initial not in LEGAL
            previous = initial
            if turn is not None:
                turns = (turn, turn, 1) if turns is None else (turns[0], turn, turns[2] + (turn != turns[1]))
            if len(held) >= 4096:
                yield batch(held)
                held.clear()
    if last is not None:
        yield from close()
    if held:
        yield batch(held)


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_MESSAGE = "key string, pos long, nth int, conv_id long, role string, text string, edit string"


def edits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``rows`` with their places in their conversations, and the edits that repair these.

    Rows (conv_id, turn, role, text, alive) are in order of turn, nulls first, then role and text; rows with a null
    conv_id are one conversation, null roles and texts one space, and rows that are not alive only name their conversation.
    """
    one = F.lit(" ")
    key = F.coalesce(F.col("conv_id").cast("string"), one)
    role, text = F.coalesce("role", one), F.coalesce("text", one)
    named = rows.select(key.alias("key"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.coalesce("alive", F.lit(True)).alias("alive")).repartition("key")
    order = [F.asc_nulls_first("turn"), "role", "text"]
    placed = named.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("alive"), *order)).cast("long"))
    # equal rows of one turn: the one that is placed first is not the repeated one
    placed = placed.withColumn("repeated", F.row_number().over(Window.partitionBy("key", "alive", "role", "text").orderBy("pos")) > 1)
    facts = placed.select("key", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(_NOT_SPACE)).alias("blank"), "repeated", (~F.col("text").rlike(_ENDED)).alias("truncated"), "alive", "pos")
    return placed.where("alive").select("key", "pos", "role", "text"), facts.sortWithinPartitions("key", "pos").mapInArrow(_solved, _EDITS)


def messages(rows: DataFrame) -> DataFrame:
    """(key, pos, nth, conv_id, role, text, edit): the messages of the repaired conversations in order of pos and nth."""
    placed, found = edits(rows)
    both = found.join(placed, ["key", "pos"], "left")
    put = F.transform(F.filter(F.split("put", ""), lambda c: c != ""), lambda c: F.struct(F.when(c == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("given") == "u", ROLES["u"]).otherwise(ROLES["a"])
    own = F.when(F.col("edit").isin("K", "R"), F.array(F.struct(role.alias("role"), "text", "edit"))).otherwise(F.array().cast("array<struct<role:string,text:string,edit:string>>"))
    out = both.select("key", "pos", "conv_id", F.posexplode(F.concat(put, own)).alias("nth", "m"))
    return out.select("key", "pos", "nth", "conv_id", "m.role", "m.text", "m.edit")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RESULT.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    digest, empty = hashlib.sha256(), True
    for b in batches:
        out = []
        for r in b.to_pylist():
            lines = [ROLES[c] + ":" for c in r["put"]]
            if r["edit"] == "K":
                lines.append(f"{r['role']}:{r['text']}")
            elif r["edit"] == "R":
                lines.append(f"{ROLES[r['given']]}:{r['text']}")
            if lines:
                digest.update(("\n" * (not empty) + "\n".join(lines)).encode())
                empty = False
            if r["edit"] is None:
                out.append((*(r[k] for k in names[:-1]), digest.hexdigest()))
                digest, empty = hashlib.sha256(), True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    release_memory()


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    Without rows that are alive all counts are 0, the audit is empty and the digest that of an empty text.
    """
    durable.bounded_batches(rows.sparkSession)
    placed, found = edits(rows)
    both = found.join(placed, ["key", "pos"], "left").repartition("key").sortWithinPartitions("key", "pos")
    return both.mapInArrow(_digests, _RESULT)


_SPACES = r"\x20\x09-\x0D"
#: Small conversations only: each step takes all conversations a row further and keeps the best path to each state.
ORACLE_SQL = f"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c // 2) ELSE c // 2 END) AS v FROM range(256) r(i))),
n AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') AS key, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT n.*, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(unicode(x) AS BIGINT) FOR x IN string_split(name, '')], lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM n, tab),
d AS (SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM h, (VALUES (0), (1)) o(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
f AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY key, role, text ORDER BY pos) > 1 AS again,
  NOT regexp_matches(text, '[^{_SPACES}]') AS blank, NOT regexp_matches(text, '[.!?][{_SPACES}]*\\z') AS cut FROM p),
r AS (SELECT *, blank OR again AS faulty, cut AND NOT blank AND NOT again AS late, lag(initial) OVER (PARTITION BY key ORDER BY pos) || initial AS pair FROM f),
c(g, via, put, said) AS (VALUES (0, 0, '', ''), (0, 2, 'I', chr(10) || 'user:'), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, '', ''), (1, 2, 'I', chr(10) || 'user:'), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, '', ''), (2, 3, 'I', chr(10) || 'assistant:'), (3, 3, '', ''), (3, 2, 'I', chr(10) || 'user:')),
gr(via, need, onto) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
a AS (SELECT via, 'D' AS e, CAST(NULL AS VARCHAR) AS need, via AS onto, CAST(NULL AS VARCHAR) AS given, 3 AS price FROM (VALUES (0), (1), (2), (3)) v(via) UNION ALL SELECT via, 'K', need, onto, CAST(NULL AS VARCHAR), 0 FROM gr
  UNION ALL SELECT via, 'R', CAST(NULL AS VARCHAR), onto, CASE need WHEN 'u' THEN 'user' ELSE 'assistant' END, 2 FROM gr WHERE need <> 's'),
s AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS pos, 0 AS g, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS body FROM n UNION ALL
  SELECT key, pos, g, cost, audit, body FROM (SELECT s.key, r.pos, a.onto AS g, s.cost + 2 * length(c.put) + a.price + CASE WHEN a.e <> 'D' AND r.late THEN 1 ELSE 0 END AS cost, s.audit || c.put || a.e AS audit,
    s.body || c.said || CASE a.e WHEN 'D' THEN '' ELSE chr(10) || coalesce(a.given, r.role) || ':' || r.text END AS body
    FROM s JOIN r ON r.key = s.key AND r.pos = s.pos + 1 JOIN c ON c.g = s.g JOIN a ON a.via = c.via AND (a.e = 'D' OR (NOT r.faulty AND (a.e = 'R' OR a.need = r.initial))))
  QUALIFY row_number() OVER (PARTITION BY key, g ORDER BY cost, audit) = 1),
z AS (SELECT s.key, s.cost + 2 * length(c.put) AS cost, s.audit || c.put AS audit, s.body || c.said AS body FROM s JOIN (SELECT key, max(pos) AS pos FROM s GROUP BY key) m ON m.key = s.key AND m.pos = s.pos JOIN c ON c.g = s.g AND c.via IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY s.key ORDER BY s.cost + 2 * length(c.put), s.audit || c.put) = 1),
q AS (SELECT key, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (late) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY key)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(substr(body, 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM n) i JOIN z USING (key) LEFT JOIN q USING (key)
"""
