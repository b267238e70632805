"""Repair of conversation structure by lightest derivations (Knuth's agenda).

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``: an optional
system turn, then user and assistant turns by turns, or nothing at all. The cheapest edits that
make it so are found as the lightest derivation of a weighted deduction system:

* an item (i, q) says that the first i rows were edited to something that state q accepts: 0
  nothing yet, 1 a system turn, 2 after a user turn, 3 after an assistant turn;
* deductions lead from (i, q) to (i + 1, q') by keeping, re-roling or deleting row i, and from
  (i, q) to (i, q') by inserting a turn; the goal follows from (n, 0) and (n, 3);
* a value is (cost, audit), the audit being the initials of the edits: K(eep) 0, R(erole) 3,
  D(elete) 4, I(nsert) 3, and 3 more for a truncated row that stays. Blank and duplicate rows
  must go.

A deduction adds a cost and a letter, so its value exceeds that of the item it starts from, and
of two values of one item the smaller one stays smaller: two audits of one item that cost the
same cannot be prefixes of each other, as what the longer one has more would be inserts. Such
functions are superior, so an item is final when the agenda pops it, by cost and then by audit.
The audit decides the result, since in each state only one role may be inserted or re-roled to.

Conversations are streams: Spark sends the rows of each, in order, to one task, which derives
``SEGMENT`` rows at a time. Items over ``SLACK`` dearer than the cheapest can never win, since
any later path can be had from any state for at most 7 more. What all remaining items agree on
is settled: it goes to the checksum or the output, and its rows are let go. So memory depends
on the rows that are still undecided, not on the conversation, which may hold a third of all
rows; the checksum of its text has to be taken by one task, in order, whatever the method.

Order within a conversation: turn (nulls first), role, text. Null roles and texts are one
space, in checksums of keys also null ids and turns; an empty role has no initial and cannot
be kept. Rows without conv_id are one conversation. Repeated rows are duplicates. A
conversation without rows (after damage) has zeros, an empty audit and the checksum of the
empty string. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staysearch.llm.common import freeing, small_batches

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
# The role that a row may get, or that an inserted turn has, in each state.
OWN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ACCEPTING = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SLACK = 7
SEGMENT = 256
SPACES = " \t\n\x0b\x0c\r"
GONE, SOUND, CUT_OFF = 0, 1, 2


@dataclass
class Row:
    role: str
    text: str
    #: GONE if it must be deleted, CUT_OFF if truncated.
    state: int


def derive(rows: list[Row], axioms: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """Lightest values of the items after all ``rows``, by state, from the items before them.

    If these are the last rows, only the lightest item that reaches the goal; else all that
    are at most ``SLACK`` dearer than the cheapest.
    """
    n, best = len(rows), {}
    agenda = [(cost, audit, 0, state) for state, (cost, audit) in axioms.items()]
    heapq.heapify(agenda)
    final, bound = set(), None
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        if bound is not None and cost > bound:
            break
        final.add((i, q))
        if i == n:
            if last and q in ACCEPTING:
                return {q: (cost, audit)}
            if not last:
                best[q] = (cost, audit)
                bound = cost + SLACK if bound is None else bound
        else:
            row = rows[i]
            heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, q))
            if row.state != GONE:
                stays = cost + (TRUNCATED if row.state == CUT_OFF else 0)
                kept = NEXT[q].get(row.role[:1])
                if kept is not None:
                    heapq.heappush(agenda, (stays + KEEP, audit + "K", i + 1, kept))
                heapq.heappush(agenda, (stays + REROLE, audit + "R", i + 1, OWN[q][1]))
        heapq.heappush(agenda, (cost + INSERT, audit + "I", i, OWN[q][1]))
    return best


@dataclass
class Repair:
    """The repair of one conversation whose rows come one after the other."""

    waiting: list[Row] = field(default_factory=list)
    undecided: list[Row] = field(default_factory=list)
    items: dict[int, tuple[int, str]] = field(default_factory=lambda: {START: (0, "")})
    state: int = START  # of what is settled
    audit: list[str] = field(default_factory=list)

    def add(self, row: Row) -> Iterator[tuple[str, str]]:
        """Takes a row; gives the repaired turns (role, text) that it settles."""
        self.waiting.append(row)
        return self._advance(False) if len(self.waiting) >= SEGMENT else iter(())

    def finish(self) -> Iterator[tuple[str, str]]:
        return self._advance(True)

    @property
    def cost(self) -> int:
        return min(cost for cost, _ in self.items.values())

    def _advance(self, last: bool) -> Iterator[tuple[str, str]]:
        self.items = derive(self.waiting, self.items, last)
        self.undecided += self.waiting
        self.waiting = []
        audits = [audit for _, audit in self.items.values()]
        least, most = min(audits), max(audits)
        k = next((i for i, (a, b) in enumerate(zip(least, most)) if a != b), min(len(least), len(most)))
        self.items = {q: (cost, audit[k:]) for q, (cost, audit) in self.items.items()}
        self.audit.append(least[:k])
        return self._settle(least[:k])

    def _settle(self, letters: str) -> Iterator[tuple[str, str]]:
        used = 0
        for letter in letters:
            row = None
            if letter != "I":
                row, used = self.undecided[used], used + 1
            if letter == "D":
                continue
            if letter == "K":
                role, self.state = row.role, NEXT[self.state][row.role[:1]]
            else:
                role, self.state = OWN[self.state]
            yield role, row.text if row else ""
        del self.undecided[:used]


def edits(rows: list[tuple[str, str, int]]) -> tuple[int, str, list[tuple[str, str]]]:
    """Cost, audit and repaired turns of one conversation of (role, text, state) rows."""
    work, turns = Repair(), []
    for row in rows:
        turns += work.add(Row(*row))
    turns += work.finish()
    return work.cost, "".join(work.audit), turns


# -- tables ----------------------------------------------------------------------


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, with ``live`` true: what a repair starts from."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _spaced("role").alias("role"),
        _spaced("text").alias("text"),
        F.lit(True).alias("live"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after damage by a checksum of their key. Dropped ones stay as not ``live``."""
    key = F.concat_ws(":", _spaced("conv_id"), _spaced("turn"))
    kind = F.crc32(key.cast("binary")) % 20
    rows = turns(conversations.select("conv_id", "turn", "role", "text")).drop("live")
    return rows.withColumn("damage", kind).select(
        "conv_id",
        "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "")
        .when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("damage") != 0).alias("live"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _arranged(rows: DataFrame) -> DataFrame:
    """Rows with their fault, in order, all of a conversation in one partition.

    One exchange by conversation; the window within it sorts and numbers equal turns.
    """
    small_batches(rows.sparkSession)
    equal = Window.partitionBy("conv_id", "live", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    visible = F.btrim("text", F.lit(SPACES))
    fault = (
        F.when(visible == "", "blank")
        .when(F.col("number") > 1, "duplicate")
        .when(~F.substring(visible, -1, 1).isin(".", "!", "?"), "truncated")
    )
    return (
        rows.repartition("conv_id")
        .withColumn("number", F.row_number().over(equal))
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "number")
        .select("conv_id", "turn", "role", "text", "live", fault.alias("fault"))
    )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, first row?, turn, role, text, live, fault) of the sorted rows."""
    before = object()
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            yield row[0], row[0] != before, *row[1:]
            before = row[0]


@dataclass
class Report:
    """What is counted while a conversation's rows pass."""

    conv_id: int | None
    repair: Repair = field(default_factory=Repair)
    digest: object = field(default_factory=hashlib.sha256)
    rows: int = 0
    illegal: int = 0
    previous: str = ""
    turns: int = 0
    low: int | None = None
    high: int | None = None
    faults: dict[str, int] = field(default_factory=lambda: {"blank": 0, "duplicate": 0, "truncated": 0})
    written: int = 0

    def take(self, turn: int | None, role: str, text: str, fault: str | None) -> Iterator[tuple[str, str]]:
        initial = role[:1]
        if self.rows and self.previous + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.previous, self.rows = initial, self.rows + 1
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault:
            self.faults[fault] += 1
        state = GONE if fault in ("blank", "duplicate") else CUT_OFF if fault else SOUND
        return self.write(self.repair.add(Row(role, text, state)))

    def write(self, done: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
        for role, text in done:
            self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode())
            self.written += 1
            yield role, text

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def reported(rows: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the cheapest repair, and the result's checksum.

    ``rows`` come from :func:`turns` or :func:`damaged`.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None

        def close() -> None:
            for _ in now.write(now.repair.finish()):
                pass
            done.append(
                (now.conv_id, now.gaps, *now.faults.values(), now.illegal, now.repair.cost, "".join(now.repair.audit), now.digest.hexdigest())
            )

        for conv_id, first, turn, role, text, live, fault in _conversations(batches):
            if first:
                if now:
                    close()
                now = Report(conv_id)
                if len(done) >= 1000:
                    yield _table(done, REPORT)
                    done = []
            if live:
                for _ in now.take(turn, role, text, fault):
                    pass
        if now:
            close()
        if done:
            yield _table(done, REPORT)

    return _arranged(rows).mapInArrow(freeing(step), REPORT)


REPAIRED = "conv_id long, turn long, role string, text string"


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, turn (from 0), role and text."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size = None, [], 0
        for conv_id, first, turn, role, text, live, fault in _conversations(batches):
            if first:
                if now:
                    out += numbered(now, now.write(now.repair.finish()))
                now = Report(conv_id)
            if live:
                out += numbered(now, now.take(turn, role, text, fault))
                size += len(text)
            if len(out) >= 1000 or size > 1 << 20:
                if out:
                    yield _table(out, REPAIRED)
                out, size = [], 0
        if now:
            out += numbered(now, now.write(now.repair.finish()))
        if out:
            yield _table(out, REPAIRED)

    def numbered(now: Report, done: Iterator[tuple[str, str]]) -> list[tuple]:
        return [(now.conv_id, now.written - 1, role, text) for role, text in done]

    return _arranged(rows).mapInArrow(freeing(step), REPAIRED)


KINDS = {"long": pa.int64(), "string": pa.string()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = [pa.array(values, KINDS[kind]) for values, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.record_batch(columns, [name for name, _ in fields])


def repair_report(conversations: DataFrame) -> DataFrame:
    return reported(damaged(conversations))


ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(
      list_concat([4294967295::BIGINT], flatten(
        [[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]
         FOR c IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')])),
      lambda acc, x: CASE WHEN xor(acc, x) & 1 = 1
        THEN xor(xor(acc, x) >> 1, 3988292384::BIGINT) ELSE xor(acc, x) >> 1 END) AS crc
  FROM conversations
), hit AS (
  SELECT *, xor(crc, 4294967295::BIGINT) % 20 AS damage FROM keyed
), live AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) WHERE damage <> 0
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS copy,
    trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS visible
  FROM live
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM seen
), rows_ AS (
  SELECT *, role[1:1] AS initial,
    CASE WHEN visible = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate'
         WHEN visible[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS pair
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM rows_ GROUP BY conv_id
), inserts(q, role, q2) AS (
  VALUES (0, ['user:'], 2), (0, ['user:', 'assistant:'], 3), (1, ['user:'], 2), (1, ['user:', 'assistant:'], 3),
         (2, ['assistant:'], 3), (3, ['user:'], 2),
         (0, []::VARCHAR[], 0), (1, []::VARCHAR[], 1), (2, []::VARCHAR[], 2), (3, []::VARCHAR[], 3)
), reads(q, initial, q2) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), items AS (
  -- Items after i rows and the inserts that follow them: the lightest (cost, audit) of each state.
  SELECT conv_id, 0::BIGINT AS i, q2 AS q,
    {'cost': 3 * len(role)::BIGINT, 'audit': repeat('I', len(role)), 'lines': role} AS best
  FROM counted, inserts WHERE q = 0
  UNION ALL
  SELECT conv_id, i, q2 AS q, min({'cost': cost + 3 * len(ins), 'audit': audit || repeat('I', len(ins)), 'lines': list_concat(lines, ins)}) AS best
  FROM (
    SELECT e.conv_id, e.i, e.cost, e.audit, e.lines, x.role AS ins, x.q2
    FROM (
      SELECT t.conv_id, t.i + 1 AS i, t.q, t.best.cost + 4 AS cost, t.best.audit || 'D' AS audit, t.best.lines AS lines
      FROM items t JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i + 1
      UNION ALL
      SELECT t.conv_id, t.i + 1, s.q2, t.best.cost + CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END,
        t.best.audit || 'K', list_append(t.best.lines, r.role || ':' || r.text)
      FROM items t JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i + 1
      JOIN reads s ON s.q = t.q AND s.initial = r.initial
      WHERE r.fault NOT IN ('blank', 'duplicate')
      UNION ALL
      SELECT t.conv_id, t.i + 1, s.q2, t.best.cost + CASE WHEN r.fault = 'truncated' THEN 6 ELSE 3 END,
        t.best.audit || 'R', list_append(t.best.lines, CASE s.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text)
      FROM items t JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i + 1
      JOIN reads s ON s.q = t.q AND s.initial <> 's'
      WHERE r.fault NOT IN ('blank', 'duplicate')
    ) e JOIN inserts x ON x.q = e.q
  ) GROUP BY conv_id, i, q2
), goals AS (
  SELECT t.conv_id, min(t.best) AS best
  FROM items t JOIN counted c ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND c.n = t.i
  WHERE t.q IN (0, 3) GROUP BY t.conv_id
), every AS (
  SELECT DISTINCT conv_id FROM conversations
)
SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(g.best.cost, 0)::BIGINT AS cost,
  coalesce(g.best.audit, '') AS audit, sha256(coalesce(array_to_string(g.best.lines, chr(10)), '')) AS repaired_sha256
FROM every e
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN goals g ON g.conv_id IS NOT DISTINCT FROM e.conv_id
"""
