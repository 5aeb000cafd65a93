"""Conversation structure repair: the cheapest edits that turn a damaged conversation into ``(s?(ua)+)?``.

A retained-subsequence dynamic programme over the turns of a conversation, in order. What may be retained is a turn as it
is or with another role; everything else follows from which turns are retained:

* turns between two retained ones are deleted, which costs a constant each. Carried as a prefix sum, this makes "the best
  retained turn before this one" a running minimum for each state (nothing yet, last role s, u or a),
* the pair of the last retained role and the next one determines the turns to insert between them (``u, u`` needs an a,
  ``s, a`` a u), and so does the last role at the end,
* edits of equal cost are told apart by their audit string. In the ASCII-least string deletions stand before insertions,
  so the four running minima always end in a letter that consumed a turn: none is a prefix of another, and which is least
  never changes as letters are appended. Four ranks therefore stand for the four strings.

A turn costs a few operations whatever the length of its conversation, and nothing is kept of a turn but one byte for each
state. The hash of the repaired text goes along, one digest state for each running minimum.

Plan: rows are damaged by native expressions and meet by conversation in one shuffle. There repeated turns are numbered by
a window over (conversation, role, text), the rows sorted by turn (both sorts spill) and streamed in Arrow batches through
the programme, whose state is carried from batch to batch. A conversation of any length thus needs no more memory than its
audit string. It stays in one task because a SHA-256 of its text is defined only from its first row to its last; no other
conversation waits behind it, since each task gets a share of the ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: What an edit costs; an undeleted truncated turn adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NONE, S, U, A = range(4)
ROLES = {U: "user", A: "assistant"}
#: The roles to insert between the last retained turn and a next one in that state; pairs that are not listed are illegal.
BETWEEN = {(NONE, S): (), (NONE, U): (), (NONE, A): (U,), (S, U): (), (S, A): (U,), (U, U): (A,), (U, A): (), (A, U): (), (A, A): (U,)}
#: What makes the end legal.
AT_END = {NONE: (), S: (U, A), U: (A,), A: ()}
LEGAL_PAIRS = {"su", "ua", "au"}
FAULTS = ("ok", "blank", "duplicate", "truncated")

SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"


class Digest:
    """The repaired turns of a path so far, joined by newlines, as a hash."""

    __slots__ = ("hash", "some")

    def __init__(self):
        self.hash, self.some = hashlib.sha256(), False

    def then(self, turns: list[bytes]) -> Digest:
        out = Digest.__new__(Digest)
        out.hash, out.some = self.hash.copy(), True
        out.hash.update((b"\n" if self.some else b"") + b"\n".join(turns))
        return out

    def done(self) -> str:
        return self.hash.hexdigest()


class Joined:
    """The same as a text, for callers that want the repaired conversation itself; as large as the conversation."""

    __slots__ = ("turns",)

    def __init__(self, turns: tuple[bytes, ...] = ()):
        self.turns = turns

    def then(self, turns: list[bytes]) -> Joined:
        return Joined((self.turns, *turns))

    def done(self) -> str:
        parts, at = [], self.turns
        while at:
            parts.extend(reversed(at[1:]))
            at = at[0]
        return b"\n".join(reversed(parts)).decode()


class Repair:
    """The programme for one conversation: ``add`` its turns in order, then ``finish``."""

    def __init__(self, text=Digest):
        #: cost of the best edits that end in a state (None: cannot be), rank of their audits, their text
        self.cost: list[int | None] = [0, None, None, None]
        self.rank = [0, 0, 0, 0]
        self.text = [text(), None, None, None]
        #: For each turn and state, where its best edits come from: state before * 4 + letter (0 D, 1 K, 2 R).
        self.steps = bytearray()
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal, self.last, self.turns = 0, "", None

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        first = role[:1]
        self.counts[fault] += 1
        if self.steps:
            self.illegal += self.last + first not in LEGAL_PAIRS
        self.last = first
        if turn is not None:
            if self.turns is None:
                self.turns = [turn, turn, 1, turn]
            elif turn != self.turns[3]:
                self.turns[1:] = [turn, self.turns[2] + 1, turn]
        extra = TRUNCATED if fault == "truncated" else 0
        best: list[tuple | None] = [None] * 4
        for before, cost in enumerate(self.cost):
            if cost is not None:
                best[before] = (cost + DELETE, self.rank[before], "D", before)
        if fault in ("ok", "truncated"):
            for to in (S, U, A):
                kept = first == "_sua"[to]
                if not kept and to == S:
                    continue
                for before in range(4):
                    between = BETWEEN.get((before, to))
                    if between is None or self.cost[before] is None:
                        continue
                    cost = self.cost[before] + INSERT * len(between) + (0 if kept else REROLE) + extra
                    found = (cost, self.rank[before], "I" * len(between) + ("K" if kept else "R"), before)
                    if best[to] is None or found < best[to]:
                        best[to] = found
        order = sorted((b[1], b[2], to) for to, b in enumerate(best) if b)
        rank = [0] * 4
        for k, (_, _, to) in enumerate(order):
            rank[to] = k
        texts = []
        for to, b in enumerate(best):
            self.steps.append(0 if b is None else b[3] * 4 + "DKR".index(b[2][-1]))
            if b is None or b[2] == "D":
                texts.append(b and self.text[to])
            else:
                mine = f"{role if b[2][-1] == 'K' else ROLES[to]}:{text}".encode()
                texts.append(self.text[b[3]].then([*(f"{ROLES[i]}:".encode() for i in BETWEEN[b[3], to]), mine]))
        self.cost, self.rank, self.text = [b and b[0] for b in best], rank, texts

    def finish(self) -> tuple[int, str, str]:
        """(cost, audit, repaired): the text's hash, or the text, as asked for."""
        found = [(cost + INSERT * len(AT_END[at]), self.rank[at], at) for at, cost in enumerate(self.cost) if cost is not None]
        cost, _, at = min(found)
        text = self.text[at].then([f"{ROLES[i]}:".encode() for i in AT_END[at]]) if AT_END[at] else self.text[at]
        letters = bytearray(b"I" * len(AT_END[at]))
        for k in range(len(self.steps) - 4, -1, -4):
            before, letter = divmod(self.steps[k + at], 4)
            letters.append(b"DKR"[letter])
            if letter:
                letters.extend(b"I" * len(BETWEEN[before, at]))
            at = before
        letters.reverse()
        return cost, letters.decode(), text.done()

    def row(self) -> tuple:
        t = self.turns
        return (t[1] - t[0] + 1 - t[2] if t else 0, self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.illegal, *self.finish())


def damage(rows: DataFrame) -> DataFrame:
    """Damaged ``rows`` (conv_id, turn, role, text): by crc32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its text,
    2 removes its ``.!?``, 3 repeats it, 4 makes its role user. A null counts as one space; a null turn stays null."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")


def fault(text: Column, place: Column) -> Column:
    """The first fault of a turn, the ``place``-th of its role and text in its conversation."""
    said = F.regexp_replace(text, r"[\x20\x09-\x0D]+\z", "")
    return F.when(said == "", "blank").when(place > 1, "duplicate").when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated").otherwise("ok")


def repair(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): gaps, faults and illegal pairs, cost and audit of the
    cheapest edits, and the SHA-256 of the repaired turns (``with_text``: these turns themselves), as in SCHEMA.

    Turns without a number come first; turns of equal number are ordered by role and text. Rows without a conv_id are one
    conversation. A null role or text is one space. Without rows there are no conversations. Other columns are not read.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    # what the window needs, rows of a conversation together, is given by the repartition: one shuffle
    rows = rows.repartition(F.col("conv_id")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    alike = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.select("conv_id", "turn", "role", "text", fault(F.col("text"), F.row_number().over(alike)).alias("fault"))
    # a duplicate is no less one when it stands before its equal of the same turn: ranks of equal turns sort by fault last
    rows = rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", F.when(F.col("fault") == "duplicate", 1).otherwise(0))
    kind = Joined if with_text else Digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, at = None, None
        for batch in batches:
            for conv, turn, role, text, flaw in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != at:
                    if now is not None:
                        done.append((at, *now.row()))
                    now, at = Repair(kind), conv
                now.add(turn, role, text, flaw)
            if len(done) >= 1000:
                yield packed(done)
                done = []
        if now is not None:
            done.append((at, *now.row()))
        if done:
            yield packed(done)

    return rows.mapInArrow(run, SCHEMA)


def packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair(damage(rows)).withColumnRenamed("repaired", "repaired_sha256")
    # conversations that the damage left without a row
    every = rows.select(F.col("conv_id").cast("long").alias("c_")).distinct()
    both = every.join(done, F.col("c_").eqNullSafe(F.col("conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return both.select(
        F.col("c_").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


OP13_SQL = r"""
WITH RECURSIVE bits AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS crc FROM conversations),
k AS (SELECT conv_id, turn, role, text, xor(crc, 4294967295::BIGINT) % 20 AS kind FROM bits),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said FROM d),
r AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS c, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'ok' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM n),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 'blank')::INT) AS blank, sum((fault = 'duplicate')::INT) AS duplicate,
  sum((fault = 'truncated')::INT) AS truncated, sum((p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au'))::INT) AS illegal, max(i) AS rows FROM r GROUP BY conv_id),
w AS (SELECT conv_id, i, CASE WHEN fault IN ('blank', 'duplicate') THEN NULL ELSE CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END END AS x,
  CASE WHEN c = 'u' THEN 0 ELSE 3 END AS cu, CASE WHEN c = 'u' THEN 'K' ELSE 'R' END AS lu, CASE WHEN c = 'u' THEN role ELSE 'user' END || ':' || text AS tu,
  CASE WHEN c = 'a' THEN 0 ELSE 3 END AS ca, CASE WHEN c = 'a' THEN 'K' ELSE 'R' END AS la, CASE WHEN c = 'a' THEN role ELSE 'assistant' END || ':' || text AS ta,
  c = 's' AS is_s, role || ':' || text AS own FROM r),
step AS (SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'l': '', 't': ''} AS n, NULL::STRUCT(c BIGINT, l VARCHAR, t VARCHAR) AS s, NULL::STRUCT(c BIGINT, l VARCHAR, t VARCHAR) AS u,
  NULL::STRUCT(c BIGINT, l VARCHAR, t VARCHAR) AS a FROM facts
  UNION ALL SELECT z.conv_id, w.i,
  {'c': z.n.c + 4, 'l': z.n.l || 'D', 't': z.n.t},
  list_min(list_filter([CASE WHEN z.s IS NOT NULL THEN {'c': z.s.c + 4, 'l': z.s.l || 'D', 't': z.s.t} END,
    CASE WHEN w.x IS NOT NULL AND w.is_s THEN {'c': z.n.c + w.x, 'l': z.n.l || 'K', 't': z.n.t || w.own || chr(10)} END], lambda q: q IS NOT NULL)),
  list_min(list_filter([CASE WHEN z.u IS NOT NULL THEN {'c': z.u.c + 4, 'l': z.u.l || 'D', 't': z.u.t} END,
    CASE WHEN w.x IS NOT NULL THEN {'c': z.n.c + w.x + w.cu, 'l': z.n.l || w.lu, 't': z.n.t || w.tu || chr(10)} END,
    CASE WHEN w.x IS NOT NULL AND z.s IS NOT NULL THEN {'c': z.s.c + w.x + w.cu, 'l': z.s.l || w.lu, 't': z.s.t || w.tu || chr(10)} END,
    CASE WHEN w.x IS NOT NULL AND z.a IS NOT NULL THEN {'c': z.a.c + w.x + w.cu, 'l': z.a.l || w.lu, 't': z.a.t || w.tu || chr(10)} END,
    CASE WHEN w.x IS NOT NULL AND z.u IS NOT NULL THEN {'c': z.u.c + 3 + w.x + w.cu, 'l': z.u.l || 'I' || w.lu, 't': z.u.t || 'assistant:' || chr(10) || w.tu || chr(10)} END], lambda q: q IS NOT NULL)),
  list_min(list_filter([CASE WHEN z.a IS NOT NULL THEN {'c': z.a.c + 4, 'l': z.a.l || 'D', 't': z.a.t} END,
    CASE WHEN w.x IS NOT NULL AND z.u IS NOT NULL THEN {'c': z.u.c + w.x + w.ca, 'l': z.u.l || w.la, 't': z.u.t || w.ta || chr(10)} END,
    CASE WHEN w.x IS NOT NULL THEN {'c': z.n.c + 3 + w.x + w.ca, 'l': z.n.l || 'I' || w.la, 't': z.n.t || 'user:' || chr(10) || w.ta || chr(10)} END,
    CASE WHEN w.x IS NOT NULL AND z.s IS NOT NULL THEN {'c': z.s.c + 3 + w.x + w.ca, 'l': z.s.l || 'I' || w.la, 't': z.s.t || 'user:' || chr(10) || w.ta || chr(10)} END,
    CASE WHEN w.x IS NOT NULL AND z.a IS NOT NULL THEN {'c': z.a.c + 3 + w.x + w.ca, 'l': z.a.l || 'I' || w.la, 't': z.a.t || 'user:' || chr(10) || w.ta || chr(10)} END], lambda q: q IS NOT NULL))
  FROM step z JOIN w ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = z.i + 1),
ends AS (SELECT z.conv_id, gaps, blank, duplicate, truncated, illegal, list_min(list_filter([z.n, z.a,
  CASE WHEN z.u IS NOT NULL THEN {'c': z.u.c + 3, 'l': z.u.l || 'I', 't': z.u.t || 'assistant:' || chr(10)} END,
  CASE WHEN z.s IS NOT NULL THEN {'c': z.s.c + 6, 'l': z.s.l || 'II', 't': z.s.t || 'user:' || chr(10) || 'assistant:' || chr(10)} END], lambda q: q IS NOT NULL)) AS e
  FROM step z JOIN facts f ON z.conv_id IS NOT DISTINCT FROM f.conv_id AND z.i = f.rows)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.l, '') AS audit,
  sha256(CASE WHEN coalesce(e.t, '') = '' THEN '' ELSE left(e.t, length(e.t) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends ON o.conv_id IS NOT DISTINCT FROM ends.conv_id
"""
