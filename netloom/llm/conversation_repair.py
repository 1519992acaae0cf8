"""Repair of conversations: the cheapest edits that give an optional system turn and then pairs of user and assistant.

The plan of a conversation is a shortest path through a graph whose nodes are (rows left, state of the grammar) and
whose edges are edits. A path's weight is one integer: its high digits are the cost, its low digits, W of them in a fixed width, the
audit letters from the first on, zero where the audit has ended. The ordinary minimum of such integers is the cheapest
plan and, of equally cheap ones, that of the least audit; the letters of the minimum are the plan, nothing else is kept.

Rows are numbered and checked by windows, a conversation's plan needs one letter a row, and the plan meets the rows
again as the first row of a sorted stream, in which texts pass by one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.common import materialise, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Audit letters by their digit; ASCII order is the order of the digits, and 0 is the end.
LETTERS = "\0DIKR"
_BITS = 3
#: What state follows on which initial, and the role that a row or an insertion takes on in a state. Audits end in START or DONE.
START, SYSTEM, USER, DONE = range(4)
_STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
_TURN = {START: "user", SYSTEM: "user", USER: "assistant", DONE: "user"}


def _row_edits(code: str) -> list[list[tuple[int, int, int]]]:
    """By state the (cost, digit, next state) of the edits of a row. code is the initial of its role (o: any other),
    in capitals if it is truncated, or x where it has to go."""
    edits = [[(DELETE, LETTERS.index("D"), state)] for state in range(4)]
    if code == "x":
        return edits
    extra = TRUNCATED if code.isupper() else 0
    for state in range(4):
        role = _TURN[state][0]
        if (state, code.lower()) in _STEP:
            edits[state].append((KEEP + extra, LETTERS.index("K"), _STEP[state, code.lower()]))
        edits[state].append((REROLE + extra, LETTERS.index("R"), _STEP[state, role]))
    return edits


_EDITS = {code: _row_edits(code) for code in "xsuaoSUAO"}
_INSERT = [(INSERT, LETTERS.index("I"), _STEP[state, _TURN[state][0]]) for state in range(4)]


def plan(codes: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest plan for rows of these codes, the ASCII-least audit of the cheapest.

    Two insertions side by side take a state back to where two rows fewer would do, so an audit has at most 2 n + 2
    letters. The integers have as many digits: the time grows with n squared, at a machine word's pace.
    """
    width = 2 * len(codes) + 3
    shift = _BITS * width
    low, top = (1 << shift) - 1, shift - _BITS

    def before(edit: tuple[int, int, int], after: list[int]) -> int:
        """The weight of an edit and what comes after it: its letter moves all others on by one digit."""
        rest = after[edit[2]]
        return ((rest >> shift) + edit[0] << shift) | edit[1] << top | (rest & low) >> _BITS

    def with_inserted(at: list[int]) -> list[int]:
        for _ in range(2):
            at = [min(at[state], before(_INSERT[state], at)) for state in range(4)]
        return at

    never = 5 * (len(codes) + 2) << shift
    best = with_inserted([0, never, never, 0])
    for code in reversed(codes):
        best = with_inserted([min(before(edit, best) for edit in edits) for edits in _EDITS[code]])
    weight = best[START]
    digits = f"{weight & low:0{width}o}".rstrip("0")
    return weight >> shift, digits.translate({ord("1"): "D", ord("2"): "I", ord("3"): "K", ord("4"): "R"})


_short_plan = lru_cache(1 << 16)(plan)


def _plans(codes: pd.Series) -> pd.DataFrame:
    found = [(_short_plan if len(c) < 40 else plan)(c) for c in codes]
    return pd.DataFrame(found, columns=["cost", "audit"])


class Replay:
    """A conversation's audit applied to its rows in order: lines are the (role, text) that come out."""

    def __init__(self, audit: str):
        self.letters, self.state = iter(audit), START
        self.letter = next(self.letters, None)

    def _turn(self, role: str) -> str:
        self.state = _STEP[self.state, role[0]]
        self.letter = next(self.letters, None)
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        """What is inserted before the next row, or at the end."""
        while self.letter == "I":
            yield self._turn(_TURN[self.state]), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        if self.letter == "D":
            self.letter = next(self.letters, None)
        elif self.letter == "K":
            yield self._turn(role), text
        else:
            yield self._turn(_TURN[self.state]), text


def conversation_key(col: str) -> Column:
    """A text that tells ids apart, null included."""
    return F.concat(F.when(F.col(col).isNull(), "n").otherwise("v"), F.coalesce(F.col(col).cast("string"), F.lit("")))


_SPACE = r"\x20\x09-\x0D"


def checked(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(key, conv_id, place, turn, role, text, fault, code, illegal, new_turn): the rows of each conversation, numbered from 1 by turn.

    Null turns come first; rows of one turn are put by role and text. Null roles and texts are one space. fault is the
    row's first of blank, duplicate and truncated, or null. illegal is true if the initials of the row before and of this one
    are none of su, ua, au. Rows with a null id are one conversation. A conversation's rows are sorted by one task, which spills.
    """
    space = F.lit(" ")
    named = rows.select(
        conversation_key(id_col).alias("key"), F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text")
    )
    by_turn = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("key", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(by_turn), initial)
    found = named.withColumns({
        "place": F.row_number().over(by_turn).cast("long"),
        "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)),
        "new_turn": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(by_turn)),
    }).withColumn("again", F.row_number().over(same) > 1)
    fault = (
        F.when(~F.col("text").rlike(f"[^{_SPACE}]"), "blank").when(F.col("again"), "duplicate")
        .when(~F.col("text").rlike(rf"[.!?][{_SPACE}]*+\z"), "truncated")
    )
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return found.withColumn("fault", fault).withColumn("code", code).drop("again")


def planned(rows: DataFrame) -> DataFrame:
    """(key, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation of checked rows."""
    count = lambda c: F.count_if(c).alias
    kinds = ("blank", "duplicate", "truncated")
    by_key = rows.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).cast("long").alias("gaps"),
        *(count(F.coalesce(F.col("fault") == k, F.lit(False)))(k) for k in kinds), count(F.col("illegal"))("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda r: r.code), "").alias("codes"),
    )
    return by_key.withColumn("plan", F.pandas_udf(_plans, "cost long, audit string")("codes")).select("key", "conv_id", "gaps", *kinds, "illegal", "plan.cost", "plan.audit")


def _stream(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, as place 0, and its rows after it, all in one task, in order."""
    lines = rows.select("key", "place", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = plans.select("key", F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    return lines.unionByName(heads).repartition("key").sortWithinPartitions("key", "place")


def _replayed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str | None]]:
    """(key, null, null) where a conversation begins, then (key, role, text) of its repaired rows."""
    replay = at = None
    for batch in batches:
        for key, place, role, text, audit in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if place == 0:
                if replay:
                    yield from ((at, *line) for line in replay.inserted())
                replay, at = Replay(audit), key
                yield key, None, None
            else:
                yield from ((key, *line) for line in replay.row(role, text))
    if replay:
        yield from ((at, *line) for line in replay.inserted())


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(key, place, role, text) of the repaired conversations, places counted from 1; rows are checked, plans planned."""

    def work(batches):
        held, place = [], 0
        for key, role, text in _replayed(batches):
            place += 1
            if role is None:
                place = 0
                continue
            held.append((key, place, role, text))
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)

    schema = pa.schema([("key", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return _stream(rows, plans).mapInArrow(work, "key string, place long, role string, text string")


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(key, repaired_sha256): the hash of each repaired conversation's role:text lines, joined by newlines. A text is
    hashed as it passes; no conversation is held whole."""

    def work(batches):
        at, digest, done = None, None, []
        for key, role, text in _replayed(batches):
            if role is None:
                if digest is not None:
                    done.append({"key": at, "repaired_sha256": digest.hexdigest()})
                at, digest, lines = key, hashlib.sha256(), 0
                if len(done) == 4096:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done = []
                continue
            digest.update(f"\n{role}:{text}"[not lines :].encode())
            lines += 1
        if digest is not None:
            done.append({"key": at, "repaired_sha256": digest.hexdigest()})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])
    return _stream(rows, plans).mapInArrow(work, "key string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to rows of (conv_id, turn, role, text): dropped, emptied, without stops, repeated or made the user's."""
    space = F.lit(" ")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    hit = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every conversation after the contract's damage. Conversations without a row
    left have zeros, an empty audit and the hash of the empty text; rows with a null conv_id are one conversation."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = materialise(checked(damaged(given)))
    plans = materialise(planned(rows))
    found = plans.drop("conv_id").join(digests(rows, plans), "key")
    every = given.select("conv_id").distinct().withColumn("key", conversation_key("conv_id"))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, "key", "left").select(
        "conv_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


#: crc32 by a table of bytes; plans as a fold over a conversation's rows from the last to the first, whose state is the cheapest
#: (cost, audit) of each state of the grammar. '+' is a possible insertion, twice between any two rows.
OP12_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS name
  FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(name)), lambda i: ascii(decode(name)[i + 1])::BIGINT)),
      lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind
  FROM given, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'none' END AS fault,
    coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) || role[1] NOT IN ('su', 'ua', 'au'), false) AS illegal,
    CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS kind
  FROM numbered
), conv AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal,
    list({fault: fault, kind: kind} ORDER BY place DESC) AS rows_back, list({role: role, text: text} ORDER BY place) AS lines
  FROM faulty GROUP BY conv_id
), steps AS (
  SELECT *, list_reduce(list_concat(
      [{op: 'end', z: {c: 0, a: ''}, s: {c: 1000000000, a: ''}, u: {c: 1000000000, a: ''}, d: {c: 0, a: ''}, fault: '', kind: ''}, {op: '+', z: NULL, s: NULL, u: NULL, d: NULL, fault: '', kind: ''}, {op: '+', z: NULL, s: NULL, u: NULL, d: NULL, fault: '', kind: ''}],
      flatten(list_transform(rows_back, lambda r: [{op: 'row', z: NULL, s: NULL, u: NULL, d: NULL, fault: r.fault, kind: r.kind}, {op: '+', z: NULL, s: NULL, u: NULL, d: NULL, fault: '', kind: ''}, {op: '+', z: NULL, s: NULL, u: NULL, d: NULL, fault: '', kind: ''}]))),
    lambda v, r: CASE WHEN r.op = '+' THEN
      {op: '', z: list_sort([v.z, {c: v.u.c + 3, a: 'I' || v.u.a}])[1], s: list_sort([v.s, {c: v.u.c + 3, a: 'I' || v.u.a}])[1],
       u: list_sort([v.u, {c: v.d.c + 3, a: 'I' || v.d.a}])[1], d: list_sort([v.d, {c: v.u.c + 3, a: 'I' || v.u.a}])[1], fault: '', kind: ''}
    ELSE
      {op: '',
       z: list_sort([{c: v.z.c + 4, a: 'D' || v.z.a}] || CASE WHEN r.fault IN ('blank', 'duplicate') THEN [] ELSE [
           {c: v.u.c + CASE r.fault WHEN 'truncated' THEN 3 ELSE 0 END + CASE r.kind WHEN 'u' THEN 0 ELSE 3 END, a: CASE r.kind WHEN 'u' THEN 'K' ELSE 'R' END || v.u.a},
           {c: CASE r.kind WHEN 's' THEN v.s.c + CASE r.fault WHEN 'truncated' THEN 3 ELSE 0 END ELSE 1000000000 END, a: 'K' || v.s.a}] END)[1],
       s: list_sort([{c: v.s.c + 4, a: 'D' || v.s.a}] || CASE WHEN r.fault IN ('blank', 'duplicate') THEN [] ELSE [
           {c: v.u.c + CASE r.fault WHEN 'truncated' THEN 3 ELSE 0 END + CASE r.kind WHEN 'u' THEN 0 ELSE 3 END, a: CASE r.kind WHEN 'u' THEN 'K' ELSE 'R' END || v.u.a}] END)[1],
       u: list_sort([{c: v.u.c + 4, a: 'D' || v.u.a}] || CASE WHEN r.fault IN ('blank', 'duplicate') THEN [] ELSE [
           {c: v.d.c + CASE r.fault WHEN 'truncated' THEN 3 ELSE 0 END + CASE r.kind WHEN 'a' THEN 0 ELSE 3 END, a: CASE r.kind WHEN 'a' THEN 'K' ELSE 'R' END || v.d.a}] END)[1],
       d: list_sort([{c: v.d.c + 4, a: 'D' || v.d.a}] || CASE WHEN r.fault IN ('blank', 'duplicate') THEN [] ELSE [
           {c: v.u.c + CASE r.fault WHEN 'truncated' THEN 3 ELSE 0 END + CASE r.kind WHEN 'u' THEN 0 ELSE 3 END, a: CASE r.kind WHEN 'u' THEN 'K' ELSE 'R' END || v.u.a}] END)[1],
       fault: '', kind: ''} END).z AS best
  FROM conv
), replayed AS (
  SELECT *, list_reduce(list_concat([{n: 0, user: true, out: []::VARCHAR[], e: ''}], list_transform(string_split(best.a, ''), lambda e: {n: 0, user: true, out: []::VARCHAR[], e: e})),
    lambda v, x: CASE x.e WHEN '' THEN v WHEN 'D' THEN {n: v.n + 1, user: v.user, out: v.out, e: ''}
      WHEN 'I' THEN {n: v.n, user: NOT v.user, out: v.out || [CASE WHEN v.user THEN 'user:' ELSE 'assistant:' END], e: ''}
      WHEN 'K' THEN {n: v.n + 1, user: lines[v.n + 1].role[1] <> 'u', out: v.out || [lines[v.n + 1].role || ':' || lines[v.n + 1].text], e: ''}
      ELSE {n: v.n + 1, user: NOT v.user, out: v.out || [CASE WHEN v.user THEN 'user:' ELSE 'assistant:' END || lines[v.n + 1].text], e: ''} END).out AS result
  FROM steps
)
SELECT g.conv_id, coalesce(r.gaps, 0)::BIGINT AS gaps, coalesce(r.blank, 0)::BIGINT AS blank, coalesce(r.duplicate, 0)::BIGINT AS duplicate,
  coalesce(r.truncated, 0)::BIGINT AS truncated, coalesce(r.illegal, 0)::BIGINT AS illegal, coalesce(r.best.c, 0)::BIGINT AS cost,
  coalesce(r.best.a, '') AS audit, sha256(coalesce(array_to_string(r.result, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN replayed r ON g.conv_id IS NOT DISTINCT FROM r.conv_id
"""
