"""Conversation structure repair: the cheapest edits that bring a conversation into the form (system)? (user assistant)+.

Rows of a conversation stand by turn (nulls first), at equal turns by role, then by the SHA-256 of the text; a null role
or text is one space. A row is blank (nothing but white space), a duplicate (its role and text were seen earlier in the
conversation) or truncated (its last visible character does not end a sentence), in that order. Edits: keep a row (K, 0),
give it the role user or assistant (R, 3), delete it (D, 4; blank rows and duplicates must go), insert an empty row of
one of the two roles (I, 3); a truncated row that stays costs 3 more. Nothing at all is a valid conversation, too. A role
counts by its first letter; a row whose role is empty or begins with none of s, u, a cannot be kept as it is.

Every way to repair is one integer: its cost in the high digits, below it one digit of three bits for each possible place
of the audit string, letters from the left, zeros after the last. Letters have digits in their ASCII order and zero is
less than any, so the least integer is the cheapest repair and among those the one with the least audit string, and
nothing but the minimum of integers decides. The graph has a node for each row, state of the pattern and "an insertion
stands here already"; the integers of what follows are known first, and an edit in front moves the letters down a place.
Two insertions at one place are never cheapest: they can be left out, or the one kept system row with them.

Decisions need no texts: one shuffle carries roles, digests and flags, a second one takes each conversation's
decisions and its rows, sorted, through a task that never holds more than a batch of texts. A worker holds of one
conversation a letter and a digest for each row; integers have six bits a row. Equal ids are one conversation, also a
null id; repeated rows are duplicates; an empty table gives an empty table; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phantomlake.llm.common import crc32_sql, small_batches

BLANKS, ENDINGS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: States of the pattern: nothing yet, after the system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What each kept initial leads to.
KEEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What an inserted or renamed row leads to: always the one role that may follow.
FOLLOWS = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
DIGIT = {letter: k for k, letter in enumerate("DIKR", 1)}
LETTER = {k: letter for letter, k in DIGIT.items()}
RENAME, DELETE, INSERT, CUT = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}

PLAN = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PLAN = pa.schema([("conv_id", pa.int64()), *((x, pa.int64()) for x in "n_rows gaps blank duplicate truncated illegal cost".split()), ("audit", pa.string())])
#: Rows that must go are "-"; else the initial of s, u, a or "x" for others, upper case where the row is truncated.
MUST_GO = "-"


def cheapest(rows: str) -> tuple[int, str]:
    """(cost, audit) of a conversation given as one letter for each row (see MUST_GO)."""
    width = 3 * (2 * len(rows) + 1)
    unit, top = 1 << width, width - 3
    mask, far = unit - 1, unit * (8 * len(rows) + 64)

    def put(letter: str, cost: int, rest: int) -> int:
        low = rest & mask
        return rest - low + cost * unit + (DIGIT[letter] << top) + (low >> 3)

    def inserted(after: list[int]) -> list[int]:
        return [min(after[s], put("I", INSERT, after[FOLLOWS[s]])) for s in range(4)]

    best = inserted([0, far, far, 0])
    for row in reversed(rows):
        ways = [[put("D", DELETE, best[s])] for s in range(4)]
        if row != MUST_GO:
            more = CUT if row.isupper() else 0
            kept = KEEPS.get(row.lower(), {})
            for s in range(4):
                if s in kept:
                    ways[s].append(put("K", more, best[kept[s]]))
                ways[s].append(put("R", RENAME + more, best[FOLLOWS[s]]))
        best = inserted([min(w) for w in ways])
    least = best[NOTHING]
    letters = []
    while digit := (least >> top) & 7:
        letters.append(LETTER[digit])
        top -= 3
        if top < 0:
            break
    return least >> width, "".join(letters)


_short = lru_cache(200_000)(cheapest)


def decided(rows: str) -> tuple[int, str]:
    """cheapest(), remembered for conversations of usual length."""
    return _short(rows) if len(rows) <= 40 else cheapest(rows)


class Walk:
    """Follows an audit string over the rows of its conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def insertions(self) -> Iterator[str]:
        """Roles inserted before the next row (or at the end)."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = FOLLOWS[self.state]
            yield ROLE[self.state]

    def row(self, role: str) -> tuple[str, str | None]:
        """(letter, role after the edit) of the next row, None for a deleted one."""
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return letter, None
        self.state = KEEPS[role[:1]][self.state] if letter == "K" else FOLLOWS[self.state]
        return letter, role if letter == "K" else ROLE[self.state]


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The rows of conversations after planted damage, and the condition under which a row is still there."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(part("text"), "".join(ENDINGS), "")).otherwise(part("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(code == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), code.alias("code"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("*", copies.alias("copy")), F.col("code") != 0


def plans(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """One row for each conv_id: what is wrong and the cheapest edits; rows where `present` is false only name their conversation."""
    small_batches(conversations.sparkSession)
    role, text = _role_text()
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text, (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    shown = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(shown == "", "b").when(F.right(shown, F.lit(1)).isin(*ENDINGS), "").otherwise("t")
    slim = rows.select("conv_id", "turn", "role", "present", _digest().alias("digest"), fault.alias("fault"))
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest").mapInArrow(_plans, PLAN)


def _role_text() -> tuple[Column, Column]:
    return F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text")


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text"), 256))


class _Conversation:
    """What is known of a conversation while its rows go by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.seen, self.last = conv_id, [], set(), None
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.faults, self.illegal = {"b": 0, "d": 0, "t": 0}, 0

    def add(self, turn: int | None, role: str, digest: bytes, fault: str) -> None:
        initial = role[:1]
        if self.rows and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        key = (role, digest)
        if fault != "b" and key in self.seen:
            fault = "d"
        self.seen.add(key)
        if fault:
            self.faults[fault] += 1
        kind = initial if initial in ("s", "u", "a") else "x"
        self.rows.append(MUST_GO if fault in ("b", "d") else kind.upper() if fault == "t" else kind)

    def plan(self) -> tuple:
        cost, audit = decided("".join(self.rows))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, len(self.rows), gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, cost, audit


def _plans(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []
    for part in parts:
        columns = [part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "present", "digest", "fault")]
        for conv_id, turn, role, present, digest, fault in zip(*columns, strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.plan())
                now = _Conversation(conv_id)
            if present:
                now.add(turn, role, digest, fault)
        if done:
            yield _batch(done, _PLAN)
            done = []
    if now is not None:
        yield _batch([now.plan()], _PLAN)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _with_rows(conversations: DataFrame, plan: DataFrame, present: Column | None) -> DataFrame:
    """Each conversation's plan and after it its rows, sorted; a conversation is never divided."""
    role, text = _role_text()
    rows = conversations if present is None else conversations.filter(present)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    rows = rows.select("*", F.lit(1).alias("step"), _digest().alias("digest"), F.lit(None).cast(plan.schema.simpleString()).alias("plan"))
    heads = plan.select("conv_id", F.lit(0).alias("step"), F.struct(*plan.columns).alias("plan"))
    both = heads.unionByName(rows, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "step", "turn", "role", "digest")
    return both.select("step", "role", "text", "plan")


REPAIRED = "conv_id long, position long, edit string, role string, text string"
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _repaired(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per conversation ("plan", plan), then ("row", edit, role, text) for each row that is left, None after each batch."""
    walk = None
    for part in parts:
        for step, role, text, plan in zip(*(part.column(c).to_pylist() for c in ("step", "role", "text", "plan")), strict=True):
            if step == 0:
                if walk:
                    yield from (("row", "I", new, "") for new in walk.insertions())
                walk = Walk(plan["audit"])
                yield "plan", plan
                continue
            yield from (("row", "I", new, "") for new in walk.insertions())
            edit, new = walk.row(role)
            if new is not None:
                yield "row", edit, new, text
        yield None
    if walk:
        yield from (("row", "I", new, "") for new in walk.insertions())
    yield None


def _rows_out(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, conv_id, position = [], None, 0
    for x in _repaired(parts):
        if x is None:
            if out:
                yield _batch(out, _REPAIRED)
                out = []
        elif x[0] == "plan":
            conv_id, position = x[1]["conv_id"], 0
        else:
            out.append((conv_id, position, *x[1:]))
            position += 1


_DIGESTS = _PLAN.append(pa.field("repaired_sha256", pa.string()))


def _digests_out(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, plan, digest, first = [], None, hashlib.sha256(), True
    close = lambda: out.append((*plan.values(), digest.hexdigest()))
    for x in _repaired(parts):
        if x is None:
            if out:
                yield _batch(out, _DIGESTS)
                out.clear()
        elif x[0] == "plan":
            if plan:
                close()
            plan, digest, first = x[1], hashlib.sha256(), True
        else:
            digest.update(f"{'' if first else chr(10)}{x[2]}:{x[3]}".encode())
            first = False
    if plan:
        close()
        yield _batch(out, _DIGESTS)


def repaired(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """conv_id, position, edit, role, text of every row after the repair."""
    plan = plans(conversations, present)
    return _with_rows(conversations, plan, present).mapInArrow(_rows_out, REPAIRED)


def repair_report(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """The plan of each conversation with the SHA-256 of its repaired rows as `role:text`, one a line."""
    plan = plans(conversations, present)
    return _with_rows(conversations, plan, present).mapInArrow(_digests_out, f"{PLAN}, repaired_sha256 string")


def oracle_sql() -> str:
    """The report of the damaged conversations in DuckDB: the least string of cost and audit for each state, row by row from the end, then a walk along it."""

    def put(letter: str, cost: int | str, rest: str) -> str:
        return f"lpad((substr({rest}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({rest}, 10)"

    def inserted(names: list[str]) -> str:
        return ", ".join(f"least({names[s]}, {put('I', INSERT, names[FOLLOWS[s]])}) AS f{s}" for s in range(4))

    def ways(s: int) -> str:
        keep = [f"CASE WHEN initial = '{letter}' THEN {put('K', 'cut', f'f{to[s]}')} END" for letter, to in KEEPS.items() if s in to]
        stay = ", ".join([*keep, put("R", f"{RENAME} + cut", f"f{FOLLOWS[s]}")])
        return f"least({put('D', DELETE, f'f{s}')}, CASE WHEN fault NOT IN ('b', 'd') THEN least({stay}) END) AS w{s}"

    state = f"CASE letter WHEN 'D' THEN state WHEN 'K' THEN CASE substr(role, 1, 1) WHEN 's' THEN {SYSTEM} WHEN 'u' THEN {USER} ELSE {ASSISTANT} END ELSE CASE WHEN state = {USER} THEN {ASSISTANT} ELSE {USER} END END"
    line = f"CASE letter WHEN 'K' THEN role || ':' || text ELSE CASE WHEN state = {USER} THEN 'assistant:' ELSE 'user:' END || CASE letter WHEN 'R' THEN text ELSE '' END END"
    return rf"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("name")} % 20 AS code
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations)
), there AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) FROM coded WHERE code <> 0)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM there
), marked AS (
  SELECT *, CASE WHEN shown = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
), rows_of AS (SELECT *, CASE fault WHEN 't' THEN {CUT} ELSE 0 END AS cut FROM marked
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_of GROUP BY conv_id
), backward AS (
  SELECT conv_id, n AS i, {inserted(["z", "NULL::VARCHAR", "NULL::VARCHAR", "z"])} FROM (SELECT *, '000000000' AS z FROM counts)
  UNION ALL
  SELECT conv_id, i, {inserted(["w0", "w1", "w2", "w3"])}
  FROM (SELECT b.conv_id, b.i - 1 AS i, {", ".join(ways(s) for s in range(4))} FROM backward b JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i WHERE b.i > 0)
), forward AS (
  SELECT conv_id, 1::BIGINT AS i, {NOTHING} AS state, substr(f0, 10) AS rest, NULL::VARCHAR AS done FROM backward WHERE i = 0
  UNION ALL
  SELECT conv_id, i + (letter <> 'I')::BIGINT, {state}, substr(rest, 2), CASE WHEN letter = 'D' THEN done ELSE coalesce(done || chr(10), '') || {line} END
  FROM (SELECT f.*, substr(rest, 1, 1) AS letter, r.role, r.text FROM forward f LEFT JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i WHERE rest <> '')
), whole AS (SELECT b.conv_id, substr(f0, 1, 9)::BIGINT AS cost, substr(f0, 10) AS audit, done FROM backward b JOIN forward f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.rest = '' WHERE b.i = 0)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(done, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
"""
