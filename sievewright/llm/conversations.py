"""Repair of conversation structure: one solution for each distinct signature of roles and faults.

A row's sign is its role's initial (s, u, a, or another) and its fault (none, blank, duplicate, truncated), one character for both; a
conversation's signature is the string of its signs in order. The cheapest edits that lead to `(s?(ua)+)?` depend on the
signature only, so each distinct one is solved once, joined back to the conversations that have it, and replayed on their rows.

Solutions are tables of moves between the states of that pattern: for each state before and state after, the least cost and of
the audits of that cost the ASCII-least. A signature is cut in two, and the tables of its halves, which are
remembered and so shared with all signatures that hold the same half, are put together (of one table, no two audits of one cost are
prefixes of each other, as a row has one letter and each insertion costs more; so the least whole is made of least parts).

A conversation may be of any length. Rows are dealt into ranges by conversation and order, so that many tasks read one; each makes
segments of up to SEGMENT signs, which are solved like whole signatures and folded, from the last to the first, into the
conversation's audit. Where the text is needed (the hash of the repaired rows, which is sequential by its nature), a task streams the
conversation's sorted rows past its audit and keeps neither.

Order: turn (nulls first), role, md5 of the text; rows alike in these are equal. Nulls are one space: in the key of the damage, as role
and as text (a null text is blank; a null or empty role is of another initial). A null conv_id is a conversation. Rows of
equal role and text in one conversation are duplicates of the first of them. An empty table gives an empty one; columns
other than the four are not read.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLANKS = " \t\n\v\f\r"
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Signs of a segment at most.
SEGMENT = 4_096
#: Tables of moves kept by a worker.
REMEMBERED = 200_000

INITIALS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
SIGNS = "0123456789abcdef"
#: States: nothing yet, after a system row, after a user row, after an assistant row. What may follow each, by the role's initial.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
LEGAL = {"su", "ua", "au"}

Moves = tuple[tuple[tuple[int, str] | None, ...], ...]


def sign(initial: str, fault: str) -> str:
    return SIGNS[4 * (INITIALS.index(initial) if initial and initial in INITIALS else 3) + FAULTS.index(fault)]


def read_sign(c: str) -> tuple[str, str]:
    return (*INITIALS, "?")[SIGNS.index(c) // 4], FAULTS[SIGNS.index(c) % 4]


def _least(moves) -> Moves:
    """A table from (before, after, cost, audit)."""
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for before, after, *way in moves:
        if table[before][after] is None or tuple(way) < table[before][after]:
            table[before][after] = tuple(way)
    return tuple(map(tuple, table))


def _insertions():
    """States reached by inserting user and assistant rows; more than two in a row only lead round."""
    for before in range(4):
        yield before, before, 0, ""
        for i in "ua":
            if (once := FOLLOWS[before].get(i)) is not None:
                yield before, once, INSERT, "I"
                for j in "ua":
                    if (twice := FOLLOWS[once].get(j)) is not None:
                        yield before, twice, 2 * INSERT, "II"


def _row(c: str):
    """What may become of a row, whatever is inserted before it."""
    initial, fault = read_sign(c)
    for state in range(4):
        yield state, state, DELETE, "D"
        if fault in ("", "truncated"):
            more = TRUNCATED if fault else 0
            for role, after in FOLLOWS[state].items():
                if role == initial:
                    yield state, after, more, "K"
                if role in "ua":
                    yield state, after, REROLE + more, "R"


def together(first: Moves, second: Moves) -> Moves:
    return _least(
        (a, c, x[0] + y[0], x[1] + y[1])
        for a in range(4) for b in range(4) if (x := first[a][b]) is not None
        for c in range(4) if (y := second[b][c]) is not None
    )


_INSERTED = _least(_insertions())
#: What must still be inserted at the end.
_ENDED = _least((a, b, *way) for a, b, *way in _insertions() if b in (START, ASSISTANT))


@lru_cache(REMEMBERED)
def moves(signature: str) -> Moves:
    """The cheapest edits of some rows, by the states before and after them. Halves are cut at a power of two, so that equal runs share them."""
    if len(signature) <= 1:
        return together(_INSERTED, _least(_row(signature))) if signature else _least((s, s, 0, "") for s in range(4))
    half = 1 << (len(signature) - 1).bit_length() - 1
    return together(moves(signature[:half]), moves(signature[half:]))


def cheapest(table: Moves) -> tuple[int, str]:
    """Cost and audit of a whole conversation; that of no rows is empty, not made of insertions."""
    return min(x for x in together(table, _ENDED)[START] if x is not None)


def solve(signature: str) -> tuple[int, str]:
    return cheapest(moves(signature))


def faults(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours that the pattern never has."""
    marks = [read_sign(c) for c in signature]
    illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(marks, marks[1:]))
    return (*(sum(f == name for _, f in marks) for name in FAULTS[1:]), illegal)


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) after the drill's damage; nulls of role and text are one space from here on."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.pmod(F.crc32(key), F.lit(20))
    text = F.coalesce("text", blank)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", blank))
    out = rows.where(kind != 0).select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "time")


def _ends(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last character that isn't white space ends no sentence."""
    bare = F.rtrim(text, F.lit(BLANKS))
    return bare == "", ~F.right(bare, F.lit(1)).isin(".", "!", "?")


ORDER = ("turn", "role", "digest")


def signs(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> conv_id, turn, role, digest, n equal rows, the sign of the first of them and that of the others."""
    blank, cut = _ends(F.col("text"))
    marks = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), blank.alias("blank"), cut.alias("cut"))
    equal = marks.groupBy("conv_id", *ORDER, "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    # texts that a conversation has in several turns, and the first of these
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = equal.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    met = equal.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.col("first").isNotNull() & ~turn.eqNullSafe(F.col("first"))
    fault = lambda dup: F.when(F.col("blank"), 1).when(dup, 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 4).when(initial == "a", 8).otherwise(12)
    of = lambda dup: F.substring(F.lit(SIGNS), kind + fault(dup) + 1, F.lit(1))
    return met.select("conv_id", *ORDER, "n", of(later).alias("sign"), of(F.lit(True)).alias("others"))


SEGMENTS = "part int, seq int, signature string, first_turn long, last_turn long, turns long"


def _segments(most: int):
    def run(batches):
        """Segments of rows sorted by conversation and order, each with its turns (without nulls): first, last, how many."""
        from pyspark import TaskContext

        part, seq, known = TaskContext.get().partitionId(), 0, False
        conv = None
        text: list[str] = []
        size, first, last, turns = 0, None, None, 0

        def segment(kind):
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], kind), *(pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), ("".join(text), pa.string()), (first, pa.int64()), (last, pa.int64()), (turns, pa.int64())))],
                names=["conv_id", "part", "seq", "signature", "first_turn", "last_turn", "turns"],
            )

        kind = None
        for batch in batches:
            kind = batch.column("conv_id").type
            for c, turn, n, a, b in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "n", "sign", "others"))):
                if known and c != conv:
                    yield segment(kind)
                    seq, text, size, first, last, turns = seq + 1, [], 0, None, None, 0
                conv, known = c, True
                if size and size >= most:
                    yield segment(kind)
                    seq, text, size, first, last, turns = seq + 1, [], 0, None, None, 0
                if turn is not None:
                    first, last, turns = turn if first is None else first, turn, turns + (last != turn)
                text.append(a)
                size, n = size + 1, n - 1
                while n:
                    if size >= most:
                        yield segment(kind)
                        seq, text, size, first, last, turns = seq + 1, [], 0, turn, turn, int(turn is not None)
                    step = min(n, most - size)
                    text.append(b * step)
                    size, n = size + step, n - step
        if known:
            yield segment(kind)

    return run


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """The signatures of the conversations of rows, in segments numbered by task and place."""
    marked, _ = materialise(signs(rows), "signs")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = marked.repartitionByRange(n, "conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return materialise(ranged.mapInArrow(_segments(most), f"conv_id {kind}, {SEGMENTS}"), "segments")[0]


_FOUND = "signature string, cost long, audit string, blank long, duplicate long, truncated long, illegal long"
_MOVES = ", ".join(f"cost{a}{b} long, audit{a}{b} string" for a in range(4) for b in range(4))


def _solved(batches):
    for batch in batches:
        found = [(s, *solve(s), *faults(s)) for s in batch.column("signature").to_pylist()]
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])


def _moved(batches):
    names = ["signature", *(f"{x}{a}{b}" for a in range(4) for b in range(4) for x in ("cost", "audit"))]
    for batch in batches:
        rows = [(s, *(v for way in (x or (None, None) for before in moves(s) for x in before) for v in way)) for s in batch.column("signature").to_pylist()]
        kinds = [pa.string(), *[pa.int64(), pa.string()] * 16]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


SOLVED = "first_turn long, last_turn long, turns long, cost long, audit string, blank long, duplicate long, truncated long, illegal long"


def _folded(batches):
    """Segments sorted by conversation, the last first, into conversations. One table of moves and one segment's are held at a time."""
    names = [x.split()[0] for x in SOLVED.split(", ")]
    now, known, kind = None, False, None

    def settled():
        conv, table, first, last, turns, counts, _, _ = now
        rows = (conv, first, last, turns, *cheapest(table), *counts)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(rows, (kind, *[pa.int64()] * 4, pa.string(), *[pa.int64()] * 4))], names=["conv_id", *names])

    for batch in batches:
        kind = batch.column("conv_id").type
        for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
            r = dict(zip(batch.schema.names, row))
            table = tuple(tuple(None if r[f"cost{a}{b}"] is None else (r[f"cost{a}{b}"], r[f"audit{a}{b}"]) for b in range(4)) for a in range(4))
            text, counts = r["signature"], list(faults(r["signature"]))
            if known and now[0] == r["conv_id"]:
                _, after, first, last, turns, more, head, _ = now
                counts = [a + b for a, b in zip(counts, more)]
                counts[3] += faults(text[-1] + head)[3]
                same = first is not None and r["last_turn"] == first
                now = (r["conv_id"], together(table, after), r["first_turn"] if r["first_turn"] is not None else first, last if last is not None else r["last_turn"], r["turns"] + turns - same, counts, text[0], None)
            else:
                if known:
                    yield settled()
                now, known = (r["conv_id"], table, r["first_turn"], r["last_turn"], r["turns"], counts, text[0], None), True
    if known:
        yield settled()


def audits(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """rows (conv_id, turn, role, text) -> for each conversation its turns, faults, cost and audit."""
    parts = segments(rows, most)
    kind = rows.schema["conv_id"].dataType.simpleString()
    several = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).select(F.col("conv_id").alias("c"), "parts")
    parts, _ = materialise(parts.join(several, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"), "counted")
    whole, split = parts.where("parts = 1"), parts.where("parts > 1")
    solved = whole.select("signature").distinct().mapInArrow(_solved, _FOUND)
    columns = ["conv_id", *(x.split()[0] for x in SOLVED.split(", "))]
    out = whole.join(solved, "signature").select(*columns)
    moved = split.join(split.select("signature").distinct().mapInArrow(_moved, f"signature string, {_MOVES}"), "signature").drop("parts")
    folded = moved.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq")).mapInArrow(_folded, f"conv_id {kind}, {SOLVED}")
    return out.unionByName(folded)


def _replayed(batches):
    """Sorted rows, each conversation's after a row with its audit, to the hashes of the repaired conversations."""
    conv = kind = None
    known = False
    audit, at, digest, lines, state = "", 0, sha256(), 0, START

    def put(role, text):
        nonlocal lines
        digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        lines += 1

    def inserted():
        nonlocal at, state
        while audit[at : at + 1] == "I":
            state = ASSISTANT if state == USER else USER
            put("assistant" if state == ASSISTANT else "user", "")
            at += 1

    for batch in batches:
        kind, out = batch.column("conv_id").type, []
        for c, head, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "head", "role", "text"))):
            if head:
                if known:
                    inserted()
                    out.append((conv, digest.hexdigest()))
                conv, known, audit, at, digest, lines, state = c, True, text, 0, sha256(), 0, START
                continue
            inserted()
            letter, at = audit[at], at + 1
            if letter == "K":
                state = FOLLOWS[state][role[:1]]
                put(role, text)
            elif letter == "R":
                state = ASSISTANT if state == USER else USER
                put("assistant" if state == ASSISTANT else "user", text)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
    if known:
        inserted()
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def replay(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The sha256 of each repaired conversation (`role:text` lines) from its rows and found (conv_id, audit)."""
    none = lambda kind: F.lit(None).cast(kind)
    heads = found.select("conv_id", F.lit(True).alias("head"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), F.col("audit").alias("text"))
    texts = rows.select("conv_id", F.lit(False).alias("head"), "turn", "role", F.unhex(F.md5("text")).alias("digest"), "text")
    dealt = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), *ORDER)
    return dealt.mapInArrow(_replayed, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(table: DataFrame, damaged: bool = True, most: int = SEGMENT) -> DataFrame:
    """table (conv_id, turn, role, text) -> a row for each conv_id: gaps, faults, cost, audit and the repaired conversation's hash.

    With `damaged`, the drill damages the rows first; conversations that lose all of theirs have zeros and nothing to repair."""
    rows = damage(table) if damaged else table.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    found, _ = materialise(audits(rows, most), "audits")
    gaps = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0)
    hashes = replay(rows, found).withColumnRenamed("conv_id", "c")
    told = found.withColumn("gaps", gaps).join(hashes, F.col("conv_id").eqNullSafe(F.col("c"))).select(F.col("conv_id").alias("c"), *COUNTS, "audit", "repaired_sha256")
    every = table.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return every.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))


def _states_sql() -> tuple[str, str, str]:
    """VALUES of the insertions (state, letters, cost, next), the edits (state, initial or *, letter, cost, next) and the ends (state, letters, cost)."""
    inserts = "('0','',0,'0'),('0','I',3,'u'),('0','II',6,'a'),('s','',0,'s'),('s','I',3,'u'),('s','II',6,'a'),('u','',0,'u'),('u','I',3,'a'),('a','',0,'a'),('a','I',3,'u')"
    keeps = "('0','s','K',0,'s'),('0','u','K',0,'u'),('s','u','K',0,'u'),('a','u','K',0,'u'),('u','a','K',0,'a')"
    others = "('0','*','R',3,'u'),('s','*','R',3,'u'),('a','*','R',3,'u'),('u','*','R',3,'a'),('0','*','D',4,'0'),('s','*','D',4,'s'),('u','*','D',4,'u'),('a','*','D',4,'a')"
    return inserts, f"{keeps},{others}", "('0','',0),('a','',0),('u','I',3),('s','II',6)"


def repair_sql() -> str:
    """The query in DuckDB SQL: a row at a time, the least cost and audit that lead to each state."""
    from .merkle import crc32_sql

    inserts, edits, ends = _states_sql()
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return rf"""
    WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(key)} % 20 AS kind FROM conversations),
    damaged AS (
      SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM keyed WHERE kind <> 0)),
    numbered_rows AS (
      SELECT *, regexp_replace(text, '[ \t\n\v\f\r]+$', '') AS bare, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
    judged AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS repeated FROM numbered_rows),
    seq AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN repeated THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM judged),
    pairs AS (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM seq),
    walk AS (
      SELECT conv_id, 0::BIGINT AS i, '0' AS state, '000000000' AS best FROM seq GROUP BY conv_id
      UNION ALL
      SELECT w.conv_id, s.i, e.next, min(lpad((left(w.best, 9)::BIGINT + n.cost + e.cost + CASE WHEN s.fault = 'truncated' AND e.letter <> 'D' THEN 3 ELSE 0 END)::VARCHAR, 9, '0') || substr(w.best, 10) || n.letters || e.letter)
      FROM walk w JOIN seq s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1
      JOIN (VALUES {inserts}) n(state, letters, cost, next) ON n.state = w.state
      JOIN (VALUES {edits}) e(state, initial, letter, cost, next) ON e.state = n.next AND (e.initial = '*' OR e.initial = s.initial)
      WHERE e.letter = 'D' OR s.fault IN ('', 'truncated')
      GROUP BY w.conv_id, s.i, e.next),
    solved AS (
      SELECT conv_id, min(lpad((left(best, 9)::BIGINT + x.cost)::VARCHAR, 9, '0') || substr(best, 10) || x.letters) AS best
      FROM walk JOIN (VALUES {ends}) x(state, letters, cost) USING (state)
      WHERE i = (SELECT count(*) FROM seq s WHERE s.conv_id IS NOT DISTINCT FROM walk.conv_id) GROUP BY conv_id),
    letters AS (SELECT conv_id, j, best[9 + j] AS letter FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS j FROM solved)),
    numbered AS (
      SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS place FROM letters),
    placed AS (
      SELECT n.conv_id, n.j, n.letter, n.place, s.role, s.text, max(CASE WHEN n.letter = 'K' AND n.place = 1 AND s.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS systems
      FROM numbered n LEFT JOIN seq s ON n.letter <> 'I' AND s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.i = n.i WHERE n.letter <> 'D'),
    repaired AS (
      SELECT conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN (place - systems) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h
      FROM placed GROUP BY conv_id),
    counted AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated FROM seq GROUP BY conv_id),
    broken AS (SELECT conv_id, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
      coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN broken ON broken.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN solved ON solved.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM c.conv_id"""
