"""Repair of conversations against all edits of short signatures and against its SQL."""

import itertools
import random
import re

import duckdb
import pyarrow as pa
import pytest

from sievewright.llm import conversations as cv

COLUMNS = ["conv_id", *cv.COUNTS, "audit", "repaired_sha256"]
ROWS = "conv_id long, turn long, role string, text string"


def all_edits(signature):
    rows, best = [cv.read_sign(c) for c in signature], None

    def go(i, roles, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
        else:
            initial, fault = rows[i]
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                go(i + 1, roles + initial, cost + more, audit + "K", 0)
                for r in "ua":
                    go(i + 1, roles + r, cost + 3 + more, audit + "R", 0)
        if inserted < 3:
            for r in "ua":
                go(i, roles + r, cost + 3, audit + "I", inserted + 1)

    go(0, "", 0, "", 0)
    return best


def test_cheapest_edits_of_all_short_signatures():
    for n in range(3):
        for s in itertools.product(cv.SIGNS, repeat=n):
            assert cv.solve("".join(s)) == all_edits("".join(s)), s


@pytest.mark.parametrize("seed", range(6))
def test_cheapest_edits_of_longer_signatures(seed):
    rng = random.Random(seed)
    for _ in range(15):
        s = "".join(rng.choices(cv.SIGNS, k=rng.randint(3, 6)))
        assert cv.solve(s) == all_edits(s), s


def test_a_signature_is_put_together_from_any_parts():
    rng = random.Random(5)
    s = "".join(rng.choices(cv.SIGNS, k=200))
    for cut in (1, 77, 199):
        assert cv.together(cv.moves(s[:cut]), cv.moves(s[cut:])) == cv.moves(s)


def by_sql(rows):
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    con = duckdb.connect()
    con.register("conversations", pa.table({n: pa.array(c, k) for n, c, k in zip(("conv_id", "turn", "role", "text"), columns, kinds)}))
    return sorted(con.sql(cv.repair_sql()).fetchall(), key=repr)


def random_rows(seed, n):
    rng = random.Random(seed)
    roles, texts = [None, "", "user", "assistant", "system", "tool", "sys", "USER"], [None, "", " \n", "Hi.", "ok", "What?\n", "yes! ", "é…", "Bye.", "x" * 5_000]
    return [(rng.choice([None, *range(30)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("segment", [cv.SEGMENT, 3])
def test_repair_against_sql(spark, segment):
    rows = random_rows(segment, 700)
    extra = [(*r, "a", 1) for r in rows]
    df = spark.createDataFrame(extra, f"{ROWS}, audit string, Cost long").repartition(5)
    got = sorted(map(tuple, cv.repair(df, most=segment).select(COLUMNS).collect()), key=repr)
    assert got == by_sql(rows)


def test_one_conversation_over_many_tasks(spark):
    """A conversation that holds most rows, with a text that is repeated often within a turn and over the turns."""
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["again.", f"text {t}.", "cut"])) for t in range(1_500)] + [(7, 3, "user", "again.")] * 50 + [(8, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, ROWS).repartition(8)
    parts = cv.segments(cv.damage(df), 100)
    assert parts.where("conv_id = 7").select("part").distinct().count() > 1
    got = sorted(map(tuple, cv.repair(df, most=100).select(COLUMNS).collect()), key=repr)
    assert got == by_sql(rows)


def test_repaired_conversations_have_the_pattern(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "U."), (1, 2, "user", "U2"), (2, 5, "assistant", "A."), (3, None, None, None)]
    got = {r.conv_id: r for r in cv.repair(spark.createDataFrame(rows, ROWS), damaged=False).collect()}
    # the truncated user row becomes the answer (3 + 3): deleting it (4) would take an inserted one (3)
    assert (got[1].audit, got[1].cost, got[1].truncated, got[1].illegal) == ("KKR", 6, 1, 1)
    assert (got[2].audit, got[2].cost) == ("IK", 3)
    assert (got[3].audit, got[3].cost, got[3].blank, got[3].gaps) == ("D", 4, 1, 0)
    assert got[3].repaired_sha256 == cv.sha256(b"").hexdigest()
    assert got[2].repaired_sha256 == cv.sha256(b"user:\nassistant:A.").hexdigest()


def test_empty_table(spark):
    assert cv.repair(spark.createDataFrame([], ROWS)).count() == 0
