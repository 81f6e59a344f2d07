"""Conversation repair against a search over all edits, row by row."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_repair as cr
from tessera.llm.conversation_repair import damage_conversations, distances, repair, repair_conversations, repaired_sha256

SCHEMA = "conv_id long, turn long, role string, text string, place string, code int"
WHITE = " \t\n\v\f\r"


def ordered(rows):
    digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    rows = [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r)))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        tail = text.rstrip(WHITE)
        out.append(1 if not tail else 2 if (role, text) in seen else 3 if tail[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def brute(rows):
    """All edits by recursion over suffixes; the pattern is tested as text on the initials that come out."""
    rows, n = ordered(rows), len(rows)
    fault = faults(rows)

    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @functools.lru_cache(maxsize=None)
    def best(i, state):
        """Up to three insertions, and then the row's own edits."""
        ways, cost, letters, turns = [], 0, "", ()
        for _ in range(4):
            rest = after(i, state)
            if rest is not None:
                ways.append((cost + rest[0], letters + rest[1], turns + rest[2]))
            state = follows[state][-1]
            cost, letters, turns = cost + 5, letters + "I", (*turns, (name[state], ""))
        return min(ways, default=None)

    @functools.lru_cache(maxsize=None)
    def after(i, state):
        if i == n:
            return (0, "", ()) if state in ("", "a") else None
        role, text = rows[i][2:]
        options = [(2, "D", None)]
        if fault[i] not in (1, 2):
            more = 5 * (fault[i] == 3)
            options += [(more, "K", (role, text)), (1 + more, "R", ("user", text)), (1 + more, "R", ("assistant", text))]
        ways = []
        for cost, letter, turn in options:
            then = state if turn is None else turn[0][:1]
            if turn is None or (then and then in follows[state]):
                rest = best(i + 1, then)
                if rest is not None:
                    ways.append((cost + rest[0], letter + rest[1], (() if turn is None else (turn,)) + rest[2]))
        return min(ways, default=None)

    cost, audit, turns = best(0, "")
    assert re.fullmatch("(s?(ua)+)?", "".join(t[0][:1] for t in turns))
    turn = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    gaps = max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return gaps, fault.count(1), fault.count(2), fault.count(3), illegal, cost, audit, sha


def conversation(rng, conv, n):
    rows = []
    for k in range(n):
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.4 else ["user", "assistant"][k % 2]
        role = rng.choice(["system", "tool", "", None, "User"]) if rng.random() < 0.15 else role
        text = rng.choice(["Yes.", "Well", "", None, " \t", "No!  ", f"It is {rng.randint(0, 9)}.", "Ça va ?\n", "."])
        rows.append((conv, rng.choice([None, k, k, k, k // 2]), role, text))
    return rows


def check(spark, rows, partitions):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
        found, turns = repair_conversations(frame)
        shas = {r["conv_id"]: r["sha256"] for r in repaired_sha256(turns).collect()}
        got = {r["conv_id"]: (*tuple(r)[1:], shas.get(r["conv_id"], hashlib.sha256(b"").hexdigest())) for r in found.collect()}
        lines = {c: sum(r["turns"] != [] for r in turns.where(F.col("conv_id").eqNullSafe(F.lit(c))).collect()) for c in [rows[0][0]]} if rows else {}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = {c: brute([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want
    assert all(n <= len(rows) for n in lines.values())


def test_small_conversations(spark):
    rng = random.Random(1)
    rows = [r for c in range(150) for r in conversation(rng, c if c else None, rng.randint(1, 7))]
    check(spark, rows, "4")


@pytest.mark.parametrize("seed,partitions", [(2, "9"), (3, "16")])
def test_a_conversation_over_many_partitions(spark, seed, partitions):
    """A conversation of a third of all rows and one of half of them are put together from their units."""
    rng = random.Random(seed)
    rows = conversation(rng, 5, 120) + conversation(rng, None, 180) + [r for c in (3, 4, 6, 7) for r in conversation(rng, c, 15)]
    check(spark, rows, partitions)


def test_a_third_of_equal_rows(spark):
    rows = [(1, 1, "user", "Same.")] * 80 + [(1, 2, "assistant", "Well.")] * 40 + [(2, k, ["user", "assistant"][k % 2], f"T {k}.") for k in range(60)]
    check(spark, rows, "8")


def test_no_rows(spark):
    found, turns = repair_conversations(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and turns.count() == 0 and repaired_sha256(turns).count() == 0


def test_damage(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, k // 5]), rng.choice([None, k]), rng.choice([None, "user", "assistant"]), rng.choice([None, "A. b! c?", "x" * 5])) for k in range(400)]
    want = []
    for c, t, role, text in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        want += [(c, t, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    got = damage_conversations(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    assert got.columns == ["conv_id", "turn", "role", "text"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_distances_equal_bellman_ford():
    rng = random.Random(6)
    for _ in range(200):
        codes = bytes(rng.randrange(16) for _ in range(rng.randint(0, 9)))
        ends = tuple(rng.choice([0, 3, 10, 16, cr._LOWEST]) for _ in range(3)) + (rng.randint(0, 5),)
        n = len(codes)
        want = [cr._LOWEST] * (4 * n) + list(ends)
        for _ in range(4 * n + 4):
            for i in range(n):
                for s in range(4):
                    now = [want[4 * i + 4 + t] + c for _, c, t in cr.arcs(s, codes[i])] + [want[4 * i + cr._MADE[s]] + cr.INSERT, want[4 * i + s]]
                    want[4 * i + s] = min(now)
        got = distances(codes, ends)
        assert [min(x, cr._LOWEST) for x in got] == [min(x, cr._LOWEST) for x in want]


def test_long_conversation_alone():
    """100,000 rows in one unit: a queue, no recursion."""
    rng = random.Random(7)
    codes = bytes(rng.randrange(16) for _ in range(100_000))
    edits, cost = repair(codes)
    assert len(edits) == 100_000 and cost > 0


def test_query(spark, tmp_path):
    from tessera.llm.queries import op13_conversation_repair

    rng = random.Random(8)
    rows = [r for c in range(60) for r in conversation(rng, c, rng.randint(1, 6))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    after = [tuple(r) for r in damage_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in op13_conversation_repair(spark, str(tmp_path)).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: brute(a) if (a := [r for r in after if r[0] == c]) else nothing for c in range(60)}
    assert got == want
