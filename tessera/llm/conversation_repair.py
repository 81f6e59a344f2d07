"""Repair of conversations: the cheapest edits after which roles read ``(s?(ua)+)?``, by their initials.

Rows of a conversation, in order, and the four states of that pattern span a graph: a node for each place between rows
and each state, an arc for each edit. Costs are small integers, so Dial's bucket queue settles all nodes from the end
on without a heap; the audit is then read off by walking from the start along tight arcs, the least letter first.

Rows get their places by range partitioning on the whole order, so a conversation of any length is spread over
partitions. What one partition holds of one conversation is a unit. A conversation that crosses partitions (at most
one for each border between two of them) is put together from 4 x 4 tables of distances between the states at both
ends of its units, and from the states that walks lead to; the driver sees at most two units a partition.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, materialize, trim

#: White space of the contract: 0x20 and 0x09 to 0x0D.
SPACE = " \t\n\v\f\r"
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn; roles in the same numbers.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state an inserted or reroled turn leads to.
_MADE = (USER, USER, ASSISTANT, USER)
#: The role a kept turn must have, and the states from which it is in place.
_KEPT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
#: What is still to be paid where a conversation ends: an unanswered user turn needs an answer, a lone system turn both.
_END = (0, 2 * INSERT, INSERT, 0)
_WIDEST = REROLE + LEFT_TRUNCATED
_LOWEST = 1 << 62


# --- shortest paths ----------------------------------------------------------------------------------------


def arcs(state: int, code: int) -> list[tuple[str, int, int]]:
    """The edits of a row in a state as (letter, cost, next state); ``code`` is role + 4 * fault."""
    role, fault = code & 3, code >> 2
    out = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = LEFT_TRUNCATED if fault == TRUNCATED else 0
        if role in _KEPT[state]:
            out.append(("K", more, role))
        out.append(("A" if _MADE[state] == ASSISTANT else "U", REROLE + more, _MADE[state]))
    return out


#: Arcs backwards: for each code and state reached, (cost, state before).
_BACK = [[[(cost, s) for s in range(4) for _, cost, t in arcs(s, code) if t == reached] for reached in range(4)] for code in range(16)]
_BACK_INSERT = [[s for s in range(4) if _MADE[s] == reached] for reached in range(4)]


def distances(codes: bytes, ends: tuple[int, ...]) -> list[int]:
    """Cheapest costs from every node (4 * place + state) on, given those at the end; Dial's queue, backwards.

    No distance differs from one in the queue by more than an arc costs or the ends differ, so a ring of that many
    buckets holds all that is open.
    """
    n = len(codes)
    dist = [_LOWEST] * (4 * n + 4)
    known = [e for e in ends if e < _LOWEST]
    low, wide = min(known), max(max(known) - min(known), _WIDEST) + 1
    ring: list[list[int]] = [[] for _ in range(wide)]
    for state, e in enumerate(ends):
        if e < _LOWEST:
            dist[4 * n + state] = e
            ring[(e - low) % wide].append(4 * n + state)
    at, idle = low, 0
    while idle < wide:
        bucket = ring[(at - low) % wide]
        idle = 0 if bucket else idle + 1
        while bucket:
            node = bucket.pop()
            if dist[node] != at:
                continue
            place, state = node >> 2, node & 3
            if place < n:
                for s in _BACK_INSERT[state]:
                    if at + INSERT < dist[node - state + s]:
                        dist[node - state + s] = at + INSERT
                        ring[(at + INSERT - low) % wide].append(node - state + s)
            if place:
                first = node - state - 4
                for cost, s in _BACK[codes[place - 1]][state]:
                    if at + cost < dist[first + s]:
                        dist[first + s] = at + cost
                        ring[(at + cost - low) % wide].append(first + s)
        at += 1
    return dist


def walk(codes: bytes, dist: list[int], state: int, last: bool) -> tuple[list[str], int]:
    """Edits of each row along the tight arcs of least letters (D, I, K, R in this order), and the state at the end.

    A row's edits: ``u`` or ``a`` for turns inserted before it, then D, K, or U or A for the role it gets; a
    conversation's last row also has those inserted after it.
    """
    out, n = [], len(codes)
    for i in range(n):
        edits, node = "", 4 * i
        while True:
            now, after, options = dist[node + state], node + 4, arcs(state, codes[i])
            if dist[after + state] + DELETE == now:
                edits += "D"
                break
            if dist[node + _MADE[state]] + INSERT == now:
                state = _MADE[state]
                edits += "a" if state == ASSISTANT else "u"
                continue
            letter, _, state = next(o for o in options[1:] if dist[after + o[2]] + o[1] == now)
            edits += letter
            break
        out.append(edits)
    while last and _END[state]:
        state = _MADE[state]
        out[-1] += "a" if state == ASSISTANT else "u"
    return out, state


def _solve(codes: bytes, ends: tuple[int, ...], entry: int, last: bool) -> tuple[list[str], int]:
    dist = distances(codes, ends)
    edits, leaving = walk(codes, dist, entry, last)
    return edits, dist[entry] - (0 if last else ends[leaving])


#: Short conversations recur.
_solve_known = functools.lru_cache(maxsize=1 << 14)(_solve)


def repair(codes: bytes, ends: tuple[int, ...] = _END, entry: int = START, last: bool = True) -> tuple[list[str], int]:
    """Edits of each row, and their cost."""
    return (_solve_known if len(codes) <= 64 else _solve)(codes, ends, entry, last)


# --- plans -------------------------------------------------------------------------------------------------


def damage_conversations(rows: DataFrame) -> DataFrame:
    """Rows damaged by ``crc32(conv_id:turn) % 20``: 0 goes, 1 loses its text, 2 its ``.!?``, 3 is doubled, 4 is a user's.

    Nulls in any of the four columns count as one space there; conv_id and turn themselves stay null.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    kept = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    kept = kept.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))
    return kept.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def place_rows(rows: DataFrame) -> DataFrame:
    """Rows by (conv_id, turn, role, SHA-256 of role and text), nulls first, with ``place``: increasing in that order.

    The upper bits of a place are its range partition, so rows of one conversation, turn or text are spread like any
    others. Equal rows are interchangeable; the last key only tells the partitioner where it may cut among them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    keyed = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("digest", digest).withColumn("cut", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "digest", "cut"]
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    tail = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(START)
    fault = F.when(tail == "", BLANK).when(F.substring(tail, -1, 1).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    return materialize(placed.drop("cut").withColumn("code", (number + 4 * fault).cast("tinyint")), "placed")


def units_of(placed: DataFrame) -> DataFrame:
    """(conv_id, part, places, codes): what a range partition holds of a conversation, with duplicates found."""
    full = F.shiftright("code", 2) != BLANK
    firsts = placed.where(full).groupBy("conv_id", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    rows = placed.select("conv_id", "place", "code").join(firsts, "place", "left")
    again = full & F.col("first").isNull()
    code = F.when(again, F.col("code").bitwiseAND(3) + 4 * DUPLICATE).otherwise(F.col("code")).cast("tinyint")
    units = rows.groupBy("conv_id", F.shiftright("place", 33).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", code.alias("code")))).alias("rows"))
    return units.select("conv_id", "part", F.col("rows.place").alias("places"), F.col("rows.code").alias("codes"))


def _each_unit(units: DataFrame, schema: str, make) -> DataFrame:
    """One row for each unit: its conv_id, part and places, and the columns of ``schema``, which ``make`` gives as a tuple."""
    fields = T._parse_datatype_string(schema).fields
    whole = T.StructType([units.schema["conv_id"], units.schema["part"], units.schema["places"], *fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        trim()
        kinds = to_arrow_schema(whole)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                column = {c: part.column(part.schema.get_field_index(c)) for c in part.schema.names}
                codes = column["codes"]
                more = [column[c].to_pylist() for c in ("ends", "entry", "last") if c in column]
                made = [make(np.asarray(c.values).astype(np.uint8).tobytes(), *m) for c, *m in zip(codes, *more)]
                arrays = [column["conv_id"], column["part"], column["places"], *(pa.array([m[k] for m in made], kinds.field(3 + k).type) for k in range(len(fields)))]
                yield pa.RecordBatch.from_arrays(arrays, names=whole.names)

    return units.mapInArrow(each, whole)


def _table(codes: bytes) -> tuple[list[list[int]]]:
    columns = [distances(codes, tuple(0 if t == s else _LOWEST for s in range(4)))[:4] for t in range(4)]
    return ([list(row) for row in zip(*columns)],)


def _leaving(codes: bytes, ends, entry, last) -> tuple[list[int]]:
    dist = distances(codes, tuple(ends))
    return ([walk(codes, dist, s, last)[1] if dist[s] < _LOWEST else s for s in range(4)],)


def _edits(codes: bytes, ends, entry, last) -> tuple:
    edits, cost = repair(codes, _END if ends is None else tuple(ends), entry or START, last is not False)
    faults = [c >> 2 for c in codes]
    roles = [c & 3 for c in codes]
    odd = sum(not _adjacent(a, b) for a, b in zip(roles, roles[1:]))
    return edits, cost, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), odd, roles[0], roles[-1]


def _adjacent(a: int, b: int) -> bool:
    return (a, b) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def _crossing(units: DataFrame) -> list[Row]:
    """Of conversations in several partitions: each unit with the costs at its end, its first state, whether it is the last.

    Neighbouring partitions share one conversation at most, so these are fewer units than twice the partitions.
    """
    several = units.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("crossing"))
    several = [r["crossing"] for r in several.collect()]  # fewer than the partitions
    if not several:
        return []
    named = F.col("conv_id").isin([c for c in several if c is not None])
    held = units.where(F.coalesce(named, F.lit(False)) | (F.col("conv_id").isNull() & F.lit(None in several)))
    tables = sorted(_each_unit(held, "found array<array<bigint>>", _table).drop("places").collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"], r["part"]))
    plan, ends, later = {}, _END, None
    for r in reversed(tables):
        key = (r["conv_id"], r["part"])
        if later != r["conv_id"] or not plan:
            ends, last = _END, True
        else:
            last = False
        plan[key] = (ends, last)
        ends, later = tuple(min(a + b for a, b in zip(row, ends)) if min(row) < _LOWEST else _LOWEST for row in r["found"]), r["conv_id"]
    frame = _planned(held, [Row(conv_id=c, part=p, ends=list(e), entry=0, last=last) for (c, p), (e, last) in plan.items()])
    leads = {(r["conv_id"], r["part"]): r["found"] for r in _each_unit(frame, "found array<bigint>", _leaving).drop("places").collect()}
    out, state, before = [], START, None
    for r in tables:
        key = (r["conv_id"], r["part"])
        state = START if not out or before != r["conv_id"] else state
        out.append(Row(conv_id=key[0], part=key[1], ends=list(plan[key][0]), entry=int(state), last=plan[key][1]))
        state, before = leads[key][state], r["conv_id"]
    return out


def _planned(units: DataFrame, plan: list[Row]) -> DataFrame:
    """Units with ``ends``, ``entry`` and ``last``: null but for those in ``plan``, which is broadcast (two rows a partition)."""
    kind = T.StructType([units.schema["conv_id"], units.schema["part"], *T._parse_datatype_string("ends array<bigint>, entry int, last boolean").fields])
    table = units.sparkSession.createDataFrame(plan, kind).withColumnsRenamed({"conv_id": "plan_conv", "part": "plan_part"})
    joined = units.join(F.broadcast(table), F.col("conv_id").eqNullSafe(F.col("plan_conv")) & (F.col("part") == F.col("plan_part")), "left")
    return joined.drop("plan_conv", "plan_part")


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): the repair of each conversation, and each row's repaired turns.

    ``rows`` has conv_id, turn, role and text, and may have others, which are not looked at. Order: by turn, nulls
    first; rows of one turn by role, then by the SHA-256 of role and text; equal rows are equal. Null roles and texts
    count as one space (no role of the pattern; blank). Null conv_ids are one conversation. Without rows: no rows.

    ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    ``turns``: conv_id, place, turn, turns (array of edit, role, text; none for a deleted row), in order of place.
    """
    placed = place_rows(rows)
    units = materialize(units_of(placed), "units")
    kinds = "edits array<string>, cost bigint, blank bigint, duplicate bigint, truncated bigint, odd bigint, first int, final int"
    solved = materialize(_each_unit(_planned(units, _crossing(units)), kinds, _edits), "edits")
    discard(units)

    letters = F.translate(F.array_join("edits", ""), "uaUA", "IIRR")
    piece = F.struct("part", letters.alias("audit"), "first", "final")
    pieces = F.array_sort(F.collect_list(piece))  # one for each partition at most
    sums = [F.sum(c).alias(c) for c in ("cost", "blank", "duplicate", "truncated", "odd")]
    found = solved.groupBy("conv_id").agg(*sums, pieces.alias("pieces"))
    borders = F.expr("transform(sequence(1, size(pieces)), i -> CASE WHEN i = 1 THEN 0 WHEN pieces[i - 2].final * 4 + pieces[i - 1].first IN (6, 11, 14) THEN 0 ELSE 1 END)")
    illegal = F.col("odd") + F.aggregate(borders, F.lit(0).cast("bigint"), lambda a, b: a + b)
    turns = placed.groupBy(F.col("conv_id").alias("of")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    conversations = found.join(turns, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", illegal.alias("illegal"), "cost", F.array_join("pieces.audit", "").alias("audit"))

    edits = solved.select(F.explode(F.arrays_zip("places", "edits")).alias("e")).select(F.col("e.places").alias("place"), F.split("e.edits", "").alias("letters"))
    return conversations, placed.join(edits, "place").select("conv_id", "place", "turn", _turns().alias("turns"))


def _turns() -> Column:
    """The turns that a row's edits leave, from its letters, role and text."""

    def turn(x: Column) -> Column:
        kept = x == "K"
        role = F.when(kept, F.col("role")).when(F.lower(x) == "u", "user").otherwise("assistant")
        edit = F.when(kept, "K").when(x == F.lower(x), "I").otherwise("R")
        return F.struct(edit.alias("edit"), role.alias("role"), F.when(x == F.lower(x), "").otherwise(F.col("text")).alias("text"))

    return F.transform(F.filter("letters", lambda x: x.isin("u", "a", "U", "A", "K")), turn)


def sequence_sha256(rows: DataFrame, key: str, order: list[str], line: Column, joint: str = "\n") -> DataFrame:
    """(key, sha256): lowercase hex of each key's lines in order, joined; null lines do not count.

    SHA-256 is sequential, so a key is hashed in one task, line by line as they come from the sorted exchange.
    """
    lines = rows.select(F.col(key), *order, line.alias("line")).where("line IS NOT NULL").repartition(key).sortWithinPartitions(key, *order)
    schema = T.StructType([lines.schema[key], T.StructField("sha256", T.StringType())])
    between = joint.encode()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, state = None, None, None
        for batch in batches:
            keys, done, sums = batch.column(0), [], []
            kind = keys.type
            for k, text in zip(keys.to_pylist(), batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()):
                if state is None or k != now:
                    if state is not None:
                        done.append(now)
                        sums.append(state.hexdigest())
                    now, state = k, hashlib.sha256(text)
                else:
                    state.update(between)
                    state.update(text)
            yield pa.RecordBatch.from_arrays([pa.array(done, kind), pa.array(sums, pa.string())], names=[key, "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([state.hexdigest()], pa.string())], names=[key, "sha256"])

    return lines.mapInArrow(digest, schema)


def repaired_sha256(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the repaired ``role:text``, newline-joined; conversations without a turn are left out."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return sequence_sha256(turns, "conv_id", ["place"], F.when(F.size("turns") > 0, lines))
