"""Repair of conversation structure by Dial's bucket-queue shortest paths.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``.
Edits bring it there: Keep costs 0, Rerole 1, Delete 2, Insert 5, and a
truncated message that stays costs 5 more.  They are the arcs of a layered
graph whose nodes are (rows done, state of the expression).  All costs are
small integers, so that Dial's ring of buckets settles the nodes in order;
the distances are recorded, and walking the tight arcs, the least letter
first, spells the ASCII-least of the cheapest audits.

Decisions need no text: rows are reduced to keys, digests and counts of equal
rows before they are sorted by range, so that a conversation of any length is
spread over tasks and cut into segments of at most SEGMENT rows.  A segment
yields the best path from each state to each state.  Every path ends in a
letter of a row, so that no two of them begin alike to the end of one, and
the segments' paths can be put together state by state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stash

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SEGMENT = 4096
#: State after each initial: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: "user", 1: "user", 2: "assistant", 3: "user"}
AFTER = {q: STEP[q, role[0]] for q, role in NEXT.items()}
#: Inserts that complete a conversation whose rows have all been read, and the state that stands for one completed.
TAIL = {0: "", 1: "II", 2: "I", 3: ""}
DONE = 4
LEGAL = {"su", "ua", "au"}
SPACE = r"\x20\x09-\x0D"
BATCH = 2048


def arcs(initial: str, forced: bool, truncated: bool) -> list[list[tuple[str, int, int]]]:
    """For each state the arcs over a row: letter, cost, next state; letters in order."""
    extra = TRUNCATED if truncated else 0
    out = []
    for q in range(4):
        own = [("D", DELETE, q)]
        if not forced:
            if (q, initial) in STEP:
                own.append(("K", KEEP + extra, STEP[q, initial]))
            own.append(("R", REROLE + extra, AFTER[q]))
        out.append(own)
    return out


#: Arcs by code: the place of the initial in "sua " times 3, plus 1 for a row that must go and 2 for a truncated one.
ARCS = [arcs(c, kind == 1, kind == 2) for c in "sua " for kind in range(3)]
INTO = [[[(q, cost) for q in range(4) for _, cost, to in table[q] if to == end] for end in range(4)] for table in ARCS]
INSERTED = [[q for q in range(4) if AFTER[q] == end] for end in range(4)]
RING = 1 + max(INSERT, *(cost for table in ARCS for own in table for _, cost, _ in own))


def dial(codes: list[int], goals: dict[int, int]) -> list[int | None]:
    """Cost from each node (row * 4 + state) to the end; ``goals`` has the cost from each state behind the last row."""
    last = len(codes) * 4
    dist: list[int | None] = [None] * (last + 4)
    # beyond the ring's own span only goals lie, which join when their cost comes up
    later = sorted(((cost, q) for q, cost in goals.items()), reverse=True)
    ring: list[list[int]] = [[] for _ in range(RING)]
    waiting, at = 0, later[-1][0]
    while waiting or later:
        while later and later[-1][0] == at:
            ring[at % RING].append(last + later.pop()[1])
            waiting += 1
        bucket = ring[at % RING]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] is not None:
                continue
            dist[node] = at
            i, q = divmod(node, 4)
            if i:
                for p, cost in INTO[codes[i - 1]][q]:
                    if dist[node - 4 - q + p] is None:
                        ring[(at + cost) % RING].append(node - 4 - q + p)
                        waiting += 1
            if node < last:
                for p in INSERTED[q]:
                    if dist[node - q + p] is None:
                        ring[(at + INSERT) % RING].append(node - q + p)
                        waiting += 1
        at += 1
    return dist


def walk(codes: list[int], copies: list[int], dist: list[int | None], start: int) -> tuple[str, int]:
    """The ASCII-least letters of a cheapest path from ``start``, and its last state.

    Copies of a row can only be deleted, which changes no state, so that their
    letters stand at once behind the row's own.
    """
    letters, i, q = [], 0, start
    while i < len(codes):
        left = dist[i * 4 + q]
        for letter, cost, to in ARCS[codes[i]][q]:
            if letter > "I" and dist[i * 4 + AFTER[q]] is not None and left == INSERT + dist[i * 4 + AFTER[q]]:
                letters.append("I")
                q = AFTER[q]
                break
            ahead = dist[i * 4 + 4 + to]
            if ahead is not None and left == cost + ahead:
                letters.append(letter)
                if copies[i] > 1:
                    letters.append("D" * (copies[i] - 1))
                i, q = i + 1, to
                break
        else:  # a row that can only be deleted, and whose cheapest path inserts first
            letters.append("I")
            q = AFTER[q]
    return "".join(letters), q


def paths(codes: list[int], copies: list[int], whole: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of a segment; one path alone for a whole conversation."""
    more = DELETE * (sum(copies) - len(copies))
    if whole:
        dist = dial(codes, {q: INSERT * len(t) for q, t in TAIL.items()})
        audit, q = walk(codes, copies, dist, 0)
        return [(0, DONE, dist[0] + more, audit + TAIL[q])]
    out = []
    for end in range(4):
        dist = dial(codes, {end: 0})
        out += [(p, end, dist[p] + more, walk(codes, copies, dist, p)[0]) for p in range(4) if dist[p] is not None]
    return out


def joined(segments: Iterator[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from its segments' paths, in order.

    ``rank`` orders the states' audits so far: none is the beginning of
    another, so that later letters do not change their order.
    """
    best = {0: (0, 0, None)}  # state: cost, rank, pieces so far as a linked list
    for found in segments:
        chosen = {}
        for p, q, cost, audit in found:
            if p in best:
                mine = (best[p][0] + cost, best[p][1], audit, p)
                chosen[q] = min(chosen.get(q, mine), mine)
        order = sorted(chosen, key=lambda q: chosen[q][1:3])
        best = {q: (chosen[q][0], order.index(q), (best[chosen[q][3]][2], chosen[q][2])) for q in chosen}
    cost, _, q = min((c + INSERT * len(TAIL.get(q, "")), rank, q) for q, (c, rank, _) in best.items())
    pieces, at = [TAIL.get(q, "")], best[q][2]
    while at:
        at, piece = at
        pieces.append(piece)
    return cost, "".join(reversed(pieces))


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH):
            part = batch.slice(lo, BATCH)
            yield from zip(*[part.column(c).to_pylist() for c in columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most ``size`` rows and about 8 MiB of text."""
    held, text = [], 0
    for row in rows:
        held.append(row)
        text += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == size or text > 1 << 23:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, text = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(df: DataFrame, conv: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[conv].dataType)


def messages(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as _conv, _turn, _role, _text; a null role or text is one space."""
    return rows.select(F.col(conv).alias("_conv"), F.col(turn).cast("long").alias("_turn"), F.coalesce(F.col(role), F.lit(" ")).alias("_role"), F.coalesce(F.col(text), F.lit(" ")).alias("_text"), F.lit(False).alias("_lost"))


def damage(rows: DataFrame) -> DataFrame:
    """``messages`` with the damage that crc32(`conv:turn`) % 20 names; a dropped row stays as ``_lost`` for its conversation's sake."""
    name = F.concat(F.coalesce(F.col("_conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("_turn").cast("string"), F.lit(" ")))
    hit = rows.withColumn("_hit", F.crc32(name.cast("binary")) % 20)
    return hit.select(
        "_conv",
        "_turn",
        F.when(F.col("_hit") == 4, "user").otherwise(F.col("_role")).alias("_role"),
        F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text")).alias("_text"),
        (F.col("_lost") | (F.col("_hit") == 0)).alias("_lost"),
        F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def digest(text: str = "_text") -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts: _conv, _turn, _role, _digest, _lost, n, _again (an earlier turn has role and text), blank, truncated.

    Equal rows are counted before they are shuffled, and first turns are found
    by an aggregate and a join, which AQE splits, so that neither a long
    conversation nor an often repeated message passes through one task.
    """
    slim = rows.select(
        "_conv",
        F.when(~F.col("_lost"), F.col("_turn")).alias("_turn"),
        F.when(F.col("_lost"), "").otherwise(F.col("_role")).alias("_role"),
        F.when(~F.col("_lost"), digest()).otherwise(F.lit(b"")).alias("_digest"),
        "_lost",
        (~F.col("_text").rlike(f"[^{SPACE}]")).alias("_blank"),
        F.col("_text").rlike(f"[^{SPACE}.!?][{SPACE}]*\\z").alias("_open"),
    )
    counted = stash(slim.groupBy("_conv", "_turn", "_role", "_digest", "_lost").agg(F.count("*").alias("n"), F.first("_blank").alias("_blank"), F.first("_open").alias("_open")), "counted")
    place = F.struct(F.col("_turn").isNotNull(), "_turn")
    known = counted.filter("not _lost").groupBy("_conv", "_role", "_digest").agg(F.min(place).alias("_first"), F.count("*").alias("_turns")).filter("_turns > 1")
    known = known.select(F.col("_conv").alias("_c"), F.col("_role").alias("_r"), F.col("_digest").alias("_d"), "_first")
    same = F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_role") == F.col("_r")) & (F.col("_digest") == F.col("_d"))
    both = counted.join(known.hint("merge"), same, "left")
    return both.select("_conv", "_turn", "_role", "_digest", "_lost", "n", "_blank", "_open", F.coalesce(F.col("_first") < place, F.lit(False)).alias("_again"))


_PARTS = "_seg long, blank long, duplicate long, truncated long, illegal long, first string, last string, first_turn long, last_turn long, turns long, paths array<struct<p:int,q:int,cost:long,audit:string>>"
_PATHS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def segments(judged: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row for each run of at most ``segment`` distinct rows of a conversation, numbered in order, with its counts and paths."""
    order = ["_conv", "_turn", "_role", "_digest"]
    ranged = judged.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = _arrow(judged, "_conv")
    schema = pa.schema([("_conv", kind), *((c, pa.int64()) for c in ("_seg", "blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("first_turn", "last_turn", "turns")), ("paths", _PATHS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40

        def summary(conv, seg, rows, whole):
            live = [r for r in rows if not r[4]]
            codes, copies, counts, illegal, before, turns = [], [], [0, 0, 0], 0, "", []
            for _, turn, role, _, _, n, blank, open_, again in live:
                initial = role[:1] if role[:1] in ("s", "u", "a") else " "
                illegal += (n - 1) + (before != "" and before + initial not in LEGAL)
                before = initial
                if blank:
                    counts[0] += n
                else:
                    counts[1] += n if again else n - 1
                    counts[2] += open_ and not again
                codes.append("sua ".index(initial) * 3 + (1 if blank or again else 2 if open_ else 0))
                copies.append(n)
                if turn is not None and (not turns or turns[-1] != turn):
                    turns.append(turn)
            found = paths(codes, copies, whole) if codes or whole else [(p, p, 0, "") for p in range(4)]
            ends = [r[2][:1] if r[2][:1] in ("s", "u", "a") else " " for r in (live[0], live[-1])] if live else [None, None]
            return (conv, base + seg, *counts, illegal, *ends, turns[0] if turns else None, turns[-1] if turns else None, len(turns), [dict(zip(("p", "q", "cost", "audit"), f, strict=True)) for f in found])

        def made():
            rows = _runs(batches, [*order, "_lost", "n", "_blank", "_open", "_again"])
            seg, held, opened = 0, [], True  # opened: the conversation may have rows outside ``held``
            for row in rows:
                if held and row[0] != held[-1][0]:
                    yield summary(held[0][0], seg, held, not opened)
                    seg, held, opened = seg + 1, [], False
                elif len(held) == segment:
                    yield summary(held[0][0], seg, held, False)
                    seg, held, opened = seg + 1, [], True
                held.append(row)
            if held:
                yield summary(held[0][0], seg, held, False)

        # an audit is as long as its segment
        return _batches(made(), schema, 64)

    return ranged.mapInArrow(run, f"_conv {judged.schema['_conv'].dataType.simpleString()}, {_PARTS}")


def report(parts: DataFrame) -> DataFrame:
    """A row for each conversation: _conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    kind = _arrow(parts, "_conv")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = pa.schema([("_conv", kind), *((c, pa.int64()) for c in names), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def folded(rows):
            for conv, own in groupby(_runs(batches, ["_conv", "_seg", "blank", "duplicate", "truncated", "illegal", "first", "last", "first_turn", "last_turn", "turns", "paths"]), key=lambda r: r[0]):
                counts, ends, seen = [0, 0, 0, 0], None, [None, None, 0]

                def each(own=own, counts=counts, seen=seen):
                    nonlocal ends
                    for r in own:
                        for k in range(4):
                            counts[k] += r[2 + k]
                        if r[6] is not None:
                            counts[3] += ends is not None and ends + r[6] not in LEGAL
                            ends = r[7]
                        if r[8] is not None:
                            seen[2] += r[10] - (seen[1] == r[8])
                            seen[0] = r[8] if seen[0] is None else seen[0]
                            seen[1] = r[9]
                        yield [(x["p"], x["q"], x["cost"], x["audit"]) for x in r[11]]

                cost, audit = joined(each())
                gaps = 0 if seen[0] is None else min(seen[1] - seen[0] + 1 - seen[2], (1 << 63) - 1)
                yield (conv, gaps, *counts, cost, audit)

        return _batches(folded(batches), schema)

    rows = parts.repartition("_conv").sortWithinPartitions("_conv", "_seg")
    return rows.mapInArrow(run, f"_conv {parts.schema['_conv'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names) + ", audit string")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The messages that the audits leave: _conv, place, edit (K, R or I), role, text.

    A conversation's messages stand in one partition, in order.  Rows pass in
    a stream beside the audit, so that a task holds no more of a conversation
    than its audit, which is one value of the result.
    """
    kind = _arrow(rows, "_conv")
    schema = pa.schema([("_conv", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    heads = audits.select("_conv", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_turn"), F.lit("").alias("_role"), F.lit(b"").alias("_digest"), F.col("audit").alias("_text"))
    every = heads.unionByName(rows.filter("not _lost").select("_conv", F.lit(1).alias("_kind"), "_turn", "_role", digest().alias("_digest"), "_text"))
    streamed = every.repartition("_conv").sortWithinPartitions("_conv", "_kind", "_turn", "_role", "_digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for conv, own in groupby(_runs(batches, ["_conv", "_role", "_text"]), key=lambda r: r[0]):
                letters = iter(next(own)[2])
                q = place = 0
                for _, role, text in own:
                    for letter in letters:
                        if letter == "D":
                            break
                        if letter != "K":
                            given, q = NEXT[q], AFTER[q]
                        else:
                            given, q = role, STEP[q, role[0]]
                        yield conv, place, letter, given, "" if letter == "I" else text
                        place += 1
                        if letter != "I":
                            break
                for letter in letters:  # inserts behind the last row
                    yield conv, place, letter, NEXT[q], ""
                    q, place = AFTER[q], place + 1

        return _batches(made(), schema)

    return streamed.mapInArrow(run, f"_conv {rows.schema['_conv'].dataType.simpleString()}, place long, edit string, role string, text string")


def digests(kept: DataFrame) -> DataFrame:
    """_conv and the SHA-256 of its `role:text` lines, for messages that stand as ``repaired`` leaves them."""
    schema = pa.schema([("_conv", _arrow(kept, "_conv")), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for conv, own in groupby(_runs(batches, ["_conv", "role", "text"]), key=lambda r: r[0]):
                sha, sep = hashlib.sha256(), b""
                for _, role, text in own:
                    sha.update(sep + role.encode() + b":")
                    sha.update(text.encode())
                    sep = b"\n"
                yield conv, sha.hexdigest()

        return _batches(made(), schema)

    return kept.mapInArrow(run, f"_conv {kept.schema['_conv'].dataType.simpleString()}, repaired_sha256 string")


def repair(rows: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Report and repaired messages of ``messages`` rows.

    A conversation's rows are taken by turn, a null one first, then by role
    and SHA-256 of the text; repeated rows are rows each.  A null conversation
    is one like any other.  No rows give no conversations.  A number of gaps
    beyond 64 bits is the largest long.
    """
    told = stash(report(segments(faults(rows), segment)), "audits")
    return told, repaired(rows, told)


def audit(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Repair of the damaged conversations: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    One row for each conversation, null among them.  A null role or text is
    one space, which is blank as a text.  Other columns are not looked at.
    """
    told, kept = repair(damage(messages(conversations, conv, turn, role, text)), segment)
    sums = digests(kept).select(F.col("_conv").alias("_c"), "repaired_sha256")
    out = told.join(sums.hint("merge"), F.col("_conv").eqNullSafe(F.col("_c")), "left")
    none = hashlib.sha256().hexdigest()
    return out.select(F.col("_conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
