import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from corpusgraph.llm import chatrepair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def chats():
    rng = random.Random(3)
    rows = []
    texts = ["Yes.", "No!", "why", "so it is", "Yes. ", "", " \n", "a.b", "ends?\t", "世界。", "x" * 5000 + ".", None]
    for conv in range(120):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 0, 3]), role, rng.choice(texts) if rng.random() < 0.5 else f"text {conv} {turn}."))
    rows += [(None, t, r, x) for t, r, x in ((0, "user", "hm."), (None, "system", "s."), (4, None, None), (-3, "assistant", "k"))]
    rows += [(500, i, ("user", "assistant")[i % 2], f"long {i}.") for i in range(300)]
    rows += [(501, i // 40, "user", "again") for i in range(200)]
    rows += [(502, -(2**62) * 2, "user", "least."), (502, 2**63 - 1, "assistant", "most.")]
    return rows + [(600 + c, t, "user", "gone") for c in range(60) for t in range(1)]


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(name.encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def brute(rows):
    """All that the query returns of a conversation, by a search over whole (cost, audit) pairs."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = min(2**63 - 1, max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    good = re.compile("(s?(ua)+)?")
    begins = re.compile("s?(ua)*u?")
    state = lambda x: (x == "s", len(x) % 2 if x[:1] != "s" else 1 - len(x) % 2, x == "")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, kept = heapq.heappop(heap)
        if i == len(rows) and good.fullmatch(initials):
            break
        if (i, state(initials)) in done:
            continue
        done.add((i, state(initials)))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, initials + role[0], (*kept, f"{role}:"))) if begins.fullmatch(initials + role[0]) else None
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, initials, kept))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                for letter, role, price in (("K", rows[i][1], 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if role and begins.fullmatch(initials + role[0]):
                        heapq.heappush(heap, (cost + more + price, audit + letter, i + 1, initials + role[0], (*kept, f"{role}:{rows[i][2]}")))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    return chats()


@pytest.fixture(scope="module")
def want(rows):
    by = damaged(rows)
    return {c: brute(by[c]) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("segment", [chatrepair.SEGMENT, 1, 3])
def test_brute_force(spark, rows, want, segment):
    got = chatrepair.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), segment=segment).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    assert len(got) == len(want)


def test_every_letter(want):
    # an insert never pays at these costs: deleting the message that it would go with is cheaper
    assert {x for w in want.values() for x in w[6]} == set("DKR")
    assert any(w == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for w in want.values())


def test_inserts():
    # inside a conversation, between states that rows alone do not join
    for codes, start, end, audit, cost in (([3], 2, 2, "D", 2), ([1], 2, 3, "ID", 7), ([8], 0, 3, "IK", 10), ([], 1, 1, "", 0)):
        found = {(p, q): (c, a) for p, q, c, a in chatrepair.paths(codes, [1] * len(codes), False)}
        assert found[start, end] == (cost, audit)
    assert chatrepair.joined(iter([[(0, 1, 0, "K")], [(1, 1, 2, "D")]])) == (12, "KDII")


def test_messages(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello again."), (2, 0, "user", "Only."), (3, 0, "tool", "no")]
    told, kept = chatrepair.repair(chatrepair.messages(spark.createDataFrame(rows, SCHEMA)))
    assert {r._conv: r.audit for r in told.collect()} == {1: "KRK", 2: "D", 3: "D"}
    assert [tuple(r) for r in kept.orderBy("_conv", "place").collect()] == [(1, 0, "K", "system", "Be kind."), (1, 1, "R", "user", "Hello."), (1, 2, "K", "assistant", "Hello again.")]


def test_one_conversation_in_many_tasks(spark):
    n = 20_000
    df = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text ', id, '.') as text").repartition(4)
    judged = chatrepair.faults(chatrepair.messages(df))
    parts = chatrepair.segments(judged, 512)
    assert parts.count() >= n // 512
    one = chatrepair.report(parts).collect()
    assert len(one) == 1 and one[0].audit == "K" * n and one[0].cost == 0


def test_many_equal_rows(spark):
    df = spark.range(30_000).selectExpr("7L as conv_id", "id % 2 as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "'same.' as text")
    told, kept = chatrepair.repair(chatrepair.messages(df))
    one = told.first()
    assert one.audit == "K" + "D" * 14_999 + "K" + "D" * 14_999 and one.duplicate == 29_998 and one.illegal == 29_998
    assert [r.role for r in kept.orderBy("place").collect()] == ["user", "assistant"]


def test_edges(spark, rows, same):
    df = spark.createDataFrame(rows, SCHEMA)
    names = ("_conv", "_turn", "n", "audit", "place", "_seg", "_lost", "cost", "blank")
    clashing = spark.createDataFrame([(*r, *["?"] * len(names)) for r in rows], SCHEMA + "".join(f", {c} string" for c in names))
    same(chatrepair.audit(clashing), chatrepair.audit(df))
    assert chatrepair.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    few = spark.createDataFrame([r for r in rows if r[1] is None or abs(r[1]) < 100], SCHEMA)
    named = few.selectExpr("concat('c', conv_id) as conv_id", "cast(turn as int) as turn", "role", "text")
    assert chatrepair.audit(named).count() == named.select("conv_id").distinct().count()
