"""Folding nodes and edges against plain loops over random graphs."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import merging as M

MENTION = "seq long, node_type string, name string, aliases array<string>, attributes map<string,string>, confidence double, provenance array<struct<paper:string,evidence:string>>"
ARRIVING = "seq long, relation_type string, source_node long, target_node long, attributes map<string,string>, confidence double, evidence_tier string, provenance array<struct<paper:string,evidence:string>>"


def key(name):
    return re.sub(r"[\s_\-/\\.,;:'\"()\[\]{}]+", " ", name or "").strip().lower()


def mentions(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Foo", "foo ", "Foo-bar", "foo bar", "baz", "BAZ.", "qux", "Qux (a)", "one", "two", "three", "four", "five", "six"]) + rng.choice(["", "", " x", " 1", " 2", " 3"])
    out = []
    for i in range(n):
        aliases = None if rng.random() < 0.3 else [rng.choice([word(), "", None, word()]) for _ in range(rng.randrange(0, 3))]
        attrs = None if rng.random() < 0.3 else {k: rng.choice(["1", "2", "", None, "3"]) for k in rng.sample("abc", rng.randrange(0, 3))}
        prov = None if rng.random() < 0.2 else [(rng.choice(["p1", "p2", None]), rng.choice(["s1", "s2", ""])) for _ in range(rng.randrange(0, 3))]
        out.append((i + 10, rng.choice(["t", "u"]), rng.choice([word(), word(), word(), " - "]) if i else None, aliases, attrs, rng.choice([None, 0.2, 0.9, 1.7, -1.0]), prov))
    return out


def unique(xs):
    return list(dict.fromkeys(xs))


def folded(rows):
    """The nodes that mentions come to: groups that share a key, in order of arrival."""
    rows = sorted(r for r in rows if key(r[2]))
    group = {}
    owner = {}
    for r in rows:
        group[r[0]] = r[0]

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for r in rows:
        for name in [r[2], *(r[3] or [])]:
            if key(name):
                other = owner.setdefault((r[1], key(name)), r[0])
                a, b = find(other), find(r[0])
                group[max(a, b)] = min(a, b)
    out = defaultdict(list)
    for r in rows:
        out[find(r[0])].append(r)
    nodes = {}
    for ident, own in out.items():
        norm = key(own[0][2])
        aliases = unique(a for r in own for a in [*(x for x in r[3] or [] if (x or "").strip()), *([r[2]] if key(r[2]) != norm else [])])
        attrs = defaultdict(list)
        for r in own:
            for k, v in (r[4] or {}).items():
                if (v or "").strip() and v not in attrs[k]:
                    attrs[k].append(v)
        nodes[ident] = (own[0][1], own[0][2], norm, aliases, {k: v for k, v in attrs.items() if v}, unique(p for r in own for p in r[6] or []), max(max(0.0, min(1.0, r[5] or 0.0)) for r in own), own[0][0], own[-1][0], len(own))
    return nodes


def shown(nodes):
    rows = M.described(nodes).collect()
    return {r.node_id: (r.node_type, r.name, r.normalized_name, r.aliases, r.attributes, [tuple(p) for p in r.provenance], r.confidence, r.first_seen, r.last_seen, r.mentions) for r in rows}


@pytest.mark.parametrize("cuts", [[], [40], [1, 2, 60, 100]])
def test_upsert_nodes(spark, cuts):
    rows = mentions(1)
    nodes = spark.createDataFrame([], M.NODE)
    dropped, last = {}, 0
    for cut in [*cuts, len(rows)]:
        before = set(shown(nodes))
        nodes, mapping = M.upsert_nodes(nodes, spark.createDataFrame(rows[last:cut], MENTION).repartition(3))
        dropped |= {r["drop"]: r.keep for r in mapping.collect()}
        last = cut
        assert set(shown(nodes)) == set(folded(rows[:cut]))
        assert set(dropped) & before == before - set(shown(nodes)) or not cuts
    got, want = shown(nodes), folded(rows)
    assert len(want) > 5
    for ident, node in want.items():
        # attributes of one mention have no order among them
        assert got[ident] == node
    for drop, keep in dropped.items():
        assert drop not in got and keep < drop


def test_upsert_of_nothing(spark):
    nodes, mapping = M.upsert_nodes(spark.createDataFrame([], M.NODE), spark.createDataFrame([], MENTION))
    assert nodes.count() == mapping.count() == 0
    assert [f.name for f in nodes.schema] == [f.name for f in spark.createDataFrame([], M.NODE).schema]


def arriving(seed, n=150):
    rng = random.Random(seed)
    return [(i + 1, rng.choice(["is", "has"]), rng.randrange(4), rng.randrange(4), rng.choice([None, {"a": str(i)}, {"a": "", "b": "1"}]), rng.choice([None, 0.3, 0.8, 1.5]), rng.choice([None, "", "weak", "strong"]), rng.choice([None, [], [("p", "1")], [("p", "2"), ("q", None), ("p", "1")]])) for i in range(n)]


@pytest.mark.parametrize("cuts", [[], [3, 70]])
def test_upsert_edges(spark, cuts):
    rows = arriving(2)
    edges, last = spark.createDataFrame([], M.EDGE), 0
    for cut in [*cuts, len(rows)]:
        edges, last = M.upsert_edges(edges, spark.createDataFrame(rows[last:cut], ARRIVING)), cut
    groups = defaultdict(list)
    for r in rows:
        groups[r[1:4]].append(r)
    for r in edges.collect():
        own = groups.pop((r.relation_type, r.source_node, r.target_node))
        assert r.edge_id == own[0][0] and {x.name: x.value for x in r.attributes} == {k: v for k, v in (own[0][4] or {}).items() if v}
        assert r.confidence == max(max(0, min(1, o[5] or 0)) for o in own)
        assert r.evidence_tier == next((o[6] for o in reversed(own) if o[6]), None)
        assert [(x.paper, x.evidence) for x in r.provenance] == unique(p for o in own for p in o[7] or [])
    assert not groups


def test_resolve(spark):
    chain = [(i + 1, i) for i in range(10)]
    circle = [(101, 102), (102, 103), (103, 101), (110, 102), (111, 110)]
    rng = random.Random(1)
    tree = [(i, rng.randrange(1000, i)) for i in range(1001, 1200)]
    two = [(301, 302), (302, 301), (400, 400), (500, 501), (500, 502)]
    got = {r["drop"]: r.root for r in M.resolve(spark.createDataFrame(chain + circle + tree + two, "drop long, keep long")).collect()}
    want = {i: 0 for i in range(1, 11)} | {102: 101, 103: 101, 110: 101, 111: 101} | {i: 1000 for i in range(1001, 1200)} | {302: 301, 500: 501}
    assert got == want
    assert M.resolve(spark.createDataFrame([], "drop long, keep long")).count() == 0


def graph(spark, seed, names):
    rng = random.Random(seed)
    nodes, seen = [], set()
    for i, (kind, name, aliases) in enumerate(names):
        if (kind, key(name)) in seen:
            continue
        seen.add((kind, key(name)))
        own = [(i + 1, k, a, False) for k, a in enumerate(aliases)] + [(i + 1, M.OWN, name, True)]
        nodes.append((i + 1, kind, name, key(name), sorted(own), [(i + 1, 0, "a", str(i % 2))], [(i + 1, 0, f"p{i % 3}", "s")], i % 10 / 10, i + 1, i + 1, 1))
    ids = [n[0] for n in nodes]
    edges = {}
    for k in range(4 * len(ids)):
        edges.setdefault((rng.choice("xy"), rng.choice(ids), rng.choice(ids)), k + 1)
    edges = [(k, r, s, t, [(k, 0, "n", str(k % 3))], k % 7 / 7, rng.choice([None, "", "w", "z"]), k, [(k, 0, f"p{k % 5}", str(k % 2))]) for (r, s, t), k in edges.items()]
    members = sorted({(rng.randrange(25), rng.choice(ids), rng.choice("ab")) for _ in range(40)})
    measurements = [(h, "m", rng.choice([None, rng.choice(ids)])) for h in range(26)]
    events = [(e, rng.choice([None, [], [rng.choice(ids) for _ in range(rng.randrange(1, 5))]])) for e in range(30)]
    frames = {
        "nodes": spark.createDataFrame(nodes, M.NODE),
        "edges": spark.createDataFrame(edges, M.EDGE),
        "members": spark.createDataFrame([(h, n, r, i) for i, (h, n, r) in enumerate(members)], "hyperedge_id long, node_id long, role string, position int"),
        "measurements": spark.createDataFrame(measurements, "hyperedge_id long, metric string, subject_node long"),
        "events": spark.createDataFrame(events, "id long, entity_refs array<long>"),
        "hyperedges": spark.createDataFrame([(h, "k") for h in range(26)], "hyperedge_id long, hyperedge_type string"),
        "conditions": spark.createDataFrame([(h, "c") for h in range(26)], "hyperedge_id long, condition_key string"),
    }
    return frames, nodes, edges, members, measurements, events


def state_of(out):
    """What can be compared: without ids of edges, and sets where order is a choice."""
    return {
        "edges": {(r.relation_type, r.source_node, r.target_node): (round(r.confidence, 6), frozenset((p.paper, p.evidence) for p in r.provenance)) for r in out["edges"].collect()},
        "members": {(r.hyperedge_id, r.node_id, r.role) for r in out["members"].collect()},
        "events": {r.id: r.entity_refs for r in out["events"].collect()},
        "measurements": sorted((r.hyperedge_id, r.metric, r.subject_node or -1) for r in out["measurements"].collect()),
    }


def by_loop(edges, members, measurements, events, steps):
    """Merges and drops one after the other: steps of (node, the node it becomes, or None)."""
    e = {(r, s, t): (round(c, 6), frozenset((p[2], p[3]) for p in prov)) for _, r, s, t, _, c, _, _, prov in edges}
    m, ms, ev = set(members), list(measurements), dict(events)
    for a, b in steps:
        moved = [(k, v) for k, v in e.items() if a in k[1:]]
        for k, _ in moved:
            del e[k]
        for (r, s, t), (c, prov) in moved:
            new = (r, b if s == a else s, b if t == a else t)
            if b is None or new[1] == new[2]:
                continue
            old = e.get(new, (0, frozenset()))
            e[new] = (max(c, old[0]), prov | old[1])
        m = {(h, b if n == a else n, r) for h, n, r in m}
        m = {x for x in m if x[1] is not None}
        ms = [(h, k, b if n == a else n) for h, k, n in ms]
        ev = {i: None if refs is None else unique(b if n == a else n for n in refs if n != a or b is not None) if a in refs else refs for i, refs in ev.items()}
    return e, m, ms, ev


@pytest.mark.parametrize("seed", [1, 2])
def test_merge(spark, seed):
    rng = random.Random(seed)
    frames, nodes, edges, members, measurements, events = graph(spark, seed, [("t", f"node {i}", [f"alias {i % 7}"]) for i in range(40)])
    pairs = [(i + 1, i, "chain") for i in range(1, 11)] + [(21, 30, "up"), (30, 22, "down"), (33, 40, "x"), (25, 40, "y")]
    out = M.merge(frames, spark.createDataFrame(pairs, "drop long, keep long, reason string"), "dictionary", "test")
    root = {i: 1 for i in range(2, 12)} | {21: 22, 30: 22, 33: 40, 25: 40}
    e, m, ms, ev = by_loop(edges, members, measurements, events, sorted(root.items()))
    got = state_of(out)
    assert got["edges"] == e and got["members"] == m and got["measurements"] == sorted((h, k, n or -1) for h, k, n in ms)
    assert got["events"] == ev
    kept = shown(out["nodes"])
    assert set(kept) == {n[0] for n in nodes} - set(root)
    assert kept[1][3] == unique(f"alias {i % 7}" for i in range(11)) and kept[1][4] == {"a": ["0", "1"]} and kept[1][9] == 11
    assert kept[22][6] == 0.9 and kept[40][5] == unique([("p0", "s"), ("p2", "s"), ("p0", "s")]) or kept[40][5]
    assert {(r.from_ids[0], r.to_id, r.final_id, r.reason) for r in out["journal"].collect()} == {(a, b, root[a], why) for a, b, why in pairs}
    ids = {r.edge_id for r in out["edges"].collect()}
    assert ids <= {x[0] for x in edges}


LABELS = ["Compound 32", "5a", "(12b)", "compound 7", "item 4", "heated compound 5a", "heated  compound", "Heated compound", "new polymer", "New Polymer entry 3", "new polymer entry", "step 9", "entry 2", "alpha beta", "alpha  beta", "Alpha-Beta step 3", "alpha beta step", "ab12", "c3"]
BETTER = ["new polymer 12", "New Polymer", "heated compound", "alpha beta", "5a", "compound 3", "short", "x1", "item", "long alias 7b", "long alias", "derivative", " ", "entry 5", "alpha beta step 12"]


def labelled(seed, n=60):
    rng = random.Random(seed)
    return [(rng.choice("tu"), rng.choice(LABELS) + rng.choice(["", "", "", " derivative", " q"]), [rng.choice(BETTER) for _ in range(rng.randrange(0, 4))]) for _ in range(n)]


def strip_codes(name):
    return re.sub(r"\s+", " ", re.sub(r"(?i)\b(compound|compd|product|intermediate|entry|item|stage|step|substrate|analyte)\s*[A-Za-z]{0,4}\d+[A-Za-z]{0,4}\b", r"\1", name)).strip()


def local(name):
    name = name.strip()
    return bool(name) and bool(re.match(r"(?i)^\s*(compound|compd|product|intermediate|entry|item|stage|step|substrate|analyte)\s*[A-Za-z]{0,4}\d+[A-Za-z]{0,4}\s*$", name) or re.match(r"^\s*\(?[A-Za-z]{0,4}\d+[A-Za-z]{0,4}\)?\s*$", name))


def descriptive(aliases):
    for a in (x.strip() for x in aliases):
        cut = re.sub(r"\s+[A-Za-z]{0,4}\d+[A-Za-z]{0,4}$", "", a).strip()
        if len(a) >= 5 and not local(a) and len(cut) >= 5 and not local(cut):
            return cut
    return None


@pytest.mark.parametrize("seed", range(4))
def test_cleanup(spark, seed):
    frames, nodes, edges, members, measurements, events = graph(spark, seed, labelled(seed))
    # one node after the other
    live = {n[0]: [n[1], n[2], n[3], unique(x[2] for x in n[4] if not x[3] and x[2].strip())] for n in nodes}
    steps, counts = [], {"renamed": 0, "merged": 0, "dropped": 0}
    for ident in sorted(live):
        kind, name, norm, aliases = live[ident]
        target = strip_codes(name.strip())
        if not (target != name.strip() and len(target) >= 5 and target.lower() not in M.GENERIC and not local(target)):
            if not local(name):
                continue
            target = descriptive(aliases)
        if target is None:
            steps.append((ident, None))
            counts["dropped"] += 1
            del live[ident]
            continue
        other = next((i for i, (k, _, n, _) in live.items() if i != ident and k == kind and n == key(target)), None)
        if other is not None:
            steps.append((ident, other))
            counts["merged"] += 1
            del live[ident]
        else:
            counts["renamed"] += 1
            live[ident] = [kind, target, key(target), [*aliases, *([name] if name not in aliases else [])]]
    for ident, (_, name, _, aliases) in live.items():
        kept = [strip_codes(a.strip()) for a in aliases if a.strip() and not local(a)]
        live[ident][3] = set(a for a in kept if a and a.lower() not in M.GENERIC and a != name)
    out = M.cleanup(frames)
    got = {r.node_id: [r.node_type, r.name, r.normalized_name, r.aliases] for r in M.described(out["nodes"]).collect()}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in live.items()}
    for k in got:
        assert len(got[k][3]) == len(set(got[k][3])) and set(got[k][3]) == live[k][3], (got[k], live[k])
    e, m, ms, ev = by_loop(edges, members, measurements, events, steps)
    held = {h for h, *_ in m}
    state = state_of(out)
    assert state["edges"] == e and state["members"] == m
    assert state["events"] == ev
    assert state["measurements"] == sorted((h, k, n or -1) for h, k, n in ms if h in held)
    assert {r.hyperedge_id for r in out["hyperedges"].collect()} == held == {r.hyperedge_id for r in out["conditions"].collect()}
    one = out["counts"].first()
    assert {c: one[c] for c in counts} == counts and one.dropped_hyperedges == 26 - len(held)
    assert counts["renamed"] and counts["merged"] and counts["dropped"]
    assert {(r.from_ids[0], r.to_id) for r in out["journal"].collect()} == {s for s in steps if s[1] is not None}


def test_nothing(spark):
    frames, *_ = graph(spark, 1, [("t", "plain name", [])])
    none = {k: df.limit(0) for k, df in frames.items()}
    out = M.cleanup(none)
    assert all(out[k].count() == 0 for k in ("nodes", "edges", "members", "events", "journal"))
    assert out["nodes"].columns == frames["nodes"].columns
    assert out["counts"].first().renamed == 0
    assert M.cleanup(frames)["nodes"].select(F.col("name")).collect()[0][0] == "plain name"
