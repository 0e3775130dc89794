"""The evidence bundle against a plain reading of a small graph."""

import re

import pytest

from corpusgraph.operators import evidence as E

EDGE = "edge_id long, relation_type string, source_node long, target_node long, confidence double, evidence_tier string, provenance array<struct<paper:string,evidence:string>>"


@pytest.fixture(scope="module")
def tables(spark):
    nodes = [(1, "material", "Red widgets"), (2, "organization", "Acme"), (3, "method", "widget pressing"), (4, "place", None)]
    edges = [
        (7, "supplied_by", 1, 2, 0.9, None, [("p1", " first. "), ("p1", ""), (None, "second"), ("p2", "third")]),
        (8, "used_in", 1, 3, 0.9, "tested", [("p1", "x")]),
        (9, "used_in", 3, 1, 0.95, "", [("p9", None), (" ", "y")]),
        (10, "located_in", 2, 4, 0.99, None, [("p3", "z")]),
        (11, "located_in", 2, 99, 0.99, None, [("p4", "an end that no node has")]),
        (12, "is_a", 1, 3, 0.99, None, []),
        (13, "is_a", 3, 2, 0.99, None, None),
        (14, "is_a", 2, 3, 0.59, None, [("p5", "too weak")]),
    ]
    hyper = [(1, "event", "oxidation of widgets", 0.7, None), (2, "relation", "is_a", 0.9, "t"), (3, None, None, 0.8, None), (4, "mechanism", "oxidation", 0.5, None)]
    members = [(1, 2, 1), (1, 1, 0), (2, 3, 0), (3, 99, 0), (3, 4, 1)]
    spans = [(1, 1, "p1", "s1"), (1, 2, None, " "), (1, 3, "p7", "s3"), (1, 4, "p8", "s4"), (2, 5, None, "s5")]
    return {
        "nodes": spark.createDataFrame(nodes, "node_id long, node_type string, name string"),
        "edges": spark.createDataFrame(edges, EDGE),
        "hyperedges": spark.createDataFrame(hyper, "hyperedge_id long, hyperedge_type string, label string, confidence double, evidence_tier string"),
        "members": spark.createDataFrame(members, "hyperedge_id long, node_id long, position int"),
        "spans": spark.createDataFrame(spans, "hyperedge_id long, id long, paper_key string, span_text string"),
        "conditions": spark.createDataFrame([(2, 1, "oxidant")], "hyperedge_id long, id long, condition_key string"),
        "measurements": spark.createDataFrame([], "hyperedge_id long, id long, metric string"),
        "papers": spark.createDataFrame([("p1", 1999), ("p7", 2007)], "paper_key string, pub_year int"),
    }


def test_tokens():
    assert E.Mission(terms=(" Red widgets", "", "co2-rich gas", "1234", "red widgets")).tokens == ["red widgets", "widgets", "co2-rich gas", "co2-rich", "1234"]


def score(tokens, text, weight):
    def forms(t):
        return (t, t[:-3] + "y") if re.search("ies$", t) and len(t) > 4 else (t, t[:-2]) if t.endswith("es") and len(t) > 3 else (t, t[:-1]) if t.endswith("s") and len(t) > 3 else (t, t + "s")

    return sum(weight * max(2, min(12, len(t))) for t in tokens if any(f in text.lower() for f in forms(t)))


def test_bundle(tables):
    mission = E.Mission(terms=("red widgets",), min_patterns=10, mechanism=("oxid",), low_value=("is_a",))
    out = {k: df.collect() for k, df in E.mine(tables, mission).items()}
    shown = sorted(out["patterns"], key=lambda r: r.place)
    assert [(r.pattern_id, r.support_count, r.paper_keys, r.evidence_ids) for r in shown] == [
        ("P-0007", 2, ["p1", "p2"], ["E-0007-1", "E-0007-3", "E-0007-4"]),
        ("P-0009", 1, ["p9"], ["E-0009-2"]),
        ("P-0008", 1, ["p1"], ["E-0008-1"]),
        ("P-0010", 1, ["p3"], ["E-0010-1"]),
    ]
    for r in shown:  # a token of both names counts once
        assert r.relevance == score(mission.tokens, r.title, 2) + score(mission.tokens, r.relation_type, 1)
    assert shown[2].title == "material: Red widgets --used_in--> method: widget pressing" and shown[2].relevance == 2 * (11 + 7)
    assert {r.evidence_tier for r in shown} == {"unclassified", "tested"}
    cards = sorted(out["hyperedges"], key=lambda r: r.place)
    assert [(r.reference_id, r.member_names, r.mechanism_score, r.evidence_ids, r.paper_keys) for r in cards] == [
        ("H-0001", ["Red widgets", "Acme"], 1, ["H-0001-1", "H-0001-3"], ["p1", "p7", "p8"]),
        ("H-0002", ["widget pressing"], 1, ["H-0002-1"], []),
        ("H-0003", [""], 0, [], []),
    ]
    seen = {r.evidence_id: (r.pattern_id, r.hyperedge_id, r.paper_key, r.sentence, r.year) for r in out["evidence"]}
    assert seen["E-0007-3"] == ("P-0007", None, "unknown", "second", None) and seen["E-0007-1"][4] == 1999
    assert seen["H-0001-3"] == ("", "H-0001", "p7", "s3", 2007) and "H-0001-4" not in seen
    assert {r.paper_key for r in out["papers"]} == {"p1", "p2", "p3", "p7", "p8", "p9"}
    assert out["coverage"][0].coverage_score == 0.7


def test_limits_and_no_terms(tables):
    out = E.mine(tables, E.Mission(limit_patterns=2, limit_evidence=1, quota={"relation": 0, "event": 1}, spans=1))
    assert [r.pattern_id for r in sorted(out["patterns"].collect(), key=lambda r: r.place)] == ["P-0010", "P-0009"]
    assert {r.evidence_id for r in out["evidence"].collect()} == {"E-0010-1", "H-0001-1"}
    assert [r.reference_id for r in out["hyperedges"].collect()] == ["H-0001"]


def test_nothing(tables):
    none = {k: df.limit(0) for k, df in tables.items()}
    out = E.mine(none, E.Mission(terms=("a",)))
    assert all(out[k].count() == 0 for k in ("patterns", "evidence", "hyperedges", "papers"))
    assert out["coverage"].first().coverage_score == 0
