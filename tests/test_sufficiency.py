"""Each dimension and gate of a section's verdict."""

import pytest

from corpusgraph.operators import sufficiency as S


@pytest.fixture(scope="module")
def tables(spark):
    f = spark.createDataFrame
    papers = [(f"p{i}", "ingested" if i < 4 else "pending", "Bone study" if i % 2 == 0 else None, "steel" if i == 3 else "", None) for i in range(8)]
    return {
        "papers": f(papers, "paper_key string, status string, title string, abstract string, keywords string"),
        "quality": f([("p4", "direct"), ("p6", "human")], "paper_key string, decision string"),
        "log": f([("p0", "extracted"), ("p0", "extracted"), ("p2", "read"), ("p4", "extracted"), ("p3", "extracted")], "paper_key string, event string"),
        "hyperedges": f([(1, "a", "p0"), (2, "a", "p0"), (3, "b", "p2"), (4, "c", "p4")], "hyperedge_id long, hyperedge_type string, paper_key string"),
        "conditions": f([(1,), (1,)], "hyperedge_id long"),
        "measurements": f([(1,), (4,)], "hyperedge_id long"),
        "edges": f([("x",), ("x",), ("y",)], "relation_type string"),
        "texts": f([("A bone study",)], "text string"),
        "names": f([("Bone",)], "name string"),
    }


def verdicts(tables, sections, floors=S.Floors()):
    return {r.section: r for r in S.evaluate(tables, sections, floors).collect()}


def test_dimensions(tables):
    r = verdicts(tables, [S.Section("s", tokens=("BONE",), requirements=("bone", "wood", "绿色", "q"))])["s"]
    # p0, p2 are ingested, p4 is decided for
    assert (r.matched, r.extracted, r.hyperedges, r.quantified, r.covered, r.missing, r.unverifiable) == (3, 2, 4, 2, 1, 1, 1)
    assert (r.min_papers, r.min_evidence, r.min_comparison) == (4, 3, 1)
    assert (r.papers, r.knowledge, r.conditions, r.requirements, r.evidence, r.comparison) == (0.75, 0.667, 0.5, 0.5, 1.0, 1.0)
    assert r.failed == ["papers"] and r.confidence == 0.619 and r.decision == "insufficient"


def test_gates(tables):
    one = lambda **k: verdicts(tables, [S.Section("s", **k)])["s"]
    assert one(tokens=("bone",), cited=1).failed == [] and one(tokens=("bone",), cited=1).decision == "sufficient"
    assert one(tokens=("steel",)).failed == ["papers"] and one(tokens=("steel",)).hyperedges == 0
    assert one(tokens=("bone",), cited=1, requirements=("wood", "iron")).failed == ["requirements"]
    assert one(tokens=("none",), rounds_done=2).decision == "exhausted"
    assert one().failed == [] and one().papers == 0
    templated = one(tokens=("steel",), template=True, required=("conditions", "comparison"), weights={"conditions": 1.0})
    assert templated.failed == ["conditions"] and templated.confidence == 0
    assert one(tokens=("steel",), template=True, required=("comparison",), weights={"comparison": 2.0}).decision == "sufficient"
    strict = verdicts(tables, [S.Section("s", tokens=("bone",))], S.Floors(papers=1, knowledge=0.7, conditions=0.6, evidence=9, adaptive=False))["s"]
    assert strict.failed == ["knowledge", "conditions", "evidence"]


def test_comparison_and_evidence_of_edges(tables):
    none = tables | {"hyperedges": tables["hyperedges"].limit(0)}
    r = verdicts(none, [S.Section("s", tokens=("bone",))])["s"]
    assert (r.evidence_ids, r.comparison_groups, r.hyperedges) == (3, 1, 0)
    empty = {k: df.limit(0) for k, df in tables.items()}
    r = verdicts(empty, [S.Section("s", tokens=("bone",), requirements=("bone",)), S.Section("t")])
    assert r["s"].failed == ["papers", "requirements"] and r["t"].failed == [] and r["s"].min_papers == 6
