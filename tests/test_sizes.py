"""What larger tables bring up: long keys, ties and large groups."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from corpusgraph import storage
from corpusgraph.functions import text as T
from corpusgraph.operators import hyperedges as H
from corpusgraph.operators import library as L
from corpusgraph.operators import merging as M
from corpusgraph.operators import study, walks
from corpusgraph.plans import bindings, catalog
from corpusgraph.sources import readers

from . import test_catalog


def values(spark, column, *inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, c string").repartition(2)
    return [r.v for r in rows.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


def test_long_reference_ids(spark):
    assert values(spark, T.is_reference_id, "P-999999", "P-1000000", "E-12345678-3", "P-", "P-1x") == [True, True, True, False, False]


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """The smallest tables with part keys beyond a million, event ids of seven digits, and pages that end in the midst of a reference."""
    import duckdb

    folder = tmp_path_factory.mktemp("wide")
    con = duckdb.connect()
    changed = {
        "part": "* replace (p_partkey * 7001 as p_partkey)",
        "lineitem": "* replace (l_partkey * 7001 as l_partkey)",
        "events": "* replace (event_id + 999990 as event_id)",
        "pages": "* replace (case page_id % 3 when 0 then 'A &amp;lt; b &amp' when 1 then 'token = &quot <b>x</b> &amp;&copy' else html end as html)",
    }
    for path in glob.glob(f"{test_catalog.FOLDER}/*.parquet"):
        name = os.path.basename(path)
        con.execute(f"copy (select {changed.get(name[:-8], '*')} from '{path}') to '{folder}/{name}' (format parquet)")
    return str(folder)


@pytest.mark.skipif(not os.path.isdir(test_catalog.FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", ["g10_events", "j19_materials", "n04_notes", "t08_html_clean", "w14_first_appearance"])
def test_wide_keys(spark, wide, monkeypatch, name):
    monkeypatch.setattr(test_catalog, "FOLDER", wide)
    test_catalog.agree(spark, name, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """The smallest tables with lines that an order by line and part leaves open, by equal keys and by sums that come out equal."""
    import duckdb

    folder = tmp_path_factory.mktemp("tied")
    con = duckdb.connect()
    changed = {
        "part": "select * exclude (j) replace (p_partkey + j * 1000000 as p_partkey, p_name || j as p_name) from '{}', range(2) r(j)",
        "lineitem": "select * replace (l_partkey % 16 + l_suppkey % 2 * 1000000 as l_partkey) from '{}'",
    }
    for path in glob.glob(f"{test_catalog.FOLDER}/*.parquet"):
        name = os.path.basename(path)
        con.execute(f"copy ({changed.get(name[:-8], "select * from '{}'").format(path)}) to '{folder}/{name}' (format parquet)")
    return str(folder)


@pytest.mark.skipif(not os.path.isdir(test_catalog.FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", ["g10_events", "x17_revision_actions"])
def test_ties(spark, tied, monkeypatch, name):
    """What the SQL's order leaves open goes by the order of the table's rows, as the engine that runs it on one thread takes them; on several it takes them as they come."""
    import duckdb

    monkeypatch.setattr(test_catalog, "FOLDER", tied)
    monkeypatch.setattr(duckdb, "connect", lambda connect=duckdb.connect: connect(config={"threads": 1}))
    test_catalog.agree(spark, name, catalog.queries()[name], catalog.oracle_sql()[name])


def test_places_of_rows(spark, tmp_path):
    """Files by name, then rows, whatever the size of a file and the number of tasks."""
    path = f"{tmp_path}/t.parquet"
    for n in (3, 4000, 20):
        spark.range(n).select(F.lit(n).alias("n"), F.col("id").alias("row")).coalesce(1).write.mode("append").parquet(path)
    at = bindings.placed(spark, str(tmp_path), "t").repartition(7).orderBy("_at").collect()
    assert [r["row"] for r in at] == [x for n in dict.fromkeys(r.n for r in at) for x in range(n)]


def test_absorbing_many_nodes(spark):
    """A node that takes in thousands folds their lists in proportion to their items."""
    n = 20_000
    ids = spark.range(n)
    item = lambda *cols: F.array(F.struct(F.col("id").alias("seq"), F.lit(0).alias("pos"), *cols))
    nodes = ids.select(
        F.col("id").alias("node_id"), F.lit("t").alias("node_type"), F.lit("x").alias("name"), F.lit("x").alias("normalized_name"),
        item(F.concat(F.lit("alias "), F.col("id").cast("string")).alias("value"), F.lit(False).alias("own")).alias("names"),
        item(F.lit("a").alias("name"), F.col("id").cast("string").alias("value")).alias("attributes"),
        item((F.col("id") % 7).cast("string").alias("paper"), F.lit("e").alias("evidence")).alias("provenance"),
        F.lit(0.5).alias("confidence"), F.col("id").alias("first_seen"), F.col("id").alias("last_seen"), F.lit(1).cast("long").alias("mentions"),
    )
    roots = ids.filter("id > 0").select(F.col("id").alias("drop"), F.lit(0).cast("long").alias("root"))
    out = M.absorbed(nodes, roots)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(slice" not in plan and "flatten(collect_list" not in plan
    (got,) = out.collect()
    assert (got.node_id, got.mentions, len(got.names), len(got.attributes)) == (0, n, n, n)
    assert [p.paper for p in got.provenance] == [str(i) for i in range(7)] and got.names[1].value == "alias 1"


def test_pages_share_partitions(tmp_path):
    n = 3 * readers.PARTITIONS
    for page in range(n):
        folder = tmp_path / "service=arxiv" / f"page={page}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text('{"items": [{"k": %d}]}' % page if page % 10 else '{"items": [')
    reader = readers.Pages(str(tmp_path))
    parts = reader.partitions()
    assert len(parts) == readers.PARTITIONS
    rows = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert sorted(r["page"] for r in rows) == list(range(n)) and sum(r["error"] is not None for r in rows) == n // 10


def test_known_values_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(walks, "OFTEN", 3)
    values = [None] * 20 + ["often"] * 5 + ["known"] * 5 + ["b", "c", "c"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, _value string")
    ids = spark.createDataFrame([("known", True), ("c", True), ("z", True)], "_id string, _known boolean")
    marked = walks._known(rows, ids)
    got = {r["i"]: r["_known"] for r in marked.collect()}
    assert got == {i: True if v in ("known", "c") else None for i, v in enumerate(values)}
    # what a task gets of the shuffle is rows of rare values alone
    assert "_often" in marked._jdf.queryExecution().optimizedPlan().toString()


def test_copies_of_titles_are_compared_once(spark):
    """Thousands of copies make members of a class; each different text is linked once."""
    n = 5_000
    copies = spark.range(n).select("id", F.lit("Large Ring, of steel").alias("title"))
    others = spark.createDataFrame([(n, "a large ring of steel 5"), (n + 1, "copper wire, thin"), (n + 2, "THIN wire copper")], "id long, title string")
    members, links = L.title_classes(copies.unionByName(others), "id", "title")
    assert sorted(tuple(r) for r in links.collect()) == [(0, n), (n + 1, n + 2)]
    assert {r["class"]: r["n"] for r in members.groupBy("class").agg(F.count("*").alias("n")).collect()} == {0: n, n: 1, n + 1: 1, n + 2: 1}
    few = copies.filter("id < 3").unionByName(others)
    pairs = sorted(tuple(r) for r in L.similar_titles(few, "id", "title").collect())
    assert pairs == [(0, 1), (0, 2), (0, n), (1, 2), (1, n), (2, n), (n + 1, n + 2)]


@pytest.mark.skipif(not os.path.isdir(test_catalog.FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", ["g03_edge_merge", "g06_conditions", "g06_upsert_hyperedges", "g10_repoint", "g10_repoint_members", "g13_cleanup", "g13_counts", "g13_edges", "g13_members", "g15_backfill"])
def test_many_tasks(spark, monkeypatch, name):
    """The same results where tables are dealt over more tasks than a shuffle has."""
    monkeypatch.setattr(storage, "ROWS", 1000)
    test_catalog.agree(spark, name, catalog.queries()[name], catalog.oracle_sql()[name])


def test_tasks_grow_with_rows(spark):
    assert storage.tasks(spark, 1) == 4 and storage.tasks(spark, 50 * storage.ROWS + 1) == 51


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_are_marked_once(spark):
    """Tables of hyperedges come from rows that were written with their fingerprints; odd numbers, nulls and order make no difference to them."""
    row = lambda seq, members, value: (seq, "x", "l", "p", 0.5, None, members, [("k", None, value, None, None, None)], [], [])
    a, b = (1, "r", None), (2, "s", None)
    schema = "seq long, hyperedge_type string, label string, paper_key string, confidence double, evidence_tier string, members array<struct<node_id:long,role:string,position:int>>, conditions array<struct<key:string,operator:string,value_text:string,value_num:double,unit:string,qualifier:string>>, measurements array<struct<key:string>>, evidence array<struct<paper_key:string,section:string,span_text:string>>"
    tables = H.upsert(spark.createDataFrame([row(3, [a, b], "v"), row(2, [b, a], "v"), row(1, [a, b], "w")], schema))
    assert not any("sha1" in plan(df) for df in tables.values())
    assert sorted((r.first_seq, r.n_payloads) for r in tables["hyperedges"].collect()) == [(1, 1), (2, 2)]
    assert sorted((r.node_id, r.position) for r in tables["members"].collect()) == [(1, 0), (1, 0), (2, 0), (2, 1)]
    assert sorted(r.value_text for r in tables["conditions"].collect()) == ["v", "w"] and tables["evidence"].count() == 0


def test_numbers_of_texts(spark):
    got = values(spark, H._number, "80", " -1e3 ", "R", "NaN", "-Infinity", "inf", "1x", ".5", "", None)
    want = values(spark, lambda c: c.try_cast("double"), "80", " -1e3 ", "R", "NaN", "-Infinity", "inf", "1x", ".5", "", None)
    assert [str(x) for x in got] == [str(x) for x in want]


def test_members_are_dealt(spark):
    members = spark.createDataFrame([(1, 5, "r", 3), (1, 6, "r", 2), (2, 7, "r", 1), (2, 8, "r", 0), (3, 9, "r", 0)], "hyperedge_id long, node_id long, role string, position int")
    mapping = spark.createDataFrame([(5, 6), (7, 8)], "drop long, keep long")
    out = H.repoint_members(members, mapping, 7, spark.createDataFrame([(8,)], "node_id long"))
    assert out.rdd.getNumPartitions() == 7
    assert sorted(tuple(r) for r in out.collect()) == [(1, 6, "r", 2), (3, 9, "r", 0)]


def test_edges_are_folded_in_one_pass(spark):
    schema = "seq long, relation_type string, source_node long, target_node long, attributes map<string,string>, confidence double, evidence_tier string, provenance array<struct<paper:string,evidence:string>>"
    rows = [(1, "r", 1, 2, {"a": "x"}, 0.2, "t", []), (2, "r", 1, 2, {"a": "y"}, 0.4, "", [("p", "e"), ("q", None)]), (3, "r", 1, 2, None, 0.3, None, [("p", "e"), (None, None)]), (4, None, 1, 2, None, None, None, None)]
    out = M.upsert_edges(spark.createDataFrame([], M.EDGE), spark.createDataFrame(rows, schema))
    assert "Join" not in plan(out)
    one, other = sorted(out.collect(), key=lambda r: r.edge_id)
    assert (one.edge_id, one.confidence, one.evidence_tier, one.attributes[0].value, [(p.seq, p.paper, p.evidence) for p in one.provenance]) == (1, 0.4, "t", "x", [(2, "p", "e"), (2, "q", None), (3, None, None)])
    assert (other.edge_id, other.relation_type, other.confidence, other.attributes, other.provenance) == (4, None, 0.0, [], [])


def test_chains_are_read_once(spark):
    steps = [(1, 1, "combine", "x", None), (1, 2, "combine", "x", "aa bb"), (1, 3, "what", "cc", "cc"), (1, 4, "swap", "cc", "aa"), (1, 5, "combine", "aa", ""), (2, 1, " ", None, None), (2, 2, "what", None, None)]
    got = study.chains(spark.createDataFrame(steps, "chain_id int, position int, operator string, input string, output string"), {"combine": "L2", "substitute": "L1"}, {"combine": "c", "substitute": "s"}, {"swap": "substitute"})
    assert "Join" not in plan(got)
    rows = {r.chain_id: r for r in got.collect()}
    assert (rows[1].operators, rows[1].unknown, rows[1].breaks, rows[1].level, rows[1].low_level_only) == (["combine", "substitute", "combine"], 1, 0, "L2", rows[1].low_level_only)
    assert (rows[2].operators, rows[2].unknown, rows[2].breaks, rows[2].mechanistic, rows[2].max_level, rows[2].level, rows[2].low_level_only) == ([], 1, 0, 0, "L0", "L0", False)


@pytest.mark.skipif(not os.path.isdir(test_catalog.FOLDER), reason="needs the test tables")
def test_titles_that_share_seven_tenths_are_linked(spark):
    """All customers whose titles share 70 % of the words of the smaller one, most of which share no 95 %."""
    least, words = {}, {}
    for r in spark.read.parquet(f"{test_catalog.FOLDER}/customer.parquet").orderBy("c_custkey").collect():
        title = f"{r.c_mktsegment} customer {r.c_custkey % 97} of nation {r.c_nationkey}".lower()
        if least.setdefault(title, r.c_custkey) == r.c_custkey:
            words[r.c_custkey] = set(title.split())
    share = {(a, b): len(words[a] & words[b]) / min(len(words[a]), len(words[b])) for a in words for b in words if a < b}
    want = {pair for pair, s in share.items() if s >= 0.7}
    links = catalog.queries()["j12_fuzzy_title"](spark, test_catalog.FOLDER).filter("kind = 'link' and b < 10000000")
    assert want == {(r.a, r.b) for r in links.collect()} and sum(share[p] < 0.95 for p in want) > len(want) / 2
