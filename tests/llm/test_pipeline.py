import os
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusgraph.llm import linededup, neardup

from .test_linededup import brute as repeated
from .test_neardup import brute as classes
from .test_packing import reference_ids


@pytest.fixture(scope="module")
def folder(tmp_path_factory, docs, spark):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, docs.filter("doc_id = 3").first().text)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, docs, clashing, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "decontaminate", "pack"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, clashing, folder).columns == clashing.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_language_stage_drops_what_has_no_letter(spark, docs, rows, folder):
    kept = corpus_pipeline.language_id(spark, docs, folder).collect()
    want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    bare = lambda r: str((r[0], r[1], r[3], r[4]))
    assert sorted(map(bare, kept)) == sorted(map(bare, want))
    told = {(r[0], r[1], r[2]) for r in want if r[2] is not None}
    assert told <= {(r.doc_id, r.text, r.lang) for r in kept} and all(r.lang for r in kept)


def test_language_stage_without_a_language_to_learn(spark, docs, rows, folder):
    """Nothing to learn from: what has a letter stays as it is."""
    bare = docs.drop("lang").withColumn("lang", F.lit(None).cast("string")).select(docs.columns)
    kept = corpus_pipeline.language_id(spark, bare, folder).collect()
    assert len(kept) == sum(any(c.isalpha() for c in r[1] or "") for r in rows)


def test_near_dedup_stage_keeps_one_of_each_class(spark, docs, rows, folder):
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()]
    want = [k for k, n, c in classes(rows, 80) if k == c]
    assert sorted(map(str, kept)) == sorted(map(str, want))
    assert neardup.SHINGLE == 5


def test_substring_stage_keeps_all_rows(spark, docs, rows, folder):
    out = corpus_pipeline.substring_dedup(spark, docs, folder).collect()
    assert len(out) == len(rows)
    changed = {str(k) for k, *_ in repeated(rows)}
    before = {(str(r[0]), r[1]) for r in rows}
    assert {str(r.doc_id) for r in out if (str(r.doc_id), r.text) not in before} == changed


def test_decontaminate_stage(spark, docs, rows, folder):
    kept = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, folder).collect()}
    assert kept == {r[0] for r in rows} - {3}


def test_whole_run(spark, rows, folder):
    """The pieces of all documents that five brute-force stages leave, by their checksums."""
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    stay = {k for k, _, c in classes(kept, 80) if k == c}
    kept = [r for r in kept if r[0] in stay]
    spans = defaultdict(list)
    for k, a, b in repeated(kept):
        spans[k].append((a, b))
    texts = [(r[0], linededup.cut_out(r[1], spans[r[0]]) if spans[r[0]] else r[1]) for r in kept if r[0] != 3]
    want = defaultdict(list)
    for (k, _), ids in zip(texts, reference_ids([t for _, t in texts]), strict=True):
        want[k].append(np.array(ids, dtype="<u4"))
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.doc_id].append(r)
    assert set(got) == set(want) and 3 not in got
    for k, pieces in got.items():
        assert sum(r.length for r in pieces) == sum(map(len, want[k]))
        for r in pieces:
            assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in want[k])


def test_registered():
    names = set(entry.queries())
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {n if n == "pipeline" else n.split("_")[0] + "_" for n in names}
    assert set(entry.oracle_sql()) <= names


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", ["op4_host_trust", "op9_line_dedup", "op10_quality_rules"])
def test_sql(spark, name):
    from tests.test_catalog import agree

    agree(spark, name, entry.queries()[name], entry.oracle_sql()[name])
