"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# fixed values: columns of the caller's that are named like those that operators make
CLASHING = ("_key", "_hash", "_text", "_row", "score", "digest", "label", "n", "block", "_id", "_gone", "_p")


def words(rng, n, of=300):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def held_out(key, parts, part):
    return zlib.crc32(str(key).encode()) % parts == part


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        rows.append((i, words(rng, rng.randrange(1, 120)), "en", f"src{i % 3}", 0))
    base = [words(rng, 80) for _ in range(4)]
    for i in range(60, 84):  # near copies, a word or two apart
        w = base[i % 4].split()
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w), "en", "src0", 0))
    rows += [(90, base[0], "en", None, None), (91, base[0].upper(), "en", "src0", 0), (92, "  " + base[0].replace(" ", "\t"), "en", "src0", 0)]
    rows += [(100, None, None, None, None), (101, "", "en", "src1", 0), (102, " \n\t ", "de", "src1", 3), (103, "one two", "en", "src1", 7), (104, "ONE\x0btwo", "fr", "src1", 7), (105, "a b c d e", "en", "src1", 9), (106, "Ünïcode ñ \U0001f600 łódź 世界", None, "src1", 9)]
    rows += [(107, "x " * 5000 + "end", "en", "src2", 10003), (107, "x " * 5000 + "end", "en", "src2", 10003), (108, "y" * 30000, "en", "src2", 30000), (None, "no key here at all today", "en", "src2", 5), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    return spark.createDataFrame([(*r, *["?"] * len(CLASHING)) for r in rows], SCHEMA + "".join(f", {c} string" for c in CLASHING)).repartition(2)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def same():
    """Whether two frames hold the same rows."""

    def check(a, b):
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))

    return check
