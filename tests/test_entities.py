"""Character references against the standard library."""

import html
import random
import re

from pyspark.sql import functions as F

from corpusgraph.functions import text as T


def texts():
    rng = random.Random(2)
    names = ["amp", "amp;", "lt", "nbsp;", "notit;", "not", "notin;", "copy", "eacute;", "Aacute", "hearts;", "zzz;", "", ";", "a", "ab", "#65;", "#x41", "#0;", "#128;", "#x81;", "#13", "#xD800;", "#1114112;", "#99999999999999999999;", "#x110000", "#xfdd0;", "#x1F600;", "#65533;", "#x", "#;", "#000065", "NotEqualTilde;", "fjlig;", "ampx", "😀;", "a" * 40 + ";", "#xFFFFF;", "#1;", "#x0b;", "lt;b>", "AMP&amp"]
    out = [None, "", "plain", "&", "&&", "a & b", "&amp;lt;", "<i>&lt;</i> &#60;", "&é;"]
    return out + ["".join(rng.choice(["&" + rng.choice(names), " ", "x", "é", "&", "\n", "&" + rng.choice(names)]) for _ in range(rng.randrange(1, 8))) for _ in range(1500)]


def test_unescape(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    out = df.select("i", T.unescape(F.col("t")).alias("all"), T.resolve_entities(F.col("t")).alias("some"))
    assert "ArrowEval" not in out._jdf.queryExecution().executedPlan().toString()

    def one(m):
        char = html.unescape(m[0])
        return {"<": "&lt;", ">": "&gt;", "&": "&amp;"}.get(char, char)

    for r in out.collect():
        t = rows[r.i]
        assert r["all"] == (None if t is None else html.unescape(t)), t
        assert r["some"] == (None if t is None else re.sub(r"&#?\w+;", one, t)), t


def test_every_name(spark):
    names = sorted(html.entities.html5)
    out = spark.createDataFrame([(f"<{'&' + n} ",) for n in names], "t string").select("t", T.unescape(F.col("t")).alias("u")).collect()
    assert all(r.u == html.unescape(r.t) for r in out)
