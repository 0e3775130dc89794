import random
import re
import unicodedata
from collections import defaultdict

import numpy as np

from corpusgraph.llm import linededup

LONG = " ".join(f"word{i}" for i in range(20))
OTHER = " ".join(f"other{i}" for i in range(60))
SCHEMA = "doc_id long, text string, unit string"
FOLD = str.maketrans("".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))


def stretches(text, least=linededup.MIN_WORDS, run=linededup.RUN_WORDS):
    """(start, end, words) of lines and of shortest stretches of units, by the definition."""
    units, line = [], 0
    before = None
    for m in re.finditer(r"[^ \t-\r]+", text):
        word = m[0]
        if before is None or "\n" in text[before : m.start()]:
            line += 1
            units.append((line, [m]))
        elif text[before - 1] in ".!?" or unicodedata.category(word[0]) == "Lu":
            units.append((line, [m]))
        else:
            units[-1][1].append(m)
        before = m.end()
    out = set()
    n = len(units)
    count = lambda i, j: sum(len(u[1]) for u in units[i:j])
    chosen = set()
    for i in range(n):
        j = next((j for j in range(i + 1, n + 1) if count(i, j) >= run), None)
        if j:
            chosen.add((i, j))
        k = next((k for k in range(i, -1, -1) if count(k, i + 1) >= run), None)
        if k is not None:
            chosen.add((k, i + 1))
        if i == 0 or units[i - 1][0] != units[i][0]:
            e = next((e for e in range(i, n) if units[e][0] != units[i][0]), n)
            if count(i, e) >= least:
                chosen.add((i, e))
    for i, j in chosen:
        out.add((units[i][1][0].start(), units[j - 1][1][-1].end(), " ".join(m[0].translate(FOLD) for u in units[i:j] for m in u[1])))
    return out


def brute(rows):
    """(key, text, merged spans) of all that stood before; rows of one key and text are one document."""
    docs = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None})
    first, gone = {}, defaultdict(list)
    found = [(d, s) for d in docs for s in sorted(stretches(d[2]))]
    for d, (a, b, words) in found:
        if words not in first:
            first[words] = (d, b)
        elif first[words][0] != d or a >= first[words][1]:
            gone[d].append((a, b))
    out = []
    for (none, key, text), spans in gone.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out += [(None if none else key, a, b) for a, b in merged]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r[:2], "x") for r in rows], SCHEMA).repartition(3)


def spans(df):
    return sorted({(r.doc_id, r.start, r.end) for r in df.collect()}, key=str)


def texts(spark, rows):
    return {(r.doc_id, r.text) for r in linededup.dedup(frame(spark, rows)).collect()}


def sentence(rng, n):
    return " ".join(rng.choice(["Élan", "Ωmega", "The", "Ab"]) if i == 0 else f"{rng.choice('abcdé世')}{rng.randrange(10**6)}" for i in range(n)) + rng.choice(".!?")


def test_lines(spark):
    rows = [(1, f"Title one\n{LONG}\nshort line\n"), (2, f"Title two\n{LONG.upper()}\nshort line\n{OTHER}"), (3, f"{OTHER}\n\n  {LONG.replace(' ', '   ')} \ntail\n{LONG}"), (4, None), (5, ""), (6, f"ünïcode 😀\n{OTHER}"), (None, f"{OTHER}\nown"), (7, LONG)]
    assert spans(linededup.repeated(frame(spark, rows))) == brute(rows)
    got = dict(texts(spark, rows))
    assert got == {1: rows[0][1], 2: f"Title two\nshort line\n{OTHER}", 3: "\ntail", 4: None, 5: "", 6: "ünïcode 😀", None: "own", 7: ""}


def test_passages_inside_lines(spark):
    """Passages of 51 to 120 words, put into lines of other documents anywhere, wrapped anew or not, go from all but one of them; all else stays."""
    rng = random.Random(4)
    rows, hosts = [], []
    for n in range(12):
        passage, left = [], rng.randrange(51, 121)
        while left > 0:
            passage.append(sentence(rng, min(left, rng.randrange(2, 18))))
            left -= len(passage[-1].split())
        for k in range(3):
            host = [sentence(rng, rng.randrange(3, 15)) for _ in range(8)]
            whole = (" " if k < 2 else "\n").join(passage) if n % 2 else " ".join(passage)
            before, after = " ".join(host[:4])[: -1 if k else None], " ".join(host[4:])
            rows.append((3 * n + k, f"{before} {whole} {after}\nlast line {n} {k}"))
            hosts.append(f"{before} {after}\nlast line {n} {k}")
    assert spans(linededup.repeated(frame(spark, rows))) == brute(rows)
    got = dict(texts(spark, rows))
    assert all(got[i].split() == (rows[i][1] if i % 3 == 0 else hosts[i]).split() for i in got) and len(got) == len(rows)


def test_random_texts(spark):
    rng = random.Random(9)
    bits = [sentence(rng, rng.randrange(1, 25)) for _ in range(40)]
    rows = [(rng.randrange(30) if rng.random() < 0.9 else None, "".join(rng.choice(bits) + rng.choice([" ", "  ", "\n", "\n\n", "\t"]) for _ in range(rng.randrange(0, 30)))) for _ in range(60)]
    got = {}
    for r in linededup.repeated(frame(spark, rows)).collect():
        got.setdefault((r.doc_id, r._hash), []).append((r.start, r.end))
    # among other texts of one key the order is that of their hashes, so keys are made single here
    single = {r[0]: r for r in rows if r[0] is not None}.values()
    assert spans(linededup.repeated(frame(spark, single))) == brute(list(single))
    assert got


def test_only_the_row_with_the_repeat_is_cut(spark):
    a, b, e = (" ".join(f"{c}{i}" for i in range(30)) for c in "abe")
    assert texts(spark, [(1, a), (2, a), (2, b), (None, a), (None, e)]) == {(1, a), (2, ""), (2, b), (None, ""), (None, e)}


def test_repeated_rows_are_one_document(spark):
    rows = [(1, LONG), (1, LONG), (2, LONG), (None, OTHER), (None, OTHER)]
    assert texts(spark, rows) == {(1, LONG), (2, ""), (None, OTHER)}


def test_a_stretch_does_not_repeat_itself(spark):
    rows = [(1, "tick\n" * 39 + "end"), (2, "Tock. " * 100)]
    assert spans(linededup.repeated(frame(spark, rows))) == brute(rows)


def test_long_text(spark):
    rng = random.Random(2)
    passage = " ".join(sentence(rng, 12) for _ in range(6))
    huge = "y" * 2_500_000 + "\n" + " ".join(f"z{i}" for i in range(300_000)) + f". {passage} End"
    got = spans(linededup.repeated(frame(spark, [(1, passage), (2, huge)])))
    assert got == [(2, len(huge) - len(passage) - 4, len(huge) - 4)]


def test_capitals():
    text = "AbÀÉßωΩДд世ẞ𐐀𝒜1."
    raw = np.frombuffer(text.encode(), dtype="uint8")
    at = np.cumsum([0, *[len(c.encode()) for c in text[:-1]]])
    assert linededup.capitalised(raw, at).tolist() == [unicodedata.category(c) == "Lu" for c in text]


def test_edges(docs, clashing, empty, same):
    same(linededup.repeated(clashing), linededup.repeated(docs))
    same(linededup.dedup(clashing).select(docs.columns), linededup.dedup(docs))
    assert linededup.dedup(clashing).columns == clashing.columns
    assert linededup.repeated(empty).count() == linededup.dedup(empty).count() == 0
