import random

import pytest
from lacuna.llm.line_dedup import drop_repeated_lines, within
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice("abé") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abé") + s[i + 1 :]])
    return s


@pytest.mark.parametrize("edits", [1, 2])
def test_bit_parallel_distance(spark, edits):
    rng = random.Random(9)
    pairs = [("", ""), ("a", ""), ("", "ab"), ("abc", "abc")]
    for _ in range(300):
        s = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        pairs.append((s, changed(rng, s, rng.randint(0, 4))))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", within(F.col("a"), F.col("b"), edits).alias("w")).collect()
    for r in got:
        assert r.w == (distance(r.a, r.b) <= edits), r


@pytest.mark.parametrize("edits", [1, 2])
def test_against_brute_force(spark, edits):
    rng = random.Random(10)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(8, 24))) for _ in range(25)]
    docs = []
    for i in range(60):
        docs.append((i, "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 6)))))
    docs += [(70, None), (71, ""), (72, "\n\n"), (73, docs[3][1]), (None, base[0]), (74, "q" * 3_000), (75, "q" * 3_001)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, no int, gone string").repartition(5)
    got = {r.doc_id: r for r in drop_repeated_lines(df, edits=edits, per=1, least=8).collect()}
    seen = []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        kept, exact, near = [], 0, 0
        for line in [] if t is None else t.split("\n"):
            if len(line) >= 8:
                e = line in seen
                n = not e and any(abs(len(s) - len(line)) <= edits and (len(line) > 1000 or distance(s, line) <= edits) for s in seen)
                exact, near = exact + e, near + n
                seen.append(line)
                if e or n:
                    continue
            kept.append(line)
        assert (got[d].text, got[d].n_exact, got[d].n_near) == (None if t is None else "\n".join(kept), exact, near), d
    assert got[70].n_lines == 0 and got[72].n_lines == 3 and got[71].no == 1
    assert drop_repeated_lines(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a line that is long enough to count")] * 2, "doc_id long, text string")
    assert [r.n_exact for r in drop_repeated_lines(twice).collect()] == [0, 0]


def near(a, b, edits, per):
    e = min(edits, min(len(a), len(b)) // per)
    return abs(len(a) - len(b)) <= e and distance(a, b) <= e


def brute(docs, edits, per):
    """(doc_id, kept lines, n_exact, n_near) by comparing each line with all that come earlier."""
    seen, out = [], {}
    for d, t in sorted(docs):
        kept, exact, almost = [], 0, 0
        for line in t.split("\n"):
            if line.strip():
                e = line in seen
                n = not e and any(near(s, line, edits, per) for s in seen)
                exact, almost = exact + e, almost + n
                seen.append(line)
                if e or n:
                    continue
            kept.append(line)
        out[d] = ("\n".join(kept), exact, almost)
    return out


@pytest.mark.parametrize("edits", [1])
def test_hot_segments_are_split(spark, edits):
    """Templated lines share segments by the hundred, at the same and at shifted places; short lines count when equal."""
    rng = random.Random(12)
    lines = [f"the visitor number {i} came in by the northern gate today" for i in range(90, 190)]
    lines += [f"the visitor number 77 came in by gate {chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + i * 7 % 26)}{chr(97 + i * 3 % 26)} and left" for i in range(90)]
    lines += [changed(rng, rng.choice(lines), rng.randint(1, 3)) for _ in range(60)] + ["ok", "no", "ok", "", " ", "a b"]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(64)]
    got = {r.doc_id: (r.text, r.n_exact, r.n_near) for r in drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), edits=edits).collect()}
    assert got == brute(docs, edits, 20)


def test_clashing_columns_and_very_long_texts(spark):
    rows = [(1, "\n".join(f"line {i % 5_000}" for i in range(20_000)), 7, "x"), (2, "line 3\nfresh", 8, None)]
    out = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, n_exact int, N_near string"))
    assert out.columns == ["doc_id", "text", "n_exact", "N_near", "n_lines", "n_exact_", "n_near_"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].n_exact_ == 15_000 and got[1].n_exact == 7 and got[1].text.split("\n") == [f"line {i}" for i in range(5_000)] and got[2].text == "fresh"
