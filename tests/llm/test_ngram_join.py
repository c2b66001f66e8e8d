import random
import re

import numpy as np
from lacuna.llm.ngram_join import Tree, bitmap, block_pairs, jaccard_components, not_earlier


def brute(rows, width=4):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 85 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(top(i), []).append(d)
    return sorted(((d, len(s), min((x for x in least[top(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def texts(rng, n):
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 20, 60, 200]))]
        if rng.random() < 0.3:
            base = passage[: rng.randint(10, 40)] + base[:8]
        for _ in range(rng.randint(1, 12)):
            out.append(" ".join(base))
            base = list(base)
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = word()
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = list(enumerate(texts(rng, 60), 10)) + [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one  TWO"), (6, "É b c d"), (7, "é b c d")]
    rows += [(8, "x y z"), (8, "x y z"), (8, "p q r s t"), (None, "one two"), (None, "all alone here")]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, node int, n string").repartition(5)
    for hot in (4000, 3):
        got = jaccard_components(df, hot=hot).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert jaccard_components(df.limit(0)).count() == 0


def test_traversal_loses_no_pair():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, rng.integers(5, 300)).astype(np.uint64)
        for _ in range(rng.integers(1, 6)):
            sets.append(np.unique(base[rng.random(len(base)) > 0.05]))
    sets = [s for s in sets if len(s)]
    n = np.array([len(s) for s in sets])
    maps, lows = [bitmap(s) for s in sets], np.array([int(s[0]) for s in sets])
    found = {tuple(sorted(p)) for i, j in block_pairs(np.arange(len(sets)), n, maps, lows, np.arange(len(sets)), 85) for p in zip(i.tolist(), j.tolist())}
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (n[i] + n[j] - k)}
    assert links <= found and len(found) < 3 * len(links)
    assert len(Tree(np.stack([m[:1] for m in maps]), n, n, n).levels) == 4


def test_pairs_are_held_back_only_where_a_smaller_key_is_shared():
    rng = np.random.default_rng(5)
    keys = [np.unique(rng.integers(-40, 40, rng.integers(1, 9))) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    for key in (-41, -3, 0, 17, 40):
        want = [not any(k < key for k in set(keys[a].tolist()) & set(keys[b].tolist())) for a, b in zip(i, j)]
        assert not_earlier(key, keys, i, j).tolist() == want


def test_least_shared_is_a_bound(spark):
    from lacuna.llm.ngram_join import least_shared, prefix_length
    from pyspark.sql import functions as F

    rng, rows = random.Random(3), []
    for percent in (80, 85):
        for _ in range(400):
            both = rng.sample(range(10_000), rng.randint(1, 300))
            at = rng.randint(0, max(1, len(both) // 6))
            x, y = sorted(both[at:] or both), sorted(both[: len(both) - rng.randint(0, max(1, len(both) // 6))] or both)
            k = len(set(x) & set(y))
            if 100 * k >= percent * (len(x) + len(y) - k):
                rows.append((len(x), len(y), percent, len(set(x[: prefix_length(len(x), percent)]) & set(y[: prefix_length(len(y), percent)]))))
    for percent, d in ((80, 11), (85, 8)):  # all that one lacks comes first, all that the other lacks comes last
        core = list(range(1000, 1100 - d))
        x, y = list(range(d)) + core, core + list(range(5000, 5000 + d))
        rows.append((100, 100, percent, len(set(x[: prefix_length(100, percent)]) & set(y[: prefix_length(100, percent)]))))
    df = spark.createDataFrame(rows, "a int, b int, percent int, met int")
    got = [r for p in (80, 85) for r in df.where(F.col("percent") == p).withColumn("least", least_shared(F.col("a"), F.col("b"), p)).collect()]
    assert len(got) == len(rows) > 200 and all(1 <= r.least <= r.met for r in got)
    assert any(r.least == r.met > 3 for r in got)


def test_chance_meetings_are_not_searched(spark, monkeypatch):
    from lacuna.llm import ngram_join

    rng, seen = random.Random(4), {}
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(40):  # pairs that share one passage of eight words, and no more
        rows += [(2 * k, (p := text(8)) + " " + text(200)), (2 * k + 1, text(200) + " " + p)]
    rows += [(100, t := text(200)), (101, t + " end")]
    written = ngram_join.materialise

    def watched(df, tag):
        out = written(df, tag)
        seen.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", watched)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [*((i, i) for i in range(80)), (100, 100), (101, 100)]
    assert seen["members"] == [2] and seen["dealt"][0] >= 2
