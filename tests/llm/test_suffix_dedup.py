import random

import numpy as np
import pytest

from lacuna.llm.suffix_dedup import WINDOW, multikey_order, remove_repeats


def brute(docs):
    seen, out = set(), []
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, docs[i][1] or ""))
    for i in order:
        data = (docs[i][1] or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - WINDOW + 1):
            w = data[a : a + WINDOW]
            if w in seen:
                gone[a : a + WINDOW] = b"\1" * WINDOW
            seen.add(w)
        runs = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((docs[i][0], len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.mark.parametrize("windows", [200_000, 50])
def test_against_brute_force(spark, windows):
    rng = random.Random(6)
    passages = [words(rng, k) for k in (14, 20, 30, 60, 200)]
    docs = []
    for i in range(120):
        parts = [words(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            parts += [p[a : a + rng.randint(60, 600)], words(rng, rng.randint(0, 10))]
        docs.append((i * 7 % 120, "".join(parts)))
    docs += [(300, docs[5][1]), (301, docs[5][1][:-1] + "x"), (302, "a" * 500), (303, "ab" * 400), (304, "a" * 99), (305, None), (306, ""), (307, passages[4][:100]), (308, "z" + passages[4][:100])]
    docs += [(309, docs[7][1]), (309, docs[7][1]), (309, docs[8][1] + "!"), (None, docs[9][1])]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, rep int, gram int").repartition(6)
    got = remove_repeats(df, windows=windows).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(docs)


def test_pieces_of_long_texts_meet(spark):
    rng = random.Random(7)
    long = words(rng, 300_000)
    df = spark.createDataFrame([(1, long), (2, "x" + long), (3, long[500_000:])], "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert len(long) > 1 << 20 and got[1].n_removed == 0 and bytes(got[2].kept) == b"x" and got[3].n_removed == got[3].n_bytes


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_multikey_quicksort_against_plain_grouping():
    rng = np.random.default_rng(8)
    for n, wide in ((0, 3), (1, 3), (500, 2), (2_000, 5), (2_000, 1)):
        group, keys = np.sort(rng.integers(0, 4, n)), rng.integers(0, 4, (wide, n)).astype(np.uint64)
        rows, label = multikey_order(group, keys)
        want = {}
        for r in range(n):
            want.setdefault((group[r], *keys[:, r]), []).append(r)
        got = {}
        for r, g in zip(rows.tolist(), label.tolist()):
            got.setdefault(g, []).append(r)
        assert sorted(got.values()) == sorted(v for v in want.values() if len(v) > 1)
