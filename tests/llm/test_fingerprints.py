import hashlib
import random

from lacuna.llm.fingerprints import SPAN, Prefix, edited, fingerprint_documents, likeness, shared, sketch


def test_spans_and_extensions():
    rng = random.Random(3)
    t = "".join(rng.choice("abé🙂") for _ in range(300)) + "hello world" * 9
    p = Prefix(t)
    for _ in range(500):
        a, b, n = rng.randrange(len(t)), rng.randrange(len(t)), rng.randint(0, 20)
        n = min(n, len(t) - max(a, b))
        assert (int(p.span(a, a + n)) == int(p.span(b, b + n))) == (t[a : a + n] == t[b : b + n])
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        assert p.common(a, p, b) == k


def plain_shared(a, b):
    """Greedy passages in common, by comparing characters."""
    if not a or not b:
        return float(a == b)
    common = lambda i, j: next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
    if len(a) < SPAN or len(b) < SPAN:
        return common(0, 0) / len(a)
    blocks = {}
    for j in range(0, len(b) - SPAN + 1, SPAN):
        blocks.setdefault(b[j : j + SPAN], j)
    covered = end = at = 0
    while at <= len(a) - SPAN:
        j = blocks.get(a[at : at + SPAN])
        if j is None:
            at += 1
            continue
        back = 0
        while back < min(at - end, j) and a[at - back - 1] == b[j - back - 1]:
            back += 1
        on = common(at, j)
        covered, end = covered + back + on, at + on
        at = end
    return covered / len(a)


def test_joined_prefixes_equal_those_of_the_joined_text():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé🙂") for _ in range(rng.randint(0, 60))) for _ in range(2))
        cut, size = rng.randint(0, len(a)), rng.randint(0, len(b))
        p, q = Prefix.joined(Prefix(a), cut, Prefix(b), size), Prefix(a[:cut] + b[:size])
        assert p.n == q.n and p.spans().tolist() == q.spans().tolist() and all((x == y).all() for x, y in zip(p.sums, q.sums))


def plain_likeness(a, b):
    cut = lambda t: {t[i : i + SPAN] for i in range(max(1, len(t) - SPAN + 1))} if t else set()
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_shared_passages_and_likeness_against_plain_comparison():
    rng = random.Random(5)
    bits = ["".join(rng.choice("abcdeé🙂 ") for _ in range(rng.randint(1, 90))) for _ in range(12)] + ["ab" * 30, ""]
    for _ in range(300):
        a, b = ("".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert shared(Prefix(a), Prefix(b)) == plain_shared(a, b)
        assert abs(likeness(sketch(a), sketch(b)) - plain_likeness(a, b)) < 0.25
    a, b = ("".join(rng.choice("abcd") for _ in range(60_000)) for _ in range(2))
    assert shared(Prefix(a), Prefix(b + a[:40_000])) > 0.66 and shared(Prefix(a), Prefix(a)) == 1.0


def test_against_brute_force(spark):
    rng = random.Random(4)
    docs = [(i * 3, "".join(rng.choice("abcdefé ") for _ in range(rng.randint(0, 400)))) for i in range(150)]
    docs += [(7, docs[3][1]), (10**17, None), (10**17 + 1, "")]
    got = {r.doc_id: r for r in fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    order = sorted(docs, reverse=True)
    assert len(got) == len(docs)
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        new = edited(t, after)
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert got[d].shared_edited == plain_shared(t, new) and got[d].shared_next == plain_shared(t, after)
        assert got[d].near_edited == likeness(sketch(t), sketch(new)) and got[d].near_next == likeness(sketch(t), sketch(after))
    assert got[7].fingerprint == got[9].fingerprint


def test_odd_tables(spark):
    schema = "doc_id long, text string, b int, tail int, goes string"
    assert fingerprint_documents(spark.createDataFrame([], schema)).count() == 0
    one = fingerprint_documents(spark.createDataFrame([(5, "abc", 1, 1, "x")], schema)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = [(None, "x", 0, 0, ""), (None, "y", 0, 0, ""), (4, "abc", 0, 0, ""), (4, "abd", 0, 0, ""), (4, "abd", 0, 0, "")]
    got = fingerprint_documents(spark.createDataFrame(rows, schema)).collect()
    order = ["abd", "abd", "abc", "y", "x"]
    want = sorted(hashlib.sha256(edited(t, order[(i + 1) % 5]).encode()).hexdigest() for i, t in enumerate(order))
    assert sorted(r.edited_sha256 for r in got) == want
