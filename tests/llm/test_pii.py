import hashlib
import random
import re

from lacuna.llm.pii import find_personal_data

EXPR = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, e) in enumerate(EXPR.items()):
        for m in re.finditer(e, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def test_base_against_brute_force(spark):
    rng = random.Random(11)
    bits = ["a.b@c.d", "@", "é", "🙂", "+1 (017) 555-0199", "1.2.3.4", "256.1.1.1", "007.0255.1.9", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", ".", "+", "12", "x_y@z-.co.uk.", "1.2.3.4.5", "%", "(", "3782 822463 10005", "\n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "a" * 1_500), (903, "1" * 1_500), (904, "1.2." * 600), (905, "a." * 700 + "@b"), (906, "x@" + "b." * 700 + "c"), (907, "+" + "1 " * 700)]
    rows += [(1, rows[1][1]), (None, "q a@b.c")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, base string, id int").repartition(4)
    want = sorted(((d if d is not None else -1), hashlib.sha256(brute(t or "").encode()).hexdigest()) for d, t in rows)
    got = find_personal_data(df).collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.base_sha256) for r in got) == want
    assert find_personal_data(df.limit(0)).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"ring mobile +1 (017) 555-01{i:02d} soon") for i in range(10)]
    rows += [(20, "ring mobile 555-0199-7 soon"), (21, "the year 2024-05-06 was warm"), (22, "nothing")]
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20].spans == "phone:12:22" and got[20].n_phone == 1 and got[20].n_added == 1
    assert got[21].spans == "" and got[22].n_added == 0 and got[3].n_added == 0


def test_very_long_texts(spark):
    rows = [(1, "a" * 200_000), (2, "a." * 50_000 + "@b"), (3, "x@" + "b." * 20_000 + "c"), (4, "1" * 100_000), (5, "+" + "1 " * 50_000)]
    got = {r.doc_id: r.spans for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "", 3: "email:0:40003", 4: "", 5: ""}


def planted(rng, n):
    """Rows with seeds and unseen identifiers in the same contexts, and clean rows with codes in others."""
    word = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    rows, want = [], {}
    for i in range(n):
        x, y = word(rng.randint(4, 8)), word(rng.randint(4, 8))
        kind, lead, tail, seed, unseen = rng.choice(
            [
                ("email", "mail", "today", f"{x}@{y}.org", f"{x}[at]{y}.org"),
                ("email", "write", "soon", f"{x}@{y}.com", f"{x}@{y}"),
                ("phone", "ring", "now", f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", f"{rng.randint(200, 999)}-555-{rng.randint(1000, 9999)}"),
                ("ip", "host", "down", f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.7", f"fe80-{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}"),
            ]
        )
        filler = " ".join(word(5) for _ in range(rng.randint(0, 9)))
        if rng.random() < 0.7:
            rows.append((i, f"{filler} {lead} {seed} {tail} {filler}"))
        elif rng.random() < 0.5:
            rows.append((i, f"{filler} {lead} {unseen} {tail} {filler}"))
            at = len(filler) + len(lead) + 2
            want[i] = f"{kind}:{at}:{at + len(unseen)}"
        else:
            rows.append((i, f"{filler} item {rng.randint(10**7, 10**8)} sold part{rng.randint(100, 999)}-{word(4)} {filler}"))
    return rows, want


def test_recall_of_planted_identifiers(spark):
    rows, want = planted(random.Random(12), 600)
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {d: r.spans for d, r in got.items() if r.n_added}
    hit = sum(added.get(d) == s for d, s in want.items())
    assert len(want) > 60 and hit >= 0.9 * len(want)
    assert set(added) <= set(want)  # clean rows and rows of seeds gain nothing


def test_known_identifiers_in_another_form_and_cut_runs(spark):
    rows = [(1, "4111 1111 1111 1111"), (2, "x 4111.1111.1111.1111 y"), (3, "+1 (017) 555-0199"), (4, "1017 555 0199"), (5, "0175550199 10.1.2.3")]
    rows += [(6, "zz 10.9.8.7 5550107")] + [(10 + i, f"zz {5550200 + i}") for i in range(4)]
    got = {r.doc_id: r.spans for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == "card:2:21" and got[4] == "phone:0:13" and got[5] == "ip:11:19" and got[6] == "ip:3:11"


def test_contexts_reach_over_long_blanks(spark):
    rows = [(i, "ring" + " " * 500 + f"+1 (017) 555-01{i:02d} " + "." * 500 + "soon") for i in range(10)]
    rows += [(20, "ring 555-0199-7 soon")]
    got = {r.doc_id: r.spans for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == "phone:5:15"


def test_many_matches_keep_their_places(spark):
    text = "é a@b.c 1.2.3.4 " * 1_000
    got = find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.base_sha256 == hashlib.sha256(brute(text).encode()).hexdigest() and got.n_email == got.n_ip == 1_000
