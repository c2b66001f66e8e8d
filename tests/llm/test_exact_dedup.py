from lacuna.llm.exact_dedup import exact_dedup


def brute(rows):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(low(t), []).append(d)
    best = {k: max((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d if d is not None else -1, best[low(t)], len(groups[low(t)]), d == best[low(t)]) for d, t in rows), key=str)


def test_against_brute_force(spark):
    rows = [(i, "Hot Copy" if i % 3 else f"text É{i % 40}") for i in range(600)] + [(700, "HOT copy"), (701, None), (702, ""), (703, "É"), (704, "é")]
    rows += [(705, "same"), (705, "same"), (None, "same"), (None, "alone"), (706, "w " * 200_000), (707, "W " * 200_000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, digest string").repartition(7)
    for share in (1e-4, 0.1):
        got = exact_dedup(df, hot_share=share).collect()
        assert sorted(((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute(rows)
    assert exact_dedup(df.limit(0)).count() == 0


def test_a_hot_text_under_null_and_one_repeated_id(spark):
    from lacuna.llm.exact_dedup import exact_dedup

    rows = [(None, "Same") for _ in range(300)] + [(7, "sAME") for _ in range(300)] + [(1, "other")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot_share=0.1).collect()
    assert len(got) == 601 and {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(None, 7, 600, False), (7, 7, 600, True), (1, 1, 1, True)}
