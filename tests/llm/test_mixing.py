from collections import Counter, defaultdict

from lacuna.llm.mixing import mix


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, source string, slot int, parts string").repartition(5)
    return [tuple(r) for r in mix(df, **kw).collect()]


def test_every_prefix_is_within_a_block_of_its_share(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}" if i % 21 else None, 0, "") for i in range(2000)]
    weights = {"hot": 5, "s0": 1, "s3": 2}
    got = run(spark, rows, weights=weights, period=50, block_rows=1, bucket_rows=100)
    slots = defaultdict(set)
    for _, s, _, _, slot in got:
        slots[slot].add(s)
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    total, parts = len(slots), Counter(next(iter(slots[i])) for i in range(50))
    assert total % 50 == 0 and sum(parts.values()) == 50
    done = Counter()
    for i in range(total):
        done[next(iter(slots[i]))] += 1
        for s, p in parts.items():
            assert abs(done[s] * 50 - (i + 1) * p) < 50, (i, s)
    # nobody is left out, and an epoch repeats no row
    assert {d for d, *_ in got} == set(range(2000))
    assert max(Counter((d, e) for d, _, e, _, _ in got).values()) == 1


def test_blocks_stay_whole(spark):
    got = run(spark, [(i, "ab"[i % 2], 0, "") for i in range(100)], power=1.0, period=10, block_rows=4)
    sizes = Counter(slot for *_, slot in got)
    assert max(sizes.values()) == 4 and len({(s, b) for _, s, _, b, _ in got}) == len(sizes)


def test_odd_tables(spark):
    assert run(spark, []) == []
    got = run(spark, [(None, None, 0, ""), (None, None, 0, ""), (1, "a", 0, ""), (1, "a", 0, "")], period=4, block_rows=1)
    assert Counter(s for _, s, *_ in got) == {None: 2, "a": 2} and sorted(slot for *_, slot in got) == [0, 1, 2, 3]


def test_more_sources_than_the_default_period(spark):
    rows = [(i, f"s{i % 1100}" if i < 1500 else "hot", 0, "") for i in range(4000)]
    got = run(spark, rows, block_rows=1)
    assert {d for d, *_ in got} == set(range(4000))
    slots = sorted(slot for *_, slot in got)
    assert slots == list(range(len(slots))) and len(slots) % 4404 == 0
    per = Counter(s for _, s, _, _, slot in got if slot < 4404)
    assert len(per) == 1101 and per["hot"] == max(per.values())
