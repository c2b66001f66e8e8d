"""Removal of repeated and nearly repeated lines by a segment-partition edit join (DataFrame operations only).

Two lines within e edits of each other share at least one of e + 1 segments. Every distinct line is indexed
under its segments together with its length, and probes the indexes of its own and of slightly shorter
lengths with the substrings at the places where an intact segment can stand. A key that very many distinct
lines share is split: what is left of its lines without the shared segment is within as many edits, so it is
partitioned and probed in the same way, until the groups are small or nothing but e characters is left.
Candidates are verified by a banded bit-parallel edit distance: one machine word per number of errors holds
the reachable diagonals of the band, and each character advances it with shifts and masks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, discard, free_names, materialise, partitions, release, table

LOWEST = -(1 << 63)
#: A key is split if more distinct lines than this are indexed under it.
HOT = 16


def allowed(size: Column, edits: int, per: int) -> Column:
    """Edits that a line of this length may have: one for every ``per`` code points, at most ``edits``."""
    return F.least(F.floor(size / F.lit(per)).cast("int"), F.lit(edits))


def with_keys(lines: DataFrame, line: str, errors, edits: int) -> DataFrame:
    """The rows of lines for each of their keys, with key, probe, at, wide, n, e: index keys under the line's own
    length, probe keys for shorter lengths n. ``errors`` tells from a length how many edits there are; ``at`` and
    ``wide`` place the segment."""
    # an intact segment has moved by no more than the edits before it, and those after it
    places = [(e, gap, i, off) for e in range(1, edits + 1) for gap in range(e + 1) for i in range(e + 1) for off in range(max(-i, gap - (e - i)), min(i, gap + (e - i)) + 1)]
    of = F.from_json(F.lit(str([dict(zip(("e", "gap", "i", "off"), p)) for p in places])), "array<struct<e:int,gap:int,i:int,off:int>>")
    rows = lines.select("*", F.inline(of)).withColumn("n", F.length(line) - F.col("gap"))
    rows = rows.where((F.col("n") > F.col("e")) & (errors(F.col("n")) == F.col("e")))
    begin, end = F.expr("cast(n * i div (e + 1) as int)"), F.expr("cast(n * (i + 1) div (e + 1) as int)")
    rows = rows.withColumn("at", begin + F.col("off")).withColumn("wide", end - begin)
    key = F.xxhash64("n", F.col("e") * 16 + F.col("i"), F.substring(line, F.col("at") + 1, F.col("wide")))
    return rows.select(*lines.columns, key.alias("key"), ((F.col("gap") > 0) | (F.col("off") != 0)).alias("probe"), "at", "wide", "n", "e")


def core(a: Column, b: Column) -> Column:
    """struct<x, y>: what is left of two strings without a common begin and a common end. Their distance is that
    of the whole strings. The begin's length is found by halving steps, and so is the end's."""
    steps = F.array(*[F.lit(1 << k) for k in range(17, -1, -1)])

    def longest(x: Column, y: Column) -> Column:
        most = F.least(F.length(x), F.length(y))
        same = lambda at, s: (at + s <= most) & (F.substring(x, at + 1, s) == F.substring(y, at + 1, s))
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when(same(at, s), at + s).otherwise(at))

    def cut(z: Column, n: Column) -> Column:
        return F.struct(F.substring(z["x"], n + 1, F.length(z["x"])).alias("x"), F.substring(z["y"], n + 1, F.length(z["y"])).alias("y"))

    def turned(z: Column) -> Column:
        return F.struct(F.reverse(z["x"]).alias("x"), F.reverse(z["y"]).alias("y"))

    one = F.array(F.struct(a.alias("x"), b.alias("y")))
    for _ in range(2):  # the rest is turned round, cut in the same way, and turned back
        one = F.transform(one, lambda z: turned(cut(z, longest(z["x"], z["y"]))))
    return one[0]


def plausible(a: Column, b: Column, e: Column, parts: int = 32) -> Column:
    """Necessary for a, the shorter, to be within e edits of b: all but e of its pieces stand near their place."""
    n = F.length(a)

    def lost(count: Column, i: Column) -> Column:
        begin, end = F.floor(n * i / parts).cast("int"), F.floor(n * (i + 1) / parts).cast("int")
        low = F.greatest(begin - e, F.lit(0))
        near = F.instr(F.substring(b, low + 1, end + e - low), F.substring(a, begin + 1, end - begin)) > 0
        return F.when((count > e) | near, count).otherwise(count + 1)

    return F.aggregate(F.sequence(F.lit(0), F.lit(parts - 1)), F.lit(0), lost) <= e


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within so many edits. Bit d + edits of word e: the diagonal d (place in b less
    place in a) is reachable with at most e errors."""
    # bound once by transform(): inside the loop they would be split again for each character
    both = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")))
    n, m = F.length(a), F.length(b)
    few = F.least(n, F.lit(16))
    # most pairs have no reachable diagonal left after some characters
    alive = lambda z: (n <= 16) | (_reached(z["x"], z["y"], few, edits)[f"w{edits}"] != 0)
    return F.transform(both, lambda z: F.when(alive(z), _within(z["x"], z["y"], n, m, edits)).otherwise(False))[0]


def _within(x: Column, y: Column, n: Column, m: Column, edits: int) -> Column:
    last = _reached(x, y, n, edits)[f"w{edits}"]
    return F.coalesce((F.abs(n - m) <= edits) & (F.getbit(last, F.when(F.abs(n - m) <= edits, m - n + edits).otherwise(0)) == 1), F.lit(False))


def _reached(x: Column, y: Column, n: Column, edits: int) -> Column:
    """The words after n characters of x."""
    mask = (1 << (2 * edits + 1)) - 1

    def shifted(w: Column, by: int) -> Column:
        return F.shiftleft(w, by).bitwiseAND(F.lit(mask)) if by > 0 else F.shiftright(w, -by)

    def advance(state: Column, i: Column) -> Column:
        same = F.lit(0)
        for d in range(-edits, edits + 1):
            here = (i + d >= 0) & (F.get(x, i) == F.get(y, F.greatest(i + d, F.lit(0))))
            same = same.bitwiseOR(F.when(here, 1 << (d + edits)).otherwise(0))
        words: list[Column] = []
        for e in range(edits + 1):
            w = state[f"w{e}"].bitwiseAND(same)
            if e:
                before = state[f"w{e - 1}"]
                w = w.bitwiseOR(before).bitwiseOR(shifted(before, -1)).bitwiseOR(shifted(words[-1], 1))
            words.append(w)
        return F.struct(*[w.alias(f"w{e}") for e, w in enumerate(words)])

    start = F.struct(*[F.lit(sum(1 << (edits + d) for d in range(e + 1))).alias(f"w{e}") for e in range(edits + 1)])
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, advance)


def _pairs(level: DataFrame) -> DataFrame:
    """Pairs of classes that share a key and may be near: indexed ones with each other, and with those that probe,
    which are no shorter."""
    own = level.where("not probe").select("key", F.col("cls").alias("a"), F.col("line").alias("p"), "e")
    met = level.select(F.col("key").alias("k"), F.col("cls").alias("b"), F.col("line").alias("q"), "probe")
    fit = (F.col("key") == F.col("k")) & ((F.col("a") < F.col("b")) | (F.col("probe") & (F.col("a") != F.col("b")))) & plausible(F.col("p"), F.col("q"), F.col("e"))
    return own.join(met, fit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _star(leaf: DataFrame) -> DataFrame:
    """Pairs of groups in which no more than e characters of the indexed lines are left. These are all within e
    of each other, so the earliest settles the rest; who probes with more characters, and is not settled by the
    earliest, meets every one of those few short strings."""
    first = leaf.where("not probe").groupBy("key").agg(F.min(F.struct("first", "cls", "body")).alias("lead"))
    met = leaf.join(first, "key")
    star = met.where(F.col("cls") != F.col("lead.cls")).select(F.col("lead.cls").alias("a"), F.col("cls").alias("b"))
    settled = (F.col("lead.first") < F.col("first")) & (F.levenshtein(F.col("lead.body"), F.col("body")) <= F.col("e"))
    open_ = met.where(F.col("probe") & (F.length("body") > F.col("e")) & ~settled).select("key", F.col("cls").alias("b"))
    rest = leaf.where("not probe").select("key", F.col("cls").alias("a")).join(open_, "key").where("a != b").select("a", "b")
    both = star.unionByName(rest)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _candidates(level: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Distinct pairs (a, b) of classes that may be near. Every round splits the keys that are still hot."""
    found, level = [], materialise(level.drop("first").join(bounded(texts), "cls").withColumn("body", F.col("line")), "level")
    while True:
        # at most one in HOT of the rows
        hot = materialise(level.where("not probe").groupBy("key").agg(F.count("*").alias("n_own")).where(F.col("n_own") > HOT).select("key"), "hot")
        many = hot.count()
        cold = level if not many else level.join(bounded(hot, many), "key", "left_anti")
        found.append(materialise(_pairs(cold).distinct(), "pairs"))
        if not many:
            break
        left = F.concat(F.expr("substring(body, 1, at)"), F.substring("body", F.col("at") + F.col("wide") + 1, F.length("body")))
        rows = level.join(bounded(hot, many), "key")
        rows = rows.select("key", "probe", "e", "cls", "first", "line", (F.col("n") - F.col("wide")).alias("own"), left.alias("body"))
        rows = materialise(rows, "split")
        discard(level)
        found.append(materialise(_star(rows.where(F.col("own") <= F.col("e"))).distinct(), "pairs"))
        deeper = rows.where(F.col("own") > F.col("e"))
        deeper = deeper.select(F.col("key").alias("above"), F.col("probe").alias("probing"), F.col("e").alias("may"), "cls", "first", "line", "body")
        deeper = with_keys(deeper, "body", lambda n: F.col("may"), edits)
        deeper = deeper.select(F.xxhash64("above", "key").alias("key"), (F.col("probing") | F.col("probe")).alias("probe"), "at", "wide", "n", "e", "cls", "first", "line", "body")
        # a key of one line, or of none that is indexed, meets nobody
        deeper = materialise(deeper, "level")
        shared = materialise(deeper.groupBy("key").agg(F.count("*").alias("all"), F.count_if(F.expr("not probe")).alias("own")).where("all > 1 and own > 0").select("key"), "shared")
        level = materialise(deeper.join(bounded(shared), "key", "left_semi"), "level")
        for done in (hot, rows, deeper, shared):
            discard(done)
        release(texts.sparkSession)
    return reduce(DataFrame.unionByName, found).distinct()


def drop_repeated_lines(docs: DataFrame, edits: int = 1, per: int = 20, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, text without its repeated lines, and n_lines, n_exact, n_near (lines dropped).

    Lines are parted by line feeds and compared as they stand. A line of ``least`` code points or more that is
    not blank is dropped if an equal line, or one near it, occurs earlier in the input: in a smaller id (null
    is smallest; rows that repeat an id go by a hash of their text; rows equal in both count as one document)
    or earlier in the text. Near are lines within one edit for every ``per`` code points of the shorter one,
    ``edits`` at most; shorter lines must be equal. One edit is the default: with it a hot key's halves are halved
    in one way only, while with more edits a group is reached by several orders of splitting, and hot keys cost more. All is judged on the input, not on what is left. Null texts
    stay null, with 0 lines; a text whose lines all go becomes empty. Texts are taken whole, however long. An
    empty table gives no rows. Where docs has a column n_lines, n_exact or n_near, that of the result gets an
    underscore more; the three are always the last.

    Lines are identified by 128 bits; a pair of different lines with equal 64-bit hashes is not compared.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST)).alias("id"), F.xxhash64(f"`{text_col}`").alias("th"), F.col(f"`{text_col}`").alias("text"))
    lines = rows.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where((F.length("line") >= least) & F.col("line").rlike(r"\S"))
    tau = lambda n: allowed(n, edits, per)
    keyed = lines.where(F.length("line") >= per)
    shared = with_keys(keyed.select(F.xxhash64("line").alias("c"), "line"), "line", tau, edits).select("c", "key")
    shared = shared.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x != y").select("key")
    shared = materialise(shared, "shared")
    release(spark)
    cls, place = F.unhex(F.md5("line")).alias("cls"), F.struct("id", "th", "no").alias("first")
    met = with_keys(keyed.select(cls, place, "line"), "line", tau, edits).drop("line").join(bounded(shared), "key", "left_semi")
    met = materialise(met.groupBy("key", "probe", "at", "wide", "n", "e", "cls").agg(F.min("first").alias("first")), "met")
    discard(shared)
    release(spark)

    wanted = met.groupBy("cls").agg(F.min("first").alias("first"))
    wanted = materialise(wanted.groupBy(F.col("first.id").alias("id"), F.col("first.th").alias("th")).agg(F.collect_list(F.struct(F.col("first.no").alias("no"), "cls")).alias("at")), "wanted")
    texts = rows.join(bounded(wanted), ["id", "th"]).withColumn("lines", F.split("text", "\n", -1)).select("id", "th", F.explode("at").alias("x"), "lines")
    texts = texts.select("x.cls", F.struct("id", "th", "x.no").alias("first"), F.col("lines")[F.col("x.no")].alias("line"))
    # rows equal in id and text come once
    texts = materialise(texts.groupBy("cls").agg(F.min("first").alias("first"), F.any_value("line").alias("line")), "lines")
    discard(wanted)
    release(spark)
    pairs = materialise(_candidates(met, texts, edits), "pairs")
    discard(met)
    one = lambda x, c: texts.select(F.col("cls").alias(x), F.col("line").alias(c), F.col("first").alias(f"f{x}"))
    near = pairs.join(one("a", "p"), "a").join(one("b", "q"), "b")
    swap = F.length("p") <= F.length("q")
    near = near.select("a", "b", "fa", "fb", F.when(swap, F.col("p")).otherwise(F.col("q")).alias("p"), F.when(swap, F.col("q")).otherwise(F.col("p")).alias("q"))
    near = near.withColumn("e", tau(F.length("p")))
    # few bytes but long work: adaptive plans would leave it to one task
    near = near.repartition(partitions(spark))
    any_of = lambda z: reduce(lambda w, e: w.when(F.col("e") == e, within(z["x"], z["y"], e)), range(1, edits + 1), F.when(F.lit(False), F.lit(False)))
    sure = F.transform(F.array(core(F.col("p"), F.col("q"))), any_of)[0]
    near = materialise(near.where(sure).select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("cls")).distinct(), "near")
    discard(pairs)
    discard(texts)

    all_lines = lines.select(cls, "id", "th", "no")
    again = all_lines.groupBy("cls").agg(F.min(F.struct("id", "th", "no")).alias("first"), F.count("*").alias("n")).where("n > 1").select("cls", "first")
    judged = materialise(again.join(near.withColumn("near", F.lit(True)), "cls", "full"), "judged")
    release(spark)
    exact = F.coalesce(F.struct("id", "th", "no") != F.col("first"), F.lit(False))
    gone = all_lines.join(bounded(judged), "cls").withColumn("exact", exact).where("exact or near").dropDuplicates(["id", "th", "no"])
    gone = gone.groupBy("id", "th").agg(F.array_sort(F.collect_list("no")).alias("gone"), F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_near"))
    gone = materialise(gone, "gone")
    discard(judged)
    release(spark)
    keys = [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST)).alias("__id"), F.xxhash64(f"`{text_col}`").alias("__th")]
    all_ = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *keys)
    out = all_.join(bounded(gone.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "gone", "n_exact", "n_near")), ["__id", "__th"], "left")
    whole = F.split(F.col("__row")[text_col], "\n", -1)
    # what stands between lines that go, and around them; the text is split once
    bounds = lambda w: F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(w)))
    between = lambda z: F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda i: F.slice(z["w"], F.get(z["b"], i - 1) + 2, F.get(z["b"], i) - F.get(z["b"], i - 1) - 1))
    left = F.transform(F.transform(F.array(whole), lambda w: F.struct(w.alias("w"), bounds(w).alias("b"))), lambda z: F.array_join(F.flatten(between(z)), "\n"))[0]
    text = F.when(F.col("gone").isNull(), F.col("__row")[text_col]).otherwise(left)
    names = free_names(["n_lines", "n_exact", "n_near"], docs.columns)
    return out.select(
        *[text.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in docs.columns],
        F.when(F.col("__row")[text_col].isNull(), F.lit(0)).otherwise(F.coalesce(F.size(whole), F.lit(0))).alias(names[0]),
        F.coalesce("n_exact", F.lit(0)).alias(names[1]),
        F.coalesce("n_near", F.lit(0)).alias(names[2]),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
