"""Personal data by bootstrapped contextual extraction (DataFrame operations only).

Exact expressions find the seed entities of four kinds. Each seed, and every other token that could be an
identifier (a long run of digits; a token with a digit, an ``@`` or a bracket in it), is an instance. It stands
in lexical contexts: the word before it, the word after it, and both. Contexts are patterns; patterns and
instances, told apart by their normalised text, form a bipartite graph. In each round a pattern's confidence
for a kind is the mean score of its instances (seeds of the kind 1, of other kinds 0, others their current
score), if enough different instances of high score support it, and an instance's score is its best
pattern's. After the last round, instances under patterns of high confidence become spans of that kind, and
so do seeds written in another way.

The expressions are written so that Java's matcher takes linear time on any text: quantifiers are possessive
where what follows cannot match inside, and runs are entered only at their begin or where a match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, discard, materialise, release, table

LOWEST = -(1 << 63)
KINDS = ["email", "ip", "card", "phone"]
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What else may be an identifier: seven digits or more, at most two separators between them ...
_RUN = r"(?<![\p{L}\p{N}])(?<![0-9][\x20().-]{1,2})[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+(?![\p{L}\p{N}])"
#: ... or a token whose first digit, @ or bracket follows on letters and signs only.
_TOKEN = r"(?<![\p{L}\p{N}._%+-])(?=[\p{L}._%+-]*+[0-9@\[])[\p{L}\p{N}]++(?:[._%+@\[\]-]{1,4}+[\p{L}\p{N}]++)*+"
OTHER = f"{_RUN}|{_TOKEN}"
SHORTEST = 6  # code points of an instance that is no seed
BLOCK = 256
_SPANS = "array<struct<start:int,ord:int,end:int>>"
_TOLD = "array<struct<start:int,ord:int,end:int,value:string,before:string,after:string>>"


def matches(text: Column, expression: str, ordinal: int, good) -> Column:
    """array<struct<start, ord, end, value, before, after>> of the leftmost non-overlapping matches that good(match)
    accepts: place, matched text, and the nearest words on both sides, up to the next match or digit.

    Places are running sums, made in blocks, so that appending stays cheap in texts with very many matches."""
    hits = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    gaps = F.split(text, expression, -1)
    ends = F.zip_with(hits, F.slice(gaps, F.lit(2), F.size(gaps)), lambda h, z: F.struct(h.alias("h"), z.alias("z")))
    parts = F.filter(F.zip_with(gaps, ends, lambda g, e: F.struct(g.alias("g"), e["h"].alias("h"), e["z"].alias("z"))), lambda x: x["h"].isNotNull())
    none = F.array().cast(_TOLD)

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["g"])
        end = begin + F.length(x["h"])
        before = F.lower(F.reverse(F.regexp_extract(F.reverse(x["g"]), r"^[^\p{L}0-9]*+(\p{L}++)", 1)))
        after = F.lower(F.regexp_extract(x["z"], r"^[^\p{L}0-9]*+(\p{L}++)", 1))
        span = F.struct(begin.alias("start"), F.lit(ordinal).alias("ord"), end.alias("end"), x["h"].alias("value"), before.alias("before"), after.alias("after"))
        return F.struct(end.alias("at"), F.when(good(x["h"]), F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def spans(some: Column) -> Column:  # a lambda's variable: a plain expression would be worked out anew for each block
        def block(done: Column, b: Column) -> Column:
            begin = F.when(F.size(done) > 0, F.get(done, F.size(done) - 1)["at"]).otherwise(0)
            return F.concat(done, F.array(F.aggregate(F.slice(some, b * BLOCK + 1, BLOCK), F.struct(begin.alias("at"), none.alias("out")), step)))

        blocks = F.sequence(F.lit(0), F.floor((F.size(some) - 1) / BLOCK).cast("int"))
        empty = F.array().cast(f"array<struct<at:int,out:{_TOLD}>>")
        return F.when(F.size(some) > 0, F.flatten(F.transform(F.aggregate(blocks, empty, block), lambda x: x["out"]))).otherwise(none)

    return F.transform(F.array(parts), spans)[0]


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def seeds(text: Column) -> Column:
    none = F.array().cast(_TOLD)
    found = [
        F.when(F.instr(text, "@") > 0, matches(text, EMAIL, 0, lambda m: F.lit(True))).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), matches(text, IP, 1, lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))).otherwise(none),
        F.when(text.rlike(r"[0-9][\x20-]?[0-9]"), matches(text, CARD, 2, lambda m: F.length(digits(m)).between(12, 19) & F.call_function("luhn_check", digits(m)))).otherwise(none),
        F.when(F.instr(text, "+") > 0, matches(text, PHONE, 3, lambda m: F.length(digits(m)).between(9, 15))).otherwise(none),
    ]
    return F.array_sort(F.concat(*found))


def others(text: Column, base: Column) -> Column:
    """Instances that are no seeds. Of a match that overlaps seeds, what lies before the first and after the last."""
    none = F.array().cast(_TOLD)
    found = F.when(text.rlike(r"[0-9@\[]"), matches(text, OTHER, -1, lambda m: F.lit(True))).otherwise(none)

    def cut(c: Column) -> Column:
        met = F.filter(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        first, last = F.array_min(F.transform(met, lambda b: b["start"])), F.array_max(F.transform(met, lambda b: b["end"]))
        head = F.regexp_replace(F.left(c["value"], F.greatest(first - c["start"], F.lit(0))), r"[^\p{L}\p{N}]++$", "")
        tail = F.regexp_replace(F.right(c["value"], F.greatest(c["end"] - last, F.lit(0))), r"^[^\p{L}\p{N}]++", "")
        rest = F.array(
            F.struct(c["start"].alias("start"), c["ord"].alias("ord"), (c["start"] + F.length(head)).alias("end"), head.alias("value"), c["before"].alias("before"), F.lit("").alias("after")),
            F.struct((c["end"] - F.length(tail)).alias("start"), c["ord"].alias("ord"), c["end"].alias("end"), tail.alias("value"), F.lit("").alias("before"), c["after"].alias("after")),
        )
        return F.when(F.size(met) > 0, rest).otherwise(F.array(c))

    return F.filter(F.flatten(F.transform(found, cut)), lambda c: F.length(c["value"]) >= SHORTEST)


def normal(x: Column) -> Column:
    """What an instance is known by: its digits if it is digits and separators, as cards and phones are (IP addresses
    keep their dots); else its text in lower case."""
    numeric = x["ord"].isin(2, 3) | ((x["ord"] < 0) & x["value"].rlike(r"^[0-9\x20().-]++$"))
    return F.when(numeric, digits(x["value"])).otherwise(F.lower(x["value"]))


def contexts(before: Column, after: Column) -> Column:
    """Patterns around an instance: the nearest word before, the nearest after, both; without a word none."""
    made = F.array(
        F.when(before != "", F.concat(F.lit("< "), before)),
        F.when(after != "", F.concat(F.lit("> "), after)),
        F.when((before != "") & (after != ""), F.concat(before, F.lit(" _ "), after)),
    )
    return F.filter(made, lambda x: x.isNotNull())


def said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(ordinal: int):
    return lambda s: s["ord"] == ordinal


def find_personal_data(docs: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (of all spans), base_sha256, spans, n_added.

    Null text counts as empty and has no spans. Repeated rows get equal results; other columns are ignored;
    an empty table gives no rows. Texts of any length are taken whole. Places count code points, ends are
    exclusive. Of kinds with equal confidence an added span takes the one listed first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(LOWEST)).alias("id"), F.xxhash64("text").alias("th"), "text", seeds(F.col("text")).alias("seeds"))
    told = F.transform(
        F.concat("seeds", others(F.col("text"), F.col("seeds"))),
        lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), normal(x).alias("value"), contexts(x["before"], x["after"]).alias("patterns")),
    )
    base = F.transform("seeds", lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end")))
    found = materialise(rows.select("doc_id", "id", "th", base.alias("base"), told.alias("told")), "found")
    release(spark)

    # instances are texts, known to be of a kind if they are seeds of it anywhere; each counts once under a pattern
    spots = found.where(F.size("told") > 0).select("id", "th", F.explode("told").alias("x")).select("id", "th", "x.start", "x.ord", "x.end", "x.value", "x.patterns")
    known = materialise(spots.where("ord >= 0").groupBy("value").agg(F.min("ord").alias("known")), "known")
    edges = spots.select("value", F.explode("patterns").alias("pattern")).distinct()
    # a pattern with fewer instances can never gain confidence
    enough = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("pattern")
    edges = edges.join(enough, "pattern").join(bounded(known), "value", "left")
    edges = materialise(edges.select("pattern", "value", F.coalesce("known", F.lit(-1)).alias("known")), "edges")
    kinds = F.array(*[F.lit(i) for i in range(len(KINDS))])
    scores, conf = None, None
    for _ in range(rounds):
        now = edges.select("pattern", "value", "known", F.explode(kinds).alias("kind"))
        own = F.when(F.col("known") == F.col("kind"), 1.0)
        if scores is None:
            now = now.withColumn("score", own.otherwise(0.0))
        else:
            now = now.join(bounded(scores), ["value", "kind"], "left").withColumn("score", own.when(F.col("known") >= 0, 0.0).otherwise(F.coalesce("score", F.lit(0.0))))
        means = now.groupBy("pattern", "kind").agg(F.round(F.avg("score"), 9).alias("conf"), F.count_if(F.col("score") >= confidence).alias("own"))
        old = [x for x in (conf, scores) if x is not None]
        conf = materialise(means.where((F.col("own") >= support) & (F.col("conf") > 0)).select("pattern", "kind", "conf"), "patterns")
        scores = materialise(edges.where("known < 0").join(bounded(conf), "pattern").groupBy("value", "kind").agg(F.max("conf").alias("score")), "scores")
        for x in old:
            discard(x)
    discard(edges)
    free = spots.where("ord < 0")
    by_pattern = free.select("id", "th", "start", "end", F.explode("patterns").alias("pattern")).join(bounded(conf.where(F.col("conf") >= confidence)), "pattern")
    again = free.join(bounded(known), "value").select("id", "th", "start", "end", F.lit(1.0).alias("conf"), F.col("known").alias("kind"))
    added = by_pattern.select("id", "th", "start", "end", "conf", "kind").unionByName(again)
    added = added.groupBy("id", "th", "start", "end").agg(F.max(F.struct("conf", (-F.col("kind")).alias("k"))).alias("best"))
    added = added.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("best.k")).cast("int").alias("ord"), "end"))).alias("added"))
    out = found.join(added, ["id", "th"], "left").withColumn("added", F.coalesce("added", F.array().cast(_SPANS)))
    out = out.withColumn("all", F.array_sort(F.concat("base", "added")))
    return out.select(
        "doc_id",
        *[F.size(F.filter("all", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.col("all")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
