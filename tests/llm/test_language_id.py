from pyspark.sql import functions as F

from lacuna.llm.language_id import fit, held_out, op8_language_id, predict

EN = ["the cat and the dog of the house", "this is the thing that they have", "where were they when it rained there"]
DE = ["der hund und die katze im haus", "das ist nicht schön für mich", "über die straße gehen wir nicht"]


def test_nulls_ties_empty_and_extra_columns(spark):
    model = fit(EN * 3 + DE * 3 + ["", "123"], ["en"] * 9 + ["de"] * 9 + ["en", "de"], clusters=2)
    rows = [(1, "the house of the cat", 1.0), (1, "the house of the cat", 1.0), (2, "die katze und der hund", 2.0), (None, None, None), (4, "", 0.0), (5, "123 !!", 0.0), (6, "the dog " * 50_000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n double")
    got = predict(df, model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "und"), (1, "en"), (1, "en"), (2, "de"), (4, "und"), (5, "und"), (6, "en")]
    assert all(0 <= r.score <= 1 for r in got) and predict(df.limit(0), model).count() == 0
    assert predict(df, fit([], [])).where("lang_pred != 'und'").count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op8_language_id(spark, sf).where("held_out").join(truth, "doc_id").selectExpr("avg(int(lang_pred = lang)) a", "avg(int(rejected)) r", "count(*) n").first()
    assert got.n > 100 and got.a > 0.98 and got.r < 0.01


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(100).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_clashing_columns_and_rare_languages(spark):
    from lacuna.llm.language_id import train

    rows = [(i, " ".join([EN[i % 3]] * 2), "en", 1.0, "x") for i in range(60)] + [(100 + i, DE[i], "de", 2.0, "y") for i in range(3)] + [(None, None, "fr", 0.0, ""), (200, "1 2", "zz", 0.0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, Rejected string").repartition(3)
    model = train(df, F.lit(True), sample=5)
    assert set(model.langs) == {"en", "de"}
    out = predict(df, model)
    assert out.columns == [*df.columns, "lang_pred", "score_", "rejected_"]
    got = out.collect()
    assert all(r.lang_pred == (r.lang if r.lang in ("en", "de") else "und") and r.Rejected in "xy" for r in got)
    assert train(df.limit(0), F.lit(True)).langs == []


def test_against_a_plain_scorer(spark):
    """Counts and cosines gram by gram, in plain Python, give the same languages and scores."""
    import math
    import re

    import numpy as np
    from lacuna.llm.language_id import DIMS

    texts = EN + DE
    model = fit(texts, ["en"] * 3 + ["de"] * 3, clusters=1)

    def vector(t):
        data = (" " + re.sub(r"[\W\d_]+", " ", t).lower() + " ").encode()
        c = [0] * DIMS
        for n in range(1, 5):
            for i in range(len(data) - n + 1):
                g = data[i]
                for x in data[i + 1 : i + n]:
                    g = g * 0x01000193 % 2**32 ^ x
                c[(g * 0x9E3779B1 + n * 0x85EBCA6B) % 2**32 >> 19] += 1
        return c

    many = [vector(t) for t in texts]
    idf = [math.log((1 + len(many)) / (1 + sum(v[k] > 0 for v in many))) + 1 for k in range(DIMS)]

    def unit(v):
        w = [math.log1p(x) * f for x, f in zip(v, idf)]
        z = math.sqrt(sum(x * x for x in w))
        return [x / z for x in w]

    def centre(rows):
        m = [sum(x) / len(rows) for x in zip(*rows)]
        z = math.sqrt(sum(x * x for x in m))
        return [x / z for x in m]

    units = [unit(v) for v in many]
    centres = {"en": centre(units[:3]), "de": centre(units[3:])}
    probes = ["the dog of the street", "der hund der straße", "when they are there"]
    for t, (lang, score, _) in zip(probes, model.predict(probes)):
        cos = {g: sum(a * b for a, b in zip(unit(vector(t)), c)) for g, c in centres.items()}
        assert lang == max(cos, key=cos.get) and np.isclose(score, cos[lang], atol=1e-4)
