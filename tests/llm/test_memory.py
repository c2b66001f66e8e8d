"""What Python workers hold, during and after a task."""

import re

from lacuna.llm.common import lean, small_batches
from lacuna.llm.language_id import predict, train
from pyspark.sql import functions as F


def held():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024


def test_a_task_gives_back_what_it_freed():
    import numpy as np

    def run(batches):
        for n in batches:
            pinned = []
            own = []
            for k in range(n):  # small pieces stay between the large ones, so that the heap's end is never free
                own.append(np.ones(8_000, np.uint8))
                if k % 50 == 0:
                    pinned.append(np.ones(2_000, np.uint8))
            kept.append(pinned)
            yield sum(map(len, own))

    kept, before = [], held()
    assert list(run(iter([10_000]))) == [80_000_000]
    plain = held() - before
    kept.clear()
    assert list(lean(run)(iter([10_000]))) == [80_000_000]
    assert held() - before < 30 < 60 < plain


def test_texts_go_to_python_in_small_batches(spark):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("en").alias("lang"))
    predict(docs, train(docs, F.lit(True))).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "700"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
