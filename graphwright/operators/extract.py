"""The extractor step: sentences -> replies by a function of the user's.

``extractor`` is a function without arguments that returns the one that answers a list of
sentences with as many replies; it is called once in a Python worker, so a model is loaded
once for all tasks that the worker runs.  Each different sentence that passes the length gate and that no
earlier run has answered is asked once, in batches.  If a batch fails, its sentences are asked one by
one; a sentence that fails alone goes to the quarantine with its error and is asked again
by the next run.  Replies and errors are written, a folder for each run, before they are joined
with the sentences, so a second run over the same sentences asks nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.constants import MIN_SENTENCE_SIZE
from ..functions.joins import skew_join
from ..session import exists

REPLIES = "md5 string, sentence string, response string, error string"
Answer = Callable[[list[str]], list[str]]


def _asker(extractor: Callable[[], Answer], batch_size: int):
    token = uuid.uuid4().hex

    def ask(batches):
        import pandas as pd
        import pyspark

        # kept in the worker process, which runs many tasks
        made = pyspark.__dict__.setdefault("_extractors", {})
        for frame in batches:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size]
                sentences = part["sentence"].tolist()
                if token not in made:
                    made[token] = extractor()

                def one(xs):
                    replies = list(made[token](xs))
                    if len(replies) != len(xs):
                        raise ValueError(f"{len(replies)} replies to {len(xs)} sentences")
                    return replies

                try:
                    answers = [(r, None) for r in one(sentences)]
                except Exception:  # noqa: BLE001 - the sentence that fails is found below
                    answers = []
                    for x in sentences:
                        try:
                            answers.append((one([x])[0], None))
                        except Exception as e:  # noqa: BLE001 - told in the quarantine
                            answers.append((None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame({"md5": part["md5"].to_numpy(), "sentence": sentences, "response": [a for a, _ in answers],
                                    "error": [e for _, e in answers]}, dtype=object)

    return ask


def answered(spark: SparkSession, store: str) -> DataFrame:
    """All replies and errors of the runs so far."""
    if not exists(spark, store):
        return spark.createDataFrame([], REPLIES)
    return spark.read.schema(REPLIES).parquet(f"{store}/run=*")


def extract(sentences: DataFrame, extractor: Callable[[], Answer], store: str, batch_size: int = 32,
            min_size: int = MIN_SENTENCE_SIZE) -> DataFrame:
    """``sentences`` with ``response`` and ``error``; both are null for a sentence that does
    not pass the gate (strictly longer than ``min_size``).  ``store``: folder of the replies."""
    spark = sentences.sparkSession
    keyed = sentences.withColumn("md5", F.when(F.length("sentence") > min_size, F.md5("sentence")))
    work = keyed.where("md5 IS NOT NULL").groupBy("md5").agg(F.first("sentence").alias("sentence"))
    known = answered(spark, store).where("error IS NULL").select("md5").distinct()
    asked = work.join(known, "md5", "left_anti").mapInPandas(_asker(extractor, batch_size), REPLIES)
    asked.write.parquet(f"{store}/run={uuid.uuid4().hex}")
    # an answer of any run, else the error of the last ones
    best = answered(spark, store).groupBy("md5").agg(
        F.max("response").alias("response"), F.when(F.max("response").isNull(), F.max("error")).alias("error"))
    return skew_join(keyed, best, "md5", "left").drop("md5")


def quarantine(spark: SparkSession, store: str) -> DataFrame:
    """``md5, sentence, error`` of the sentences without a reply."""
    rows = answered(spark, store)
    return (rows.groupBy("md5").agg(F.first("sentence").alias("sentence"), F.max("response").alias("response"), F.max("error").alias("error"))
            .where("response IS NULL").drop("response"))
