"""The extractor step: asked once, set up once in a worker, failures kept apart."""

import os
import tempfile

from pyspark.sql import functions as F

from graphwright.operators import extract as E, relations as R
from graphwright.session import scratch_path

ROWS = [(1, 0, "A sentence that is long enough."), (1, 1, "short"), (2, 0, "A sentence that is long enough."), (2, 1, None),
        (3, 0, "This one makes the model fail."), (3, 1, "Another sentence, as long as others."), (4, 0, "")]


def extractor(folder, fail="fail"):
    def make():
        with open(f"{folder}/setups", "a") as f:
            f.write(f"{os.getpid()}\n")

        def answer(sentences):
            with open(f"{folder}/asked", "a") as f:
                f.write("".join(f"{s}\n" for s in sentences))
            if any(fail in s for s in sentences):
                raise RuntimeError("no answer")
            return [f'{{\n"concept1": "{len(s)}"\n}}' for s in sentences]
        return answer
    return make


def lines(folder, name):
    path = f"{folder}/{name}"
    return open(path).read().splitlines() if os.path.exists(path) else []


def test_sentences_are_asked_once_and_failures_do_not_end_the_job(spark):
    folder, store = tempfile.mkdtemp(prefix="gw-extract-"), scratch_path(spark, "replies")
    df = spark.createDataFrame(ROWS, "doc_id long, uid long, sentence string").repartition(5)
    got = {(r.doc_id, r.uid): (r.response, r.error) for r in E.extract(df, extractor(folder), store, batch_size=10).collect()}
    assert len(got) == len(ROWS) and got[1, 1] == got[2, 1] == got[4, 0] == (None, None)
    assert got[1, 0] == got[2, 0] == ('{\n"concept1": "31"\n}', None) and got[3, 0] == (None, "RuntimeError: no answer")
    assert got[3, 1][1] is None
    setups = lines(folder, "setups")
    assert len(setups) == len(set(setups))  # one in each worker
    asked = lines(folder, "asked")
    assert asked.count(ROWS[0][2]) <= 2  # again only if its batch failed
    assert [(r.sentence, r.error) for r in E.quarantine(spark, store).collect()] == [(ROWS[4][2], "RuntimeError: no answer")]
    # a second run asks nothing but what failed, now with an answer
    again = tempfile.mkdtemp(prefix="gw-extract-")
    got = {(r.doc_id, r.uid): r.response for r in E.extract(df, extractor(again, "never"), store).collect()}
    assert lines(again, "asked") == [ROWS[4][2]] and got[3, 0] is not None
    third = tempfile.mkdtemp(prefix="gw-extract-")
    E.extract(df, extractor(third), store).collect()
    assert not lines(third, "asked") and not lines(third, "setups") and E.quarantine(spark, store).count() == 0


def test_replies_go_on_to_atoms_and_empty_tables_give_none(spark):
    folder = tempfile.mkdtemp(prefix="gw-extract-")
    df = spark.createDataFrame(ROWS, "doc_id long, uid long, sentence string")
    out = E.extract(df, extractor(folder), scratch_path(spark, "replies"))
    assert sorted(r.concept1 for r in R.atoms(out.where(F.col("response").isNotNull())).collect()) == ["31", "31", "36"]
    assert E.extract(df.limit(0), extractor(folder), scratch_path(spark, "replies")).count() == 0


def test_a_wrong_number_of_replies_is_an_error(spark):
    df = spark.createDataFrame(ROWS[:1], "doc_id long, uid long, sentence string")
    out = E.extract(df, lambda: lambda xs: [], scratch_path(spark, "replies")).first()
    assert out.response is None and out.error == "ValueError: 0 replies to 1 sentences"
