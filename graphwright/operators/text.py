"""Text operators: payloads, sentences, gate, paragraphs, md5 ids, language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.constants import MIN_SENTENCE_SIZE
from ..functions.text import sentence_array, squeeze_sentence_breaks


def payload_fields(payloads: DataFrame, id_col: str = "payload_id",
                   json_col: str = "payload") -> DataFrame:
    """JSON object -> ``(pos, key, value)`` in field order."""
    m = F.from_json(F.col(json_col), "map<string,string>")
    return payloads.select(id_col, F.posexplode_outer(m).alias("pos", "key", "value")) \
        .where(F.col("pos").isNotNull()) \
        .withColumn("pos", F.col("pos").cast("bigint"))


def payload_text(payloads: DataFrame, id_col: str = "payload_id",
                 json_col: str = "payload") -> DataFrame:
    """Field values joined as ``". v1. v2 ..."`` (starts with ``". "``)."""
    m = F.from_json(F.col(json_col), "map<string,string>")
    text = F.concat(F.lit(". "), F.array_join(F.map_values(m), ". ", "None"))
    return payloads.select(id_col, text.alias("text"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentence table ``(doc_id, uid, sentence, n_chars)``, ``uid`` 0-based."""
    return (docs.select(id_col, F.posexplode_outer(sentence_array(F.col(text_col)))
                        .alias("uid", "sentence"))
            .where(F.col("sentence") != "")
            .select(id_col, F.col("uid").cast("bigint").alias("uid"), "sentence",
                    F.length("sentence").cast("bigint").alias("n_chars")))


def sentence_gate(sents: DataFrame, min_size: int = MIN_SENTENCE_SIZE) -> DataFrame:
    """Every sentence stays; ``has_data`` only when longer than ``min_size``."""
    return sents.withColumn("has_data", F.length("sentence") > min_size)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs split at blank lines; sentences inside joined by one space."""
    parts = F.split(F.col(text_col), r"\n[ \t]*\n")
    return (docs.select(id_col, F.posexplode_outer(parts).alias("para_ix", "p"))
            .select(id_col, F.col("para_ix").cast("bigint").alias("para_ix"),
                    squeeze_sentence_breaks(F.col("p")).alias("paragraph"))
            .where(F.col("paragraph") != ""))


def md5_ids(sents: DataFrame) -> DataFrame:
    return sents.select("doc_id", "uid", F.md5("sentence").alias("md5"))


# --- language of a text -----------------------------------------------------
# Naive Bayes over hashed character trigrams.  The model is a table of LANG_BUCKETS whole
# numbers for each language: counted by one partial aggregate with as many groups, and
# applied to a text in one projection without a shuffle.  Characters are counted and looked up
# as arrays (Arrow batches); lambdas over the characters of a text took ten times as long.

LANG_BUCKETS = 16381  # a prime, so that all bits of the three code points count
_TRIGRAM = 31337
LETTERS = r"[^\p{L}]+"
_CHARACTERS = 1 << 20  # that a task holds at a time, one text at least


def _plain(text: Column) -> Column:
    """The lower-cased text; what is no letter is one space, at both ends too."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), LETTERS, " ")), F.lit(" "))


def _trigrams():
    """A function of an Arrow array of plain texts: (first text, bounds, buckets) of runs of them."""
    root, size, most = _TRIGRAM, LANG_BUCKETS, _CHARACTERS

    def runs(texts):
        import numpy as np

        texts = [t or "" for t in texts.to_pylist()]
        lengths = np.array([len(t) for t in texts], np.int64)
        start = 0
        while start < len(texts):
            stop = start + max(1, int(np.searchsorted(np.cumsum(lengths[start:]), most, side="right")))
            points = np.frombuffer("".join(texts[start:stop]).encode("utf-32-le"), "<u4").astype(np.int64)
            ends = np.cumsum(lengths[start:stop])
            three = ((points[:-2] * root + points[1:-1]) * root + points[2:]) % size if len(points) > 2 else points[:0]
            inside = np.ones(len(three), bool)
            for back in (1, 2):  # those that reach into the next text
                at = ends - back
                inside[at[(at >= 0) & (at < len(three))]] = False
            bounds = np.r_[0, np.cumsum(np.maximum(lengths[start:stop] - 2, 0))]
            yield start, bounds, three[inside]
            start = stop

    return runs


def lang_profile(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, bucket, n)`` counts over whole texts; at most ``LANG_BUCKETS`` rows for a language."""
    runs, size = _trigrams(), LANG_BUCKETS

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            langs = b.column(0).to_pylist()
            total = {l: np.zeros(size, np.int64) for l in set(langs)}
            for start, bounds, buckets in runs(b.column(1)):
                for i in range(len(bounds) - 1):
                    total[langs[start + i]] += np.bincount(buckets[bounds[i]:bounds[i + 1]], minlength=size)
            for l, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = labelled.select(F.col(lang_col).alias("lang"), _plain(F.col(text_col)).alias("text")).where("lang IS NOT NULL")
    return rows.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def lang_model(profile: DataFrame) -> DataFrame:
    """One row: ``langs`` in order, the ``weights`` (bucket, weight) of the buckets that each has, and
    the weight of the ``others``; a weight is 1000 times the logarithm of a bucket's share
    (add-one), rounded down.  Languages are a small set of labels, so the row has a bounded
    size: ``LANG_BUCKETS`` pairs for each."""
    total = profile.groupBy("lang").agg(F.sum("n").alias("total"), F.collect_list(F.struct("bucket", "n")).alias("seen"))
    weight = lambda n: F.floor(1000 * F.log((n + 1) / (F.col("total") + LANG_BUCKETS))).cast("int")
    row = total.select("lang", F.transform("seen", lambda x: F.struct(x["bucket"].alias("bucket"), weight(x["n"]).alias("weight"))).alias("weights"),
                       weight(F.lit(0)).alias("other"))
    both = F.array_sort(F.collect_list(F.struct("lang", "weights", "other")))
    return row.agg(both.alias("m")).select(F.col("m.lang").alias("langs"), F.col("m.weights").alias("weights"), F.col("m.other").alias("others"))


def lang_detect(docs: DataFrame, model: DataFrame, text_col: str = "text", name: str = "lang_detected") -> DataFrame:
    """The documents with the most likely language ``name`` of a text under a model (one
    row of bounded size), the first by name of equal ones; null for a text without
    letters."""
    langs, weights, others = model.first()
    runs, size = _trigrams(), LANG_BUCKETS
    weights = [([x.bucket for x in w], [x.weight for x in w]) for w in weights]

    @F.arrow_udf("string")
    def detect(texts):
        import numpy as np
        import pyarrow as pa

        table, out = np.repeat(np.array(others, np.int64)[:, None], size, axis=1), []
        for row, (at, value) in zip(table, weights):
            row[at] = value
        for _, bounds, buckets in runs(texts):
            sums = np.concatenate([np.zeros((len(table), 1), np.int64), np.cumsum(table[:, buckets], axis=1)], axis=1)
            best = np.argmax(sums[:, bounds[1:]] - sums[:, bounds[:-1]], axis=0)
            some = bounds[1:] > bounds[:-1]
            out += [langs[k] if s else None for k, s in zip(best.tolist(), some.tolist())]
        return pa.array(out, pa.string())

    if not langs:
        return docs.withColumn(name, F.lit(None).cast("string"))
    return docs.withColumn(name, detect(_plain(F.col(text_col))))
