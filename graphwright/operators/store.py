"""Triple store: terms as ids, triples by predicate and subject, labels by id.

``build`` writes four tables once, under the shared folder:

* ``triples``: ``s, p, o, lang`` with ids for subject and object, a folder for each
  predicate, bucketed and sorted by subject; a pattern with a constant predicate reads its folder
  alone, and patterns on one subject join bucket by bucket, without a shuffle;
* ``terms``: ``id, term``, bucketed by id;
* ``labels``: ``id, lang, label`` of the label predicate, bucketed by id;
* ``clashes``: ``term, id`` of terms whose hash another term has.

A term's id is its 64-bit hash, so terms are coded in a projection.  Terms that share a hash
are found when the store is built; all but the first of them get another id, which is looked up
(in the order of n**2 / 2**65 of n terms: none in most stores).

All tables have the same number of buckets, so names of subjects are read without a shuffle;
names of other ids are read once for the distinct ids of a result.  The store is never shuffled
or broadcast: only ids that a query asks for go to it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.joins import skew_join
from ..functions.lineage import written
from ..session import scratch_path
from . import hierarchy, wikidata as W

ROWS_PER_BUCKET = 5_000_000


def term_hash(term: Column) -> Column:
    return F.xxhash64(term)


@dataclass
class TripleStore:
    spark: SparkSession
    triples: DataFrame
    terms: DataFrame
    labels: DataFrame
    clashes: DataFrame | None
    buckets: int
    tables: tuple[str, ...]
    _classes: hierarchy.Hierarchy | None = None

    def drop(self) -> None:
        """Forget the tables (their files belong to the shared folder)."""
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")

    # -- terms and names --------------------------------------------------------

    def coded(self, df: DataFrame, term: str, out: str) -> DataFrame:
        """Adds the id of a term (null for null)."""
        return _coded(df, term, out, self.clashes)

    def slice(self, predicate: str, s: str = "s", o: str = "o") -> DataFrame:
        """Subjects and objects of one predicate."""
        return self.triples.where(F.col("p") == predicate).select(F.col("s").alias(s), F.col("o").alias(o))

    def names(self, languages=("en",)) -> DataFrame:
        """``id, term, label``: the label in the first available language, else the term."""
        rank = F.coalesce(*(F.when(F.col("lang") == l, F.lit(i)) for i, l in enumerate(languages)))
        best = (self.labels.where(F.col("lang").isin(*languages)).groupBy("id")
                .agg(F.min(F.struct(rank.alias("rank"), "label"))["label"].alias("label")))
        return self.terms.join(best, "id", "left").select("id", "term", F.coalesce("label", "term").alias("label"))

    def names_of(self, ids: DataFrame, languages=("en",)) -> DataFrame:
        """Names of the ids in the columns of ``ids``, read once."""
        wanted = ids.select(F.explode(F.array(*ids.columns)).alias("id")).distinct()
        return self.names(languages).join(wanted, "id", "left_semi")

    # -- queries ------------------------------------------------------------------

    def statements(self, entities: DataFrame) -> DataFrame:
        """``entity, p, o, lang`` of the statements of a batch of entities (distinct ids)."""
        wanted = self.coded(entities.select("entity").distinct(), "entity", "s")
        return self.triples.join(wanted, "s").select("entity", "p", "o", F.coalesce("lang", F.lit("")).alias("lang"))

    def describe(self, entities: DataFrame, languages=("en",)) -> DataFrame:
        """All ``(property, value)`` of a batch of entities, with labels and the value's
        language ('' when absent)."""
        rows = self.coded(self.statements(entities), "p", "pid")
        named = written(self.names_of(rows.select("o", "pid"), languages), "names")
        values = skew_join(rows, named.select(F.col("id").alias("o"), F.col("term").alias("value"), F.col("label").alias("value_label")),
                           "o", "left")
        # as many rows as predicates in the result
        out = skew_join(values, named.select(F.col("id").alias("pid"), F.col("label").alias("property_label")), "pid", "left", counted=rows)
        return out.select("entity", F.col("p").alias("property"), "value", "lang",
                          F.coalesce("property_label", "p").alias("property_label"), "value_label")

    def property_values(self, entities: DataFrame) -> DataFrame:
        """``(property, value, lang)`` of a batch of entities; no labels are looked up."""
        rows = self.statements(entities)
        wanted = rows.select(F.col("o").alias("id")).distinct()
        values = self.terms.join(wanted, "id", "left_semi").select(F.col("id").alias("o"), F.col("term").alias("value"))
        return skew_join(rows, values, "o", "left").select(F.col("p").alias("property"), "value", "lang")

    def external_id_reverse(self, id_property: str = "wdtn:P214", languages=("en",)) -> DataFrame:
        """For every value of ``id_property``: the entities that hold it and every property by
        which they point to it.  One pass over the buckets: statements of a subject
        that share a value meet in a group of their own."""
        held = (self.triples.where("o IS NOT NULL").groupBy("s", "o").agg(F.collect_list("p").alias("ps"))
                .where(F.array_contains("ps", id_property)))
        rows = self.coded(held.select("s", "o", F.explode("ps").alias("p")), "p", "pid")
        rows = self.with_terms(self.with_terms(rows, "s", "entity"), "o", "value")
        names = self.names_of(rows.select("pid"), languages).select(F.col("id").alias("pid"), F.col("label").alias("property_label"))
        return skew_join(rows, names, "pid", "left").select(
            "entity", "value", F.col("p").alias("property"), F.coalesce("property_label", "p").alias("property_label"))

    def with_terms(self, rows: DataFrame, id_col: str, out: str) -> DataFrame:
        """Adds the term of an id that occurs a bounded number of times."""
        return rows.join(self.terms.select(F.col("id").alias(id_col), F.col("term").alias(out)), id_col, "left")

    def external_id_describe(self, id_property: str = "wdt:P214", languages=("en",)) -> DataFrame:
        """Persons with a literal id and all their statements."""
        rows = self.slice(id_property, o="id_term").join(self.triples.select("s", "p", "o"), "s")
        rows = self.coded(rows, "p", "pid")
        # subjects are named bucket by bucket
        names = self.names(languages).select(F.col("id").alias("s"), F.col("term").alias("person"), F.col("label").alias("person_label"))
        rows = rows.join(names, "s")
        named = written(self.names_of(rows.select("id_term", "o", "pid"), languages), "names")
        part = lambda key, **cols: named.select(F.col("id").alias(key), *(F.col(c).alias(n) for n, c in cols.items()))
        out = rows.join(part("id_term", person_id="term"), "id_term", "left")
        out = skew_join(out, part("o", value="term"), "o", "left", counted=self.triples)
        out = skew_join(out, part("pid", property_label="label"), "pid", "left", counted=rows)
        return out.select("person", "person_id", F.col("p").alias("property"), "value", "person_label",
                          F.coalesce("property_label", "p").alias("property_label"))

    def label_fallback(self, languages=("de", "en")) -> DataFrame:
        """Every subject with its label in the preferred languages, else its id."""
        subjects = self.triples.groupBy(F.col("s").alias("id")).agg(F.count(F.lit(1)).alias("n")).drop("n")
        return subjects.join(self.names(languages), "id").select(F.col("term").alias("entity"), "label")

    def class_members_top(self, target: str = "wd:Q515", location: str | None = None, k: int = 100) -> DataFrame:
        """Members of a class with population, coordinates and English label; DISTINCT rows,
        top ``k`` by population (ties: label, coordinates)."""
        star = self.slice(W.POPULATION, o="population").join(self.slice(W.COORDINATES, o="gps_id"), "s")
        members = self.slice(W.INSTANCE_OF, o="cls").join(star, "s")
        below = self.subclasses_of(target)
        members = members.join(below, "cls", "left_semi").select("s", "population", "gps_id").distinct()
        if location is not None:  # exact English label filter
            named = self.labels.where((F.col("label") == location) & (F.col("lang") == "en")).select(F.col("id").alias("s"))
            members = members.join(named, "s", "left_semi")
        names = self.names(("en",)).select(F.col("id").alias("s"), F.col("label").alias("city_label"))
        members = written(members.join(names, "s"), "members")
        wanted = members.select(F.explode(F.array("population", "gps_id")).alias("id")).distinct()
        terms = written(self.terms.join(wanted, "id", "left_semi"), "member-terms")
        term = lambda key, out: terms.select(F.col("id").alias(key), F.col("term").alias(out))
        rows = skew_join(skew_join(members, term("population", "n"), "population", "left"), term("gps_id", "gps"), "gps_id", "left", counted=members)
        rows = rows.select("city_label", F.col("n").try_cast("bigint").alias("population"), "gps").distinct()
        return rows.orderBy(F.col("population").desc_nulls_last(), "city_label", "gps").limit(k)

    def classes(self) -> hierarchy.Hierarchy:
        """Labels of the class graph, built when they are first asked for."""
        if self._classes is None:
            self._classes = hierarchy.build(self.slice(W.SUBCLASS_OF, "cls", "anc"))
        return self._classes

    def subclasses_of(self, target: str) -> DataFrame:
        """``cls``: ids of the target and every class below it."""
        return self.classes().below(self.coded(self.spark.range(1).select(F.lit(target).alias("t")), "t", "cls"))

    def class_members(self) -> DataFrame:
        """``(item, class_id)`` for ``item P31/P279* class_id``."""
        inst = self.slice(W.INSTANCE_OF, "item", "cls")
        up = skew_join(inst, self.classes().closure(), "cls").select("item", F.col("anc").alias("class_id"))
        pairs = inst.select("item", F.col("cls").alias("class_id")).unionByName(up).distinct()
        named = written(self.terms.join(pairs.select(F.col("class_id").alias("id")).distinct(), "id", "left_semi"), "class-names")
        names = lambda key: F.col("term").alias(key)
        out = skew_join(pairs, named.select(F.col("id").alias("class_id"), names("class_name")), "class_id", "left")
        return out.join(self.terms.select(F.col("id").alias("item"), names("item_name")), "item").select(
            F.col("item_name").alias("item"), F.col("class_name").alias("class_id"))


def _coded(df: DataFrame, term: str, out: str, clashes: DataFrame | None) -> DataFrame:
    own = F.when(F.col(term).isNotNull(), term_hash(F.col(term)))
    if clashes is None:
        return df.withColumn(out, own)
    # a handful of rows: terms that share their hash with another one
    other = clashes.select(F.col("term").alias(term), F.col("id").alias("_other"))
    return df.join(other, term, "left").withColumn(out, F.coalesce("_other", own)).drop("_other")


def _clashes(terms: DataFrame) -> DataFrame | None:
    """Ids of their own for all but the first (in order) of terms that share a hash."""
    spark = terms.sparkSession
    several = terms.groupBy("h").agg(F.min("term").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = written(terms.join(several, "h").where("term != first").select("term"), "clashes")
    if later.isEmpty():
        return None
    for k in count(1):
        tried = later.withColumn("id", F.xxhash64("term", F.lit(k)))
        taken = tried.join(terms, tried["id"] == terms["h"], "left_semi")
        if tried.groupBy("id").count().where("count > 1").isEmpty() and taken.isEmpty():
            return written(tried, "clash-ids")


def build(triples: DataFrame, label: str = W.LABEL, buckets: int | None = None) -> TripleStore:
    """Write ``s, p, o, lang`` as a store.  Triples without subject or predicate are left out;
    an object may be null.  ``buckets``: at least the session's number of shuffle partitions, so that
    Spark keeps the layout in joins."""
    spark = triples.sparkSession
    triples = written(triples.where("s IS NOT NULL AND p IS NOT NULL").select("s", "p", "o", "lang"), "triples")
    terms = triples.select(F.explode(F.array("s", "p", "o")).alias("term")).where("term IS NOT NULL").distinct()
    terms = written(terms.withColumn("h", term_hash(F.col("term"))), "terms")
    clashes = _clashes(terms)
    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-triples.count() // ROWS_PER_BUCKET))
    tag = uuid.uuid4().hex[:12]

    def save(df: DataFrame, name: str, key: str, *parts: str) -> DataFrame:
        table = f"store_{name}_{tag}"
        # dealt as the buckets are: a task writes one file for each folder
        df = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, f"store-{name}"))
        (df.partitionBy(*parts) if parts else df).saveAsTable(table)
        names.append(table)
        return spark.table(table)

    names: list[str] = []
    s = _coded(triples, "s", "sid", clashes)
    rows = save(_coded(s, "o", "oid", clashes).select(F.col("sid").alias("s"), F.col("oid").alias("o"), "lang", "p"), "triples", "s", "p")
    known = save(_coded(terms, "term", "id", clashes).select("id", "term"), "terms", "id")
    named = s.where((F.col("p") == label) & F.col("o").isNotNull())
    labels = save(named.select(F.col("sid").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("o").alias("label")), "labels", "id")
    return TripleStore(spark, rows, known, labels, clashes, buckets, tuple(names))
