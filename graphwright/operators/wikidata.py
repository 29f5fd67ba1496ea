"""Knowledge-base shaped queries over a triple table ``(s, p, o, lang)``.

* label service: label in a preferred language, else ``en``, else the id;
* property path ``P31/P279*`` (instance of, then zero or more subclass steps):
  by labels of the *class* graph (``hierarchy``), which instances join once;
* star pattern (type, population, coordinates, label), top-k by population;
* describe an entity batch, reverse look-up by external-id IRI, persons by a
  literal id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.joins import skew_join
from ..functions.lineage import checkpoint, written
from . import hierarchy

INSTANCE_OF = "wdt:P31"
SUBCLASS_OF = "wdt:P279"
POPULATION = "wdt:P1082"
COORDINATES = "wdt:P625"
LABEL = "rdfs:label"


def labels(triples: DataFrame, languages=("en",)) -> DataFrame:
    """``(entity, label)``: the label in the first available language.

    Ranked with ``min(struct(rank, label))`` per entity, a partial aggregate."""
    lang = F.coalesce(F.col("lang"), F.lit(""))
    rank = None
    for i, l in enumerate(languages):
        rank = F.when(lang == l, F.lit(i)) if rank is None else rank.when(lang == l, F.lit(i))
    lab = triples.where((F.col("p") == LABEL) & lang.isin(*languages)) \
        .select(F.col("s").alias("entity"), rank.alias("rank"), F.col("o").alias("label"))
    return lab.groupBy("entity").agg(F.min(F.struct("rank", "label"))["label"].alias("label"))


def with_label(df: DataFrame, id_col: str, lab: DataFrame, out_col: str,
               hot_keys: bool = True) -> DataFrame:
    """Left join a label table; fall back to the id itself.

    ``hot_keys``: the id column may repeat a lot (a property id sits on a
    large share of statements), so the join is salted; ``False`` when every id
    occurs a bounded number of times (distinct members or subjects)."""
    lab = lab.withColumnRenamed("entity", id_col).withColumnRenamed("label", "_lab")
    j = skew_join(df, lab, id_col, "left") if hot_keys else df.join(lab, id_col, "left")
    return j.withColumn(out_col, F.coalesce(F.col("_lab"), F.col(id_col))).drop("_lab")


def labels_for(triples: DataFrame, ids: DataFrame, languages=("en",)) -> DataFrame:
    """Labels of the given ids only: the label triples are first reduced to
    those ids (a semi join; a small id set is broadcast by AQE), so describing
    a batch does not aggregate the labels of the whole store."""
    needed = ids.select(F.col(ids.columns[0]).alias("s")).distinct()
    return labels(triples.join(needed, "s", "left_semi"), languages)


def class_edges(triples: DataFrame, subclass_p: str = SUBCLASS_OF) -> DataFrame:
    return triples.where(F.col("p") == subclass_p).select(F.col("s").alias("cls"), F.col("o").alias("anc"))


def class_closure(triples: DataFrame, subclass_p: str = SUBCLASS_OF) -> DataFrame:
    """``(cls, anc)`` for one or more subclass steps (cycles are safe), written once."""
    return written(hierarchy.build(class_edges(triples, subclass_p)).closure(), "closure")


def class_members(triples: DataFrame, closure: DataFrame | None = None,
                  instance_p: str = INSTANCE_OF) -> DataFrame:
    """``(item, class_id)`` for ``item P31/P279* class_id``."""
    if closure is None:
        closure = class_closure(triples)
    inst = triples.where(F.col("p") == instance_p).select(F.col("s").alias("item"),
                                                          F.col("o").alias("cls"))
    # one class may hold a large share of the instances
    up = skew_join(inst, closure, "cls").select("item", F.col("anc").alias("class_id"))
    return inst.select("item", F.col("cls").alias("class_id")).unionByName(up).distinct()


def subclasses_of(triples: DataFrame, target: str, subclass_p: str = SUBCLASS_OF) -> DataFrame:
    """``cls``: the target and every class below it, by labels of the class graph."""
    start = triples.sparkSession.range(1).select(F.lit(target).alias("cls"))
    return hierarchy.build(class_edges(triples, subclass_p)).below(start)


def class_members_top(triples: DataFrame, target: str = "wd:Q515", location: str | None = None,
                      k: int = 100) -> DataFrame:
    """Members of a class with population, coordinates and English label;
    DISTINCT rows, top ``k`` by population (ties: label, coordinates)."""
    inst = triples.where(F.col("p") == INSTANCE_OF).select(F.col("s").alias("item"), F.col("o").alias("cls"))
    members = inst.join(subclasses_of(triples, target), "cls", "left_semi").select("item").distinct()
    pop = triples.where(F.col("p") == POPULATION).select(F.col("s").alias("item"),
                                                         F.col("o").alias("population_raw"))
    gps = triples.where(F.col("p") == COORDINATES).select(F.col("s").alias("item"),
                                                          F.col("o").alias("gps"))
    star = members.join(pop, "item").join(gps, "item")
    if location is not None:  # exact English label filter
        named = triples.where((F.col("p") == LABEL) & (F.col("o") == location)
                              & (F.col("lang") == "en")).select(F.col("s").alias("item"))
        star = star.join(named, "item", "left_semi")
    # written once: the star is read for its ids and for its rows
    star = checkpoint(star)
    # items are distinct members with a few population/coordinate values each
    star = with_label(star, "item", labels_for(triples, star.select("item"), ("en",)), "city_label",
                      hot_keys=False)
    rows = star.select("city_label", F.col("population_raw").try_cast("bigint").alias("population"),
                       "gps").distinct()
    return rows.orderBy(F.col("population").desc_nulls_last(), "city_label", "gps").limit(k)


def entity_describe(triples: DataFrame, ids: DataFrame, languages=("en",)) -> DataFrame:
    """All ``(property, value)`` of a batch of entities, with labels and the
    value's language ('' when absent)."""
    t = triples.join(ids.select(F.col("entity").alias("s")), "s", "left_semi")
    rows = t.select(F.col("s").alias("entity"), F.col("p").alias("property"),
                    F.col("o").alias("value"), F.coalesce("lang", F.lit("")).alias("lang"))
    wanted = rows.select(F.col("property").alias("id")).unionByName(rows.select(F.col("value").alias("id")))
    lab = labels_for(triples, wanted, languages)
    rows = with_label(rows, "property", lab, "property_label")
    return with_label(rows, "value", lab, "value_label")


def property_values(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """``(property, value, lang)`` of a batch of entities ('' when a value has no
    language); no labels are looked up."""
    t = triples.join(ids.select(F.col("entity").alias("s")), "s", "left_semi")
    return t.select(F.col("p").alias("property"), F.col("o").alias("value"), F.coalesce("lang", F.lit("")).alias("lang"))


def external_id_reverse(triples: DataFrame, id_property: str = "wdtn:P214") -> DataFrame:
    """For every value of ``id_property``: the entities holding it and every
    property by which they point to that value (join on ``(s, o)``)."""
    holders = triples.where(F.col("p") == id_property).select(
        F.col("s").alias("entity"), F.col("o").alias("value")).distinct()
    all_edges = triples.select(F.col("s").alias("entity"), F.col("o").alias("value"),
                               F.col("p").alias("property"))
    rows = holders.join(all_edges, ["entity", "value"])
    return with_label(rows, "property", labels_for(triples, rows.select("property")), "property_label")


def external_id_describe(triples: DataFrame, id_property: str = "wdt:P214") -> DataFrame:
    """Persons identified by a literal id and all their statements."""
    persons = triples.where(F.col("p") == id_property).select(F.col("s").alias("person"),
                                                              F.col("o").alias("person_id"))
    st = persons.join(triples.select(F.col("s").alias("person"), F.col("p").alias("property"),
                                     F.col("o").alias("value")), "person")
    wanted = st.select(F.col("person").alias("id")).unionByName(st.select(F.col("property").alias("id")))
    lab = labels_for(triples, wanted)
    st = with_label(st, "person", lab, "person_label")
    return with_label(st, "property", lab, "property_label")


def label_fallback(triples: DataFrame, languages=("de", "en")) -> DataFrame:
    """Every subject with its label in the preferred languages, else its id."""
    ents = triples.select(F.col("s").alias("entity")).distinct()
    return with_label(ents, "entity", labels(triples, languages), "label", hot_keys=False)
