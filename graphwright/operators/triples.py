"""Triple tables: ``(s, p, o, o_kind, lang)`` with set semantics.

``o_kind`` is ``iri`` or ``lit``; ``lang`` is the literal's language tag or
``''``.  Builders emit a fixed small array of triples per input row with
``inline`` (narrow) and finish with one ``distinct`` (the only shuffle,
map-side combined).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions.text import ntriples_literal
from .relations import complete_atoms

TRIPLE_COLS = ["s", "p", "o", "o_kind", "lang"]


def triple(s: Column, p: Column, o: Column, kind: str, lang: Column | None = None) -> Column:
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"),
                    (lang if lang is not None else F.lit("")).alias("lang"))


def _underscore(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def kg_plain(atoms_df: DataFrame, distinct: bool = True) -> DataFrame:
    """``ex:c1 rel:relationship ex:c2`` and ``ex:c1 rel:hasImportance "i"``."""
    a = complete_atoms(atoms_df, ("concept1", "concept2", "relationship", "importance"))
    out = a.select(F.inline(_plain_triples()))
    return out.distinct() if distinct else out


def _plain_triples() -> Column:
    c1 = F.concat(F.lit(C.NS_PLAIN_CONCEPT), _underscore(F.col("concept1")))
    c2 = F.concat(F.lit(C.NS_PLAIN_CONCEPT), _underscore(F.col("concept2")))
    rel = F.concat(F.lit(C.NS_PLAIN_RELATION), _underscore(F.col("relationship")))
    imp = F.lit(C.NS_PLAIN_RELATION + "hasImportance")
    return F.array(triple(c1, rel, c2, "iri"), triple(c1, imp, F.col("importance"), "lit"))


def skos_predicate(rel: Column, strict_case: bool = True) -> Column:
    """SKOS predicate chosen from the lower-cased relationship.

    ``strict_case=True`` keeps the observed behaviour: the tests for
    closeMatch/topConceptOf/inScheme/partOf compare a mixed-case needle with
    lower-cased text and never fire.  ``False`` maps them as intended.
    """
    low = F.lower(rel)
    pred = (F.when(low.contains("relat"), F.lit(C.SKOS + "related"))
            .when(low.contains("narrower"), F.lit(C.SKOS + "narrower"))
            .when(low.contains("broader"), F.lit(C.SKOS + "broader")))
    if not strict_case:
        pred = (pred.when(low.contains("closematch"), F.lit(C.SKOS + "closeMatch"))
                .when(low.contains("topconceptof"), F.lit(C.SKOS + "topConceptOf"))
                .when(low.contains("inscheme"), F.lit(C.SKOS + "inScheme"))
                .when(low.contains("partof"), F.lit(C.SKOS + "topConceptOf")))
    return pred


def kg_skos(atoms_df: DataFrame, strict_case: bool = True, distinct: bool = True) -> DataFrame:
    """SKOS graph on md5 concept ids (importance is not emitted).
    ``distinct=False`` leaves the set step to a later union."""
    a = complete_atoms(atoms_df, ("concept1", "concept2", "relationship", "importance"))
    out = a.select(F.inline(_skos_triples(strict_case)))
    return out.distinct() if distinct else out


def _skos_triples(strict_case: bool) -> Column:
    q1 = F.concat(F.lit(C.NS_ID), F.md5("concept1"))
    q2 = F.concat(F.lit(C.NS_ID), F.md5("concept2"))
    pred = skos_predicate(F.col("relationship"), strict_case)
    fallback = F.concat(F.lit(C.NS_SKOS_FALLBACK), _underscore(F.col("relationship")))
    return (F.when(pred.isNotNull(),
                   F.array(triple(q1, pred, F.col("concept2"), "lit"), triple(q1, pred, q2, "iri")))
            .otherwise(F.array(triple(q1, fallback, F.col("concept2"), "lit"))))


def kg_both(atoms_df: DataFrame, strict_case: bool = True) -> DataFrame:
    """The union of the SKOS and the plain graph; the replies are parsed once."""
    a = complete_atoms(atoms_df, ("concept1", "concept2", "relationship", "importance"))
    return a.select(F.inline(F.concat(_skos_triples(strict_case), _plain_triples()))).distinct()


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple (N-Triples is valid Turtle)."""
    obj = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), F.col("o"), F.lit(">"))) \
        .otherwise(ntriples_literal(F.col("o"), F.col("lang")))
    line = F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), obj,
                    F.lit(" ."))
    return triples.select(line.alias("line"))


def write_ntriples(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    ntriples_lines(triples).write.mode(mode).text(path)


def graph_union(*graphs: DataFrame) -> DataFrame:
    """Set union of triple tables (adding a graph twice changes nothing)."""
    return reduce(lambda a, b: a.unionByName(b), [g.select(*TRIPLE_COLS) for g in graphs]) \
        .distinct()


def as_triples(spo: DataFrame) -> DataFrame:
    """``(s, p, o)`` rows to the triple layout: IRIs recognised by scheme."""
    kind = F.when(F.col("o").rlike("^(https?|urn):"), F.lit("iri")).otherwise(F.lit("lit"))
    lang = F.col("lang") if "lang" in spo.columns else F.lit("")
    return spo.select("s", "p", "o", kind.alias("o_kind"), F.coalesce(lang, F.lit("")).alias("lang"))


def seed_graph(seed: DataFrame, *new: DataFrame) -> DataFrame:
    """Start from an existing graph instead of an empty one."""
    return graph_union(seed, *new)
