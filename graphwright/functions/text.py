"""Column expressions shared by the text operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ASCII whitespace class written out, so Spark (Java regex) and RE2 agree.
WS = r"[ \t\n\r\f]"
SENTENCE_BREAK = r"([.!?])" + WS + "+"
SPLIT_MARK = "\u0001"


def sentence_array(text: Column) -> Column:
    """Sentences of a text: break after ``.``/``!``/``?`` followed by blanks."""
    marked = F.regexp_replace(F.trim(text), SENTENCE_BREAK, "$1" + SPLIT_MARK)
    return F.split(marked, SPLIT_MARK)


def squeeze_sentence_breaks(text: Column) -> Column:
    """Sentences of a text joined back with one space."""
    return F.trim(F.regexp_replace(text, SENTENCE_BREAK, "$1 "))


def replace_all(col: Column, pairs) -> Column:
    for a, b in pairs:
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def ntriples_literal(value: Column, lang: Column) -> Column:
    esc = replace_all(value, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")])
    return F.concat(F.lit('"'), esc, F.lit('"'),
                    F.when(F.coalesce(lang, F.lit("")) != "", F.concat(F.lit("@"), lang))
                    .otherwise(F.lit("")))


def case_map(col: Column, mapping: dict, default: Column | None = None) -> Column:
    """Exact-match lookup of fixed values written as a CASE expression."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(default if default is not None else col)
