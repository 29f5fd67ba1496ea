"""Derived input tables, built from the given TPC-H-ish tables.

The reference's inputs (model replies, triple stores, web pages, NER payloads,
JSON records) are derived here from the testdata tables so that their size grows
with the scale factor.  Each fixture is a list of ``Sel`` blocks written in one
SQL expression text that Spark (``selectExpr``) and DuckDB both accept; only the
string type name differs (``{S}``).  The oracle side embeds the same text as a CTE.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import table

NL = "chr(10)"
Q = "chr(34)"


def _esc(col: str) -> str:
    """JSON string escaping of a text column with chr() only (both dialects)."""
    x = f"replace({col}, chr(92), chr(92) || chr(92))"
    x = f"replace({x}, chr(34), chr(92) || chr(34))"
    x = f"replace({x}, chr(10), chr(92) || 'n')"
    x = f"replace({x}, chr(13), chr(92) || 'r')"
    x = f"replace({x}, chr(9), chr(92) || 't')"
    return x


@dataclass
class Sel:
    tables: list[str]
    exprs: list[str]
    where: str | None = None
    joins: list[str] = field(default_factory=list)  # join conditions, one per extra table


_REL = ("CASE CAST(p_partkey % 10 AS INT) WHEN 0 THEN 'the same as' WHEN 1 THEN 'is part of' "
        "WHEN 2 THEN 'broader' WHEN 3 THEN 'narrower' WHEN 4 THEN 'related' "
        "WHEN 5 THEN 'in scheme' WHEN 6 THEN 'top concept of' WHEN 7 THEN 'close match' "
        "WHEN 8 THEN 'narrowest' ELSE 'is part of the line' END")


def _line(key: str, value_sql: str, quoted: bool = True, comma: bool = True) -> str:
    v = f"'\"' || {value_sql} || '\"'" if quoted else value_sql
    tail = "','" if comma else "''"
    return f"'\"{key}\": ' || {v} || {tail} || {NL}"


_BLOCK_MAIN = ("'{' || " + NL + " || "
               + _line("concept1", "p_name") + " || "
               + _line("concept2", "p_brand || ', ' || p_type") + " || "
               + _line("entity", "lower(p_type)") + " || "
               + _line("relationship", _REL) + " || "
               + _line("importance", "CAST(p_size AS {S})", comma=False) + " || '}'")
_BLOCK_NO_ENTITY = ("'{' || " + NL + " || "
                    + _line("concept1", "p_name") + " || "
                    + _line("concept2", "p_brand") + " || "
                    + _line("relationship", _REL) + " || '}'")
_BLOCK_SECOND = (NL + " || '{' || " + NL + " || "
                 + _line("concept1", "p_brand") + " || "
                 + _line("concept2", "p_type") + " || "
                 + "'\"entity\": \"brand\",' || " + NL + " || "
                 + "'\"relationship\": \"Broader\",' || " + NL + " || "
                 + "'\"importance\": 4' || " + NL + " || '}'")
_ONE_LINE = ("'{\"concept1\": \"' || p_name || '\", \"concept2\": \"' || p_brand || "
             "'\", \"relationship\": \"related\"}'")

_WIKI_TITLE = "replace(p_name, ' ', '_')"

FIXTURES: dict[str, list[Sel]] = {
    # model replies per sentence (doc_id, uid, sentence, response)
    "responses": [Sel(["part"], [
        "CAST(floor(p_partkey / 10) AS BIGINT) AS doc_id",
        "CAST(p_partkey % 10 AS BIGINT) AS uid",
        "CASE WHEN p_partkey % 67 = 0 THEN 'Short one.' ELSE p_name || ' sold as ' || p_brand || '.' END AS sentence",
        "CASE WHEN p_partkey % 61 = 0 THEN '\"ok\"' "
        f"WHEN p_partkey % 53 = 0 THEN {_ONE_LINE} "
        f"WHEN p_partkey % 89 = 0 THEN {_BLOCK_NO_ENTITY} "
        f"WHEN p_partkey % 7 = 3 THEN {_BLOCK_MAIN} || {_BLOCK_SECOND} "
        f"ELSE {_BLOCK_MAIN} END || '<|im_end|>' AS response",
    ])],
    # authority triples (viaf <-> loc edges, labels, issued dates as topics)
    "authority_triples": [
        Sel(["orders"], ["'http://viaf.org/viaf/' || CAST(o_custkey AS {S}) AS s",
                         "'http://www.w3.org/2002/07/owl#sameAs' AS p",
                         "'http://id.loc.gov/authorities/names/no' || CAST(o_orderkey AS {S}) AS o"],
            "o_orderkey % 3 <> 0"),
        Sel(["orders"], ["'http://id.loc.gov/authorities/names/no' || CAST(o_orderkey AS {S}) AS s",
                         "'http://www.w3.org/2002/07/owl#sameAs' AS p",
                         "'http://viaf.org/viaf/' || CAST(o_custkey AS {S}) AS o"],
            "o_orderkey % 3 = 0"),
        Sel(["customer"], ["'http://viaf.org/viaf/' || CAST(c_custkey AS {S}) AS s",
                           "'http://www.w3.org/2000/01/rdf-schema#label' AS p",
                           "CASE WHEN c_custkey % 9 <> 4 THEN c_name END AS o"]),
        Sel(["orders"], ["'http://id.loc.gov/authorities/names/no' || CAST(o_orderkey AS {S}) AS s",
                         "'http://www.w3.org/2001/XMLSchema#issued' AS p",
                         "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS {S}) END AS o"]),
    ],
    # entity triples shaped like a public knowledge base (s, p, o, lang)
    "entity_triples": [
        # a third of the instances in one class, the others spread over the tree
        Sel(["customer"], ["'wd:C' || CAST(c_custkey AS {S}) AS s", "'wdt:P31' AS p",
                           "CASE WHEN c_custkey % 3 = 0 THEN 'wd:S1' WHEN c_custkey % 3 = 1 THEN "
                           "'wd:N' || CAST(c_nationkey AS {S}) ELSE 'wd:S' || CAST(c_custkey % 97 + 1 AS {S}) END AS o",
                           "'' AS lang"]),
        # a class tree of the suppliers, its depth the logarithm of their number
        Sel(["supplier"], ["'wd:S' || CAST(s_suppkey AS {S}) AS s", "'wdt:P279' AS p",
                           "CASE WHEN s_suppkey > 1 THEN 'wd:S' || CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS {S}) "
                           "ELSE 'wd:N7' END AS o", "'' AS lang"]),
        Sel(["supplier"], ["'wd:S' || CAST(s_suppkey AS {S}) AS s", "'rdfs:label' AS p",
                           "s_name AS o", "CASE WHEN s_suppkey % 2 = 0 THEN 'en' ELSE '' END AS lang"]),
        Sel(["nation"], ["'wd:N' || CAST(n_nationkey AS {S}) AS s", "'wdt:P279' AS p",
                         "'wd:R' || CAST(n_regionkey AS {S}) AS o", "'' AS lang"]),
        Sel(["nation"], ["'wd:N' || CAST(n_nationkey AS {S}) AS s", "'wdt:P279' AS p",
                         "'wd:N' || CAST(n_nationkey - 1 AS {S}) AS o", "'' AS lang"],
            "n_nationkey % 8 = 7"),
        Sel(["region"], ["'wd:R' || CAST(r_regionkey AS {S}) AS s", "'wdt:P279' AS p",
                         "CASE WHEN r_regionkey = 4 THEN 'wd:Q6256' ELSE 'wd:Q515' END AS o",
                         "'' AS lang"]),
        Sel(["region"], ["CASE WHEN r_regionkey = 0 THEN 'wd:Q515' ELSE 'wd:Q486972' END AS s",
                         "'wdt:P279' AS p",
                         "CASE WHEN r_regionkey = 0 THEN 'wd:Q486972' ELSE 'wd:Q515' END AS o",
                         "'' AS lang"], "r_regionkey < 2"),
        Sel(["customer"], ["'wd:C' || CAST(c_custkey AS {S}) AS s", "'wdt:P1082' AS p",
                           "CASE WHEN c_custkey % 11 <> 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS {S}) END AS o",
                           "'' AS lang"]),
        Sel(["customer"], ["'wd:C' || CAST(c_custkey AS {S}) AS s", "'wdt:P625' AS p",
                           "CASE WHEN c_custkey % 13 <> 0 THEN 'Point(' || CAST(c_custkey % 360 - 180 AS {S}) || ' ' || "
                           "CAST(c_nationkey AS {S}) || ')' END AS o", "'' AS lang"]),
        Sel(["customer"], ["'wd:C' || CAST(c_custkey AS {S}) AS s", "'rdfs:label' AS p",
                           "c_name AS o",
                           "CASE WHEN c_custkey % 2 = 0 THEN 'en' ELSE '' END AS lang"]),
        Sel(["customer"], ["'wd:C' || CAST(c_custkey AS {S}) AS s", "'wdtn:P214' AS p",
                           "'http://viaf.org/viaf/' || CAST(c_custkey AS {S}) AS o", "'' AS lang"]),
        Sel(["customer"], ["'wd:C' || CAST(c_custkey AS {S}) AS s", "'wdt:P214' AS p",
                           "CAST(c_custkey AS {S}) AS o", "'' AS lang"]),
        Sel(["customer"], ["'wd:C' || CAST(c_custkey AS {S}) AS s", "'wdt:P1343' AS p",
                           "CASE WHEN c_custkey % 3 = 0 THEN 'http://viaf.org/viaf/' || CAST(c_custkey AS {S}) END AS o",
                           "'' AS lang"]),
        Sel(["nation"], ["'wd:N' || CAST(n_nationkey AS {S}) AS s", "'rdfs:label' AS p",
                         "n_name AS o", "'en' AS lang"]),
        Sel(["region"], ["'wd:R' || CAST(r_regionkey AS {S}) AS s", "'rdfs:label' AS p",
                         "r_name AS o", "'de' AS lang"]),
    ],
    # web pages with wiki-style links and images
    "link_pages": [Sel(["pages"], [
        "page_id",
        "CASE WHEN page_id % 2 = 0 THEN 'https://en.wikipedia.org/wiki/P' || CAST(page_id AS {S}) "
        "WHEN page_id % 11 = 1 THEN 'https://site.example/' WHEN page_id % 11 = 3 THEN 'https://site.example' "
        "ELSE url END AS url",
        "'<img src=\"//upload.wikimedia.org/a/' || CAST(page_id AS {S}) || '.svg\">' || "
        "CASE WHEN page_id % 2 = 0 THEN '<img alt=\"x\" src=\"//upload.wikimedia.org/b/' || "
        "CAST(page_id AS {S}) || '.jpg\">' ELSE '' END || "
        "'<a href=\"/wiki/P' || CAST(page_id AS {S}) || '\">self</a>' || "
        "'<a href=\"/wiki/Category:Group' || CAST(page_id % 7 AS {S}) || '\">Group</a>' || "
        "'<a href=\"/wiki/Help:Contents\">Help</a>' || "
        "'<a class=\"ext\" href=\"https://fr.wikipedia.org/wiki/Paris\">Paris &amp; <b>co</b></a>' || "
        "'<A data-href=\"/wiki/No\" HREF=' || chr(39) || '/wiki/Caf%C3%A9_' || CAST(page_id % 5 AS {S}) || chr(39) || "
        "'>caf&eacute; &#8364;&#x41; &bogus;</A><a href=/wiki/Bare title=\"a > b\">bare</a>' || "
        "'<IMG data-src=\"//upload.wikimedia.org/no.jpg\" src=' || chr(39) || '//upload.wikimedia.org/c/' || "
        "CAST(page_id AS {S}) || '.png' || chr(39) || '/>' || "
        # markup that is none, a tag that holds ">" and one that never ends
        "'<!-- <a href=\"/wiki/Hidden\">no</a> --><script>var t = ' || chr(39) || '<a href=\"/wiki/Script\">' || chr(39) || "
        "';</script><a href=\"/wiki/Open\">open <i>one<a title=it' || chr(39) || 's href=/wiki/Next>next</a><title><a href=x></title>' || "
        "replace(html, 'href=\"/', 'href=\"/wiki/') || CASE WHEN page_id % 13 = 5 THEN '<a href=\"/wiki/End' || repeat(' x', 3000) ELSE '' END AS html",
    ])],
    # translation replies of a chat model, one per part
    "replies": [Sel(["part"], [
        "CAST(p_partkey AS BIGINT) AS reply_id",
        "p_name AS concept",
        f"'<|system|>' || {NL} || 'sys: prompt' || {NL} || '<|assistant|>' || {NL} || "
        f"'English: ' || p_name || {NL} || {NL} || "
        f"'User' || chr(39) || 's request in Dutch: ' || p_name || ' nl' || {NL} || "
        f"'Description: part ' || p_name || {NL} || 'free text' || "
        f"CASE WHEN p_partkey % 3 = 0 THEN {NL} || 'English: ' || lower(p_name) ELSE '' END || "
        f"CASE WHEN p_partkey % 9 = 2 THEN {NL} || 'Basque: ' || p_name ELSE '' END || "
        f"CASE WHEN p_partkey % 4 = 1 THEN {NL} || 'German: ' || p_name || ' de' || {NL} || 'more text' "
        "ELSE '' END AS response",
    ])],
    # NER service payloads
    "ner_payloads": [Sel(["customer", "nation"], [
        "c_custkey AS payload_id",
        "'{\"lang\": \"en\", ' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '\"entities\": 1, ' END || "
        "'\"original_entities\": [{\"entity\": \"' || c_name || '\", \"label\": \"' || "
        "CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'ORG' WHEN 1 THEN 'PER' WHEN 2 THEN 'GPE' ELSE 'MISC' END"
        " || '\"}, {\"entity\": \"' || n_name || '\", \"label\": \"GPE\"}, {\"entity\": \"\", \"label\": \"ORG\"}], "
        "\"title\": \"' || c_mktsegment || '\", \"text\": \"' || c_name || '\"}' AS payload",
    ], joins=["c_nationkey = n_nationkey"])],
    # F8: nested JSON records for identifier statistics
    "json_values": [Sel(["customer", "nation", "region"], [
        "c_custkey AS record_id",
        "c_name AS name",
        "'{\"a\":\"' || c_mktsegment || '_' || n_name || '\",\"b\":{\"c\":\"x/y_z\"},"
        "\"d\":[\"in_list\",{\"e\":\"' || r_name || '_r\"}],\"f\":\"\",\"n\":5,\"g\":' || "
        # every seventh record holds a string below twelve more levels
        "CASE WHEN c_custkey % 7 = 0 THEN repeat('{\"x\":', 12) || '\"deep_' || n_name || '\"' || repeat('}', 12) "
        "ELSE 'null' END || '}' AS data",
    ], joins=["c_nationkey = n_nationkey", "n_regionkey = r_regionkey"])],
    # page references in several URL shapes
    "page_refs": [Sel(["part"], [
        "p_partkey AS ref_id",
        "CASE CAST(p_partkey % 6 AS INT) "
        f"WHEN 0 THEN 'https://en.wikipedia.org/wiki/' || {_WIKI_TITLE} "
        f"WHEN 1 THEN 'https://wikipedia.org/wiki/' || {_WIKI_TITLE} "
        f"WHEN 2 THEN 'https://www.wikipedia.org/wiki/' || {_WIKI_TITLE} "
        f"WHEN 3 THEN 'https://en.m.wikipedia.org/wiki/' || {_WIKI_TITLE} "
        f"WHEN 4 THEN 'https://www.en.wikipedia.org/wiki/' || {_WIKI_TITLE} "
        f"ELSE {_WIKI_TITLE} END AS ref",
    ])],
    # page title -> external id look-up
    "wiki_ids": [
        Sel(["part"], ["'enwiki' AS site", f"{_WIKI_TITLE} AS title",
                       "'Q' || CAST(p_partkey AS {S}) AS wiki_id"]),
        Sel(["pages"], ["'euwiki' AS site", "regexp_extract(html, 'href=\"/([^\"]*)\"', 1) AS title",
                        "'Q' || CAST(100000 + page_id AS {S}) AS wiki_id"]),
    ],
    # T26: references to route (titles, dataset pages, web pages)
    "source_refs": [Sel(["pages"], [
        "page_id AS ref_id",
        "CASE CAST(page_id % 4 AS INT) WHEN 1 THEN "
        "'https://data.example.org/dataset.xhtml?persistentId=doi:10.5072/FK2/' || CAST(page_id AS {S}) "
        "WHEN 2 THEN 'Title_' || CAST(page_id AS {S}) ELSE url END AS ref",
    ])],
    # S5: JSON text payloads (ordered fields)
    "payloads": [Sel(["documents"], [
        "doc_id AS payload_id",
        f"'{{\"title\": \"' || source || '\", \"lang\": \"' || lang || '\", \"text\": \"' || {_esc('text')} || '\"}}' AS payload",
    ])],
    # S7: dataset-export JSON documents
    "dataset_exports": [Sel(["documents"], [
        "doc_id AS dataset_id",
        f"'{{\"ore:describes\": {{\"title\": \"' || source || '\", \"citation:dsDescription\": "
        f"{{\"citation:dsDescriptionValue\": \"' || {_esc('text')} || '\"}}}}}}' AS export",
    ])],
    # S9: query-service JSON results
    "sparql_results": [Sel(["customer"], [
        "c_custkey AS result_id",
        "'{\"head\": {\"vars\": [\"cityLabel\", \"population\"]}, \"results\": {\"bindings\": ["
        "{\"cityLabel\": {\"type\": \"literal\", \"value\": \"' || c_name || '\", \"xml:lang\": \"en\"}, "
        "\"population\": {\"type\": \"literal\", \"value\": \"' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS {S}) || '\"}}, "
        "{\"cityLabel\": {\"type\": \"literal\", \"value\": \"' || c_mktsegment || '\"}, "
        "\"population\": {\"type\": \"literal\", \"value\": \"n/a\"}}]}}' AS result",
    ])],
    # T13: keyword replies
    "keyword_replies": [Sel(["part"], [
        "p_partkey AS reply_id",
        "'{\"keywords\": [\"' || p_name || '\", \"' || p_brand || '\"]}<br>\"' || p_type || '\"' AS response",
    ])],
}


def fixture_exprs(name: str, string_type: str):
    return [(sel, [e.replace("{S}", string_type) for e in sel.exprs]) for sel in FIXTURES[name]]


# Fixtures whose rows feed CPU-heavy parsing (regex, JSON).  The test tables are
# one file of one row group each, so the derived input is dealt to several parts
# here, as real input would arrive in several files.
PARSE_HEAVY = {"responses", "link_pages", "replies", "ner_payloads", "json_values", "payloads",
               "dataset_exports", "sparql_results", "keyword_replies", "page_refs", "source_refs"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a fixture as a Spark DataFrame (narrow projections of the scans)."""
    parts = []
    for sel, exprs in fixture_exprs(name, "STRING"):
        df = table(spark, sf_dir, sel.tables[0])
        for t, cond in zip(sel.tables[1:], sel.joins):
            # the joined tables are the 25-row nation and 5-row region dimensions
            df = df.join(F.broadcast(table(spark, sf_dir, t)), F.expr(cond))
        if sel.where:
            df = df.where(sel.where)
        if name in PARSE_HEAVY:
            df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        parts.append(df.selectExpr(*exprs))
    return reduce(lambda a, b: a.unionByName(b), parts)


def fixture_sql(name: str) -> str:
    """The same fixture as DuckDB SQL (for the oracle)."""
    blocks = []
    for sel, exprs in fixture_exprs(name, "VARCHAR"):
        src = sel.tables[0]
        for t, cond in zip(sel.tables[1:], sel.joins):
            src += f" JOIN {t} ON {cond}"
        sql = f"SELECT {', '.join(exprs)} FROM {src}"
        if sel.where:
            sql += f" WHERE {sel.where}"
        blocks.append(sql)
    return " UNION ALL ".join(blocks)


def with_fixtures(names, body: str) -> str:
    """Prefix an oracle query with the fixture CTEs it needs."""
    ctes = ",\n".join(f"{n} AS ({fixture_sql(n)})" for n in names)
    return f"WITH {ctes}\n{body}"


# S2: rows of one dataset arriving from two source kinds (csv < spreadsheet)
FIXTURES["source_rows"] = [
    Sel(["customer"], ["c_mktsegment AS dataset", "'csv' AS source_kind", "1 AS priority", "c_custkey",
                       "c_name"]),
    Sel(["customer"], ["c_mktsegment AS dataset", "'spreadsheet' AS source_kind", "2 AS priority", "c_custkey",
                       "c_name"], "c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0"),
]
