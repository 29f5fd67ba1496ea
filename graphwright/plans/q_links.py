"""Web page link tables and page references."""

from __future__ import annotations

from ..functions import constants as C
from ..functions.lineage import written
from ..operators import links as L
from ..sources.fixtures import fixture
from . import duck as D
from .registry import register

def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """The pattern without possessive marks, which this engine does not know: in these
    patterns the first way through a loop always leads to a match."""
    return _q(pattern.replace("*+", "*").replace("++", "+").replace("?+", "?"))


def _tags(names: str) -> str:
    """List of the tags of ``names`` in ``html``, each with the text after it (DuckDB)."""
    marked = f"regexp_replace(translate(html, chr(1) || chr(2), ''), {_re2(L.tag_pattern(names))}, chr(1) || '\\1' || chr(2), 'g')"
    return f"string_split(replace({marked}, chr(1) || chr(2), ''), chr(1))[2:]"


def _attr(tag: str, name: str) -> str:
    marked = f"regexp_replace({tag}, {_re2(L.attribute_pattern(name))}, chr(1) || '\\1=\\2\\3\\4' || chr(2), 'g')"
    return f"regexp_extract({marked}, '(?i)\x01{name}=([^\x02]*)', 1)"


_NAMED = "MAP {" + ", ".join(f"{_q(k)}: chr({v})" for k, v in L.NAMED.items()) + "}"


def _decoded(text: str) -> str:
    """Character references of a text (DuckDB)."""
    ref = f"regexp_extract(p, {_q(L.ENTITY)}, 1)"
    number = (f"CASE WHEN lower(substr({ref}, 1, 2)) = '#x' THEN TRY_CAST('0x' || substr({ref}, 3) AS BIGINT) "
              f"WHEN starts_with({ref}, '#') THEN TRY_CAST(substr({ref}, 2) AS BIGINT) END")
    char = (f"CASE WHEN ({number}) BETWEEN 1 AND 1114111 AND NOT ({number}) BETWEEN 55296 AND 57343 "
            f"THEN chr(CAST({number} AS INTEGER)) ELSE {_NAMED}[{ref}] END")
    piece = f"coalesce(({char}) || substr(p, length({ref}) + 2), '&' || p)"
    return (f"(string_split({text}, '&')[1] || array_to_string(list_transform(string_split({text}, '&')[2:], "
            f"lambda p: {piece}), ''))")


_ANCHORS = f"""anchors AS (SELECT page_id, url, pos, href,
    CASE WHEN NOT contains(href, 'http') THEN '{C.WIKI_LINK_PREFIX}' || href ELSE href END AS link, text FROM (
  SELECT page_id, url, CAST(pos AS BIGINT) AS pos, {_decoded(_attr("string_split(a, chr(2))[1]", 'href'))} AS href,
         {_decoded("string_split(a, chr(2))[2]")} AS text FROM (
  SELECT page_id, url, unnest(l) AS a, unnest(range(len(l))) AS pos FROM (
    SELECT page_id, url, list_filter({_tags('/?a')}, lambda t: NOT starts_with(t, '/')) AS l FROM link_pages)))
  WHERE href <> '')"""
_PATH = r"""CASE WHEN contains(url, 'wikipedia.org') THEN regexp_replace(url, '^\S+wikipedia.org', '')
  ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"""
_LINKS = f"""plinks AS (SELECT DISTINCT page_id, link AS wikilink, text AS value,
    CASE WHEN contains(link, 'Category') THEN 'category' ELSE 'concept' END AS type, '' AS wiki_id
  FROM anchors WHERE contains(link, '/wiki/')
    AND NOT ({_PATH} NOT IN ('', '/') AND contains(regexp_replace(link, '^\\S+wikipedia.org', ''), {_PATH}))
    AND NOT regexp_matches(link, '{C.META_NAMESPACE_PATTERN}'))"""


def _ref_sql(ref: str) -> str:
    """key, page, lang of a reference (DuckDB)."""
    stripped = f"replace({ref}, 'www.', '')"
    pat2 = f"'{C.PAGE_REF_PATTERN}'"
    page = (f"CASE WHEN NOT contains({ref}, 'http') THEN '' "
            f"WHEN contains({ref}, '//wikipedia') THEN regexp_extract({ref}, 'wikipedia.org/wiki/(\\S+)', 1) "
            f"ELSE regexp_extract({stripped}, {pat2}, 2) END")
    lang = f"CASE WHEN contains({ref}, '//wikipedia') THEN 'eu' ELSE regexp_extract({stripped}, {pat2}, 1) END"
    key = f"CASE WHEN contains({ref}, '//wikipedia') THEN {ref} ELSE {stripped} END"
    return key, page, lang


_WIDS = "wids AS (SELECT site, title, min(wiki_id) AS wiki_id FROM wiki_ids GROUP BY ALL)"


@register("page_anchors", D.wf(["link_pages"], "SELECT * FROM anchors", _ANCHORS))
def q_page_anchors(spark, sf):
    return L.page_anchors(fixture(spark, sf, "link_pages"))


@register("page_links", D.wf(["link_pages"], "SELECT * FROM plinks", _ANCHORS + ",\n" + _LINKS))
def q_page_links(spark, sf):
    return L.page_links(L.page_anchors(fixture(spark, sf, "link_pages")))


_K, _P, _L = _ref_sql("wikilink")


@register("links_linked", D.wf(["link_pages", "wiki_ids"], f"""
SELECT k.page_id, k.wikilink, k.value, k.type, coalesce(w.wiki_id, '') AS wiki_id FROM (
  SELECT *, CASE WHEN type = 'concept' AND {_P} <> '' THEN {_L} || 'wiki' END AS site,
            CASE WHEN type = 'concept' AND {_P} <> '' THEN {_P} END AS title FROM plinks) k
LEFT JOIN wids w ON w.site = k.site AND w.title = k.title""",
                                _ANCHORS + ",\n" + _LINKS + ",\n" + _WIDS))
def q_links_linked(spark, sf):
    # written once, as keys are counted and joined
    links = written(L.page_links(L.page_anchors(fixture(spark, sf, "link_pages"))), "links")
    return L.links_linked(links, fixture(spark, sf, "wiki_ids"))


@register("first_image", D.wf(["link_pages"], f"""
SELECT page_id, url, 'http:' || src AS image FROM (
  SELECT page_id, url, list_filter(list_transform({_tags('img')}, lambda t: {_attr('string_split(t, chr(2))[1]', 'src')}),
    lambda x: contains(x, 'upload.wikimedia.org') AND NOT contains(x, '.svg') AND NOT contains(x, 'http'))[1] AS src
  FROM link_pages)
WHERE src IS NOT NULL"""))
def q_first_image(spark, sf):
    return L.first_image(fixture(spark, sf, "link_pages"))


@register("link_foaf", D.wf(["link_pages"], f"""
SELECT DISTINCT * FROM (
  SELECT wikilink AS s, '{C.RDF_TYPE}' AS p, '{C.FOAF_PERSON}' AS o, 'iri' AS o_kind, '' AS lang
  FROM plinks WHERE type = 'concept'
  UNION ALL SELECT wikilink, '{C.FOAF_NAME}', value, 'lit', '' FROM plinks WHERE type = 'concept')""",
                             _ANCHORS + ",\n" + _LINKS))
def q_link_foaf(spark, sf):
    return L.link_foaf(L.page_links(L.page_anchors(fixture(spark, sf, "link_pages"))))


_RK, _RP, _RL = _ref_sql("ref")


@register("page_ref_parse", D.wf(["page_refs"], f"""
SELECT ref_id, ref, key, page, lang FROM (
  SELECT ref_id, ref, {_RK} AS key, {_RP} AS page, {_RL} AS lang FROM page_refs) WHERE page <> ''"""))
def q_page_ref_parse(spark, sf):
    return L.page_ref_parse(fixture(spark, sf, "page_refs"))


@register("page_ref_lookup", D.wf(["page_refs", "wiki_ids"], f"""
SELECT key, arg_max(w.wiki_id, r.ref_id) AS wiki_id FROM (
  SELECT ref_id, {_RK} AS key, {_RP} AS page, {_RL} || 'wiki' AS site FROM page_refs) r
JOIN wids w ON w.site = r.site AND w.title = r.page WHERE r.page <> '' GROUP BY key""", _WIDS))
def q_page_ref_lookup(spark, sf):
    return L.page_ref_lookup(fixture(spark, sf, "page_refs"), fixture(spark, sf, "wiki_ids"))


@register("route_source", D.wf(["source_refs"], f"""
SELECT ref_id, ref,
  CASE WHEN NOT contains(ref, 'http') THEN 'article' WHEN contains(ref, '{C.DATASET_MARKER}') THEN 'dataset'
       ELSE 'page' END AS route,
  CASE WHEN contains(ref, 'http') AND contains(ref, '{C.DATASET_MARKER}')
       THEN regexp_extract(ref, 'Id=(\\S+)', 1) END AS dataset_id FROM source_refs"""))
def q_route_source(spark, sf):
    return L.route_source(fixture(spark, sf, "source_refs"))
