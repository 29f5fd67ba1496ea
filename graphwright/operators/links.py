"""Web pages -> anchors, link tables, images; page references -> ids.

A page is read as tokens in one linear pass (``tags``): start and end tags with their
attributes in any quoting, comments, declarations, and the elements whose content is
no markup.  Tag and attribute names may have any case.  Patterns only hold possessive
loops over single characters or whole attributes, so the length of a tag, an open quote
or a missing ``>`` cost neither stack nor a second look: a tag, comment or raw element
that is not closed ends with the page, and is no tag then.

An anchor's text ends at the next ``</a>`` or ``<a ...>`` or with the page.  Character
references are decoded.  The control characters U+0001 and U+0002 are dropped.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as C
from ..functions.joins import skew_join

# one attribute, or what stands between attributes; what is neither is part of a name
_SP = r"[ \t\n\f\r]"
_VALUE = r"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+)"""
_NAME = r"=?+[^ \t\n\f\r/>=]++"
_ATTRIBUTE = rf"(?:[ \t\n\f\r/]++|{_NAME}(?:{_SP}*+={_SP}*+{_VALUE}?+)?+|=)"
# Elements whose content is text.
RAW_ELEMENTS = ("script", "style", "textarea", "title")
HOST_PREFIX = r"^\S+wikipedia.org"
ENTITY = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
# code points of the named entities (HTML 4), from the standard library's table
NAMED = dict(sorted(name2codepoint.items())) | {"apos": 39}


def tag_pattern(names: str) -> str:
    """Pattern of one token of a page; group 1 is the name and the attributes of a tag
    of ``names`` (a pattern), and holds nothing for other tokens."""
    attributes = rf"(?:[ \t\n\f\r/]{_ATTRIBUTE}*+)?+"
    raw = "|".join(rf"{n}{attributes}>[\s\S]*?(?:</{n}(?:>|[ \t\n\f\r/][^>]*+(?:>|\z))|\z)" for n in RAW_ELEMENTS)
    return (rf"(?i)<(?:((?:{names}){attributes})>|{raw}|/?[a-z][^ \t\n\f\r/>]*+{_ATTRIBUTE}*+(?:>|\z)"
            rf"|!--(?:-?>|[\s\S]*?(?:--!?>|\z))|[!?][^>]*+(?:>|\z)|/[^a-z>][^>]*+(?:>|\z)|/>)")


def attribute_pattern(name: str) -> str:
    """Pattern of a tag's name or of one attribute; groups 1 to 4 are the name and the
    value of those called ``name``, and hold nothing for others."""
    value = r"""(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\f\r>"'][^ \t\n\f\r>]*+))"""
    return rf"(?i)^[^ \t\n\f\r/>]++|({name}){_SP}*+={_SP}*+{value}|{_NAME}(?:{_SP}*+={_SP}*+{_VALUE}?+)?+"


def tags(html: Column, names: str) -> Column:
    """The tags of ``names`` in order, each with the text up to the next of them:
    ``name attributes U+0002 text``.  Other tags, comments and raw elements are gone."""
    marked = F.regexp_replace(F.translate(html, "\u0001\u0002", ""), tag_pattern(names), "\u0001$1\u0002")
    pieces = F.split(F.replace(marked, F.lit("\u0001\u0002"), F.lit("")), "\u0001")
    return F.slice(pieces, 2, F.size(pieces))  # the first is the text before any tag


def attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute ``name`` of a tag, in any quoting and case; ''
    when there is none or it has no value.  Attributes are read one by one, so a name
    inside another attribute's name or value does not count."""
    marked = F.regexp_replace(tag, attribute_pattern(name), "\u0001$1=$2$3$4\u0002")
    return F.regexp_extract(marked, f"(?i)\u0001{name}=([^\u0002]*+)", 1)


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Named (HTML 4) and numeric character references, each decoded once."""
    names = F.create_map(*[F.lit(x) for k, v in NAMED.items() for x in (k, chr(v))])

    def piece(p: Column) -> Column:
        ref = F.regexp_extract(p, ENTITY, 1)
        number = F.when(F.lower(F.substr(ref, F.lit(1), F.lit(2))) == "#x", F.conv(F.substr(ref, F.lit(3)), 16, 10)) \
            .when(ref.startswith("#"), F.substr(ref, F.lit(2))).try_cast("bigint")
        char = F.when(number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), _code_point(number)) \
            .otherwise(F.try_element_at(names, ref))
        return F.coalesce(F.concat(char, F.substr(p, F.length(ref) + 2)), F.concat(F.lit("&"), p))

    parts = F.split(text, "&")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), ""))


def page_anchors(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, href, link, text)``; a link without ``http`` gets the
    site prefix."""
    anchors = F.filter(tags(F.col("html"), "/?a"), lambda t: ~t.startswith("/"))
    a = pages.select("page_id", "url", F.posexplode_outer(anchors).alias("pos", "a")) \
        .where(F.col("pos").isNotNull())
    a = a.withColumn("href", decode_entities(attribute(F.substring_index("a", "\u0002", 1), "href")))
    href = F.col("href")
    link = F.when(~href.contains("http"), F.concat(F.lit(C.WIKI_LINK_PREFIX), href)).otherwise(href)
    return (a.where(href != "")
            .select("page_id", "url", F.col("pos").cast("bigint").alias("pos"), href.alias("href"),
                    link.alias("link"), decode_entities(F.substring_index("a", "\u0002", -1)).alias("text")))


def page_path(url: Column) -> Column:
    """Path of the page: URL without ``^\\S+wikipedia.org``; other hosts use the
    URL path (null for a URL that does not parse)."""
    return F.when(url.contains("wikipedia.org"), F.regexp_replace(url, HOST_PREFIX, "")) \
        .otherwise(F.expr("try_parse_url(url, 'PATH')"))


def page_links(anchors: DataFrame, path_marker: str = "/wiki/") -> DataFrame:
    """Link table ``(page_id, wikilink, value, type, wiki_id)``: wiki links,
    no self links, no meta pages, ``category``/``concept``, de-duplicated."""
    link = F.col("link")
    this = F.regexp_replace(link, HOST_PREFIX, "")
    # a page without a path of its own (empty, "/" or a URL that does not parse) has no self links
    path = page_path(F.col("url"))
    own = F.when(path.isNotNull() & ~path.isin("", "/"), this.contains(path)).otherwise(F.lit(False))
    keep = link.contains(path_marker) & ~own & ~link.rlike(C.META_NAMESPACE_PATTERN)
    typ = F.when(link.contains("Category"), F.lit("category")).otherwise(F.lit("concept"))
    return (anchors.where(keep)
            .select("page_id", link.alias("wikilink"), F.col("text").alias("value"),
                    typ.alias("type"), F.lit("").alias("wiki_id"))
            .dropDuplicates(["page_id", "wikilink", "value", "type", "wiki_id"]))


def first_image(pages: DataFrame) -> DataFrame:
    """First hosted, non-SVG image with a scheme-less ``src`` per page."""
    src = F.transform(tags(F.col("html"), "img"), lambda t: attribute(F.substring_index(t, "\u0002", 1), "src"))
    ok = F.filter(src, lambda x: x.contains("upload.wikimedia.org") & ~x.contains(".svg") & ~x.contains("http"))
    first = F.try_element_at(ok, F.lit(1))
    return (pages.select("page_id", "url", first.alias("src")).where(F.col("src").isNotNull())
            .select("page_id", "url", F.concat(F.lit("http:"), "src").alias("image")))


def link_foaf(links: DataFrame) -> DataFrame:
    """Concept links as ``foaf:Person`` with ``foaf:name``."""
    c = links.where(F.col("type") == "concept")
    arr = F.array(
        F.struct(F.col("wikilink").alias("s"), F.lit(C.RDF_TYPE).alias("p"),
                 F.lit(C.FOAF_PERSON).alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("lang")),
        F.struct(F.col("wikilink").alias("s"), F.lit(C.FOAF_NAME).alias("p"),
                 F.col("value").alias("o"), F.lit("lit").alias("o_kind"), F.lit("").alias("lang")))
    return c.select(F.inline(arr)).distinct()


# --- page references ---------------------------------------------------------

def _ref_parts(ref: Column):
    """``(key, page, lang)`` columns of a page reference; ``page`` is '' when
    nothing matches.

    ``//wikipedia`` -> language ``eu``, key is the reference; otherwise every
    ``www.`` is dropped and ``//<lang>.wikipedia.org/wiki/<page>`` matched, key
    is the stripped reference.  No ``http`` -> no result."""
    plain = ref.contains("//wikipedia")
    stripped = F.replace(ref, F.lit("www."), F.lit(""))
    pat2 = C.PAGE_REF_PATTERN
    page = (F.when(~ref.contains("http"), F.lit(""))
            .when(plain, F.regexp_extract(ref, r"wikipedia.org/wiki/(\S+)", 1))
            .otherwise(F.regexp_extract(stripped, pat2, 2)))
    lang = F.when(plain, F.lit("eu")).otherwise(F.regexp_extract(stripped, pat2, 1))
    key = F.when(plain, ref).otherwise(stripped)
    return key, page, lang


def page_ref_parse(refs: DataFrame, ref_col: str = "ref") -> DataFrame:
    key, page, lang = _ref_parts(F.col(ref_col))
    return (refs.select("*", key.alias("key"), page.alias("page"), lang.alias("lang"))
            .where(F.col("page") != ""))


def wiki_id_table(ids: DataFrame) -> DataFrame:
    """Look-up ``(site, title) -> wiki_id``; one id per key (smallest)."""
    return ids.groupBy("site", "title").agg(F.min("wiki_id").alias("wiki_id"))


def page_ref_lookup(refs: DataFrame, ids: DataFrame, order_col: str = "ref_id") -> DataFrame:
    """Id per reference key; when a key repeats, the last reference wins
    (``max_by`` over the reference order, a partial aggregate)."""
    parsed = page_ref_parse(refs).select(order_col, "key",
                                         F.concat(F.col("lang"), F.lit("wiki")).alias("site"),
                                         F.col("page").alias("title"))
    hit = skew_join(parsed, wiki_id_table(ids), ["site", "title"])
    return hit.groupBy("key").agg(F.max_by("wiki_id", order_col).alias("wiki_id"))


def links_linked(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Link table with the external id of concept links ('' when unknown)."""
    _, page, lang = _ref_parts(F.col("wikilink"))
    is_concept = (F.col("type") == "concept") & (page != "")
    keyed = links.drop("wiki_id").select(
        "*", F.when(is_concept, F.concat(lang, F.lit("wiki"))).alias("site"),
        F.when(is_concept, page).alias("title"))
    j = skew_join(keyed, wiki_id_table(ids), ["site", "title"], "left")
    return j.select("page_id", "wikilink", "value", "type",
                    F.coalesce("wiki_id", F.lit("")).alias("wiki_id"))


def route_source(refs: DataFrame, ref_col: str = "ref") -> DataFrame:
    """Reader for a reference: title (no http), dataset export, or page."""
    ref = F.col(ref_col)
    route = (F.when(~ref.contains("http"), F.lit("article"))
             .when(ref.contains(C.DATASET_MARKER), F.lit("dataset")).otherwise(F.lit("page")))
    ds = F.when(route == "dataset", F.regexp_extract(ref, r"Id=(\S+)", 1))
    return refs.select("*", route.alias("route"), ds.alias("dataset_id"))
