"""DuckDB text shared by the oracle queries (the second engine of the check)."""

from __future__ import annotations

from ..functions import constants as C


def case_sql(col: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE {default or col} END"


KV = r"""'"(\S+)":\s+([^\n]+)'"""


def atoms_ctes(strip_quotes: bool = True, name: str = "atoms") -> str:
    clean = (f"replace(replace(regexp_extract(l, {KV}, 2), ',', ''), '\"', '')" if strip_quotes
             else f"replace(regexp_extract(l, {KV}, 2), ',', '')")
    keys = ", ".join(
        f"list_filter(kv, lambda x: x.k = '{k}')[-1].v AS {k}"
        for k in ("concept1", "concept2", "entity", "relationship", "importance"))
    norm = case_sql("relationship", C.RELATION_MAP)
    return f"""
{name}_g AS (SELECT doc_id, uid, sentence, replace(response, '{C.END_MARKER}', '') AS reply
       FROM responses WHERE length(sentence) > {C.MIN_SENTENCE_SIZE}
       AND length(replace(response, '{C.END_MARKER}', '')) > {C.MIN_SENTENCE_SIZE}),
{name}_b AS (SELECT doc_id, uid, sentence, unnest(string_split(reply, '}}')) AS block,
       unnest(range(len(string_split(reply, '}}')))) AS atom_ix FROM {name}_g),
{name}_k AS (SELECT doc_id, uid, sentence, atom_ix,
       list_filter(list_transform(string_split(block, chr(10)),
         lambda l: {{'k': regexp_extract(l, {KV}, 1), 'v': {clean}}}),
         lambda x: x.k <> '') AS kv FROM {name}_b),
{name}_r AS (SELECT doc_id, uid, sentence, CAST(atom_ix AS BIGINT) AS atom_ix, {keys},
       CAST(len(list_distinct(list_transform(kv, lambda x: x.k))) AS BIGINT) AS n_keys
       FROM {name}_k WHERE len(kv) > 0),
{name} AS (SELECT doc_id, uid, sentence, atom_ix, concept1, concept2, entity,
       {norm} AS relationship, importance, n_keys, relationship AS relationship_raw FROM {name}_r)"""


COMPLETE = ("concept1 IS NOT NULL AND concept2 IS NOT NULL AND relationship IS NOT NULL "
            "AND importance IS NOT NULL")


def skos_sql(strict_case: bool = True, src: str = "atoms") -> str:
    S = C.SKOS
    whens = [("relat", "related"), ("narrower", "narrower"), ("broader", "broader")]
    if not strict_case:
        whens += [("closematch", "closeMatch"), ("topconceptof", "topConceptOf"),
                  ("inscheme", "inScheme"), ("partof", "topConceptOf")]
    case = "CASE " + " ".join(f"WHEN contains(lower(relationship), '{n}') THEN '{S}{p}'"
                              for n, p in whens) + " END"
    return f"""(WITH x AS (SELECT '{C.NS_ID}' || md5(concept1) AS q1, '{C.NS_ID}' || md5(concept2) AS q2,
        concept2, relationship, {case} AS pred FROM {src} WHERE {COMPLETE})
  SELECT DISTINCT * FROM (
    SELECT q1 AS s, pred AS p, concept2 AS o, 'lit' AS o_kind, '' AS lang FROM x WHERE pred IS NOT NULL
    UNION ALL SELECT q1, pred, q2, 'iri', '' FROM x WHERE pred IS NOT NULL
    UNION ALL SELECT q1, '{C.NS_SKOS_FALLBACK}' || replace(relationship, ' ', '_'), concept2, 'lit', ''
      FROM x WHERE pred IS NULL))"""


def plain_sql(src: str = "atoms") -> str:
    A, R = C.NS_PLAIN_CONCEPT, C.NS_PLAIN_RELATION
    return f"""(SELECT DISTINCT * FROM (
    SELECT '{A}' || replace(concept1, ' ', '_') AS s, '{R}' || replace(relationship, ' ', '_') AS p,
           '{A}' || replace(concept2, ' ', '_') AS o, 'iri' AS o_kind, '' AS lang FROM {src} WHERE {COMPLETE}
    UNION ALL SELECT '{A}' || replace(concept1, ' ', '_'), '{R}hasImportance', importance, 'lit', ''
      FROM {src} WHERE {COMPLETE}))"""


def nt_literal_sql(o: str = "o", lang: str = "lang") -> str:
    esc = (f"replace(replace(replace(replace({o}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), "
           f"chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')")
    return f"(chr(34) || {esc} || chr(34) || CASE WHEN {lang} <> '' THEN '@' || {lang} ELSE '' END)"


def authority_rows_sql(src: str = "authority_triples") -> str:
    return f"""(SELECT DISTINCT * FROM (
  SELECT o AS locResource, p AS property, s AS viafResource, NULL::VARCHAR AS label, NULL::VARCHAR AS topic
    FROM {src} WHERE starts_with(s, '{C.VIAF_PREFIX}') AND starts_with(o, '{C.LOC_PREFIX}')
  UNION ALL SELECT s, p, o, NULL, NULL FROM {src}
    WHERE starts_with(s, '{C.LOC_PREFIX}') AND starts_with(o, '{C.VIAF_PREFIX}')
  UNION ALL SELECT NULL, NULL, s, o, NULL FROM {src}
    WHERE p = '{C.RDFS_LABEL}' AND starts_with(s, '{C.VIAF_LABEL_SCOPE}')
  UNION ALL SELECT s, NULL, NULL, NULL, o FROM {src}
    WHERE p = '{C.XSD_ISSUED}' AND starts_with(s, '{C.LOC_TOPIC_SCOPE}')))"""


def authority_nodes_sql(rows: str = "arows") -> str:
    return f"""(WITH labels AS (SELECT viafResource, max(label) AS label FROM {rows} WHERE label IS NOT NULL GROUP BY 1),
  topics AS (SELECT locResource, max(topic) AS topic FROM {rows} WHERE topic IS NOT NULL GROUP BY 1),
  e AS (SELECT r.viafResource, r.property, l.label, coalesce(t.topic, l.label) AS description,
          replace(r.locResource, '{C.LOC_ID_PREFIX}', '') AS id
        FROM {rows} r LEFT JOIN labels l ON r.viafResource = l.viafResource
        LEFT JOIN topics t ON r.locResource = t.locResource
        WHERE r.locResource IS NOT NULL AND r.viafResource IS NOT NULL AND r.property IS NOT NULL),
  f AS (SELECT id, min({{'v': viafResource, 'p': property, 'u': label, 'd': description}}) AS n
        FROM e WHERE description IS NOT NULL GROUP BY id)
  SELECT id, n.u AS user, n.d AS description, n.v AS link FROM f)"""


def wf(names, select: str, ctes: str = "") -> str:
    """Oracle text: fixture CTEs, then extra CTEs, then the final select."""
    from ..sources.fixtures import fixture_sql
    parts = [f"{n} AS ({fixture_sql(n)})" for n in names]
    if ctes.strip():
        parts.append(ctes.strip().strip(","))
    if not parts:
        return select.strip()
    return "WITH " + ",\n".join(parts) + "\n" + select
