"""Fixed values that must equal the behaviour being matched.

Stated plainly, in natural order, in one place.
"""

# --- fixed values: relationship normalisation (exact, case-sensitive match) ---
RELATION_MAP = {
    "the same as": "skos:exactMatch",
    "is part of": "owl:partOf",
    "broader": "skos:broader",
    "narrower": "skos:narrower",
    "related": "skos:related",
    "in scheme": "skos:inScheme",
    "top concept of": "skos:topConceptOf",
    "close match": "skos:closeMatch",
    "narrowest": "skos:narrower",
}

# --- fixed values: NER label -> schema.org term ---
NER_CONTEXT = {
    "ORG": "https://schema.org/parentOrganization",
    "PERSON": "https://schema.org/person",
    "PER": "https://schema.org/person",
    "GPE": "https://schema.org/location",
    "lang": "https://schema.org/language",
    "LOC": "https://schema.org/location",
    "MONEY": "https://schema.org/MonetaryAmount",
    "PRODUCT": "https://schema.org/Product",
    "WORK_OF_ART": "https://schema.org/VisualArtwork",
    "DATE": "https://schema.org/date",
    "CARDINAL": "https://schema.org/value",
}

# --- fixed values: language names asked for in translation replies -> codes ---
LANGUAGE_CODES = {
    "English": "en",
    "Dutch": "nl",
    "German": "de",
    "French": "fr",
    "Spanish": "es",
    "Ukrainian": "uk",
    "Russian": "ru",
    "Italian": "it",
    "Portuguese": "pt",
    "Polish": "pl",
    "Czech": "cs",
    "Slovak": "sk",
    "Greek": "el",
    "Swedish": "sv",
    "Norwegian": "no",
    "Danish": "da",
}

# --- fixed values: namespaces ---
NS_PLAIN_CONCEPT = "http://knowledgegraph.ai/"
NS_PLAIN_RELATION = "http://knowledgerelationship.org/"
NS_SKOS_FALLBACK = "http://kg.ai/"
NS_ID = "https://id.now.museum/"
SKOS = "http://www.w3.org/2004/02/skos/core#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
XSD_ISSUED = "http://www.w3.org/2001/XMLSchema#issued"
DCTERMS_IDENTIFIER = "http://purl.org/dc/terms/identifier"
SCHEMA = "https://schema.org/"
FOAF_PERSON = "http://xmlns.com/foaf/0.1/Person"
FOAF_NAME = "http://xmlns.com/foaf/0.1/name"
VIAF_PREFIX = "http://viaf.org/viaf/"
LOC_PREFIX = "http://id.loc.gov/authorities/names/"
LOC_ID_PREFIX = "http://id.loc.gov/authorities/names/no"
VIAF_LABEL_SCOPE = "http://viaf.org/"
LOC_TOPIC_SCOPE = "http://id.loc.gov/"

# --- fixed values: markers, patterns and defaults ---
END_MARKER = "<|im_end|>"
ASSISTANT_MARKER = "<|assistant|>"
MIN_SENTENCE_SIZE = 10
ID_SEPARATOR = "_"
ID_FORBIDDEN = "/"
DEFAULT_CACHE_TYPE = "resource"
DEFAULT_CONTEXT = "nocontext"
LOCAL_TIME_ZONE = "Europe/Amsterdam"
WIKI_LINK_PREFIX = "https://wikipedia.org"
META_NAMESPACE_PATTERN = (
    "Wikipedia:|Help:|Special:|Portal:|Talk:|Privacy_policy|Main_Page|Template|"
    "Template_talk|erms_of_Use"
)
DATASET_MARKER = "dataset.xhtml?persistentId="
TOP_PLACES = 100
# Patterns that decide what counts as a key/value line and as a page reference.
KV_PATTERN = r'"(\S+)":\s+([^\n]+)'
PAGE_REF_PATTERN = r"//(\S+?)\.wikipedia.org/wiki/(\S+)"
