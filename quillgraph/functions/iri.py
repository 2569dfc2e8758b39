"""Prefix maps, compact IRIs and their resolution, as expressions on map columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The engine's own vocabulary. Pass another base where sidecars written elsewhere use it.
VOCABULARY = "urn:quillgraph:vocab/"

# Well-known prefixes that every document has.
BUILTIN_PREFIXES = {
    "schema": "http://schema.org/",
    "dc": "http://purl.org/dc/terms/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "wikidata": "http://www.wikidata.org/entity/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "sd": VOCABULARY,
}
# Prefixes that a sidecar does not declare.
UNWRITTEN_PREFIXES = ("rdf", "rdfs", "owl", "xsd", "wikidata", "skos", "foaf")
# Systems of external ids and their addresses.
EXTERNAL_SYSTEMS = ("wikidata", "doi", "orcid", "isbn", "issn")
EXTERNAL_URLS = {"wikidata": "http://www.wikidata.org/entity/", "doi": "https://doi.org/", "orcid": "https://orcid.org/"}

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"{}|\\^`]*$"


def seed_prefixes() -> Column:
    return F.create_map(*(F.lit(x) for pair in BUILTIN_PREFIXES.items() for x in pair))


def merge_prefixes(*maps: Column) -> Column:
    """Later maps override earlier ones, whatever the session's policy for equal keys is."""
    out = maps[0]
    for later in maps[1:]:
        later = F.coalesce(later, F.create_map().cast("map<string,string>"))
        out = F.map_concat(_without(out, later), later)
    return out


def _without(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k))


def is_iri(text: Column) -> Column:
    """An absolute IRI: a scheme, and none of the characters that IRIs forbid."""
    return text.rlike(_SCHEME)


def resolve(curie: Column, prefixes: Column) -> Column:
    """The IRI of a compact name, null if it has none: whole http(s) IRIs stay, a known prefix is replaced, all else fails."""
    prefix = F.substring_index(curie, ":", 1)
    local = F.substring(curie, F.length(prefix) + 2, F.length(curie))
    whole = F.when(is_iri(curie), curie)
    joined = F.concat(F.try_element_at(prefixes, prefix), local)
    return F.when(~F.contains(curie, F.lit(":")), whole).when(prefix.isin("http", "https"), whole).otherwise(F.when(is_iri(joined), joined))


def sorted_entries(prefixes: Column) -> Column:
    return F.array_sort(F.map_entries(prefixes))


def compact(iri: Column, prefixes: Column, brackets: bool = True) -> Column:
    """prefix:local by the alphabetically first prefix whose base the IRI starts with, else the IRI, in brackets for sidecars."""
    return compact_by(iri, sorted_entries(prefixes), brackets)


def compact_by(iri: Column, entries: Column, brackets: bool = True) -> Column:
    """`compact` by entries that are sorted already: once a document, not once a name."""
    first = F.filter(entries, lambda e: F.startswith(iri, e["value"]))
    name = F.concat(first[0]["key"], F.lit(":"), F.substring(iri, F.length(first[0]["value"]) + 1, F.length(iri)))
    return F.when(F.size(first) > 0, name).otherwise(F.concat(F.lit("<"), iri, F.lit(">")) if brackets else iri)


def compact_known(iri: Column) -> Column:
    """Only schema, dc and foaf are shortened, as views for people do."""
    out = iri
    for p in ("foaf", "dc", "schema"):
        base = BUILTIN_PREFIXES[p]
        out = F.when(F.startswith(iri, F.lit(base)), F.concat(F.lit(f"{p}:"), F.substring(iri, len(base) + 1, 1 << 20))).otherwise(out)
    return out


def local_name(iri: Column) -> Column:
    """After the last #, else after the last /, else all of it."""
    return F.when(F.contains(iri, F.lit("#")), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


def same_as(system: Column, identifier: Column) -> Column:
    """The address of an external id; systems without one give the id."""
    out = identifier
    for name, base in EXTERNAL_URLS.items():
        out = F.when(system == name, F.concat(F.lit(base), identifier)).otherwise(out)
    return out
