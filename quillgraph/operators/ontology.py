"""Ontologies as small dimension frames, and validation against them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.iri import BUILTIN_PREFIXES

# Value types of properties. "E:x" is an entity of type x of the same ontology.
SCHEMA_PROPERTIES = """
name Text, description Text, url Url, image Url, datePublished Date, dateModified Date, dateCreated Date, author E:Person,
creator E:Person, publisher E:Organization, startDate Date, endDate Date, location E:Place, performer E:Person, attendee E:Person,
organizer E:Organization, reviewBody Text, ratingValue Float, bestRating Float, worstRating Float, itemReviewed E:Thing, price Text,
priceCurrency Text, brand E:Organization, headline Text, articleBody Text, wordCount Integer, genre Text, inLanguage Text,
keywords Text, about E:Thing, email Text, telephone Text, address E:PostalAddress, jobTitle Text, memberOf E:Organization,
duration Text, identifier Text, sameAs Url
"""
DC_PROPERTIES = """
title Text, creator Text, subject Text, description Text, publisher Text, contributor Text, date Date, type Text, format Text,
identifier Text, source Url, language Text, relation Url, coverage Text, rights Text
"""
FOAF_PROPERTIES = """
name Text, mbox Url, homepage Url, knows E:Person, member E:Agent, depiction Url, nick Text, title Text, firstName Text,
lastName Text, age Integer, interest E:Document
"""
SD_PROPERTIES = "role E:Section, snippet Text"
# Type < parent: own properties.
SCHEMA_TYPES = """
Thing: name description url image identifier sameAs
CreativeWork < Thing: author creator publisher datePublished dateModified dateCreated headline keywords inLanguage genre about
Article < CreativeWork: articleBody wordCount
BlogPosting < Article:
Event < Thing: startDate endDate location performer attendee organizer duration
Person < Thing: email telephone jobTitle memberOf
Organization < Thing: email telephone address
Place < Thing: address telephone
Product < Thing: brand price priceCurrency
Review < CreativeWork: reviewBody ratingValue bestRating worstRating itemReviewed
HowTo < CreativeWork: duration
FAQPage < CreativeWork:
Recipe < HowTo: duration
Course < CreativeWork:
Book < CreativeWork:
Movie < CreativeWork: duration
MusicRecording < CreativeWork: duration
SoftwareApplication < CreativeWork:
WebPage < CreativeWork:
ImageObject < CreativeWork:
VideoObject < CreativeWork: duration
PostalAddress < Thing:
"""
FOAF_TYPES = """
Agent: name mbox homepage
Person < Agent: name mbox homepage knows nick title firstName lastName age depiction interest
Organization < Agent: name mbox homepage member
Document:
Image < Document: depiction
"""
SD_TYPES = """
Section: role snippet
Paragraph: role snippet
Review:
Abstract:
Argument:
Summary:
Comparison:
Example:
"""


@dataclass
class Ontology:
    """A provider: types with parents and own properties, and properties with value types."""

    prefix: str
    base: str
    types: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)

    @classmethod
    def read(cls, prefix: str, base: str, types: str, properties: str) -> Ontology:
        found = {}
        for line in filter(None, map(str.strip, types.splitlines())):
            head, _, own = line.partition(":")
            name, _, parents = head.partition("<")
            found[name.strip()] = (parents.split(), own.split())
        return cls(prefix, base, found, dict(p.split() for p in properties.replace("\n", " ").split(",")))


def builtins() -> dict[str, Ontology]:
    b = BUILTIN_PREFIXES
    given = [("schema", SCHEMA_TYPES, SCHEMA_PROPERTIES), ("dc", "", DC_PROPERTIES), ("foaf", FOAF_TYPES, FOAF_PROPERTIES), ("sd", SD_TYPES, SD_PROPERTIES)]
    return {p: Ontology.read(p, b[p], t, q) for p, t, q in given}


class Registry:
    """Ontologies by prefix; registering a prefix again replaces it. Frames are small and fixed, so joins with them are broadcast."""

    def __init__(self, ontologies: dict[str, Ontology] | None = None):
        self.ontologies = dict(builtins() if ontologies is None else ontologies)

    def register(self, ontology: Ontology) -> Registry:
        self.ontologies[ontology.prefix] = ontology
        return self

    def prefixes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(o.prefix, o.base) for o in self.ontologies.values()], "prefix string, base string")

    def types(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(o.prefix, t, o.base + t, [o.base + p for p in parents]) for o in self.ontologies.values() for t, (parents, _) in o.types.items()], "prefix string, type string, iri string, parents array<string>")

    def properties(self, spark: SparkSession) -> DataFrame:
        rows = [(o.prefix, p, o.base + p, "Entity" if v[:2] == "E:" else v, o.base + v[2:] if v[:2] == "E:" else None) for o in self.ontologies.values() for p, v in o.properties.items()]
        return spark.createDataFrame(rows, "prefix string, property string, iri string, expected string, entity_iri string")

    def type_properties(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(o.base + t, o.base + p) for o in self.ontologies.values() for t, (_, own) in o.types.items() for p in own], "type_iri string, property_iri string")

    def allowed(self, exact: bool = False) -> set[tuple[str, str]]:
        """(type, property) pairs by IRI: own properties and those of parents, or of all ancestors where exact."""
        out = set()
        for o in self.ontologies.values():
            for t in o.types:
                seen, todo = {t}, list(o.types[t][0])
                while todo:
                    p = todo.pop()
                    if p not in seen and p in o.types:
                        seen.add(p)
                        todo += o.types[p][0] if exact else []
                out |= {(o.base + t, o.base + p) for s in seen for p in o.types[s][1]}
        return out

    def validate_properties(self, pairs: DataFrame, exact: bool = False) -> DataFrame:
        """Adds `verdict` to rows of (type_iri, property_iri): unknown type first, then valid, then known elsewhere, then unknown."""
        spark = pairs.sparkSession
        known_types = self.types(spark).select(F.col("iri").alias("type_iri"), F.lit(True).alias("__type"))
        known_props = self.properties(spark).select(F.col("iri").alias("property_iri"), F.lit(True).alias("__property")).distinct()
        allowed = spark.createDataFrame(sorted(self.allowed(exact)), "type_iri string, property_iri string").withColumn("__allowed", F.lit(True))
        out = pairs.join(F.broadcast(known_types), "type_iri", "left").join(F.broadcast(known_props), "property_iri", "left").join(F.broadcast(allowed), ["type_iri", "property_iri"], "left")
        verdict = F.when(F.col("__type").isNull(), "UnknownType").when(F.col("__allowed"), "Valid").when(F.col("__property"), "NotDefinedForType").otherwise("UnknownProperty")
        return out.select(*pairs.columns, verdict.alias("verdict"))

    def base_of(self, iri: Column) -> Column:
        """The prefix of the provider whose base an IRI starts with; the longest base counts."""
        out = F.lit(None).cast("string")
        for o in sorted(self.ontologies.values(), key=lambda o: len(o.base)):
            out = F.when(F.startswith(iri, F.lit(o.base)), F.lit(o.prefix)).otherwise(out)
        return out

    def knows_type(self, iri: Column) -> Column:
        return F.coalesce(iri.isin([o.base + t for o in self.ontologies.values() for t in o.types]), F.lit(False))

    def search_types(self, spark: SparkSession, text: str, limit: int = 50) -> DataFrame:
        return self.types(spark).where(F.contains(F.lower("type"), F.lit(text.lower()))).orderBy("prefix", "type").limit(limit)
