"""Warnings about annotated documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.ontology import Registry


def validate_nodes(nodes: DataFrame, registry: Registry | None = None) -> DataFrame:
    """(doc_id, node_id, pos, kind, message): four kinds of warnings, each from one scan of the annotations."""
    registry = registry or Registry()
    # A directive without annotations is found beside the annotations of the others, so nodes are read once.
    none = F.expr("array(cast(null as struct<kind:string,resolved_iri:string,raw:string>))")
    told = F.transform("annotations", lambda a: F.struct(a["kind"].alias("kind"), a["resolved_iri"].alias("resolved_iri"), a["raw"].alias("raw")))
    bare = F.col("kind").isin("InlineDirective", "DirectiveBlock") & (F.size("annotations") == 0)
    rows = nodes.where(bare | (F.size("annotations") > 0))
    each = rows.select("doc_id", "node_id", F.col("kind").alias("node"), "name", F.posexplode(F.when(bare, none).otherwise(told)).alias("pos", "a"))
    raw, iri, kind = F.col("a.raw"), F.col("a.resolved_iri"), F.col("a.kind")
    colon = F.contains(raw, F.lit(":"))
    code = (
        F.when(F.col("a").isNull(), F.when(F.col("node") == "InlineDirective", "bare_inline").otherwise("bare_block"))
        .when((kind == "type") & iri.isNull() & colon, "type_curie")
        .when((kind == "type") & iri.isNotNull() & ~registry.knows_type(iri), "unknown_type")
        .when((kind == "property") & iri.isNull() & colon, "property_curie")
    )
    word = F.when(F.col("node") == "InlineDirective", "Inline").otherwise("Block")
    text = (
        F.when(F.col("code") == "type_curie", F.concat(F.lit("Could not resolve type CURIE: "), raw))
        .when(F.col("code") == "unknown_type", F.concat(F.lit("Type not found in registered ontologies: "), raw))
        .when(F.col("code") == "property_curie", F.concat(F.lit("Could not resolve property CURIE: "), raw))
        .otherwise(F.concat(word, F.lit(" directive '"), "name", F.lit("' has no semantic annotations")))
    )
    return each.withColumn("code", code).where("code is not null").select("doc_id", "node_id", "pos", F.col("code").alias("kind"), text.alias("message"))


def issue_counts(docs: DataFrame, warnings: DataFrame) -> DataFrame:
    """(doc_id, warnings, errors): errors are never raised, the column is there for the report."""
    n = warnings.groupBy("doc_id").agg(F.count("*").alias("warnings"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("warnings", F.lit(0)).alias("warnings"), F.lit(0).cast("long").alias("errors"))


def report(counts: DataFrame, level: str = "warning") -> DataFrame:
    """(doc_id, text): with level error only errors count."""
    shown = F.col("errors") if level == "error" else F.col("warnings") + F.col("errors")
    text = F.when(shown == 0, F.concat(F.lit("Valid: no issues found in "), "doc_id")).otherwise(F.format_string("%d warning(s), %d error(s) in %s", "warnings", "errors", "doc_id"))
    return counts.select("doc_id", text.alias("text"))
