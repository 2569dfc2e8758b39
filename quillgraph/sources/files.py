"""Folders of markdown files and sidecars, templates, and sinks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import sidecar_path

SIDECAR = "sem"

# The templates that a new document starts from. {type}, {title} and {name} are filled in.
_HEAD = '---\ntitle: {title}\n"@type": schema:{type}\nprefixes:\n  schema: http://schema.org/\n---\n\n'
TEMPLATES = {
    "article": _HEAD.format(title="My Article", type="Article") + "# My Article {.schema:Article}\n\nYour content here.\n",
    "event": _HEAD.format(title="My Event", type="Event") + "# My Event {.schema:Event startDate=2026-01-01 endDate=2026-01-02}\n\nEvent description here.\n",
    "review": _HEAD.format(title="My Review", type="Review") + "# My Review {.schema:Review}\n\n::: schema:Review\nYour review content here.\n:::\n",
    "person": _HEAD.format(title="About Me", type="Person") + "# About Me {.schema:Person}\n\n:entity[Your Name]{type=schema:Person}\n",
}


def scan_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, source) of every markdown file at or below a path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))


def scan_text(spark: SparkSession, source: str, name: str = "-") -> DataFrame:
    """One document given as text."""
    return spark.createDataFrame([(name, name, source)], "doc_id string, path string, source string")


def scan_workspace(spark: SparkSession, path: str, extension: str = SIDECAR) -> DataFrame:
    """(name, path, has_sidecar) of markdown files outside folders whose name begins with a dot, by path.

    Files are only listed, not read. A sidecar may be named after the whole file
    name or in place of its suffix.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    below = F.regexp_replace("path", r"^\w*:?/*" + re.escape(re.sub(r"^\w*:?/*", "", path).rstrip("/")), "")
    shown = listed.where(~below.rlike(r"/\.[^/]*/"))
    docs = shown.where(F.endswith("path", F.lit(".md")))
    sides = listed.where(F.endswith("path", F.lit(f".{extension}"))).select("path")
    a, b = (sidecar_path(F.col("path"), extension, keep).alias(n) for keep, n in ((True, "a"), (False, "b")))
    both = docs.select("path", F.explode(F.array(a, b)).alias("side")).join(sides.withColumnRenamed("path", "side"), "side", "left_semi").select("path").distinct().withColumn("has_sidecar", F.lit(True))
    return docs.join(both, "path", "left").select(F.substring_index("path", "/", -1).alias("name"), "path", F.coalesce("has_sidecar", F.lit(False)).alias("has_sidecar")).orderBy("path")


def has_sidecar(docs: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Documents (path) that have a sidecar (path) beside them."""
    keyed = docs.withColumn("__side", sidecar_path(F.col("path")))
    return keyed.join(sidecars.select(F.col("path").alias("__side")), "__side", "left_semi").drop("__side")


def previous_versions(versions: DataFrame) -> DataFrame:
    """(doc_id, version, old_source, new_source): each version of a document with the one before it."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("version")
    return versions.select("doc_id", "version", F.lag("source").over(order).alias("old_source"), F.col("source").alias("new_source"))


def template(kind: Column) -> Column:
    """The template of a kind; unknown kinds have the article's."""
    known = F.create_map(*(F.lit(x) for p in TEMPLATES.items() for x in p))
    return F.coalesce(F.try_element_at(known, kind), F.lit(TEMPLATES["article"]))


def empty_sidecars(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of sidecars without entities, for documents (doc_id, source)."""
    from quillgraph.functions.iri import seed_prefixes
    from quillgraph.functions.text import source_hash
    from quillgraph.sources.sidecar import prefix_lines

    head = F.concat(F.lit('@source-hash "sha256:'), source_hash(F.col("source")), F.lit('" .\n'))
    return docs.select("doc_id", F.concat(head, prefix_lines(seed_prefixes()), F.lit("\n")).alias("text"))


def write_texts(rendered: DataFrame, path: str, overwrite: bool = True) -> None:
    """Write (doc_id, text) as a table of texts by document; without overwrite an existing one is an error."""
    rendered.select("doc_id", "text").write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
