"""Block documents, agents that read them, and the notes that agents leave.

Blocks are rows (doc_id, block_id, ord, flavour, text, children). Agents are functions of
documents that return suggestions; the built-in ones are rules and call nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import block_id, note_text, trim_text
from quillgraph.plans.work import work_dir

NOTE_FLAVOUR = "quill:agent-note"
# Flavours that are analysed, and agents' ids, names, kinds and confidence.
TEXT_FLAVOURS = ("affine:paragraph", "affine:list")
CONTENT_PREFIX, NOTE_PARENT = "affine:", "affine:note"
AGENTS = {"entity": ("entity-detector", "Entity Detector"), "summary": ("summarizer", "Summarizer"), "question": ("question-gen", "Question Generator")}
SUMMARY_CONFIDENCE, QUESTION_CONFIDENCE, THRESHOLD = 1.0, 0.8, 0.6

ENTITIES = "doc_id string, block_id string, text_span string, entity_type string, confidence double, reasoning string"
SUMMARIES = "doc_id string, text string, topics array<string>"
NOTES = "doc_id string, after_block_id string, content string, confidence double, agent_id string, agent_name string, note_type string, accepted boolean"
QUESTIONS = "doc_id string, text string, source_block_id string, question_type string"


def text_for_analysis(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): `[id] text` lines of paragraphs and list items."""
    rows = blocks.where(F.col("flavour").isin(*TEXT_FLAVOURS) & F.col("text").isNotNull())
    line = F.concat(F.lit("["), "block_id", F.lit("] "), "text")
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("parts"))
    return parts.select("doc_id", F.array_join(F.col("parts.line"), "\n").alias("text"))


def last_content_block(blocks: DataFrame) -> DataFrame:
    rows = blocks.where(F.startswith("flavour", F.lit(CONTENT_PREFIX)))
    return rows.groupBy("doc_id").agg(F.max_by("block_id", "ord").alias("block_id"))


def parse_output(text: Column, schema: str, default: bool = True) -> Column:
    """An agent's JSON answer; a list that doesn't parse counts as empty, a summary that doesn't as null."""
    found = F.from_json(text, schema)
    return F.coalesce(found, F.from_json(F.lit("[]"), schema)) if default else found


def rule_entities(text: str) -> list[tuple[str, str, str, float, str]]:
    """Long capitalized words of a line `[id] text`, once each: two or more in a row are a person, one is a thing."""
    out = []
    for line in (text or "").split("\n"):
        m = re.match(r"\[([^\]]*)\] (.*)", line)
        for span in dict.fromkeys(re.findall(r"\b[A-ZÀ-Þ]\w{5,}(?: [A-ZÀ-Þ]\w+)*", m[2])) if m else ():
            pair = " " in span
            out.append((m[1], span, "schema:Person" if pair else "schema:Thing", 0.8 if pair else 0.7 if len(span) > 11 else 0.5, "capitalized words"))
    return out


def entity_agent(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(d, *e) for d, t in zip(batch["doc_id"], batch["text"]) for e in rule_entities(t)], columns=[c.split()[0] for c in ENTITIES.split(", ")])

    return texts.mapInPandas(run, ENTITIES)


def summary_agent(texts: DataFrame) -> DataFrame:
    """The first line without its id, and its longest words as topics."""
    first = F.regexp_replace(F.substring_index("text", "\n", 1), r"^\[[^\]]*\] ", "")
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(first), r"(?U)\W+"), lambda w: F.length(w) > 7)))
    return texts.where(trim_text(F.col("text")) != "").select("doc_id", F.left(first, F.lit(200)).alias("text"), F.slice(words, 1, 3).alias("topics"))


def question_agent(texts: DataFrame) -> DataFrame:
    """A question for each line that asks one, and for each long line."""
    rows = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.startswith("line", F.lit("[")) & (F.endswith("line", F.lit("?")) | (F.length("line") > 200)))
    return rows.select("doc_id", F.concat(F.lit("What follows from: "), F.left(F.regexp_replace("line", r"^\[[^\]]*\] ", ""), F.lit(80))).alias("text"), F.regexp_extract("line", r"^\[([^\]]*)\]", 1).alias("source_block_id"), F.when(F.endswith("line", F.lit("?")), "clarification").otherwise("exploration").alias("question_type"))


def run_agents(blocks: DataFrame, agents: dict[str, Callable[[DataFrame], DataFrame]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Notes (doc_id, note_id, after_block_id, agent_id, agent_name, note_type, content, confidence, accepted).

    Entities below the threshold leave no note. What an agent finds is written as it
    is run, so one that fails, as it is set up or on any row, is left out and the
    others still write; without any there are no notes. Ids depend on a note's content, so
    running again makes the same notes.
    """
    agents = agents or {"entity": entity_agent, "summary": summary_agent, "question": question_agent}
    spark = blocks.sparkSession
    texts = work_dir(spark, "agent-texts")
    text_for_analysis(blocks).where(trim_text(F.col("text")) != "").write.parquet(texts)
    texts = spark.read.schema("doc_id string, text string").parquet(texts)
    notes = [spark.createDataFrame([], NOTES)]
    for kind, agent in agents.items():
        try:
            found, path = agent(texts), work_dir(spark, f"agent-{kind}")
            found.write.parquet(path)
            found = spark.read.schema(found.schema).parquet(path)
        except Exception:  # noqa: BLE001, S112  whatever a plug-in raises
            continue
        if kind == "entity":
            rows = found.where(F.col("confidence") >= threshold).select("doc_id", F.col("block_id").alias("after_block_id"), note_text(F.col("entity_type"), F.col("text_span"), F.col("reasoning")).alias("content"), "confidence")
        elif kind == "summary":
            rows = found.join(last_content_block(blocks), "doc_id", "left").select("doc_id", F.col("block_id").alias("after_block_id"), F.col("text").alias("content"), F.lit(SUMMARY_CONFIDENCE).alias("confidence"))
        else:
            rows = found.select("doc_id", F.col("source_block_id").alias("after_block_id"), F.col("text").alias("content"), F.lit(QUESTION_CONFIDENCE).alias("confidence"))
        agent_id, name = AGENTS[kind]
        notes.append(rows.withColumns({"agent_id": F.lit(agent_id), "agent_name": F.lit(name), "note_type": F.lit(kind), "accepted": F.lit(False)}))
    out = notes[0]
    for more in notes[1:]:
        out = out.unionByName(more)
    return out.withColumn("note_id", block_id(F.col("doc_id"), F.col("agent_id"), F.coalesce("after_block_id", F.lit("")), F.col("content")))


def insert_notes(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """Blocks with notes among the children of the parent of the block that they follow, else of the first note block."""
    parents = blocks.select("doc_id", F.col("block_id").alias("parent"), F.posexplode("children").alias("pos", "after_block_id"))
    first = blocks.where(F.col("flavour") == NOTE_PARENT).groupBy("doc_id").agg(F.min_by("block_id", "ord").alias("first"))
    placed = notes.join(parents, ["doc_id", "after_block_id"], "left").join(first, "doc_id", "left")
    # Notes behind one block come last in, first after it, as each is put right behind the block.
    each = placed.select("doc_id", F.coalesce("parent", "first").alias("block_id"), F.struct(F.coalesce(F.col("pos"), F.lit(1 << 30)).alias("pos"), F.lit(1).alias("kind"), F.col("note_id").alias("id")).alias("c"))
    old = parents.select("doc_id", F.col("parent").alias("block_id"), F.struct("pos", F.lit(0).alias("kind"), F.col("after_block_id").alias("id")).alias("c"))
    children = each.unionByName(old).where("block_id is not null").groupBy("doc_id", "block_id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["id"]).alias("__children"))
    out = blocks.join(children, ["doc_id", "block_id"], "left").withColumn("children", F.coalesce("__children", "children")).drop("__children")
    last = blocks.groupBy("doc_id").agg(F.max("ord").alias("__last"))
    order = Window.partitionBy("doc_id").orderBy("note_id")
    new = notes.join(last, "doc_id").select("doc_id", F.col("note_id").alias("block_id"), (F.col("__last") + F.row_number().over(order)).cast(blocks.schema["ord"].dataType).alias("ord"), F.lit(NOTE_FLAVOUR).alias("flavour"), F.col("content").alias("text"), F.expr("cast(array() as array<string>)").alias("children"))
    return out.select("doc_id", "block_id", "ord", "flavour", "text", "children").unionByName(new)


def clear_notes(blocks: DataFrame) -> DataFrame:
    """Blocks without notes, and without their ids among children. The difference in rows is how many went."""
    ids = blocks.where(F.col("flavour") == NOTE_FLAVOUR).groupBy("doc_id").agg(F.collect_list("block_id").alias("__ids"))
    kept = blocks.where(F.col("flavour") != NOTE_FLAVOUR).join(ids, "doc_id", "left")
    return kept.withColumn("children", F.when(F.col("__ids").isNull(), F.col("children")).otherwise(F.filter("children", lambda c: ~F.array_contains(F.col("__ids"), c)))).drop("__ids")


def note_children_anti(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, child) of children that are no notes."""
    notes = blocks.where(F.col("flavour") == NOTE_FLAVOUR).select("doc_id", F.col("block_id").alias("child"))
    return blocks.select("doc_id", "block_id", F.explode("children").alias("child")).join(notes, ["doc_id", "child"], "left_anti")
