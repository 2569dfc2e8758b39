"""Attribute lists `{#id .class key=value key="quoted"}` and directives: patterns, a tokenizer, and native extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.iri import EXTERNAL_SYSTEMS, resolve

# The syntax of directives and of prefixes given as link references.
INLINE_DIRECTIVE = r":([a-zA-Z][\w-]*)\[([^\]]*)\](?:\{([^}]*)\})?"
BLOCK_DIRECTIVE = r"^:::\s+(\S+)(?:\s+\{([^}]*)\})?\s*$"
LINK_PREFIX = r"^\[([a-zA-Z][\w-]*)\]:\s*<([^>]+)>\s*$"

ANNOTATIONS = "array<struct<kind:string,resolved_iri:string,raw:string,value:string,system:string>>"
_TOKEN = re.compile(r'#(?P<id>[^\s=]*)|\.(?P<cls>[^\s=]*)|(?P<key>[^\s=]+)(?:=(?:"(?P<quoted>(?:\\.|[^"\\])*)(?:"|\\?$)|(?P<value>[^\s=]*)))?|=', re.S)
_BASIC_IRI = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>\"{}|\\^`]*")


def resolve_name(name: str, prefixes: dict[str, str]) -> str | None:
    """As `functions.iri.resolve`, for parsers."""
    prefix, colon, local = name.partition(":")
    if not colon or prefix in ("http", "https"):
        iri = name
    elif prefix in prefixes:
        iri = prefixes[prefix] + local
    else:
        return None
    return iri if _BASIC_IRI.fullmatch(iri) else None


def tokenize(raw: str) -> list[tuple[str, str, str | None]]:
    """(kind, name, value) of kinds id, class and key. A bare word is a class; empty names are dropped."""
    out, at = [], 0
    while at < len(raw):
        if raw[at].isspace():
            at += 1
            continue
        m = _TOKEN.match(raw, at)
        at = m.end()
        if m["id"]:
            out.append(("id", m["id"], None))
        elif m["cls"]:
            out.append(("class", m["cls"], None))
        elif m["key"] is not None:
            if m["quoted"] is not None:
                out.append(("key", m["key"], re.sub(r"\\(.)", r"\1", m["quoted"], flags=re.S)))
            elif m["value"] is not None:
                out.append(("key", m["key"], m["value"]))
            else:
                out.append(("class", m["key"], None))
    return out


def annotation(kind: str, iri: str | None = None, raw: str | None = None, value: str | None = None, system: str | None = None) -> dict:
    return {"kind": kind, "resolved_iri": iri, "raw": raw, "value": value, "system": system}


def classify(tokens: list[tuple[str, str, str | None]], prefixes: dict[str, str], external: bool = True) -> list[dict]:
    """Annotations of tokens. Headings know no external ids: their keys are properties."""
    out = []
    for kind, name, value in tokens:
        if kind == "id":
            out.append(annotation("id", value=name))
        elif kind == "class":
            out.append(annotation("type", resolve_name(name, prefixes), name) if ":" in name else annotation("css", value=name))
        elif name in ("type", "@type"):
            out.append(annotation("type", resolve_name(value, prefixes), value))
        elif external and name in EXTERNAL_SYSTEMS:
            out.append(annotation("external", value=value, system=name))
        else:
            out.append(annotation("property", resolve_name(name, prefixes), name, value))
    return out


def tokens_native(attrs: Column) -> Column:
    """The tokens of attribute text without escapes or stray equal signs, as an array of struct(kind, name, value), in codegen."""
    words = F.regexp_extract_all(F.coalesce(attrs, F.lit("")), F.lit(r'([^\s="]+="[^"]*"|[^\s]+)'), F.lit(1))

    def token(w: Column) -> Column:
        name = F.substring_index(w, "=", 1)
        value = F.regexp_replace(F.substring(w, F.length(name) + 2, F.length(w)), '^"|"$', "")
        head = F.left(w, F.lit(1))
        kind = F.when(head == "#", "id").when(head == ".", "class").when(F.contains(w, F.lit("=")), "key").otherwise("class")
        return F.struct(kind.alias("kind"), F.when(head.isin("#", "."), F.substring(w, 2, 1 << 20)).otherwise(name).alias("name"), F.when(kind == "key", value).alias("value"))

    return F.filter(F.transform(words, token), lambda t: t["name"] != "")


def classify_native(token: Column, prefixes: Column, external: bool = True) -> Column:
    """The annotation of one token."""
    name, value, kind = token["name"], token["value"], token["kind"]
    none = F.lit(None).cast("string")

    def make(k: str, iri: Column = none, raw: Column = none, val: Column = none, system: Column = none) -> Column:
        return F.struct(F.lit(k).alias("kind"), iri.alias("resolved_iri"), raw.alias("raw"), val.alias("value"), system.alias("system"))

    is_external = name.isin(*EXTERNAL_SYSTEMS) if external else F.lit(False)
    return (
        F.when(kind == "id", make("id", val=name))
        .when((kind == "class") & F.contains(name, F.lit(":")), make("type", resolve(name, prefixes), name))
        .when(kind == "class", make("css", val=name))
        .when(name.isin("type", "@type"), make("type", resolve(value, prefixes), value))
        .when(is_external, make("external", val=value, system=name))
        .otherwise(make("property", resolve(name, prefixes), name, value))
    )


def lines(docs: DataFrame, text: str = "content") -> DataFrame:
    """(doc_id, line_no, line); a carriage return before the newline and the last newline are no part of a line."""
    whole = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r?\n\z", "")
    return docs.select("doc_id", F.posexplode(F.split(whole, r"\r?\n")).alias("line_no", "line"))


def block_starts(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, name, attrs_raw) of lines that start a block directive."""
    return rows.where(F.col("line").rlike(BLOCK_DIRECTIVE)).select("doc_id", "line_no", F.regexp_extract("line", BLOCK_DIRECTIVE, 1).alias("name"), F.regexp_extract("line", BLOCK_DIRECTIVE, 2).alias("attrs_raw"))


def link_prefixes(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, prefix, iri) of lines that give a prefix."""
    return rows.where(F.col("line").rlike("(?U)" + LINK_PREFIX)).select("doc_id", "line_no", F.regexp_extract("line", "(?U)" + LINK_PREFIX, 1).alias("prefix"), F.regexp_extract("line", "(?U)" + LINK_PREFIX, 2).alias("iri"))


def inline_directives(rows: DataFrame) -> DataFrame:
    """(doc_id, line_no, pos, name, content, attrs_raw) of inline directives, by regular expressions alone."""
    pattern = F.lit("(?U)" + INLINE_DIRECTIVE)
    found = rows.where(F.contains("line", F.lit("[")) & ~F.col("line").rlike("(?U)" + LINK_PREFIX) & ~F.col("line").rlike(BLOCK_DIRECTIVE))
    parts = F.arrays_zip(*(F.regexp_extract_all("line", pattern, F.lit(k)).alias(n) for k, n in ((1, "name"), (2, "content"), (3, "attrs_raw"))))
    return found.select("doc_id", "line_no", F.posexplode(parts).alias("pos", "d")).select("doc_id", "line_no", "pos", *(F.col(f"d.{k}").alias(n) for k, n in (("name", "name"), ("content", "content"), ("attrs_raw", "attrs_raw"))))


def rewrite_inline(line: Column) -> Column:
    """Inline directives as spans; their number is put in by `directive_numbers`."""
    return F.regexp_replace(line, "(?U)" + INLINE_DIRECTIVE, '<span data-sd="">$2</span>')
