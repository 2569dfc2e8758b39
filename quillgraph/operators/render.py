"""Renderers: Turtle and JSON-LD as DataFrame plans over nodes, HTML with RDFa as one Arrow stage over each document's nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.iri import BUILTIN_PREFIXES, EXTERNAL_URLS, same_as, sorted_entries
from quillgraph.functions.text import escape_turtle, slugify, trim_text
from quillgraph.sources import markdown

LABEL, SAME_AS = BUILTIN_PREFIXES["rdfs"] + "label", BUILTIN_PREFIXES["owl"] + "sameAs"


def has_type(annotations: str = "annotations") -> Column:
    return F.exists(annotations, lambda a: a["kind"] == "type")


def bracketed(name: Column) -> Column:
    """Whole http(s) IRIs in brackets, compact names as they are."""
    return F.when(F.startswith(name, F.lit("http://")) | F.startswith(name, F.lit("https://")), F.concat(F.lit("<"), name, F.lit(">"))).otherwise(name)


def iri_or_name(a: Column) -> Column:
    return F.when(a["resolved_iri"].isNotNull(), F.concat(F.lit("<"), a["resolved_iri"], F.lit(">"))).otherwise(bracketed(a["raw"]))


def literal(text: Column) -> Column:
    return F.concat(F.lit('"'), escape_turtle(text), F.lit('"'))


def turtle_triples(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, pos, subject, predicate, object) of typed nodes, in Turtle's notation."""
    rows = nodes.where(has_type()).withColumn("label", trim_text(F.col("text_content")))
    by_text = F.concat(F.lit("<#"), slugify(F.col("label")), F.lit(">"))
    outside = F.filter("annotations", lambda a: (a["kind"] == "external") & a["system"].isin("wikidata", "doi"))
    subject = (
        F.when((F.col("kind") == "Section") & F.col("attr_id").isNotNull(), F.concat(F.lit("<#"), "attr_id", F.lit(">")))
        .when(F.col("kind") == "Section", by_text)
        .when((F.col("kind") == "InlineDirective") & (F.size(outside) > 0), F.concat(F.lit("<"), same_as(outside[0]["system"], outside[0]["value"]), F.lit(">")))
        .when(F.col("kind") == "InlineDirective", by_text)
        .otherwise("_:b0")
    )

    def one(a: Column) -> Column:
        predicate = F.when(a["kind"] == "type", F.lit("a")).when(a["kind"] == "property", iri_or_name(a)).when(a["kind"] == "external", F.lit(f"<{SAME_AS}>"))
        outer = F.when(a["system"].isin(*EXTERNAL_URLS), F.concat(F.lit("<"), same_as(a["system"], a["value"]), F.lit(">"))).otherwise(literal(a["value"]))
        return F.struct(predicate.alias("predicate"), F.when(a["kind"] == "type", iri_or_name(a)).when(a["kind"] == "property", literal(a["value"])).otherwise(outer).alias("object"))

    told = F.transform(F.filter("annotations", lambda a: a["kind"].isin("type", "property", "external")), one)
    label = F.when(F.col("label") != "", F.array(F.struct(F.lit(f"<{LABEL}>").alias("predicate"), literal(F.col("label")).alias("object")))).otherwise(F.expr("cast(array() as array<struct<predicate:string,object:string>>)"))
    return rows.select("doc_id", "node_id", subject.alias("subject"), F.posexplode(F.concat(told, label)).alias("pos", "t")).select("doc_id", "node_id", "pos", "subject", "t.predicate", "t.object")


def document_triples(headers: DataFrame) -> DataFrame:
    """What a header says about the document; a title counts only beside a type."""
    rows = headers.where(F.col("doc_type").isNotNull())
    kind = F.struct(F.lit("a").alias("predicate"), bracketed(F.col("doc_type")).alias("object"))
    title = F.when(F.col("title").isNotNull(), F.struct(F.lit("schema:name").alias("predicate"), literal(F.col("title")).alias("object")))
    told = F.filter(F.array(kind, title), lambda t: t.isNotNull())
    return rows.select("doc_id", F.lit(2147483647).alias("node_id"), F.lit("<>").alias("subject"), F.posexplode(told).alias("pos", "t")).select("doc_id", "node_id", "pos", "subject", "t.predicate", "t.object")


def group_by_subject(triples: DataFrame) -> DataFrame:
    """(doc_id, subject, first, pairs): pairs in order, subjects by where they are first seen."""
    grouped = triples.groupBy("doc_id", "subject").agg(F.min(F.struct("node_id", "pos")).alias("first"), F.array_sort(F.collect_list(F.struct("node_id", "pos", "predicate", "object"))).alias("pairs"))
    return grouped


def render_turtle(headers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, text) in Turtle."""
    grouped = group_by_subject(turtle_triples(nodes).unionByName(document_triples(headers)))
    block = F.concat("subject", F.lit(" "), F.array_join(F.transform("pairs", lambda p: F.concat(p["predicate"], F.lit(" "), p["object"])), " ;\n    "), F.lit(" .\n\n"))
    body = grouped.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", block.alias("block")))).alias("blocks"))
    head = F.array_join(F.transform(sorted_entries(F.col("prefixes")), lambda e: F.concat(F.lit("@prefix "), e["key"], F.lit(": <"), e["value"], F.lit("> .\n"))), "")
    return headers.join(body, "doc_id", "left").select("doc_id", F.concat(head, F.lit("\n"), F.coalesce(F.array_join("blocks.block", ""), F.lit(""))).alias("text"))


def jsonld_pairs(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, key, value): for each typed node, the last value that each key is given."""
    rows = nodes.where(has_type())
    named = F.col("kind").isin("Section", "InlineDirective") & (F.col("text_content") != "")

    def one(a: Column) -> Column:
        key = F.when(a["kind"] == "type", "@type").when(a["kind"] == "external", "owl:sameAs").otherwise(F.coalesce(a["resolved_iri"], a["raw"]))
        value = F.when(a["kind"] == "type", F.coalesce(a["resolved_iri"], a["raw"])).when(a["kind"] == "external", same_as(a["system"], a["value"])).otherwise(a["value"])
        return F.struct(key.alias("key"), value.alias("value"))

    told = F.transform(F.filter("annotations", lambda a: a["kind"].isin("type", "property", "external")), one)
    none = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    # A name from the text never replaces one that was given.
    given = F.exists(told, lambda t: t["key"] == "schema:name")
    name = F.when(named & ~given, F.array(F.struct(F.lit("schema:name").alias("key"), trim_text(F.col("text_content")).alias("value")))).otherwise(none)
    ident = F.when((F.col("kind") == "Section") & F.col("attr_id").isNotNull(), F.array(F.struct(F.lit("@id").alias("key"), F.concat(F.lit("#"), "attr_id").alias("value")))).otherwise(none)
    each = rows.select("doc_id", "node_id", F.posexplode(F.concat(told, name, ident)).alias("pos", "t"))
    return each.groupBy("doc_id", "node_id", F.col("t.key").alias("key")).agg(F.max_by("t.value", "pos").alias("value"))


def render_jsonld(headers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, text): JSON-LD with sorted keys; one object where a typed document is all there is, else a graph."""
    pairs = jsonld_pairs(nodes)
    none = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    part = lambda key, c: F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit(key).alias("key"), F.col(c).alias("value")))).otherwise(none)
    own = headers.select("doc_id", F.lit(-1).alias("node_id"), F.explode(F.concat(part("@type", "doc_type"), part("schema:name", "title"))).alias("t")).select("doc_id", "node_id", "t.*")
    objects = pairs.unionByName(own).groupBy("doc_id", "node_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("object"))
    graph = objects.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "object"))).alias("graph"))
    context = F.to_json(F.map_from_entries(sorted_entries(F.col("prefixes"))))
    each = F.coalesce(F.col("graph.object"), F.expr("cast(array() as array<string>)"))
    single = (F.size(each) == 1) & F.col("doc_type").isNotNull()
    flat = F.concat(F.lit('{"@context":'), context, F.lit(","), F.substring(each[0], 2, 1 << 30))
    text = F.when(single, flat).otherwise(F.concat(F.lit('{"@context":'), context, F.lit(',"@graph":['), F.array_join(each, ","), F.lit("]}")))
    return headers.join(graph, "doc_id", "left").select("doc_id", text.alias("text"))


# HTML -------------------------------------------------------------------------------------------


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def rdfa(notes: list[dict]) -> tuple[list[str], list[tuple[str, str]], list[str]]:
    """(types, properties, classes) of annotations."""
    name = lambda a: a["resolved_iri"] or a["raw"]
    return [name(a) for a in notes if a["kind"] == "type"], [(name(a), a["value"]) for a in notes if a["kind"] == "property"], [a["value"] for a in notes if a["kind"] == "css"]


class HtmlWriter:
    """HTML of one document's tree. Block kinds map to methods; what has none shows its children."""

    TAGS = {"Emphasis": "em", "Strong": "strong", "Strikethrough": "del"}

    def document(self, doc: markdown.Document) -> str:
        types = doc.header.get("doc_type")
        if types:
            types = markdown.resolve_name(types, doc.prefixes) or types
        title = f"<title>{_escape(doc.header['title'])}</title>\n" if doc.header.get("title") is not None else ""
        names = " ".join(f"{p}: {i}" for p, i in sorted(doc.prefixes.items()))
        body = f'<body typeof="{types}">' if types else "<body>"
        return f'<!DOCTYPE html>\n<html prefix="{names}">\n<head>\n<meta charset="utf-8">\n{title}</head>\n{body}\n{"".join(self.block(n, 0) for n in doc.nodes)}</body>\n</html>\n'

    def block(self, n: markdown.Node, depth: int) -> str:
        pad = "  " * depth
        method = getattr(self, f"_{n.kind.lower()}", None)
        return method(n, pad, depth) if method else "".join(self.block(c, depth) for c in n.children)

    def inline(self, nodes: list[markdown.Node]) -> str:
        return "".join(map(self._inline, nodes))

    def _inline(self, n: markdown.Node) -> str:
        v = n.values
        title = f' title="{_escape(v["title"])}"' if v.get("title") else ""
        if n.kind in self.TAGS:
            return f"<{self.TAGS[n.kind]}>{self.inline(n.children)}</{self.TAGS[n.kind]}>"
        return {
            "Text": lambda: _escape(v["text"]),
            "InlineCode": lambda: f"<code>{_escape(v['text'])}</code>",
            "Link": lambda: f'<a href="{v["dest"]}"{title}>{self.inline(n.children)}</a>',
            "Image": lambda: f'<img src="{v["dest"]}" alt="{_escape(markdown.text_content(n))}"{title} />',
            "SoftBreak": lambda: "\n",
            "HardBreak": lambda: "<br />",
            "InlineDirective": lambda: self.block(n, 0),
            "DirectiveBlock": lambda: self.block(n, 0),
        }.get(n.kind, lambda: self.inline(n.children))()

    def _meta(self, props: list[tuple[str, str]], pad: str) -> str:
        return "".join(f'{pad}  <meta property="{k}" content="{_escape(v)}" />\n' for k, v in props)

    def _section(self, n, pad, depth):
        types, props, classes = rdfa(n.annotations)
        tag = f"h{n.values['level']}"
        attrs = [f'{k}="{v}"' for k, v in (("id", n.values.get("attr_id")), ("typeof", " ".join(types)), ("class", " ".join(classes))) if v]
        shown = "".join(f" {a}" for a in attrs)
        text = self.inline(n.children)
        if not types and not props:
            return f"{pad}<{tag}{shown}>{text}</{tag}>\n"
        return f"{pad}<section{shown}>\n{pad}  <{tag}>{text}</{tag}>\n{self._meta(props, pad)}{pad}</section>\n"

    def _paragraph(self, n, pad, depth):
        return f"{pad}<p>{self.inline(n.children)}</p>\n"

    def _directiveblock(self, n, pad, depth):
        types, props, classes = rdfa(n.annotations)
        attrs = [f'{k}="{v}"' for k, v in (("typeof", " ".join(types)), ("class", " ".join(classes))) if v] + [f'data-directive="{n.values["name"]}"']
        return f"{pad}<div {' '.join(attrs)}>\n{self._inside(n, depth)}{self._meta(props, pad)}{pad}</div>\n"

    def _inlinedirective(self, n, pad, depth):
        types = rdfa(n.annotations)[0]
        attrs = [f'typeof="{" ".join(types)}"'] if types else []
        attrs += [f'about="{EXTERNAL_URLS.get(a["system"], "")}{a["value"]}"' for a in n.annotations if a["kind"] == "external"]
        return f"<span{''.join(f' {a}' for a in attrs)}>{self.inline(n.children)}</span>"

    def _codeblock(self, n, pad, depth):
        language = f' class="language-{n.values["language"]}"' if n.values.get("language") else ""
        return f"{pad}<pre><code{language}>{_escape(n.values['content'])}</code></pre>\n"

    def _inside(self, n, depth):
        return "".join(self.block(c, depth + 1) for c in n.children)

    def _blockquote(self, n, pad, depth):
        return f"{pad}<blockquote>\n{self._inside(n, depth)}{pad}</blockquote>\n"

    def _list(self, n, pad, depth):
        start = n.values.get("list_start")
        tag, attr = ("ul", "") if start is None else ("ol", f' start="{start}"')
        return f"{pad}<{tag}{attr}>\n{self._inside(n, depth)}{pad}</{tag}>\n"

    def _item(self, n, pad, depth):
        return f"{pad}<li>{self.inline(n.children)}</li>\n"

    def _rule(self, n, pad, depth):
        return f"{pad}<hr />\n"

    def _html(self, n, pad, depth):
        return f"{pad}{n.values['content']}\n"

    def _table(self, n, pad, depth):
        return f"{pad}<table>\n{self._inside(n, depth)}{pad}</table>\n"

    def _cells(self, n, tag):
        return "".join(f"<{tag}>{self.inline(c.children)}</{tag}>" for c in n.children)

    def _tablehead(self, n, pad, depth):
        return f"{pad}<thead>\n{pad}  <tr>{self._cells(n, 'th')}</tr>\n{pad}</thead>\n"

    def _tablerow(self, n, pad, depth):
        return f"{pad}<tr>{self._cells(n, 'td')}</tr>\n"


def render_html(docs: DataFrame) -> DataFrame:
    """(doc_id, text): HTML5 with RDFa of documents (doc_id, source)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [HtmlWriter().document(markdown.parse_text(s or "")) for s in batch["source"]]})

    return markdown.spread(docs.select(F.col("doc_id").cast("string"), F.col("source").cast("string"))).mapInPandas(run, "doc_id string, text string")


def _structured(render: Callable) -> Callable:
    def run(docs: DataFrame) -> DataFrame:
        return render(markdown.parse_headers(docs), markdown.parse_documents(docs))

    return run


#: name: (renderer of documents, content type, file extension). Other renderers are added here.
RENDERERS: dict[str, tuple[Callable[[DataFrame], DataFrame], str, str]] = {
    "html": (render_html, "text/html", "html"),
    "jsonld": (_structured(render_jsonld), "application/ld+json", "jsonld"),
    "turtle": (_structured(render_turtle), "text/turtle", "ttl"),
}
ALIASES = {"json-ld": "jsonld", "ttl": "turtle"}


def render(docs: DataFrame, form: str) -> DataFrame:
    name = ALIASES.get(form, form)
    if name not in RENDERERS:
        raise ValueError(f"unknown format: {form}")
    return RENDERERS[name][0](docs)


def extract(docs: DataFrame, form: str) -> DataFrame:
    """As `render`, for data formats only."""
    if ALIASES.get(form, form) == "html":
        raise ValueError(f"unknown format: {form}")
    return render(docs, form)


