"""Parser, attributes, sidecars, renderers on small inputs."""

import json

import pytest

from quillgraph.operators import render
from quillgraph.sources import attributes, files, markdown, sidecar

EVENT = """---
title: "Conf"
"@type": schema:Event
prefixes:
  ex: http://example.org/
---

# Conf {.schema:Event startDate=2026-09-09}

:entity[Ana Ruiz]{type=schema:Person wikidata=Q7} speaks in :entity[Zürich]{type=schema:Place}.

::: schema:Review
Very good.
:::
"""


def kinds(source):
    return [r[5] for r in markdown.node_rows("d", markdown.parse_text(source).nodes)]


def test_whole_document():
    doc = markdown.parse_text(EVENT)
    assert doc.header["title"] == "Conf" and doc.prefixes["ex"] == "http://example.org/"
    assert [n.kind for n in doc.nodes] == ["Section", "Paragraph", "DirectiveBlock"]
    person = doc.nodes[1].children[0]
    assert markdown.text_content(person) == "Ana Ruiz"
    assert [a["kind"] for a in person.annotations] == ["type", "external"]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("", []),
        ("a\n\nb", ["Paragraph", "Text", "Paragraph", "Text"]),
        ("**a *b* c**", ["Paragraph", "Strong", "Text", "Emphasis", "Text", "Text"]),
        ("- a\n- b", ["List", "Item", "Text", "Item", "Text"]),
        ("- a\n\n- b", ["List", "Item", "Paragraph", "Text", "Item", "Paragraph", "Text"]),
        ("1. a\n   - b", ["List", "Item", "Text", "List", "Item", "Text"]),
        ("> a\nb", ["BlockQuote", "Paragraph", "Text", "SoftBreak", "Text"]),
        ("***", ["Rule"]),
        ("a\n===", ["Section", "Text"]),
        ("[a](b) ![c](d)", ["Paragraph", "Link", "Text", "Text", "Image", "Text"]),
        ("[a]\n\n[a]: /u", ["Paragraph", "Link", "Text"]),
        ("::: x\n:::", ["DirectiveBlock"]),
        ("::: x\nopen to the end", ["DirectiveBlock", "Paragraph", "Text"]),
        ("snake_case_word", ["Paragraph", "Text"]),
        ("a  \nb", ["Paragraph", "Text", "HardBreak", "Text"]),
    ],
)
def test_kinds(source, expected):
    assert kinds(source) == expected


def test_subtree_ranges():
    rows = markdown.node_rows("d", markdown.parse_text("# a\n\n- b\n  - c *d*\n").nodes)
    for _, node, _parent, last, depth, *_ in rows:
        inside = [r for r in rows if r[1] > node and r[4] > depth and all(q[4] > depth for q in rows[node + 1 : r[1] + 1])]
        assert last == node + len(inside)


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("#a .b c=d", [("id", "a", None), ("class", "b", None), ("key", "c", "d")]),
        ('k="x \\"y\\" z" bare', [("key", "k", 'x "y" z'), ("class", "bare", None)]),
        ("# . =", []),
        ("", []),
        ('k="open', [("key", "k", "open")]),
    ],
)
def test_tokenize(raw, expected):
    assert attributes.tokenize(raw) == expected


def test_bad_header_is_empty():
    header, content = markdown.split_header("---\n: [\n---\nx")
    assert not any(header.values()) and content == "x"


SIDE = '@source-hash "sha256:0a0b" .\n@prefix x: <urn:x:> .\n_:a [3..9] a schema:Event ;\n  sd:snippet "a\\"é\\\\" ; x:p "v" ; x:q _:b .\n_:b [5..] .\n_:a x:r <urn:z> .\n'


def test_sidecar_parts():
    g = sidecar.SidecarParser(SIDE).parse()
    assert g["source_hash"] == "0a0b" + "0" * 60
    assert g["entities"] == [(0, "a", 3, 9, 'a"é\\', ["http://schema.org/Event"], 0), (1, "b", 5, None, "", [], 0)]
    assert [t[2:] for t in g["triples"]] == [("urn:x:p", "literal", "v"), ("urn:x:q", "entity", "b"), ("urn:x:r", "iri", "urn:z")]


@pytest.mark.parametrize("text", ["", "_:a [0..1] .", '@source-hash "md5:00" .', '@source-hash "sha256:00" .\n_:a [9..3] .', '@source-hash "sha256:00" .\n_:a x:p "open', '@source-hash "sha256:00" .\n_:a [0..1] zz:p "v" .'])
def test_sidecar_refuses(text):
    with pytest.raises(sidecar.SidecarError, match="line"):
        sidecar.SidecarParser(text).parse()


def test_sidecar_round_trip(spark):
    parsed = sidecar.parse_sidecars(spark.createDataFrame([("d", SIDE), ("bad", "x")], "doc_id string, text string"))
    assert {r["doc_id"]: r["error"] is None for r in parsed.collect()} == {"d": True, "bad": False}
    good = parsed.where("error is null")
    entities, triples = sidecar.entities_of(good), sidecar.triples_of(good)
    text = sidecar.serialize(good.select("doc_id", "source_hash", "prefixes"), entities, triples).first()["text"]
    again = sidecar.SidecarParser(text).parse()
    assert again["entities"] == sidecar.SidecarParser(SIDE).parse()["entities"]
    assert sorted(t[1:] for t in again["triples"]) == sorted(t[1:] for t in sidecar.SidecarParser(SIDE).parse()["triples"])


def test_renderers_agree(spark):
    docs = files.scan_text(spark, EVENT, "d")
    turtle = render.render(docs, "turtle").first()["text"]
    assert "<http://www.wikidata.org/entity/Q7> a <http://schema.org/Person> ;" in turtle and "<#zürich> a" in turtle
    graph = json.loads(render.render(docs, "json-ld").first()["text"])["@graph"]
    assert graph[0] == {"@type": "schema:Event", "schema:name": "Conf"} and len(graph) == 5
    html = render.render(docs, "html").first()["text"]
    assert '<body typeof="http://schema.org/Event">' in html and "<p>Very good.</p>" in html
    with pytest.raises(ValueError, match="format"):
        render.extract(docs, "html")


def test_single_object_is_flat(spark):
    made = render.render(files.scan_text(spark, '---\n"@type": schema:Event\n---\n\nplain\n'), "jsonld").first()["text"]
    assert json.loads(made)["@type"] == "schema:Event"


def test_workspace(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hidden").mkdir()
    for name in ("a/x.md", "y.md", ".hidden/z.md", "a/x.md.sem"):
        (tmp_path / name).write_text("x")
    rows = files.scan_workspace(spark, str(tmp_path)).collect()
    assert [(r["name"], r["has_sidecar"]) for r in rows] == [("x.md", True), ("y.md", False)]


def nodes_of(source):
    from quillgraph.sources import markdown

    return markdown.node_rows("d", markdown.parse_text(source).nodes)


def test_footnotes():
    """A definition is a Paragraph that holds its blocks, a reference is left out, and an unknown one is text."""
    rows = nodes_of("One[^1] and [^no] two.\n\n[^1]: note *here*\n    goes on\n\n    second block\n[^b]: other\n\nLast[^B].\n")
    kinds = [(r[5], r[4]) for r in rows]
    assert [k for k, depth in kinds if depth == 0] == ["Paragraph"] * 4
    assert "Link" not in {k for k, _ in kinds}
    texts = [r[12] for r in rows if r[5] == "Text"]
    assert "".join(texts) == "One and [^no] two.note heregoes onsecond blockotherLast."
    note = next(r for r in rows if r[4] == 0 and r[1] > 0)
    assert [r[5] for r in rows if r[2] == note[1]] == ["Paragraph", "Paragraph"]


def test_one_parse_of_nodes(spark):
    """Renderers and validation parse nodes once; annotated nodes carry their text."""
    from quillgraph.operators import render, validate
    from quillgraph.sources import markdown

    docs = spark.createDataFrame([(str(i), f"# T {i} {{.schema:Person}}\n\nx :a[b *c*]{{k=v}} :d[e]\n") for i in range(40)], "doc_id string, source string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    nodes = markdown.parse_documents(docs)
    assert plan(validate.validate_nodes(nodes)).count("MapInPandas") == 1
    assert plan(render.turtle_triples(nodes)).count("MapInPandas") == 1 and plan(render.jsonld_pairs(nodes)).count("MapInPandas") == 1
    assert nodes.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    found = {(r["kind"], r["text_content"]) for r in nodes.where("text_content is not null and doc_id = '7'").collect()}
    assert found == {("Section", "T 7"), ("InlineDirective", "b c")}


def test_agents_that_fail_on_rows_are_left_out(spark):
    from quillgraph.operators import blocks

    rows = [("d", "page", 0, "affine:note", None, ["b0"]), ("d", "b0", 1, "affine:paragraph", "Somewhere Overthere is it?", [])]
    df = spark.createDataFrame(rows, "doc_id string, block_id string, ord long, flavour string, text string, children array<string>")

    def broken(texts):
        def run(batches):
            for _ in batches:
                raise RuntimeError("no answer")
            yield from ()

        return texts.mapInPandas(run, blocks.QUESTIONS)

    agents = {"entity": blocks.entity_agent, "summary": blocks.summary_agent, "question": broken}
    assert {r["note_type"] for r in blocks.run_agents(df, agents).collect()} == {"entity", "summary"}
    assert blocks.run_agents(df, {"question": broken}).count() == 0


def test_types_of_a_relationship_block_come_first(spark):
    from quillgraph.sources import sidecar

    text = '@source-hash "sha256:00" .\n@prefix x: <urn:x:> .\n_:p x:n "v" ; a x:T .\n'
    triples = sidecar.triples_of(sidecar.parse_sidecars(spark.createDataFrame([("d", text)], "doc_id string, text string"))).orderBy("ord").collect()
    assert [(r["object_kind"], r["object_value"]) for r in triples] == [("iri", "urn:x:T"), ("literal", "v")]


def test_pieces_make_up_the_sidecar(spark):
    """Pieces are as long as one subject's statements, their texts are that of the document, and are read alike."""
    from pyspark.sql import functions as F

    body = "".join(f'_:e{i} [{i}..{i + 3 if i % 2 else ""}] a schema:Person ; sd:snippet "n\\"{i}" ; x:of _:e{i + 1} .\n\n' for i in range(300))
    text = '@source-hash "sha256:' + "ab" * 32 + '" .\n@prefix x: <urn:x:> .\n' + body + "".join(f'_:z{i} x:n "{i}" ;\n    x:in _:e1 .\n' for i in range(20))
    good = sidecar.parse_sidecars(spark.createDataFrame([("d", text), ("none", '@source-hash "sha256:00" .\n')], "doc_id string, text string"))
    e, t = sidecar.entities_of(good), sidecar.triples_of(good)
    overlay = good.select("doc_id", "source_hash", "prefixes")
    parts = sidecar.pieces(overlay, e, t)
    rows = sorted(parts.collect())
    assert max(len(r["text"]) for r in rows) < 300
    assert {d: "".join(r["text"] for r in rows if r["doc_id"] == d) for d in ("d", "none")} == {r["doc_id"]: r["text"] for r in sidecar.serialize(overlay, e, t).collect()}
    parsed = sidecar.whole(sidecar.parse_pieces(parts))
    order = ["section", "piece", "ord"]
    assert sidecar.entities_of(parsed).orderBy(*order).drop(*order).collect() == e.orderBy("ord").drop("ord").collect()
    assert sidecar.triples_of(parsed).orderBy(*order).drop(*order).collect() == t.orderBy("ord").drop("ord").collect()
    broken = parts.withColumn("text", F.when(F.col("ord") == 7, "_:e7 [7..").otherwise(F.col("text")))
    read = sidecar.parse_pieces(broken)
    assert [r["error"] for r in read.where("error is not null").collect()] == ["parse error at line 1, col 6: expected [start..end]"]
    assert sidecar.whole(read).count() == 0
    headless = sidecar.parse_pieces(parts.where("section > 0"))
    assert headless.where("error is null").count() == 0 and headless.count() == 320
