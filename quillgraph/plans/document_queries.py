"""Queries over annotated documents: headers, directives, annotations, nodes, validation and rendering.

The documents are made from `customer` and `nation` (`corpus.customer_documents`), so SQL over these tables says what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions.iri import seed_prefixes
from quillgraph.operators import render, validate
from quillgraph.plans.corpus import customer_documents, table
from quillgraph.plans.work import work_dir
from quillgraph.sources import attributes, files, markdown, sidecar

ALL: dict = {}
#: Each customer with its nation, and whether its document has a header.
C = "c AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS doc_id, c_name, c_mktsegment AS seg, c_nationkey AS nk, n_name, c_custkey % 11 <> 0 AS headed FROM customer JOIN nation ON c_nationkey = n_nationkey)"
SCHEMA = "http://schema.org/"


def query(name: str, sql: str | None = None):
    def put(fn):
        ALL[name] = (fn, sql)
        return fn

    return put


def docs(spark, sf):
    return customer_documents(spark, sf)


def parsed(spark, sf):
    return markdown.parse_documents(docs(spark, sf))


def contents(spark, sf):
    return markdown.parse_headers(docs(spark, sf)).select("doc_id", "content", "prefixes")


def annotations(spark, sf):
    return parsed(spark, sf).select("doc_id", "node_id", F.col("kind").alias("node"), "name", F.posexplode("annotations").alias("pos", "a")).select("doc_id", "node_id", "node", "name", "pos", "a.*")


# Sources ----------------------------------------------------------------------------------------

@query("scan_markdown", f"WITH {C} SELECT count(*) AS n, count(*) FILTER (headed) AS n_headed FROM c")
def scan_markdown(spark, sf):
    folder = work_dir(spark, "workspace")
    docs(spark, sf).select("source").repartition(4).write.text(folder, lineSep="\x00")
    # Documents are told apart by the separator, so one file holds many.
    read = spark.read.text(folder, lineSep="\x00")
    return read.agg(F.count("*").alias("n"), F.count_if(F.startswith("value", F.lit("---"))).alias("n_headed"))


@query("scan_stdin", "SELECT 'Section' AS kind, 1 AS n")
def scan_stdin(spark, sf):
    return markdown.parse_documents(files.scan_text(spark, "# Title\n")).groupBy("kind").agg(F.count("*").alias("n")).where("kind = 'Section'")


@query("scan_workspace", "SELECT true AS ok")
def scan_workspace(spark, sf):
    # The folder of the tables holds no markdown file: the listing is empty.
    return files.scan_workspace(spark, sf).agg((F.count("*") == 0).alias("ok"))


ALL["sort_files"] = (lambda spark, sf: docs(spark, sf).select("path").orderBy("path").select("path"), f"WITH {C} SELECT '/docs/' || doc_id || '.md' AS path FROM c ORDER BY path")


@query("scan_frontmatter", f"WITH {C} SELECT doc_id, CASE WHEN headed THEN 'Account ' || k END AS title, CASE WHEN headed AND k % 4 <> 1 THEN 'schema:Person' END AS doc_type, CASE WHEN headed THEN '{{\"year\": ' || k % 7 || '}}' ELSE '{{}}' END AS extra FROM c")
def scan_frontmatter(spark, sf):
    return markdown.parse_headers(docs(spark, sf)).select("doc_id", "title", "doc_type", "extra")


@query("pod_to_json", f"WITH {C} SELECT doc_id, CASE WHEN headed THEN (k % 7)::BIGINT END AS year FROM c")
def pod_to_json(spark, sf):
    h = markdown.parse_headers(docs(spark, sf))
    return h.select("doc_id", F.expr("try_variant_get(parse_json(extra), '$.year', 'bigint')").alias("year"))


# Pre-processing ---------------------------------------------------------------------------------

@query("extract_link_prefixes", f"WITH {C} SELECT doc_id, 'ex' AS prefix, 'http://example.org/ex/' AS iri FROM c WHERE k % 2 = 0")
def extract_link_prefixes(spark, sf):
    return attributes.link_prefixes(attributes.lines(contents(spark, sf))).select("doc_id", "prefix", "iri")


@query("extract_block_directives", f"""WITH {C} SELECT doc_id, 'schema:Review' AS name, 'Segment *' || seg || '* and `code`.' AS content, 'ratingValue=' || k % 5 || ' author="A \\"' || k || '\\" B"' AS attrs_raw FROM c""")
def extract_block_directives(spark, sf):
    return markdown.extract_all_directives(contents(spark, sf)).where("is_block").select("doc_id", "name", "content", "attrs_raw")


INLINE_SQL = f"""WITH {C}, d AS (SELECT doc_id, 0 AS i, 'entity' AS name, c_name AS content, 'type=schema:Person wikidata=Q' || k AS attrs_raw FROM c UNION ALL SELECT doc_id, 1, 'place', n_name, CASE WHEN k % 5 = 0 THEN '' ELSE '.schema:Place tp:code=' || nk || ' no:such=x #here' END FROM c UNION ALL SELECT doc_id, 3, 'mark', 'two', '.zz:Odd' FROM c)"""


@query("extract_inline_directives", INLINE_SQL + " SELECT doc_id, name, content, attrs_raw FROM d")
def extract_inline_directives(spark, sf):
    """Regular expressions alone: no Python touches a row but the header split."""
    content = F.regexp_replace("source", r"(?s)\A---\n.*?\n---\n", "")
    found = attributes.inline_directives(attributes.lines(docs(spark, sf).select("doc_id", content.alias("content"))))
    return found.select("doc_id", "name", "content", "attrs_raw")


@query("directive_numbering", INLINE_SQL.replace("SELECT doc_id, 3, 'mark'", "SELECT doc_id, 2, 'schema:Review', '', '' FROM c UNION ALL SELECT doc_id, 3, 'mark'") + " SELECT doc_id, 'SD000' || i + 1 AS directive_id, name FROM d")
def directive_numbering(spark, sf):
    return markdown.extract_all_directives(contents(spark, sf)).select("doc_id", "directive_id", "name")


@query("rewrite_inline_directives", f"WITH {C} SELECT doc_id, 'The <span data-sd=\"\">' || c_name || '</span> lives in é <span data-sd=\"\">' || n_name || '</span>.' AS line FROM c")
def rewrite_inline_directives(spark, sf):
    rows = attributes.lines(contents(spark, sf)).where(F.startswith("line", F.lit("The :")))
    return rows.select("doc_id", attributes.rewrite_inline(F.col("line")).alias("line"))


# Annotations ------------------------------------------------------------------------------------

@query("tokenize_attrs", f"WITH {C} SELECT doc_id, t.kind, t.name, CASE t.name WHEN 'type' THEN 'schema:Person' WHEN 'wikidata' THEN 'Q' || k WHEN 'tp:code' THEN nk::VARCHAR WHEN 'no:such' THEN 'x' END AS value FROM c, (VALUES ('key', 'type', 0), ('key', 'wikidata', 0), ('class', 'schema:Place', 1), ('key', 'tp:code', 1), ('key', 'no:such', 1), ('id', 'here', 1), ('class', 'zz:Odd', 0)) t(kind, name, p) WHERE p = 0 OR k % 5 <> 0")
def tokenize_attrs(spark, sf):
    found = extract_inline_directives(spark, sf)
    return found.select("doc_id", F.explode(attributes.tokens_native(F.col("attrs_raw"))).alias("t")).select("doc_id", "t.kind", "t.name", "t.value")


@query("classify_annotation", f"""WITH {C} SELECT doc_id, t.kind, CASE t.kind WHEN 'css' THEN NULL ELSE t.iri END AS resolved_iri, t.raw FROM c, (VALUES ('type', '{SCHEMA}Person', 'schema:Person', 0), ('external', NULL, NULL, 0), ('type', '{SCHEMA}Place', 'schema:Place', 1), ('property', 'http://example.org/tp/code', 'tp:code', 1), ('property', NULL, 'no:such', 1), ('id', NULL, NULL, 1), ('type', NULL, 'zz:Odd', 0)) t(kind, iri, raw, p) WHERE (p = 0 OR k % 5 <> 0)""")
def classify_annotation(spark, sf):
    prefixes = F.map_concat(seed_prefixes(), F.create_map(F.lit("tp"), F.lit("http://example.org/tp/")))
    tokens = extract_inline_directives(spark, sf).select("doc_id", F.explode(attributes.tokens_native(F.col("attrs_raw"))).alias("t"))
    return tokens.select("doc_id", attributes.classify_native(F.col("t"), prefixes).alias("a")).select("doc_id", "a.kind", "a.resolved_iri", "a.raw")


@query("heading_annotations", f"""WITH {C} SELECT doc_id, pos, t.kind, CASE pos WHEN 0 THEN '{SCHEMA}Organization' WHEN 2 THEN CASE WHEN headed THEN 'http://example.org/tp/segment' END END AS resolved_iri, CASE pos WHEN 1 THEN 'featured' WHEN 2 THEN seg WHEN 3 THEN '2026' END AS value FROM c, (VALUES (0, 'type'), (1, 'css'), (2, 'property'), (3, 'property')) t(pos, kind)""")
def heading_annotations(spark, sf):
    return annotations(spark, sf).where("node = 'Section'").select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", "resolved_iri", "value")


@query("block_name_as_type", f"""WITH {C} SELECT doc_id, pos, t.kind, CASE pos WHEN 0 THEN '{SCHEMA}Review' END AS resolved_iri, CASE pos WHEN 1 THEN (k % 5)::VARCHAR WHEN 2 THEN 'A "' || k || '" B' END AS value FROM c, (VALUES (0, 'type'), (1, 'property'), (2, 'property')) t(pos, kind)""")
def block_name_as_type(spark, sf):
    return annotations(spark, sf).where("node = 'DirectiveBlock'").select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", "resolved_iri", "value")


# Trees ------------------------------------------------------------------------------------------

#: Nodes of a document without the empty ones: kind and how many.
COUNTS = "('Section', 1), ('Paragraph', 2), ('InlineDirective', 3), ('DirectiveBlock', 1), ('Emphasis', 1), ('InlineCode', 1), ('List', 1), ('Item', 2)"


@query("parse_document", f"WITH {C} SELECT doc_id, kind, n::BIGINT AS n FROM c, (VALUES {COUNTS}) t(kind, n)")
def parse_document(spark, sf):
    return parsed(spark, sf).where("kind <> 'Text'").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("markdown_options", "SELECT kind, n::BIGINT AS n FROM (VALUES ('Table', 1), ('TableHead', 1), ('TableRow', 1), ('Strikethrough', 1), ('Section', 1)) t(kind, n)")
def markdown_options(spark, sf):
    source = "# H {#x}\n\n| a | b |\n|---|---|\n| 1 | ~~2~~ |\n\n- [x] done\n"
    return markdown.parse_documents(files.scan_text(spark, source)).where("kind in ('Table', 'TableHead', 'TableRow', 'Strikethrough', 'Section')").groupBy("kind").agg(F.count("*").alias("n"))


@query("events_to_ast", f"WITH {C} SELECT doc_id, 'InlineDirective' AS kind, CASE i WHEN 2 THEN 'Item' ELSE 'Paragraph' END AS parent FROM c, range(3) t(i)")
def events_to_ast(spark, sf):
    n = parsed(spark, sf)
    up = n.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent"))
    return n.where("kind = 'InlineDirective'").join(up, ["doc_id", "parent_id"]).select("doc_id", "kind", "parent")


@query("tag_mapping", f"WITH {C} SELECT doc_id, 1::BIGINT AS level, CASE WHEN k % 3 = 0 THEN 'c' || k END AS attr_id FROM c")
def tag_mapping(spark, sf):
    return parsed(spark, sf).where("kind = 'Section'").select("doc_id", F.col("level").cast("long").alias("level"), "attr_id")


@query("dropped_events", "SELECT 'done' AS text")
def dropped_events(spark, sf):
    return markdown.parse_documents(files.scan_text(spark, "- [x] done\n")).where("kind = 'Text'").select("text")


@query("code_text_accumulate", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'sql' END AS language, p_name || chr(10) || p_brand || chr(10) AS content FROM part")
def code_text_accumulate(spark, sf):
    p = table(spark, sf, "part")
    fence = F.concat(F.lit("```"), F.when(F.col("p_size") % 2 == 0, "sql").otherwise(""), F.lit("\n"), "p_name", F.lit("\n"), "p_brand", F.lit("\n```\n"))
    indented = F.concat(F.lit("    "), "p_name", F.lit("\n    "), "p_brand", F.lit("\n"))
    d = p.select(F.col("p_partkey").cast("string").alias("doc_id"), F.when(F.col("p_size") % 3 == 1, F.when(F.col("p_size") % 2 == 0, fence).otherwise(indented)).otherwise(fence).alias("source"))
    return markdown.parse_documents(d).where("kind = 'CodeBlock'").select(F.col("doc_id").cast("long").alias("p_partkey"), "language", "content")


@query("block_reconstruct", f"WITH {C} SELECT doc_id, 'schema:Review' AS name, 'Paragraph' AS child FROM c")
def block_reconstruct(spark, sf):
    n = parsed(spark, sf)
    blocks = n.where("kind = 'DirectiveBlock'").select("doc_id", F.col("node_id").alias("parent_id"), F.col("name"))
    return n.select("doc_id", "parent_id", F.col("kind").alias("child")).join(blocks, ["doc_id", "parent_id"]).select("doc_id", "name", "child")


@query("inline_reconstruct", INLINE_SQL + " SELECT doc_id, name, content AS text FROM d")
def inline_reconstruct(spark, sf):
    n = parsed(spark, sf)
    up = n.where("kind = 'InlineDirective'").select("doc_id", F.col("node_id").alias("parent_id"), F.col("name").alias("up"))
    return n.where("kind = 'Text'").select("doc_id", "parent_id", F.col("text")).join(up, ["doc_id", "parent_id"]).select("doc_id", F.col("up").alias("name"), "text")


@query("html_passthrough", "SELECT n_nationkey, '<b>' AS content FROM nation UNION ALL SELECT n_nationkey, '</b>' FROM nation")
def html_passthrough(spark, sf):
    d = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.concat(F.lit("x <b>"), "n_name", F.lit("</b>")).alias("source"))
    return markdown.parse_documents(d).where("kind = 'Html'").select(F.col("doc_id").cast("int").alias("n_nationkey"), "content")


@query("text_content", f"WITH {C} SELECT doc_id, 'DirectiveBlock' AS kind, 'Segment ' || seg || ' and .' AS text_content FROM c UNION ALL SELECT doc_id, 'Section', 'Account ' || k FROM c")
def text_content(spark, sf):
    n = parsed(spark, sf)
    rows = n.where("kind in ('DirectiveBlock', 'Section')").select("doc_id", "node_id", "kind")
    return rows.join(markdown.text_contents(n), ["doc_id", "node_id"]).select("doc_id", "kind", "text_content")


@query("find_nodes", f"WITH {C} SELECT doc_id FROM c WHERE k % 3 = 0")
def find_nodes(spark, sf):
    return parsed(spark, sf).where("kind = 'Section' and attr_id is not null").select("doc_id")


@query("filter_has_type", f"WITH {C} SELECT doc_id, CASE WHEN k % 5 = 0 THEN 4 ELSE 5 END AS n FROM c")
def filter_has_type(spark, sf):
    return parsed(spark, sf).where(render.has_type()).groupBy("doc_id").agg(F.count("*").alias("n"))


ALL["filter_annotated"] = (lambda spark, sf: parsed(spark, sf).where(F.size("annotations") > 0).groupBy("doc_id").agg(F.count("*").alias("n")), ALL["filter_has_type"][1])


@query("directive_lookup_join", f"WITH {C} SELECT doc_id, 4::BIGINT AS n FROM c")
def directive_lookup_join(spark, sf):
    d = markdown.extract_all_directives(contents(spark, sf)).select("doc_id", "name", "directive_id")
    n = parsed(spark, sf).where("kind in ('InlineDirective', 'DirectiveBlock')").select("doc_id", "name")
    return n.join(d, ["doc_id", "name"]).groupBy("doc_id").agg(F.count("*").alias("n"))


# Validation -------------------------------------------------------------------------------------

WARN_SQL = f"""WITH {C}, w AS (SELECT doc_id, 'type_curie' AS kind, 'Could not resolve type CURIE: zz:Odd' AS message FROM c UNION ALL SELECT doc_id, 'bare_inline', 'Inline directive ''place'' has no semantic annotations' FROM c WHERE k % 5 = 0
 UNION ALL SELECT doc_id, 'property_curie', 'Could not resolve property CURIE: no:such' FROM c WHERE k % 5 <> 0 UNION ALL SELECT doc_id, 'property_curie', 'Could not resolve property CURIE: tp:code' FROM c WHERE k % 5 <> 0 AND NOT headed UNION ALL SELECT doc_id, 'property_curie', 'Could not resolve property CURIE: tp:segment' FROM c WHERE NOT headed)"""


@query("validate_document", WARN_SQL + " SELECT doc_id, kind, message FROM w")
def validate_document(spark, sf):
    return validate.validate_nodes(parsed(spark, sf)).select("doc_id", "kind", "message")


@query("issue_counts", WARN_SQL + " SELECT doc_id, count(*) AS warnings, 0 AS errors FROM w GROUP BY doc_id")
def issue_counts(spark, sf):
    return validate.issue_counts(docs(spark, sf), validate.validate_nodes(parsed(spark, sf)))


@query("validate_report", WARN_SQL + " SELECT doc_id, count(*) || ' warning(s), 0 error(s) in ' || doc_id AS text FROM w GROUP BY doc_id")
def validate_report(spark, sf):
    return validate.report(validate.issue_counts(docs(spark, sf), validate.validate_nodes(parsed(spark, sf))))


@query("validate_unknown_type", "SELECT n_nationkey, 'Type not found in registered ontologies: schema:' || n_name AS message FROM nation")
def validate_unknown_type(spark, sf):
    d = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.concat(F.lit(":e[x]{.schema:"), "n_name", F.lit("}")).alias("source"))
    return validate.validate_nodes(markdown.parse_documents(d)).select(F.col("doc_id").cast("int").alias("n_nationkey"), "message")


# Renderers --------------------------------------------------------------------------------------

TRIPLES_SQL = f"""WITH {C}, s AS (SELECT *, CASE WHEN k % 3 = 0 THEN '<#c' || k || '>' ELSE '<#account-' || k || '>' END AS top, '<http://www.wikidata.org/entity/Q' || k || '>' AS who,
  '<#' || lower(replace(n_name, '_', '-')) || '>' AS place FROM c),
 t AS (SELECT doc_id, top AS subject, 'a' AS predicate, '<{SCHEMA}Organization>' AS object FROM s UNION ALL SELECT doc_id, top, CASE WHEN headed THEN '<http://example.org/tp/segment>' ELSE 'tp:segment' END, '"' || seg || '"' FROM s
  UNION ALL SELECT doc_id, top, 'startDate', '"2026"' FROM s UNION ALL SELECT doc_id, top, '<http://www.w3.org/2000/01/rdf-schema#label>', '"Account ' || k || '"' FROM s
  UNION ALL SELECT doc_id, who, 'a', '<{SCHEMA}Person>' FROM s UNION ALL SELECT doc_id, who, '<http://www.w3.org/2002/07/owl#sameAs>', who FROM s UNION ALL SELECT doc_id, who, '<http://www.w3.org/2000/01/rdf-schema#label>', '"' || c_name || '"' FROM s
  UNION ALL SELECT doc_id, place, 'a', '<{SCHEMA}Place>' FROM s WHERE k % 5 <> 0 UNION ALL SELECT doc_id, place, CASE WHEN headed THEN '<http://example.org/tp/code>' ELSE 'tp:code' END, '"' || nk || '"' FROM s WHERE k % 5 <> 0
  UNION ALL SELECT doc_id, place, 'no:such', '"x"' FROM s WHERE k % 5 <> 0 UNION ALL SELECT doc_id, place, '<http://www.w3.org/2000/01/rdf-schema#label>', '"' || n_name || '"' FROM s WHERE k % 5 <> 0
  UNION ALL SELECT doc_id, '_:b0', 'a', '<{SCHEMA}Review>' FROM s UNION ALL SELECT doc_id, '_:b0', 'ratingValue', '"' || k % 5 || '"' FROM s UNION ALL SELECT doc_id, '_:b0', 'author', '"A \\"' || k || '\\" B"' FROM s
  UNION ALL SELECT doc_id, '_:b0', '<http://www.w3.org/2000/01/rdf-schema#label>', '"Segment ' || seg || ' and ."' FROM s
  UNION ALL SELECT doc_id, '<#two>', 'a', 'zz:Odd' FROM s UNION ALL SELECT doc_id, '<#two>', '<http://www.w3.org/2000/01/rdf-schema#label>', '"two"' FROM s)"""


@query("turtle_triples", TRIPLES_SQL + " SELECT doc_id, subject, predicate, object FROM t")
def turtle_triples(spark, sf):
    n = parsed(spark, sf)
    return render.turtle_triples(n).select("doc_id", "subject", "predicate", "object")


@query("resolve_or_curie", TRIPLES_SQL + " SELECT doc_id, count(*) AS n FROM t WHERE predicate NOT LIKE '<%' AND predicate <> 'a' GROUP BY doc_id")
def resolve_or_curie(spark, sf):
    n = parsed(spark, sf)
    return render.turtle_triples(n).where("predicate not like '<%' and predicate <> 'a'").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("render_turtle", f"WITH {C} SELECT doc_id, CASE WHEN headed AND k % 4 <> 1 THEN 1 ELSE 0 END AS about_itself, CASE WHEN headed THEN 11 ELSE 10 END + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS n_prefixes FROM c")
def render_turtle(spark, sf):
    made = render.render(docs(spark, sf), "ttl")
    return made.select("doc_id", F.regexp_count("text", F.lit(r"(?m)^<> a schema:Person ;$")).cast("int").alias("about_itself"), F.regexp_count("text", F.lit("(?m)^@prefix ")).cast("int").alias("n_prefixes"))


JSON_SQL = f"WITH {C} SELECT doc_id, (CASE WHEN headed THEN 1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 4 ELSE 5 END)::BIGINT AS n_objects, CASE WHEN headed AND k % 4 <> 1 THEN 'schema:Person' END AS first_type FROM c"


@query("render_jsonld", JSON_SQL)
def render_jsonld(spark, sf):
    made = render.render(docs(spark, sf), "jsonld").withColumn("v", F.parse_json("text"))
    first = F.expr("""try_variant_get(v, '$["@graph"][0]["@type"]', 'string')""")
    graph = F.from_json(F.get_json_object("text", "$['@graph']"), "array<string>")
    return made.select("doc_id", F.size(graph).cast("long").alias("n_objects"), F.when(first == "schema:Person", first).alias("first_type"))


@query("jsonld_entities", f"WITH {C} SELECT doc_id, 'Account ' || k AS name, CASE WHEN k % 3 = 0 THEN '#c' || k END AS id, '{SCHEMA}Organization' AS type FROM c")
def jsonld_entities(spark, sf):
    n = parsed(spark, sf)
    pairs = render.jsonld_pairs(n.where("kind = 'Section'"))
    of = lambda k, a: F.max(F.when(F.col("key") == k, F.col("value"))).alias(a)
    return pairs.groupBy("doc_id").agg(of("schema:name", "name"), of("@id", "id"), of("@type", "type"))


@query("last_wins_map", "SELECT n_nationkey, 'b' AS v, 'urn:t2' AS t FROM nation")
def last_wins_map(spark, sf):
    d = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.lit(":e[x]{type=urn:t1 type=urn:t2 k=a k=b}").alias("source"))
    n = markdown.parse_documents(d)
    pairs = render.jsonld_pairs(n)
    of = lambda k, a: F.max(F.when(F.col("key") == k, F.col("value"))).alias(a)
    return pairs.groupBy("doc_id").agg(of("k", "v"), of("@type", "t")).select(F.col("doc_id").cast("int").alias("n_nationkey"), "v", "t")


HTML_SQL = f"""WITH {C} SELECT doc_id, sha256('<!DOCTYPE html>' || chr(10) || '<html prefix="' || (SELECT string_agg(p || ': ' || i, ' ' ORDER BY p) FROM (VALUES {{prefixes}}) t(p, i, w) WHERE w = 0 OR (w = 1 AND headed) OR (w = 2 AND k % 2 = 0)) || '">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || CASE WHEN headed THEN '<title>Account ' || k || '</title>' || chr(10) ELSE '' END || '</head>' || chr(10)
 || CASE WHEN headed AND k % 4 <> 1 THEN '<body typeof="{SCHEMA}Person">' ELSE '<body>' END || chr(10)
 || '<section' || CASE WHEN k % 3 = 0 THEN ' id="c' || k || '"' ELSE '' END || ' typeof="{SCHEMA}Organization" class="featured">' || chr(10) || '  <h1>Account ' || k || '</h1>' || chr(10)
 || '  <meta property="' || CASE WHEN headed THEN 'http://example.org/tp/segment' ELSE 'tp:segment' END || '" content="' || seg || '" />' || chr(10) || '  <meta property="startDate" content="2026" />' || chr(10) || '</section>' || chr(10)
 || '<p>The <span typeof="{SCHEMA}Person" about="http://www.wikidata.org/entity/Q' || k || '">' || c_name || '</span> lives in é <span' || CASE WHEN k % 5 = 0 THEN '' ELSE ' typeof="{SCHEMA}Place"' END || '>' || n_name || '</span>.</p>' || chr(10)
 || '<div typeof="{SCHEMA}Review" data-directive="schema:Review">' || chr(10) || '  <p>Segment <em>' || seg || '</em> and <code>code</code>.</p>' || chr(10) || '  <meta property="ratingValue" content="' || k % 5 || '" />' || chr(10) || '  <meta property="author" content="A &quot;' || k || '&quot; B" />' || chr(10) || '</div>' || chr(10)
 || '<ul>' || chr(10) || '  <li>one ' || k || '</li>' || chr(10) || '  <li><span typeof="zz:Odd">two</span></li>' || chr(10) || '</ul>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)) AS digest FROM c"""


def _html_sql() -> str:
    from quillgraph.functions.iri import BUILTIN_PREFIXES

    rows = [f"('{p}', '{i}', 0)" for p, i in BUILTIN_PREFIXES.items()] + ["('tp', 'http://example.org/tp/', 1)", "('ex', 'http://example.org/ex/', 2)"]
    return HTML_SQL.replace("{prefixes}", ", ".join(rows))


@query("render_html", _html_sql())
def render_html(spark, sf):
    return render.render(docs(spark, sf), "html").select("doc_id", F.sha2("text", 256).alias("digest"))


ALL["html_block"] = ALL["html_inline"] = ALL["sink_render"] = ALL["render_html"]


@query("rdfa_attrs", f"WITH {C} SELECT doc_id, 1::BIGINT AS n_types, 2::BIGINT AS n_properties, 1::BIGINT AS n_classes FROM c")
def rdfa_attrs(spark, sf):
    n = parsed(spark, sf).where("kind = 'Section'")
    count = lambda k: F.size(F.filter("annotations", lambda a: a["kind"] == k)).cast("long")
    return n.select("doc_id", count("type").alias("n_types"), count("property").alias("n_properties"), count("css").alias("n_classes"))


@query("render_dispatch", "SELECT * FROM (VALUES ('html', 'text/html', 'html'), ('jsonld', 'application/ld+json', 'jsonld'), ('turtle', 'text/turtle', 'ttl')) t(form, content_type, extension)")
def render_dispatch(spark, sf):
    return spark.createDataFrame([(k, v[1], v[2]) for k, v in render.RENDERERS.items()], "form string, content_type string, extension string")


ALL["render_trait"] = ALL["ext_renderer"] = ALL["render_dispatch"]


# Overlays from documents ------------------------------------------------------------------------

def imported(spark, sf):
    h = markdown.parse_headers(docs(spark, sf)).select("doc_id", "prefixes").join(docs(spark, sf), "doc_id")
    n = parsed(spark, sf)
    return sidecar.import_overlay(h, n)


@query("overlay_import", f"""WITH {C} SELECT doc_id, entity_id, snippet FROM (SELECT doc_id, 'e1' AS entity_id, 'Account ' || k AS snippet FROM c UNION ALL SELECT doc_id, 'e2', c_name FROM c UNION ALL SELECT doc_id, 'e3', n_name FROM c WHERE k % 5 <> 0
 UNION ALL SELECT doc_id, CASE WHEN k % 5 = 0 THEN 'e3' ELSE 'e4' END, 'Segment ' || seg || ' and .' FROM c UNION ALL SELECT doc_id, CASE WHEN k % 5 = 0 THEN 'e4' ELSE 'e5' END, 'two' FROM c)""")
def overlay_import(spark, sf):
    return imported(spark, sf)[1].select("doc_id", "entity_id", "snippet")


ALL["entity_numbering"] = ALL["overlay_import"]


@query("overlay_import_triples", f"WITH {C} SELECT doc_id, (CASE WHEN headed THEN 1 + CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS n FROM c WHERE headed")
def overlay_import_triples(spark, sf):
    return imported(spark, sf)[2].groupBy("doc_id").agg(F.count("*").alias("n"))


@query("overlay_round_trip", f"WITH {C} SELECT doc_id, (CASE WHEN k % 5 = 0 THEN 4 ELSE 5 END)::BIGINT AS n_entities, NULL::VARCHAR AS error FROM c")
def overlay_round_trip(spark, sf):
    o, e, t = imported(spark, sf)
    return sidecar.parse_sidecars(sidecar.serialize(o, e, t)).select("doc_id", F.size("entities").cast("long").alias("n_entities"), "error")


@query("type_counts", f"""WITH {C} SELECT type, count(*) AS n FROM (SELECT '{SCHEMA}Organization' AS type FROM c UNION ALL SELECT '{SCHEMA}Person' FROM c UNION ALL SELECT '{SCHEMA}Review' FROM c UNION ALL SELECT '{SCHEMA}Place' FROM c WHERE k % 5 <> 0) GROUP BY type""")
def type_counts(spark, sf):
    return annotations(spark, sf).where("kind = 'type' and resolved_iri is not null").groupBy(F.col("resolved_iri").alias("type")).agg(F.count("*").alias("n"))
