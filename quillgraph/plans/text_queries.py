"""Queries of scalar functions, prefixes, and the ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import iri, text
from quillgraph.operators import graph, spans
from quillgraph.operators.ontology import Registry
from quillgraph.plans.corpus import customer_documents, table
from quillgraph.sources import files

ALL: dict = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        ALL[name] = (fn, sql)
        return fn

    return put


@query("escape_html", "SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS digest FROM pages")
def escape_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(text.escape_html(F.col("html")), 256).alias("digest"))


@query("escape_turtle", r"""SELECT doc_id, sha256(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r')) AS digest FROM documents""")
def escape_turtle(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.escape_turtle(F.col("text")), 256).alias("digest"))


@query("slugify", r"SELECT doc_id, sha256(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+', '-', 'g'), '-')) AS slug FROM documents")
def slugify(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.slugify(F.col("text")), 256).alias("slug"))


@query("hash_source", "SELECT doc_id, sha256(text) AS source_hash FROM documents")
def hash_source(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.source_hash(F.col("text")).alias("source_hash"))


@query("hash_hex", "SELECT p_partkey, 'sha256:' || sha256(p_name) AS hash FROM part")
def hash_hex(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("sha256:"), text.source_hash(F.col("p_name"))).alias("hash"))


@query("trim_text", r"SELECT doc_id, strlen(regexp_replace(regexp_replace('  ' || text || chr(10), '^\s+', ''), '\s+$', '')) AS n_bytes FROM documents")
def trim_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.octet_length(text.trim_text(F.concat(F.lit("  "), "text", F.lit("\n")))).cast("long").alias("n_bytes"))


@query("sidecar_path", "SELECT page_id, url || '.md.sem' AS whole, url || '.sem' AS short FROM pages")
def sidecar_path(spark, sf):
    path = F.concat("url", F.lit(".md"))
    return table(spark, sf, "pages").select("page_id", text.sidecar_path(path).alias("whole"), text.sidecar_path(path, keep_suffix=False).alias("short"))


@query("block_id_gen", "SELECT doc_id, left(sha256(doc_id || '|' || lang), 10) AS block_id FROM documents")
def block_id_gen(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.block_id(F.col("doc_id").cast("string"), F.col("lang")).alias("block_id"))


@query("note_text", "SELECT p_partkey, p_type || ' — ' || p_name || ' (' || p_brand || ')' AS note FROM part")
def note_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.note_text(F.col("p_type"), F.col("p_name"), F.col("p_brand")).alias("note"))


@query("confidence_pct", "SELECT p_partkey, round((p_size % 21) / 20.0 * 100)::INTEGER || '%' AS pct FROM part")
def confidence_pct(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.confidence_percent((F.col("p_size") % 21) / 20).alias("pct"))


@query("byte_to_utf16", "SELECT doc_id, strlen(substr(text, 1, 40)) AS at_byte, length(substr(text, 1, 40)) AS at_utf16 FROM documents")
def byte_to_utf16(spark, sf):
    at = F.octet_length(F.left("text", F.lit(40))).cast("long")
    return table(spark, sf, "documents").select("doc_id", at.alias("at_byte"), text.byte_to_utf16(F.col("text"), at).alias("at_utf16"))


@query("utf16_to_byte", "SELECT p_partkey, strlen(substr(p_name, 1, 5)) AS at_byte FROM part")
def utf16_to_byte(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.utf16_to_byte(F.col("p_name"), F.lit(5)).alias("at_byte"))


@query("byte_slice", "SELECT doc_id, sha256(decode(array_slice(encode(text), 1, strlen(substr(text, 1, 25))))) AS digest FROM documents")
def byte_slice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.byte_slice(F.col("text"), F.lit(0), F.octet_length(F.left("text", F.lit(25)))), 256).alias("digest"))


PREFIXES_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in iri.BUILTIN_PREFIXES.items()) + ")"


@query("prefix_seed", f"SELECT prefix, iri FROM {PREFIXES_SQL} t(prefix, iri)")
def prefix_seed(spark, sf):
    return spark.range(1).select(F.explode(iri.sorted_entries(iri.seed_prefixes())).alias("e")).select(F.col("e.key").alias("prefix"), F.col("e.value").alias("iri"))


@query("prefix_merge", f"SELECT n_nationkey, count(*) AS n_prefixes, max(CASE WHEN prefix = 'dc' THEN iri END) AS dc FROM (SELECT n_nationkey, prefix, CASE WHEN prefix = 'dc' AND n_regionkey = 1 THEN 'urn:other:' || n_nationkey ELSE iri END AS iri FROM nation, {PREFIXES_SQL} t(prefix, iri) UNION ALL SELECT n_nationkey, 'own', 'urn:x:' FROM nation) GROUP BY ALL")
def prefix_merge(spark, sf):
    later = F.when(F.col("n_regionkey") == 1, F.create_map(F.lit("dc"), F.concat(F.lit("urn:other:"), F.col("n_nationkey").cast("string"))))
    m = iri.merge_prefixes(iri.seed_prefixes(), later, F.create_map(F.lit("own"), F.lit("urn:x:")))
    return table(spark, sf, "nation").select("n_nationkey", F.size(m).cast("long").alias("n_prefixes"), m["dc"].alias("dc"))


def names():
    return F.when(F.col("p_size") % 6 == 0, F.lit("https://example.org/a")).when(F.col("p_size") % 6 == 1, F.concat(F.lit("schema:"), "p_type")).when(F.col("p_size") % 6 == 2, F.lit("nope:x")).when(F.col("p_size") % 6 == 3, F.lit("startDate")).when(F.col("p_size") % 6 == 4, F.lit("urn:a:b")).otherwise(F.lit("foaf:a b"))
RESOLVED_SQL = "CASE p_size % 6 WHEN 0 THEN 'https://example.org/a' WHEN 1 THEN 'http://schema.org/' || replace(p_type, ' ', '!') END"


@query("resolve_curie", f"SELECT p_partkey, {RESOLVED_SQL} AS iri, ({RESOLVED_SQL}) IS NULL AS failed FROM part")
def resolve_curie(spark, sf):
    found = iri.resolve(F.regexp_replace(names(), r"(?<=schema:.{0,40}) ", "!"), iri.seed_prefixes())
    return table(spark, sf, "part").select("p_partkey", found.alias("iri"), found.isNull().alias("failed"))


@query("try_resolve_curie", f"SELECT p_partkey, {RESOLVED_SQL} AS iri FROM part")
def try_resolve_curie(spark, sf):
    return table(spark, sf, "part").select("p_partkey", iri.resolve(F.regexp_replace(names(), r"(?<=schema:.{0,40}) ", "!"), iri.seed_prefixes()).alias("iri"))


def iris():
    return F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("http://schema.org/"), "p_brand")).when(F.col("p_size") % 4 == 1, F.concat(F.lit("http://purl.org/dc/terms/"), "p_brand")).when(F.col("p_size") % 4 == 2, F.concat(F.lit("http://www.w3.org/2002/07/owl#"), "p_brand")).otherwise(F.concat(F.lit("http://else.org/x/"), "p_brand"))
LOCAL_SQL = "CASE p_size % 4 WHEN 0 THEN 'schema:' || p_brand WHEN 1 THEN 'dc:' || p_brand WHEN 2 THEN 'owl:' || p_brand"


@query("iri_to_curie", f"SELECT p_partkey, {LOCAL_SQL} ELSE '<http://else.org/x/' || p_brand || '>' END AS name FROM part")
def iri_to_curie(spark, sf):
    return table(spark, sf, "part").select("p_partkey", iri.compact(iris(), iri.seed_prefixes()).alias("name"))


@query("iri_to_curie_merge", f"SELECT p_partkey, {LOCAL_SQL} ELSE 'http://else.org/x/' || p_brand END AS name FROM part")
def iri_to_curie_merge(spark, sf):
    return table(spark, sf, "part").select("p_partkey", iri.compact(iris(), iri.seed_prefixes(), brackets=False).alias("name"))


@query("iri_to_curie_views", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'schema:' || p_brand WHEN 1 THEN 'dc:' || p_brand WHEN 2 THEN 'http://www.w3.org/2002/07/owl#' || p_brand ELSE 'http://else.org/x/' || p_brand END AS name FROM part")
def iri_to_curie_views(spark, sf):
    return table(spark, sf, "part").select("p_partkey", iri.compact_known(iris()).alias("name"))


@query("iri_local_name", "SELECT p_partkey, CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 2) ELSE p_brand END AS name FROM part")
def iri_local_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", iri.local_name(iris()).alias("name"))


@query("prefix_iter", f"SELECT row_number() OVER (ORDER BY prefix) - 1 AS pos, prefix FROM {PREFIXES_SQL} t(prefix, iri)")
def prefix_iter(spark, sf):
    return spark.range(1).select(F.posexplode(iri.sorted_entries(iri.seed_prefixes())).alias("pos", "e")).select(F.col("pos").cast("long").alias("pos"), F.col("e.key").alias("prefix"))


@query("prefix_get", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'http://schema.org/' END AS iri FROM nation")
def prefix_get(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.try_element_at(iri.seed_prefixes(), F.when(F.col("n_regionkey") == 0, "schema").otherwise("none")).alias("iri"))


@query("same_as_iri", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'http://www.wikidata.org/entity/' WHEN 1 THEN 'https://doi.org/' WHEN 2 THEN 'https://orcid.org/' ELSE '' END || p_partkey AS iri FROM part")
def same_as_iri(spark, sf):
    system = F.element_at(F.array(*map(F.lit, ("wikidata", "doi", "orcid", "isbn"))), F.col("p_size") % 4 + 1)
    return table(spark, sf, "part").select("p_partkey", iri.same_as(system, F.col("p_partkey").cast("string")).alias("iri"))


@query("entity_color", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '#F59E0B' WHEN 1 THEN '#14B8A6' ELSE '#6B7280' END AS color FROM part")
def entity_color(spark, sf):
    kind = F.when(F.col("p_size") % 3 == 0, "schema:Person").when(F.col("p_size") % 3 == 1, "schema:Place").otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", graph.color_of(kind).alias("color"))


@query("tray_status_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'synced' WHEN o_custkey % 2 = 0 THEN o_orderkey % 3 || ' stale' WHEN o_orderkey % 3 = 0 THEN o_custkey % 2 || ' detached' ELSE o_orderkey % 3 || ' stale, ' || o_custkey % 2 || ' detached' END AS status FROM orders")
def tray_status_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", graph.tray_text(F.col("o_orderkey") % 3, F.col("o_custkey") % 2).alias("status"))


# Spans on plain columns -------------------------------------------------------------------------

def two_spans():
    a = (F.col("l_partkey"), F.col("l_partkey") + F.col("l_quantity").cast("long"))
    return a, (F.col("l_suppkey") * 10, F.when(F.col("l_linenumber") != 7, F.col("l_suppkey") * 10 + 60))


SPAN_SQL = "(SELECT *, l_partkey AS a, l_partkey + l_quantity::BIGINT AS b, l_suppkey * 10 AS c, CASE WHEN l_linenumber <> 7 THEN l_suppkey * 10 + 60 ELSE 9223372036854775807 END AS d FROM lineitem)"


def _span_query(name: str, predicate, sql: str):
    def run(spark, sf):
        return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(predicate(*two_spans())).alias("n"))

    ALL[name] = (run, f"SELECT l_suppkey, count(*) FILTER ({sql}) AS n FROM {SPAN_SQL} GROUP BY l_suppkey")


_span_query("anchor_overlaps", lambda a, b: spans.overlaps(*a, *b), "a < d AND c < b")
_span_query("anchor_contains", lambda a, b: spans.contains(*a, *b), "a <= c AND d <= b")
_span_query("anchor_contained_by", lambda a, b: spans.contains(*b, *a), "c <= a AND b <= d")


@query("anchor_effective_end", "SELECT doc_id, sum(CASE WHEN doc_id % 2 = 0 THEN strlen(text) ELSE 5 END)::BIGINT AS span_end FROM documents GROUP BY doc_id")
def anchor_effective_end(spark, sf):
    end = spans.effective_end(F.when(F.col("doc_id") % 2 != 0, F.lit(5)), F.col("text"))
    return table(spark, sf, "documents").groupBy("doc_id").agg(F.sum(end).alias("span_end"))


@query("anchor_shift", "SELECT o_orderkey, greatest(o_custkey - 100, 0) AS s, CASE WHEN o_orderkey % 2 = 0 THEN greatest(o_custkey - 90, 0) END AS e FROM orders")
def anchor_shift(spark, sf):
    s, e = spans.shift(F.col("o_custkey"), F.col("o_custkey") + 10, F.lit(-100))
    return table(spark, sf, "orders").select("o_orderkey", s.alias("s"), F.when(F.col("o_orderkey") % 2 == 0, e).alias("e"))


@query("verify_snippet", """WITH d AS (SELECT doc_id, doc_id % 4 AS k, strlen(text) AS size, strlen(left(text, 2)) AS b, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, CASE WHEN k = 2 OR (k = 0 AND b = size) THEN true WHEN k = 3 OR b >= size THEN false WHEN k = 0 THEN true ELSE substr(h, 2 * b + 1, 2 * least(3, size - b)) = substr('7A7A7A', 1, 2 * least(3, size - b)) END AS ok FROM d
 UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 2) THEN true END FROM documents WHERE text IS NULL""")
def verify_snippet(spark, sf):
    """Every document; a span begins at the byte of the third character, and its snippet is of bytes too."""
    k = F.col("doc_id") % 4
    start = F.octet_length(F.left("text", F.lit(2))).cast("long")
    start = F.when(k == 3, F.octet_length("text") + 5).otherwise(start).cast("long")
    snippet = F.when(k == 0, F.substring("text", 3, 6)).when(k == 1, "zzz").when(k == 2, "").otherwise("abc")
    end = start + F.when(k == 0, F.octet_length(snippet)).otherwise(6)
    return table(spark, sf, "documents").select("doc_id", spans.verify_snippet(start, end, snippet, F.col("text")).alias("ok"))


# Ontology ---------------------------------------------------------------------------------------

@query("registry_builtins", "SELECT * FROM (VALUES ('dc', 0, 15), ('foaf', 5, 12), ('schema', 22, 39), ('sd', 8, 2)) t(prefix, n_types, n_properties)")
def registry_builtins(spark, sf):
    r = Registry()
    t = r.types(spark).groupBy("prefix").agg(F.count("*").alias("n_types"))
    p = r.properties(spark).groupBy("prefix").agg(F.count("*").alias("n_properties"))
    return p.join(t, "prefix", "left").select("prefix", F.coalesce("n_types", F.lit(0)).alias("n_types"), "n_properties")


@query("registry_prefixes", "SELECT prefix, iri AS base FROM " + PREFIXES_SQL + " t(prefix, iri) WHERE prefix IN ('schema', 'dc', 'foaf', 'sd')")
def registry_prefixes(spark, sf):
    return Registry().prefixes(spark)


@query("registry_register", "SELECT 'acme' AS prefix, 'Widget' AS type, 'urn:acme:Widget' AS iri")
def registry_register(spark, sf):
    from quillgraph.operators.ontology import Ontology

    return Registry().register(Ontology("acme", "urn:acme:", {"Widget": ([], ["size"])}, {"size": "Integer"})).types(spark).where("prefix = 'acme'").select("prefix", "type", "iri")


@query("all_types", "SELECT prefix, count(*) AS n FROM (VALUES ('schema', 22), ('foaf', 5), ('sd', 8)) t(prefix, k), range(k) GROUP BY prefix")
def all_types(spark, sf):
    return Registry().types(spark).groupBy("prefix").agg(F.count("*").alias("n"))


@query("all_properties", "SELECT * FROM (VALUES ('Text', 33), ('Url', 8), ('Date', 6), ('Float', 3), ('Integer', 2), ('Entity', 16)) t(expected, n)")
def all_properties(spark, sf):
    return Registry().properties(spark).groupBy("expected").agg(F.count("*").alias("n"))


TYPE_CASES = [("schema:Event", "schema:startDate"), ("schema:Event", "schema:name"), ("schema:Article", "schema:author"), ("schema:Article", "schema:name"), ("schema:BlogPosting", "schema:author"), ("schema:Event", "schema:price"), ("schema:Event", "foaf:age"), ("schema:Event", "schema:bogus"), ("schema:Bogus", "schema:name"), ("dc:Anything", "dc:title")]
VERDICTS = {"compat": ["Valid", "Valid", "Valid", "NotDefinedForType", "NotDefinedForType", "NotDefinedForType", "NotDefinedForType", "UnknownProperty", "UnknownType", "UnknownType"], "exact": ["Valid"] * 5 + ["NotDefinedForType", "NotDefinedForType", "UnknownProperty", "UnknownType", "UnknownType"]}


def _pairs(spark, sf):
    cases = F.array(*(F.struct(*(F.lit(iri.BUILTIN_PREFIXES[n.split(":")[0]] + n.split(":")[1]) for n in c)) for c in TYPE_CASES))
    case = F.element_at(cases, (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", case["col1"].alias("type_iri"), case["col2"].alias("property_iri"))


for _mode in ("compat", "exact"):
    def _validate(spark, sf, mode=_mode):
        return Registry().validate_properties(_pairs(spark, sf), mode == "exact").groupBy("type_iri", "property_iri", "verdict").agg(F.count("*").alias("n"))

    _rows = ", ".join(f"({i}, '{iri.BUILTIN_PREFIXES[t.split(':')[0]] + t.split(':')[1]}', '{iri.BUILTIN_PREFIXES[p.split(':')[0]] + p.split(':')[1]}', '{VERDICTS[_mode][i]}')" for i, (t, p) in enumerate(TYPE_CASES))
    ALL["validate_property_for_type" + ("" if _mode == "compat" else "_exact")] = (_validate, f"SELECT type_iri, property_iri, verdict, count(*) AS n FROM orders JOIN (VALUES {_rows}) t(i, type_iri, property_iri, verdict) ON o_orderkey % 10 = i GROUP BY ALL")


@query("lookup_type", "SELECT o_orderkey % 10 AS k, count(*) AS n, bool_or(o_orderkey % 10 < 8) AS found FROM orders GROUP BY k")
def lookup_type(spark, sf):
    types = Registry().types(spark).select(F.col("iri").alias("type_iri"), F.lit(True).alias("hit"))
    rows = _pairs(spark, sf).join(F.broadcast(types), "type_iri", "left")
    return rows.groupBy((F.col("o_orderkey") % 10).alias("k")).agg(F.count("*").alias("n"), F.bool_or(F.coalesce("hit", F.lit(False))).alias("found"))


@query("lookup_property", "SELECT o_orderkey % 10 AS k, count(*) AS n, bool_or(o_orderkey % 10 <> 7) AS found FROM orders GROUP BY k")
def lookup_property(spark, sf):
    props = Registry().properties(spark).select(F.col("iri").alias("property_iri"), F.lit(True).alias("hit"))
    rows = _pairs(spark, sf).join(F.broadcast(props), "property_iri", "left")
    return rows.groupBy((F.col("o_orderkey") % 10).alias("k")).agg(F.count("*").alias("n"), F.bool_or(F.coalesce("hit", F.lit(False))).alias("found"))


@query("longest_base_match", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'schema' WHEN 1 THEN 'dc' END AS prefix FROM part")
def longest_base_match(spark, sf):
    return table(spark, sf, "part").select("p_partkey", Registry().base_of(iris()).alias("prefix"))


@query("ontology_lookup_join", "SELECT o_orderkey % 10 AS k, CASE WHEN o_orderkey % 10 <> 7 THEN count(*) ELSE 0 END AS n FROM orders GROUP BY k, o_orderkey % 10")
def ontology_lookup_join(spark, sf):
    props = Registry().properties(spark).select(F.col("iri").alias("property_iri"), "expected")
    return _pairs(spark, sf).join(F.broadcast(props), "property_iri", "left").groupBy((F.col("o_orderkey") % 10).alias("k")).agg(F.count("expected").alias("n"))


@query("search_types", "SELECT * FROM (VALUES ('foaf', 'Organization'), ('foaf', 'Person'), ('schema', 'Organization'), ('schema', 'Person')) t(prefix, type)")
def search_types(spark, sf):
    return Registry().search_types(spark, "rson").union(Registry().search_types(spark, "organ")).select("prefix", "type")


@query("vocab_sd", "SELECT count(*) AS n_types FROM range(8)")
def vocab_sd(spark, sf):
    return Registry().types(spark).where(F.startswith("iri", F.lit(iri.VOCABULARY))).agg(F.count("*").alias("n_types"))


@query("sink_init_template", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'Article' WHEN 1 THEN 'Event' WHEN 2 THEN 'Review' WHEN 3 THEN 'Person' ELSE 'Article' END AS kind FROM nation")
def sink_init_template(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("article", "event", "review", "person", "poem"))), F.col("n_regionkey") + 1)
    return table(spark, sf, "nation").select("n_nationkey", F.regexp_extract(files.template(kind), r'"@type": schema:(\w+)', 1).alias("kind"))


@query("sink_overlay_init", "SELECT c_custkey::VARCHAR AS doc_id, 4::BIGINT AS n_lines FROM customer")
def sink_overlay_init(spark, sf):
    made = files.empty_sidecars(customer_documents(spark, sf))
    return made.select("doc_id", F.regexp_count("text", F.lit("@")).cast("long").alias("n_lines"))


@query("list_types", "SELECT prefix, type FROM (VALUES ('foaf', 'Agent'), ('foaf', 'Document'), ('foaf', 'Image'), ('foaf', 'Organization'), ('foaf', 'Person')) t(prefix, type)")
def list_types(spark, sf):
    return Registry().types(spark).where("prefix = 'foaf'").select("prefix", "type")


@query("search_limit", "SELECT count(*) AS n FROM range(3)")
def search_limit(spark, sf):
    return Registry().search_types(spark, "e", limit=3).agg(F.count("*").alias("n"))


ALL["sort_prefixes"] = ALL["prefix_iter"]
ALL["ext_ontology_provider"] = ALL["registry_register"]
