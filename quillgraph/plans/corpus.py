"""Annotated documents, overlays and blocks made from the relational tables, so that SQL over the tables says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, source): one annotated document a customer; what it holds depends on the key modulo small numbers."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    key = k.cast("string")
    header = F.concat(F.lit("---\ntitle: Account "), key, F.when(k % 4 == 1, F.lit("")).otherwise(F.lit('\n"@type": schema:Person')), F.lit("\nprefixes:\n  tp: http://example.org/tp/\nyear: "), (k % 7).cast("string"), F.lit("\n---\n\n"))
    heading = F.concat(F.lit("# Account "), key, F.lit(" {"), F.when(k % 3 == 0, F.concat(F.lit("#c"), key, F.lit(" "))).otherwise(F.lit("")), F.lit(".schema:Organization .featured tp:segment="), "c_mktsegment", F.lit(" startDate=2026}\n\n"))
    place = F.when(k % 5 == 0, F.concat(F.lit(":place["), "n_name", F.lit("]"))).otherwise(F.concat(F.lit(":place["), "n_name", F.lit("]{.schema:Place tp:code="), F.col("c_nationkey").cast("string"), F.lit(" no:such=x #here}")))
    line = F.concat(F.lit("The :entity["), "c_name", F.lit("]{type=schema:Person wikidata=Q"), key, F.lit("} lives in é "), place, F.lit(".\n\n"))
    block = F.concat(F.lit("::: schema:Review {ratingValue="), (k % 5).cast("string"), F.lit(' author="A \\"'), key, F.lit('\\" B"}\nSegment *'), "c_mktsegment", F.lit("* and `code`.\n:::\n\n"))
    items = F.concat(F.lit("- one "), key, F.lit("\n- :mark[two]{.zz:Odd}\n"))
    linked = F.when(k % 2 == 0, F.lit("[ex]: <http://example.org/ex/>\n\n")).otherwise(F.lit(""))
    source = F.concat(F.when(k % 11 == 0, F.lit("")).otherwise(header), linked, heading, line, block, items)
    return c.select(key.alias("doc_id"), F.concat(F.lit("/docs/"), key, F.lit(".md")).alias("path"), source.alias("source"))


def lineitem_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of one document a supplier: spans from part keys and quantities."""
    n = F.col("l_linenumber")
    schema, foaf = "http://schema.org/", "http://xmlns.com/foaf/0.1/"
    types = F.when(F.col("l_returnflag") == "A", F.array(F.lit(schema + "Person"))).when(F.col("l_returnflag") == "N", F.array(F.lit(schema + "Place"), F.lit(foaf + "Person"))).otherwise(F.expr("cast(array() as array<string>)"))
    start = F.col("l_partkey")
    end = F.when(n != 7, start + F.col("l_quantity").cast("long") % 40)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("doc_id"),
        ((F.col("l_orderkey") * 10 + n) * 1000000 + F.col("l_partkey")).alias("ord"),
        F.concat_ws("_", F.lit("e"), F.col("l_orderkey").cast("string"), n.cast("string"), F.col("l_partkey").cast("string")).alias("entity_id"),
        start.alias("span_start"),
        end.alias("span_end"),
        F.concat("l_returnflag", "l_linestatus").alias("snippet"),
        types.alias("types"),
        (n % 3).cast("tinyint").alias("status"),
    )


#: The same in DuckDB SQL.
ENTITIES_SQL = """ent AS (SELECT l_suppkey::VARCHAR AS doc_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ord, 'e_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS entity_id,
 l_partkey AS span_start, CASE WHEN l_linenumber <> 7 THEN l_partkey + l_quantity::BIGINT % 40 END AS span_end, l_returnflag || l_linestatus AS snippet,
 CASE l_returnflag WHEN 'A' THEN ['http://schema.org/Person'] WHEN 'N' THEN ['http://schema.org/Place', 'http://xmlns.com/foaf/0.1/Person'] ELSE [] END AS types, l_linenumber % 3 AS status FROM lineitem)"""


def order_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range for each order, dealt over the documents of all suppliers, whose keys are 0 to their number less one."""
    suppliers = table(spark, sf_dir, "supplier").count()
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % suppliers).cast("string").alias("doc_id"), F.col("o_orderkey").alias("range_id"), F.col("o_custkey").alias("from_byte"), (F.col("o_custkey") + 5 + F.col("o_orderkey") % 20).alias("to_byte"))


RANGES_SQL = "rng AS (SELECT (o_orderkey % (SELECT count(*) FROM supplier))::VARCHAR AS doc_id, o_orderkey AS range_id, o_custkey AS from_byte, o_custkey + 5 + o_orderkey % 20 AS to_byte FROM orders)"


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(entities, triples): orders, customers and nations of one document a region; orders name customers, customers nations."""
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    region = F.col("n_regionkey").cast("string")
    c = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    o = orders.join(c, F.col("o_custkey") == F.col("c_custkey"))

    def ents(df: DataFrame, letter: str, key: str, status, snippet) -> DataFrame:
        return df.select(region.alias("doc_id"), F.concat(F.lit(letter), F.col(key).cast("string")).alias("entity_id"), F.col(key).cast("long").alias("ord"), status.cast("tinyint").alias("status"), snippet.alias("snippet"))

    entities = ents(nation, "n", "n_nationkey", F.col("n_nationkey") % 3, F.col("n_name")).unionByName(ents(c, "c", "c_custkey", F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("")))
    entities = entities.unionByName(ents(o, "o", "o_orderkey", F.lit(0), F.lit("order")))
    one = o.select(region.alias("doc_id"), (F.col("o_orderkey") * 4).alias("ord"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("subject"), F.lit("http://example.org/by").alias("predicate"), F.lit("entity").alias("object_kind"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("object_value"))
    two = o.select(region.alias("doc_id"), (F.col("o_orderkey") * 4 + 1).alias("ord"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("subject"), F.lit("http://example.org/x#priority").alias("predicate"), F.lit("literal").alias("object_kind"), F.col("o_orderpriority").alias("object_value"))
    three = c.select(region.alias("doc_id"), (F.col("c_custkey") * 4 + 2).alias("ord"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("subject"), F.lit("http://example.org/in").alias("predicate"), F.lit("entity").alias("object_kind"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("object_value"))
    # Odd orders also have a third triple and a subject that is no entity.
    four = o.where(F.col("o_orderkey") % 2 == 1).select(region.alias("doc_id"), (F.col("o_orderkey") * 4 + 3).alias("ord"), F.concat(F.lit("p"), (F.col("o_orderkey") % 50).cast("string")).alias("subject"), F.lit("http://example.org/of").alias("predicate"), F.lit("entity").alias("object_kind"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("object_value"))
    return entities, one.unionByName(two).unionByName(three).unionByName(four)


GRAPH_SQL = """cn AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey), oc AS (SELECT * FROM orders JOIN cn ON o_custkey = c_custkey),
 ent AS (SELECT n_regionkey::VARCHAR AS doc_id, 'n' || n_nationkey AS entity_id, n_nationkey::BIGINT AS ord, n_nationkey % 3 AS status, n_name AS snippet FROM nation
  UNION ALL SELECT n_regionkey::VARCHAR, 'c' || c_custkey, c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END FROM cn
  UNION ALL SELECT n_regionkey::VARCHAR, 'o' || o_orderkey, o_orderkey, 0, 'order' FROM oc),
 tri AS (SELECT n_regionkey::VARCHAR AS doc_id, o_orderkey * 4 AS ord, 'o' || o_orderkey AS subject, 'http://example.org/by' AS predicate, 'entity' AS object_kind, 'c' || c_custkey AS object_value FROM oc
  UNION ALL SELECT n_regionkey::VARCHAR, o_orderkey * 4 + 1, 'o' || o_orderkey, 'http://example.org/x#priority', 'literal', o_orderpriority FROM oc
  UNION ALL SELECT n_regionkey::VARCHAR, c_custkey * 4 + 2, 'c' || c_custkey, 'http://example.org/in', 'entity', 'n' || n_nationkey FROM cn
  UNION ALL SELECT n_regionkey::VARCHAR, o_orderkey * 4 + 3, 'p' || o_orderkey % 50, 'http://example.org/of', 'entity', 'o' || o_orderkey FROM oc WHERE o_orderkey % 2 = 1)"""


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of one document a conversation: a page with all turns as children; an assistant's turns are agent notes."""
    from quillgraph.operators.blocks import NOTE_FLAVOUR

    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    doc = F.col("conv_id").cast("string")
    turns = c.select(doc.alias("doc_id"), F.concat(F.lit("b"), F.col("turn").cast("string")).alias("block_id"), (F.col("turn") + 1).alias("ord"), F.when(F.col("role") == "user", "affine:paragraph").otherwise(NOTE_FLAVOUR).alias("flavour"), "text", F.expr("cast(array() as array<string>)").alias("children"))
    page = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.concat(F.lit("b"), t.cast("string"))).alias("children"))
    page = page.select(doc.alias("doc_id"), F.lit("page").alias("block_id"), F.lit(0).cast("long").alias("ord"), F.lit("affine:note").alias("flavour"), F.lit(None).cast("string").alias("text"), "children")
    return page.unionByName(turns)


def lineitem_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ops): edit operations of one document an order."""
    kind = F.when(F.col("l_returnflag") == "A", "I").when(F.col("l_returnflag") == "N", "D").otherwise("R")
    at, size = F.col("l_partkey") % 60, F.col("l_quantity").cast("long") % 9 + 1
    op = F.struct(kind.alias("op"), at.alias("at"), F.when(kind == "I", F.lit(0).cast("long")).otherwise(size).alias("old_len"), F.when(kind == "D", F.lit(0).cast("long")).otherwise(F.col("l_suppkey") % 7 + 1).alias("new_len"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", op.alias("op")))), lambda s: s["op"]).alias("ops"))
    return rows.select(F.col("l_orderkey").cast("string").alias("doc_id"), "ops")


def order_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") % 40
    return o.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit("a").alias("entity_id"), start.alias("span_start"), F.when(F.col("o_orderkey") % 5 != 0, start + F.col("o_custkey") % 20 + 1).alias("span_end"), F.lit(0).cast("tinyint").alias("status"))


#: The fold of `operators.sync.adjust`, one operation a step of a recursive query.
FOLD_SQL = """
WITH RECURSIVE o AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i,
  CASE l_returnflag WHEN 'A' THEN 'I' WHEN 'N' THEN 'D' ELSE 'R' END AS op, l_partkey % 60 AS at_, CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity::BIGINT % 9 + 1 END AS old, CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_suppkey % 7 + 1 END AS new FROM lineitem),
 f(k, i, s, e, st) AS (
  SELECT o_orderkey, 0, o_orderkey % 40, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 40 + o_custkey % 20 + 1 END, 0 FROM orders
  UNION ALL
  SELECT f.k, f.i + 1,
   CASE WHEN st = 2 THEN s WHEN op = 'I' THEN CASE WHEN at_ <= s THEN s + new ELSE s END
        WHEN op = 'D' THEN CASE WHEN at_ + old <= s THEN greatest(s - old, 0) WHEN e IS NOT NULL AND at_ = s AND at_ + old = e THEN at_ WHEN e IS NOT NULL AND at_ >= s AND at_ + old <= e THEN s
             WHEN e IS NOT NULL AND at_ <= s AND at_ + old >= e THEN at_ WHEN at_ < s THEN at_ ELSE s END
        WHEN at_ + old <= s THEN greatest(s + new - old, 0) ELSE s END,
   CASE WHEN st = 2 OR e IS NULL THEN e WHEN op = 'I' THEN CASE WHEN at_ <= s OR at_ < e THEN e + new ELSE e END
        WHEN op = 'D' THEN CASE WHEN at_ + old <= s THEN greatest(e - old, 0) WHEN at_ = s AND at_ + old = e THEN at_ WHEN at_ >= s AND at_ + old <= e THEN e - old
             WHEN at_ <= s AND at_ + old >= e THEN at_ WHEN at_ < s AND at_ + old > s THEN greatest(e - old - (s - at_), at_) WHEN at_ < e AND at_ + old > e THEN at_ ELSE e END
        WHEN at_ + old <= s THEN greatest(e + new - old, 0) WHEN at_ >= s AND at_ + old <= e THEN e + new - old ELSE e END,
   CASE WHEN st = 2 THEN 2 WHEN op = 'I' THEN CASE WHEN at_ <= s THEN st WHEN e IS NOT NULL AND at_ < e THEN greatest(st, 1) ELSE st END
        WHEN op = 'D' THEN CASE WHEN at_ + old <= s THEN st WHEN e IS NOT NULL AND at_ <= s AND at_ + old >= e THEN 2 WHEN e IS NOT NULL AND at_ >= s AND at_ + old <= e THEN greatest(st, 1)
             WHEN at_ < s AND at_ + old > s THEN greatest(st, 1) WHEN e IS NOT NULL AND at_ < e AND at_ + old > e THEN greatest(st, 1) ELSE st END
        WHEN at_ + old <= s THEN st ELSE greatest(st, 1) END
  FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
SELECT k::VARCHAR AS doc_id, arg_max(s, i)::BIGINT AS span_start, arg_max({'e': e}, i).e::BIGINT AS span_end, arg_max(st, i)::INTEGER AS status FROM f GROUP BY k
"""
