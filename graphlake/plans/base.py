"""What the plans share: reading tables, the graph that the test tables stand for, and the registry of queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphlake.functions import text as T
from graphlake.operators import graph as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the cluster's shared folder, so that branches and hops don't run what came before again; in a
    session without such a folder, persisted."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def folder(spark: SparkSession, name: str) -> str:
    """A new path for a stored table in the cluster's shared folder; a local session without one gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='graphlake-')}"
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def tagged(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}-"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str, all_parts: bool = True) -> DataFrame:
    """Customers as parents, their orders as children, parts as what orders contain."""
    parts = read(spark, sf_dir, "part")
    parts = parts if all_parts else parts.where("p_size <= 25")
    return G.combine(
        G.node_table(read(spark, sf_dir, "customer"), tagged("customer", "c_custkey"), "las_document", {"WELL": F.col("c_name"), "UWI": F.col("c_mktsegment")}),
        G.node_table(read(spark, sf_dir, "orders"), tagged("order", "o_orderkey"), "las_curve", {"mnemonic": F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), "unit": F.col("o_orderstatus")}),
        G.node_table(parts, tagged("part", "p_partkey"), "part", {"brand": F.col("p_brand")}),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return G.combine(
        G.edge_table(orders, tagged("order", "o_orderkey"), tagged("customer", "o_custkey"), "describes", F.col("o_orderkey")),
        G.edge_table(lines, tagged("order", "l_orderkey"), tagged("part", "l_partkey"), "contains", F.col("l_partkey")),
    )


def answers(spark: SparkSession, sf_dir: str, words: bool = False) -> DataFrame:
    """(query_id, answer, expected, context, and with words the tokens of answer and expected, taken once a text before they
    are joined, as answer_words and expected_words): each document's text as an answer to the benchmark item of the rank that its id
    leaves, divided by the number of items; the next item's text is what was retrieved."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    by_id = Window.orderBy("item_id")
    first = F.first("text").over(by_id.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = items.select((F.row_number().over(by_id) - 1).alias("rank"), F.col("text").alias("expected"), F.coalesce(F.lead("text").over(by_id), first).alias("context"))
    if words:
        docs, ranked = docs.withColumn("answer_words", T.tokens(F.col("text"))), ranked.withColumn("expected_words", T.tokens(F.col("expected")))
    more = ["answer_words", "expected_words"] if words else []
    keyed = docs.select(*more[:1], F.col("doc_id").alias("query_id"), F.col("text").alias("answer"), F.pmod("doc_id", F.lit(max(1, items.count()))).alias("rank"))
    return keyed.join(ranked, "rank").select("query_id", "answer", "expected", "context", *more)


#: The same tables in SQL, to be put after WITH.
NODES = """nodes AS (
    SELECT 'customer-' || c_custkey AS id, 'las_document' AS type, c_name AS name, NULL AS mnemonic, NULL AS unit FROM customer
    UNION ALL SELECT 'order-' || o_orderkey, 'las_curve', NULL, nullif(o_orderpriority, '5-LOW'), o_orderstatus FROM orders
    UNION ALL SELECT 'part-' || p_partkey, 'part', NULL, NULL, NULL FROM part)"""
EDGES = """edges AS (
    SELECT 'order-' || o_orderkey AS source, 'customer-' || o_custkey AS target, 'describes' AS type, o_orderkey AS pos FROM orders
    UNION ALL SELECT DISTINCT 'order-' || l_orderkey, 'part-' || l_partkey, 'contains', l_partkey FROM lineitem)"""
ANSWERS = """items AS (
    SELECT row_number() OVER (ORDER BY item_id) - 1 AS rank, text AS expected, coalesce(lead(text) OVER (ORDER BY item_id), first_value(text) OVER (ORDER BY item_id)) AS context FROM benchmark),
answers AS (
    SELECT doc_id AS query_id, d.text AS answer, expected, context FROM documents d JOIN items ON d.doc_id % (SELECT count(*) FROM benchmark) = rank)"""
TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"


def tokens_sql(column: str) -> str:
    return TOKENS.format(column)
