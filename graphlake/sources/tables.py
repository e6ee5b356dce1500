"""Table sources and sinks: graph and document tables, upserts, manifests, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Required columns of each source.
REQUIRED = {"nodes": ["id", "type", "attributes"], "edges": ["id", "source", "target", "type"], "documents": ["id", "text", "embedding"]}


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of JSON documents {nodes: [...], edges: [...]}; pos is an edge's place in its file."""
    node = "struct<id: string, type: string, attributes: map<string, string>>"
    edge = "struct<id: string, source: string, target: string, type: string>"
    whole = spark.read.schema(f"nodes array<{node}>, edges array<{edge}>").json(path, multiLine=True)
    nodes = whole.select(F.explode("nodes").alias("n")).select("n.*")
    return nodes, whole.select(F.posexplode("edges").alias("pos", "e")).select("e.*", F.col("pos").cast("long"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two Parquet tables; nodes are split by type, which filters prune."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_documents(docs: DataFrame, path: str) -> None:
    """Retrieval documents by entity type; `has_vector` tells where a vector lacks."""
    docs.withColumn("has_vector", F.col("embedding").isNotNull()).write.mode("overwrite").partitionBy("entity_type").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest version of each key over both tables; of equal versions the new table's row."""
    both = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("new_"))
    return both.withColumn("n_", F.row_number().over(latest)).where("n_ = 1").drop("n_", "new_")


def insertable_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id").distinct()
    near = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return near.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def schema_checks(df: DataFrame, name: str, least_columns: int = 0) -> DataFrame:
    """(check, ok, missing) from the schema alone."""
    lost = [c for c in REQUIRED.get(name, []) if c not in df.columns]
    rows = [("required", not lost, ",".join(lost)), ("columns", len(df.columns) >= least_columns, "")]
    return df.sparkSession.createDataFrame(rows, "check string, ok boolean, missing string")


def checksum(content: Column) -> list[Column]:
    return [F.sha2(content, 256).alias("sha256"), F.octet_length(content).alias("size_bytes")]


def manifest(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".las", ".csv", ".json", ".parquet")) -> DataFrame:
    """(path, sha256, size_bytes) of the files under a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    wanted = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    return files.where(wanted).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def verify_manifest(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status) of every stored file: MISSING, SIZE MISMATCH, HASH MISMATCH or OK, sizes first."""
    now = current.select("path", F.col("sha256").alias("sha_now"), F.col("size_bytes").alias("size_now"))
    status = F.when(F.col("size_now").isNull(), "MISSING").when(F.col("size_now") != F.col("size_bytes"), "SIZE MISMATCH").when(F.col("sha_now") != F.col("sha256"), "HASH MISMATCH").otherwise("OK")
    return stored.join(now, "path", "left").select("path", status.alias("status"))


def head(text: Column, lines: int) -> list[Column]:
    """The first lines, and whether there are that many: then more may follow."""
    first = F.slice(F.split(text, "\n"), 1, lines)
    return [F.array_join(first, "\n").alias("head"), (F.size(first) == lines).alias("truncated")]


def reconcile(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    count = lambda df, name: df.groupBy(kind).agg(F.count("*").alias(name))
    both = count(before, "before").join(count(after, "after"), kind, "full")
    return both.select(kind, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def create_collection(spark: SparkSession, name: str, dimension: int, metric: str = "cosine") -> None:
    """A table for vectors with its dimension and metric as properties."""
    spark.sql(f"CREATE TABLE {name} (id STRING, embedding ARRAY<FLOAT>) USING parquet TBLPROPERTIES ('dimension' = '{dimension}', 'metric' = '{metric}')")


def collections(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def drop_collection(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def insert_vectors(rows: DataFrame, name: str) -> None:
    """Appends vectors; one of another dimension fails the job in its task."""
    spark = rows.sparkSession
    dimension = int(spark.sql(f"SHOW TBLPROPERTIES {name} ('dimension')").first()["value"])
    checked = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector of {name} has {dimension} components")).cast("array<float>"))
    rows.select("id", checked.alias("embedding")).write.insertInto(name)


def export_metrics(log: DataFrame, path: str) -> None:
    """One folder of JSON lines for each metric type."""
    log.write.mode("overwrite").partitionBy("type").json(path)
