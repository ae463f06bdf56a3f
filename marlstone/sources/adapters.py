"""The driver's tables as files, nodes, references and feedback events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import exprs as X

#: The clock of every time-dependent query, 2024-02-01T00:00:00Z.
NOW = 1_706_745_600


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: file_path, content, content_hash, mtime, indexed_at, token_count, doc_id."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("content_hash"),
        (F.lit(NOW) - F.col("doc_id") * 60).alias("mtime"),
        (F.lit(NOW) - F.col("doc_id") * 30).alias("indexed_at"),
        X.token_count(F.col("text")).alias("token_count"),
        "doc_id",
    )


def whole_file_nodes(of: DataFrame) -> DataFrame:
    """One chunk per non-empty file."""
    start, end = F.lit(0).cast("long"), F.octet_length("content").cast("long")
    return of.filter(F.length("content") > 0).select(
        X.handle_id(F.col("file_path"), F.lit(7), start, end).alias("id"),
        "file_path",
        F.lit(0).cast("long").alias("node_ord"),
        F.lit(7).alias("node_type"),
        start.alias("start_byte"),
        end.alias("end_byte"),
        F.lit(1).alias("line_start"),
        F.size(F.split("content", "\n")).alias("line_end"),
        "token_count",
        X.preview(F.col("content"), start, end).alias("preview"),
        "content",
    )


def doc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_file_nodes(files(spark, sf_dir))


def source_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as nodes of one file per source, in order of doc_id."""
    d = read(spark, sf_dir, "documents")
    start, end = F.lit(0).cast("long"), F.octet_length("text").cast("long")
    path = F.concat("source", F.lit(".txt"))
    return d.select(
        X.handle_id(path, F.lit(7), F.col("doc_id"), F.col("doc_id") + end).alias("id"),
        path.alias("file_path"),
        F.col("doc_id").alias("node_ord"),
        (F.col("doc_id") % 8).cast("int").alias("node_type"),
        (F.col("doc_id") * 10 + 1).cast("int").alias("line_start"),
        (F.col("doc_id") * 10 + 4).cast("int").alias("line_end"),
        X.token_count(F.col("text")).alias("token_count"),
        X.preview(F.col("text"), start, end).alias("preview"),
        F.col("text").alias("content"),
    )


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as symbols: the name is p_name, the parent p_brand, the file p_type."""
    p = read(spark, sf_dir, "part")
    path, kind = F.concat(F.lit("part/"), F.col("p_type")), (F.col("p_size") % 8).cast("int")
    start = F.col("p_partkey") * 100
    end = start + F.col("p_size")
    return p.select(
        X.handle_id(path, kind, start, end).alias("id"),
        path.alias("file_path"),
        F.col("p_partkey").alias("node_ord"),
        kind.alias("node_type"),
        start.alias("start_byte"),
        end.alias("end_byte"),
        F.col("p_partkey").cast("int").alias("line_start"),
        F.col("p_partkey").cast("int").alias("line_end"),
        F.col("p_size").cast("int").alias("token_count"),
        F.col("p_name").alias("preview"),
        F.col("p_name").alias("name"),
        F.lower("p_name").alias("name_lower"),
        F.lower("p_brand").alias("parent_name_lower"),
    )


def lineitem_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as references to the names of its parts."""
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    path, kind = F.concat(F.lit("part/"), F.col("p_type")), (F.col("p_size") % 8).cast("int")
    start = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    ref_type = (
        F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "N", "import").otherwise("type_ref")
    )
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        path.alias("file_path"),
        F.col("p_name").alias("name"),
        F.lower("p_name").alias("name_lower"),
        F.col("p_brand").alias("qualifier"),
        ref_type.alias("ref_type"),
        X.handle_id(path, kind, F.col("p_partkey") * 100, F.col("p_partkey") * 100 + F.col("p_size")).alias("source_id"),
        start.alias("start_byte"),
        (start + F.length("p_name")).alias("end_byte"),
        F.col("l_orderkey").cast("int").alias("line_start"),
        F.col("l_orderkey").cast("int").alias("line_end"),
        F.concat_ws(" ", "p_name", F.col("l_suppkey").cast("string")).alias("preview"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """events as query events (views), the handles they returned, and expansions (clicks and purchases of the same user and key)."""
    e = read(spark, sf_dir, "events").select(
        "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    view = e.filter("event_type = 'view'")
    queries = view.select(
        F.col("event_id").alias("id"),
        "ts",
        F.concat(F.lit("k"), F.col("k")).alias("query_text"),
        F.transform(
            F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("**/g"), ((F.col("k") + i) % 10).cast("string"), F.lit("/**"))
        ).alias("predicted_globs"),
        F.col("user_id"),
        "k",
    )
    handles = view.select(
        F.col("event_id").alias("query_event_id"),
        F.concat(F.lit("h"), F.col("k")).alias("handle_id"),
        (F.col("k") % 8).cast("int").alias("node_type"),
        F.round("value").cast("int").alias("token_count"),
        F.concat(F.lit("**/g"), (F.col("k") % 10).cast("string"), F.lit("/**")).alias("first_match_glob"),
    )
    acts = e.filter("event_type IN ('click', 'purchase')").select(
        "user_id", "k", F.col("ts").alias("expanded_at"), F.round("value").cast("int").alias("token_count"), F.col("event_id").alias("id")
    )
    expands = acts.join(queries.select(F.col("id").alias("query_event_id"), "user_id", "k"), ["user_id", "k"]).select(
        "id", "query_event_id", F.concat(F.lit("h"), F.col("k")).alias("handle_id"), "token_count", "expanded_at"
    )
    return queries.drop("user_id", "k"), handles, expands
