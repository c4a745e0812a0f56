"""Schemas of the stored tables, and their declaration in a catalog."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

POSTS_RAW = StructType.fromDDL("id bigint, source_file string, line_number bigint, channel_id bigint, channel_username string, post_id bigint, post_date string, payload_json string")
CHANNELS_ENRICHED = StructType.fromDDL("id bigint, source_json_path string, row_index bigint, channel_name string, handle string, normalized_handle string, resolved_id bigint, parsed_jsonl_path string, payload_json string")
TABLES = {"posts_raw": POSTS_RAW, "channels_enriched": CHANNELS_ENRICHED}


def create_tables(spark: SparkSession, database: str) -> None:
    """Declares the tables where they aren't yet.  Uniqueness of (file, line) is kept by ``ingest.insert_new``."""
    for name, schema in TABLES.items():
        spark.sql(f"create table if not exists {database}.{name} ({schema.toDDL()}) using parquet")
