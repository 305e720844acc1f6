"""JSON topics in and out, and replay of a table into a topic.

The Kafka connector jar has to be on the class path of the session; the parsing and
formatting parts work on any source and are what the tests use with files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkveil.plans.numbering import row_numbers
from sparkveil.sources import rejects as rj

# Topic names.
INPUT_TOPICS = ("healthcare-stream", "financial-stream")
HYBRID_TOPIC = "hybrid-input"
PROCESSED_TOPIC, VIOLATION_TOPIC, BATCH_TOPIC = "processed-stream", "compliance-violations", "hybrid-batch-output"


def read_topics(
    spark: SparkSession, servers: str, topics: tuple[str, ...], schema: T.StructType, start: str = "latest",
    per_trigger: int | None = None,
) -> DataFrame:
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("startingOffsets", start)
    )
    if per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return parse(reader.load(), schema)


def parse(df: DataFrame, schema: T.StructType, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON values as typed columns, with what could not be read beside them.

    A value that does not fit its declared type is NULL and listed in `_rejects` as (column, value, reason), also
    inside nested types; an absent field and a null are NULL and no reject, unless the schema says the field is not
    nullable. A message that is no JSON object has all columns NULL, its text in `_unreadable`, and one reject
    without a column. `keep` names columns of the source, like key and offset, to carry along.
    """
    text = F.col(value).cast("string")
    parsed = df.select(*[F.col(k) for k in keep], text.alias("__text"), F.try_parse_json(text).alias("__doc"))
    record, misfits = rj.from_variant(F.col("__doc"), schema, F.lit(""))
    read = F.coalesce(F.schema_of_variant("__doc"), F.lit("")).startswith("OBJECT")
    lost = rj.listed((~read, rj.reject(F.lit(None).cast("string"), F.col("__text"), "not a JSON object")))
    return parsed.select(
        *keep, record.alias("__r"), F.when(~read, F.col("__text")).alias("_unreadable"), F.when(read, misfits).otherwise(lost).alias(rj.REJECTS)
    ).select(*keep, *[F.col(f"__r.`{f.name}`").alias(f.name) for f in schema.fields], "_unreadable", rj.REJECTS)


def as_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """Key and JSON value columns, as topics take them."""
    value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str | None = None, key: str | None = None):
    """Stream or table into a topic; a stream needs a checkpoint folder."""
    messages = as_messages(df, key)
    if df.isStreaming:
        return (
            messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).start()
        )
    return messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def with_replay_fields(df: DataFrame, order: list[str], ingested_at: Column) -> DataFrame:
    """Replay fields: 0-based record index along a key and the ingestion time."""
    numbered = row_numbers(df, order, "__n")
    return numbered.select(*df.columns, ingested_at.alias("_ingestion_timestamp"), (F.col("__n") - 1).alias("_record_index"))
