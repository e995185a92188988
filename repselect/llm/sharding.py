"""Sharding by global byte-size prefix sums, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repselect.llm.order import with_prefix
from repselect.session import settled

SHARDS = 16


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: one row for each row of ``docs``.

    Documents in the order of their id (null first, ties by size and checksum) are laid end to end; a shard
    takes those whose middle byte lies in its part of the whole, so shards are contiguous and no shard is
    off its share by more than a document. ``size``: UTF-8 bytes of the text plus one, a null text has none
    (and checksum null). Law ``bytes``; ``slot`` counts from 0 in each shard; ``grown_shard`` is null.
    With fewer documents than shards some shards stay empty. Other columns are ignored.
    """
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    placed = settled(with_prefix(rows, ["doc_id", "size", "text_crc32"], "size"))
    total = placed.agg(F.sum("size")).first()[0] or 1
    # the middle byte's share of all, in whole numbers
    shard = F.expr(f"cast((cast(2 * before + size as decimal(38,0)) * {shards}) div {2 * total} as int)")
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # a row a shard
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
