"""Archiving batches of commands with a SHA-256 signature.

The digest covers the time, the signer and for each command its kind and entity (or count), not its values. A batch
is one digest by definition, so it must fit one task; batches are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.scalars import u32_le, u64_le
from tidelog.model import DELETE, FAST, INSERT

BATCH = "batch_insert"


def command_bytes(op: Column, entity_id: Column, count: Column) -> Column:
    kind = F.when(op == INSERT, "INSERT:").when(op == FAST, "INSERT_FAST:").when(op == DELETE, "DELETE:").when(op == BATCH, "BATCH_INSERT:")
    return F.concat(kind.cast("binary"), F.when(op == BATCH, u32_le(count)).otherwise(u64_le(entity_id)))


def digests(commands: DataFrame, batch: Column, timestamp: Column, signer: str) -> DataFrame:
    """``batch``, ``n`` and ``hash`` of the commands (seq, op, entity_id and perhaps count) of each batch, in seq order."""
    count = F.col("count") if "count" in commands.columns else F.lit(0)
    rows = commands.select(batch.alias("batch"), timestamp.alias("ts"), "seq", command_bytes(F.col("op"), F.col("entity_id"), count).alias("bytes"))
    grouped = rows.groupBy("batch", "ts").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("seq", "bytes"))).alias("cmds"))
    body = F.unhex(F.concat_ws("", F.transform("cmds", lambda c: F.hex(c["bytes"]))))
    return grouped.select("batch", "n", F.sha2(F.concat(u64_le(F.col("ts")), F.lit(signer).cast("binary"), body), 256).alias("hash"))


def text_blocks(commands: DataFrame, batch: Column, timestamp: Column, signer: str) -> DataFrame:
    """``batch`` and ``block``, the bytes that an archive file has of each batch; a line feed follows each command."""
    count = F.col("count") if "count" in commands.columns else F.lit(0)
    signed = digests(commands, batch, timestamp, signer)
    rows = commands.select(batch.alias("batch"), timestamp.alias("ts"), "seq", command_bytes(F.col("op"), F.col("entity_id"), count).alias("bytes"))
    bodies = rows.groupBy("batch", "ts").agg(F.sort_array(F.collect_list(F.struct("seq", "bytes"))).alias("cmds"))
    body = F.unhex(F.concat_ws("", F.transform("cmds", lambda c: F.concat(F.hex(c["bytes"]), F.lit("0A")))))
    title, rule = " ".join(["=" * 3, "ARCHIVE BATCH", "=" * 3]), "=" * 21
    head = F.concat_ws("\n", F.lit(title), F.concat(F.lit("Timestamp: "), F.col("ts").cast("string")), F.lit("Signer: " + signer), F.concat(F.lit("Hash: "), F.col("hash")), F.lit(""))
    return signed.join(bodies, "batch").select("batch", F.concat(head.cast("binary"), body, F.lit(rule + "\n" * 2).cast("binary")).alias("block"))


def write_archive(commands: DataFrame, batch: Column, timestamp: Column, signer: str, path: str) -> None:
    """Appends the digests and blocks to a Parquet archive."""
    signed = digests(commands, batch, timestamp, signer)
    signed.join(text_blocks(commands, batch, timestamp, signer), "batch").write.mode("append").parquet(path)
