"""Chat formatting after collapsing cumulative snapshots of one conversation.

Logs often hold a conversation again and again, each time with more turns.
Every turn gets a hash of all turns up to it; a conversation whose whole hash is
that of a shorter part of another one is a snapshot and goes.  Of equal
conversations the smallest id stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import column, partition_id, staged

#: Turns of one rendered part; longer conversations are rendered in several.
PART = 1024
ROLES = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"}


def numbered(turns: DataFrame) -> DataFrame:
    """z, c, role, text, key, place: turns in order of conversation, number (null first), role and text, written once.

    z tells that conv_id is null, c is it or 0; place counts a conversation's turns
    from 1.  Turns are dealt out by ranges of that order, which are even whatever
    conv_id holds (a null one, or that of a third of all rows), and counted range by
    range.  A range begins within one conversation at most, so that what is ahead of
    a range's rows is a table of fewer rows than ranges.
    """
    c = F.coalesce("conv_id", F.lit(0).cast(turns.schema["conv_id"].dataType))
    rows = turns.select(F.col("conv_id").isNull().alias("z"), c.alias("c"), "turn", "role", "text", F.sha2("text", 256).alias("key"))
    order = ("z", "c", "turn", "role", "key", "row")
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "row")

    def count(batches):
        chunk, seen, last = partition_id(), 0, None
        for batch in batches:
            if not len(batch):
                continue
            z, c = column(batch, "z"), column(batch, "c")
            new = np.ones(len(batch), bool)
            new[1:] = pc.or_(pc.not_equal(z[1:], z[:-1]), pc.not_equal(c[1:], c[:-1])).to_numpy(zero_copy_only=False)
            new[0] = (z[0], c[0]) != last
            begin = np.maximum.accumulate(np.where(new, np.arange(len(batch)), 0))
            row = np.arange(len(batch)) - begin + 1
            row += np.where(np.cumsum(new) == 0, seen, 0)
            seen, last = int(row[-1]), (z[len(batch) - 1], c[len(batch) - 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), chunk, np.int32)), pa.array(row)], [*batch.schema.names, "chunk", "row"])

    schema = StructType([*rows.schema.fields, StructField("chunk", IntegerType()), StructField("row", LongType())])
    rows = staged(rows.mapInArrow(count, schema), "chat-turns")
    return _after(rows, F.max("row"), F.sum).withColumn("place", F.coalesce("ahead", F.lit(0)) + F.col("row")).drop("ahead", "row")


def _after(rows: DataFrame, one, many) -> DataFrame:
    """rows (z, c, chunk, ...) with ahead: `many` over `one` of the same conversation's chunks before, null in its first."""
    sizes = rows.groupBy("z", "c", "chunk").agg(one.alias("one"))
    ahead = many("one").over(Window.partitionBy("z", "c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))  # a row a chunk
    ahead = sizes.withColumn("ahead", ahead).where("ahead is not null").drop("one")
    return rows.join(F.broadcast(ahead), ["z", "c", "chunk"], "left")  # fewer rows than chunks


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """z, c, place, h1, h2: 128 bits over (place, role, text) of a conversation's first turns; rows: of numbered()."""
    whole = (F.col("place"), F.coalesce("role", F.lit("\x00")), F.coalesce("key", F.lit("\x00")))
    rows = rows.select("z", "c", "chunk", "place", *(F.xxhash64(F.lit(k), *whole).alias(f"x{k}") for k in (1, 2)))
    for k in (1, 2):
        rows = _after(rows, F.bit_xor(f"x{k}"), F.bit_xor).withColumnRenamed("ahead", f"y{k}")
    sofar = Window.partitionBy("z", "c", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("z", "c", "place", *(F.bit_xor(f"x{k}").over(sofar).bitwiseXOR(F.coalesce(f"y{k}", F.lit(0))).alias(f"h{k}") for k in (1, 2)))


def maximal(rows: DataFrame) -> DataFrame:
    """z, c, n_turns, copies: conversations that begin no longer one, the smallest id of equal ones; rows: of numbered().

    All rows with a null id are one conversation; of equal ones it stays only where no other is.
    """
    hashes = staged(prefix_hashes(rows), "chat-prefixes")
    last = hashes.groupBy("z", "c").agg(F.max_by(F.struct("place", "h1", "h2"), "place").alias("last"))
    whole = last.groupBy("last.place", "last.h1", "last.h2").agg(F.min(F.struct("z", "c")).alias("first"), F.count("*").alias("copies"))
    sizes = last.select("z", "c", F.col("last.place").alias("size"))
    inner = hashes.join(sizes, ["z", "c"]).where("place < size").select("place", "h1", "h2").distinct()
    return whole.join(inner, ["place", "h1", "h2"], "left_anti").select("first.z", "first.c", F.col("place").alias("n_turns"), "copies")


def render(rows: DataFrame, kept: DataFrame, roles: dict[str, str] = ROLES, end: str = "<|end|>", part: int = PART) -> DataFrame:
    """conv_id, n_turns, copies, part (from 0), chat: each `part` turns of a kept conversation in order, each as its role's mark, a newline, the text and the end mark.

    A conversation's parts one after another are its chat, so that no row holds more
    than `part` turns.  An unknown role is named between <| and |>; a null role is
    `none`; a null text is empty.  rows: of numbered().
    """
    mark = F.concat(F.lit("<|"), F.coalesce("role", F.lit("none")), F.lit("|>"))
    for role, text in roles.items():
        mark = F.when(F.col("role") == role, text).otherwise(mark)
    line = F.concat(mark, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(end), F.lit("\n"))
    lines = rows.select("z", "c", F.floor((F.col("place") - 1) / part).alias("part"), "place", line.alias("line"))
    parts = kept.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_turns") - 1) / part))).alias("part"))
    lines = lines.join(parts, ["z", "c", "part"]).groupBy("z", "c", "part").agg(F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("place", "line"))).alias("t"))
    return lines.select(F.when(~F.col("z"), F.col("c")).alias("conv_id"), "n_turns", "copies", "part", F.concat_ws("", "t.line").alias("chat"))


def op3_snapshot_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return render(rows, maximal(rows))


OP3_SQL = """
WITH t AS (SELECT conv_id, role, coalesce(text, '') AS text, sha256(text) AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, sha256(text) NULLS FIRST) AS place FROM conversations),
c AS (SELECT conv_id, list({'role': role, 'key': key} ORDER BY place) AS l FROM t GROUP BY conv_id),
r AS (SELECT conv_id, (place - 1) // 1024 AS part, string_agg(CASE WHEN role IS NULL THEN '<|none|>' ELSE '<|' || role || '|>' END || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY place) AS chat FROM t GROUP BY 1, 2),
p AS (SELECT DISTINCT l[1:n] AS l FROM (SELECT l, unnest(generate_series(1, len(l) - 1)) AS n FROM c)),
w AS (SELECT l, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY l)
SELECT w.conv_id, CAST(len(l) AS BIGINT) AS n_turns, copies, part, chat FROM w JOIN r ON w.conv_id IS NOT DISTINCT FROM r.conv_id WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = w.l)
"""
