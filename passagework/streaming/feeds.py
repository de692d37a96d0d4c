"""Message feeds as streaming queries: parsing, de-duplication, routing, quotas.

The batch-shaped entry points run a query to the end of what there is and return its result table; the
transformations take and return streaming DataFrames and can be used with any source and sink.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from passagework.sources import shared

BODY = "struct<entry:array<struct<changes:array<struct<value:struct<messages:array<struct<id:string,`from`:string,type:string,text:struct<body:string>,audio:struct<id:string>>>,statuses:array<struct<id:string>>>>>>>>"
#: How long a message id is remembered, and the longest question.
REMEMBERED, LONGEST = "1 hour", 500


def messages(bodies: DataFrame, column: str = "body") -> DataFrame:
    """(id, from, type, text, audio_id, and the other columns): one row a message; receipts have none."""
    value = F.from_json(F.col(column), BODY)
    each = F.flatten(F.transform(F.flatten(F.transform(value["entry"], lambda e: F.coalesce(e["changes"], F.array()))), lambda c: F.coalesce(c["value"]["messages"], F.array())))
    rows = bodies.withColumn("_m", F.explode(each))
    return rows.select(F.col("_m.id").alias("id"), F.col("_m.from").alias("from"), F.col("_m.type").alias("type"), F.col("_m.text.body").alias("text"), F.col("_m.audio.id").alias("audio_id"), *(c for c in bodies.columns if c != column))


def handled_once(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Without redeliveries of a key within the watermark; state is bounded by it. Event time takes the place of arrival time."""
    return rows.where(F.col(key).isNotNull()).withWatermark(at, REMEMBERED).dropDuplicatesWithinWatermark([key])


def route(kind: Column, text: Column) -> Column:
    """What happens to a message."""
    size = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(kind == "audio", "voice_reply").when(size == 0, "ask_again").when(size > LONGEST, "too_long").otherwise("answer")


def finished(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame over all that its source has and return the result.

    Executors write what each micro-batch gives into a folder of its own beneath the shared one, anew if it is redone; no rows pass through the driver."""
    spark = rows.sparkSession
    path = f"{shared.shared_dir(spark)}/feed-{uuid.uuid4().hex}"

    def written(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{'whole' if mode == 'complete' else number}")

    query = rows.writeStream.foreachBatch(written).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    shared.removed(spark, f"{path}-state")
    found = spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(f"{path}/*") if shared.exists(spark, path) else found


def session_memory(rows: DataFrame, session: str, order: str, last: int = 3) -> DataFrame:
    """(session, turns): the last few turns of each session, kept as state and emitted whenever it changes.

    State is that of the sessions' last turns only; within a micro-batch a session's rows are put in order first."""

    def remember(key, batches, state):
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            held = sorted([*held, *map(int, batch[order])])[-last:]
        state.update((held,))
        yield pd.DataFrame({session: [key[0]], "turns": [",".join(map(str, held))]})

    return rows.select(session, order).groupBy(session).applyInPandasWithState(remember, f"{session} bigint, turns string", "held array<bigint>", "update", GroupStateTimeout.NoTimeout)


def last_turns(spark: SparkSession, path: str) -> DataFrame:
    """The last user turns of each conversation of a table, through the stateful stream."""
    stream = _stream(spark, path).where("role = 'user'")
    return finished(session_memory(stream, "conv_id", "turn"), "update")


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, be it one file or a folder, as a stream."""
    there = spark.read.parquet(path)
    folder, _, file = path.rpartition("/")
    single = there.inputFiles()[0].rstrip("/").endswith("/" + file)
    reader = spark.readStream.schema(there.schema)
    return reader.option("pathGlobFilter", file).parquet(folder) if single else reader.parquet(path)


def _events(spark: SparkSession, path: str) -> DataFrame:
    """The table as a stream; time stamps without a zone are taken as the session's."""
    return _stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated_feed(spark: SparkSession, path: str) -> DataFrame:
    """Events delivered twice, handled once."""
    events = _events(spark, path)
    twice = events.select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    return finished(handled_once(twice, "event_id", "ts"))


def daily_quota(spark: SparkSession, path: str, quota: float) -> DataFrame:
    """(day, used, over): a tumbling day's sum against a quota; complete mode, so that the newest day is there too."""
    days = _events(spark, path).groupBy(F.window("ts", "1 day")).agg(F.sum("value").alias("used"))
    return finished(days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), F.round("used", 2).alias("used"), (F.col("used") > quota).alias("over")), "complete")
