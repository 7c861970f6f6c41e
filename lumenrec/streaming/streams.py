"""Event streams: append, typed split, registration, keyed dialogue state, replies. Each runs on what is there and stops.

A checkpoint names a stream: run again with the same one, a stream goes on where it
stopped, state included. Left out, it lies beside the sink, so a second run over the
same sink adds what is new. Tables that are written batch by batch have a folder for
each batch, which a repeated batch overwrites, so every row is there once.

Odd input: an event without text or button is an event; a null key is a key; equal
events are events each for itself; a stream without rows leaves the state as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import chatlog, fuzzy, similarity
from ..operators.dialogue import Machine
from ..sources.files import work_path as work_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Replies of the chat.
CONFIRM = "Please confirm the name"
UNKNOWN_TITLE = "There is no such anime in the list, please repeat the request again"


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events", files: int = 1000) -> DataFrame:
    """The files of a table as a stream, at most so many in a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{table}.parque[t]")


def beside(path: str) -> str:
    """The checkpoint of a sink that is given none."""
    return f"{path.rstrip('/')}.checkpoint"


def stop_all(spark: SparkSession) -> None:
    """Stop every stream of the session; their checkpoints let them go on later."""
    for query in spark.streams.active:
        query.stop()


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every micro-batch that is available to a function, then stop."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
    query.awaitTermination()


def stream_append(stream: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Append the stream to a Parquet table; the sink's log makes it exactly once."""
    query = stream.writeStream.option("checkpointLocation", checkpoint or beside(path)).trigger(availableNow=True).format("parquet").option("path", path).start()
    query.awaitTermination()


def _put(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def stream_split(stream: DataFrame, kind: str, targets: dict[str, str], folder: str, checkpoint: str | None = None) -> None:
    """Each micro-batch put into the table of its kind, with its batch_id; read once, written for each target."""

    def handle(batch: DataFrame, n: int) -> None:
        batch.persist()
        for table, rows in chatlog.split_by_type(batch, kind, targets).items():
            _put(rows, f"{folder}/{table}", n)
        batch.unpersist()

    run_batches(stream, handle, checkpoint or beside(folder))


def stream_register(stream: DataFrame, path: str, key: str, order: list[str], checkpoint: str | None = None) -> None:
    """The first event of each key goes into the table; later ones change nothing, nor does a repeated batch."""
    run_batches(stream, lambda batch, _: chatlog.insert_unseen(batch, path, key, order), checkpoint or beside(path))


def candidates(requests: DataFrame, titles: DataFrame) -> DataFrame:
    """event_id, user_id, request, rank, title, reply of requests(event_id, user_id, request): at most three titles to choose from, or none found."""
    found = fuzzy.close_titles(requests.select("request"), titles)
    reply = F.when(F.col("rank").isNull(), F.lit(UNKNOWN_TITLE)).otherwise(F.lit(CONFIRM))
    return requests.select("event_id", "user_id", "request").join(found, "request", "left").select("event_id", "user_id", "request", "rank", "title", reply.alias("reply"))


def recommendations(choices: DataFrame, catalogue: DataFrame) -> DataFrame:
    """event_id, user_id, pos, vec_id, line of choices(event_id, user_id, title): at most five replies; a title that no item has gets none.

    Each title that is chosen is searched once, with its first item's vector.
    """
    first = catalogue.join(choices.select("title").distinct(), "title", "left_semi").groupBy("title").agg(F.min("vec_id").alias("vec_id"))
    asked = catalogue.join(first.select("vec_id"), "vec_id", "left_semi")
    told = similarity.replies(similarity.recommend(catalogue, asked, extra=("type", "episodes", "synopsis"))).select("q", "pos", "vec_id", "line")
    each = choices.join(first.select("title", F.col("vec_id").alias("q")), "title")
    return each.join(told, "q").select("event_id", "user_id", "pos", "vec_id", "line")


def stream_candidates(requests: DataFrame, titles: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Candidates for a stream of requests, put into the reply table at path."""
    run_batches(requests, lambda batch, n: _put(candidates(batch, titles), path, n), checkpoint or beside(path))


def stream_recommendations(choices: DataFrame, catalogue: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Replies to a stream of choices, put into the reply table at path."""
    run_batches(choices, lambda batch, n: _put(recommendations(batch, catalogue), path, n), checkpoint or beside(path))


class DialogueProcessor(StatefulProcessor):
    """Keeps one state for each key and puts out every transition."""

    def __init__(self, machine: Machine, start: str) -> None:
        self.machine, self.start = machine, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        state = self.state.get()[0] if self.state.exists() else self.start
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for event, text, button in zip(batch["event_id"], batch["text"], batch["button"]):
            after, action = self.machine(state, None if pd.isna(text) else text, None if pd.isna(button) else button)
            out.append((event, key[0], state, after, action))
            state = after
        if state == self.start:
            self.state.clear()
        else:
            self.state.update((state,))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "state_before", "state_after", "action"])

    def close(self) -> None:
        pass


def stream_dialogue(stream: DataFrame, machine: Machine, start: str, path: str, checkpoint: str | None = None) -> None:
    """Transitions of every user's dialogue, appended to a Parquet table; run again with the same checkpoint, each goes on in its state.

    stream: event_id, user_id, ts, text, button. A key's rows of one micro-batch
    are sorted together; the files of a trigger bound them.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    steps = stream.groupBy("user_id").transformWithStateInPandas(DialogueProcessor(machine, start), "event_id long, user_id long, state_before string, state_after string, action string", "Append", "None")
    stream_append(steps, path, checkpoint)


def dialogue_events(events: DataFrame, texts: dict[str, str]) -> DataFrame:
    """event_id, user_id, ts, text, button of the raw events: kinds stand for what a user sends."""
    kind, value = F.col("event_type"), F.col("value")
    text = F.lit(None).cast("string")
    for k, t in texts.items():
        text = F.when(kind == k, F.lit(t)).otherwise(text)
    return events.select("event_id", "user_id", "ts", text.alias("text"), button_of(kind, value).alias("button"))


def button_of(kind: Column, value: Column) -> Column:
    """A purchase presses a button, which one depends on its value."""
    pressed = F.when(value < 10, "More Recommendations").when(value < 40, "Feedback").when(value < 80, "Exit the dialog :(").otherwise("other")
    return F.when(kind == "purchase", pressed)
