"""The save-event feed: Structured Streaming into an upserted table."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpusloom.operators.collect import KEYS, collect_first_batch, merge_firsts, merge_reduced, reduce_events
from corpusloom.operators.dialogue import Template, first_part, training_prompt
from corpusloom.operators.filters import file_events
from corpusloom.operators.keyed import folded

EVENT = "type string, filename string, inputs string, parameters map<string,string>, host string, ts timestamp"


def event_stream(spark: SparkSession, landing: str, schema: str = EVENT, files_per_trigger: int = 1000) -> DataFrame:
    """JSON events from a landing folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(landing)


def saved_files(events: DataFrame, suffix: str = ".lua") -> DataFrame:
    """(event_id, filename, user, content, ts) of the save events to collect; the id orders events of equal time."""
    kept = file_events(events, suffix)
    number = F.col("parameters")["event_id"].cast("bigint")
    return kept.select(number.alias("event_id"), "filename", F.col("host").alias("user"), F.col("inputs").alias("content"), "ts")


class Manifest:
    """The live folders of a table, as numbered versions: each a file that lists all of them, put in place in one step.

    A version is never changed. A writer whose version was taken meanwhile reads the new one and tries again, so
    an append and a compaction at the same time both count.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path}/manifest"
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.folder = self.hadoop.Path(self.path)
        self.system = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _version(self, number: int):
        return self.hadoop.Path(self.path, f"{number:020d}.json")

    def latest(self) -> tuple[int, list[dict]]:
        """(version, folders); version -1 is the empty table."""
        if not self.system.exists(self.folder):
            return -1, []
        names = [s.getPath().getName() for s in self.system.listStatus(self.folder)]
        number = max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=-1)
        return number, [] if number < 0 else self._read(number)

    def _read(self, number: int) -> list[dict]:
        stream = self.system.open(self._version(number))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def change(self, update: Callable[[list[dict]], list[dict] | None]) -> bool:
        """Puts ``update`` of the live folders in place; it gives None when there is nothing to do."""
        while True:
            number, folders = self.latest()
            new = update(folders)
            if new is None:
                return False
            draft = self.hadoop.Path(self.path, f".{uuid.uuid4().hex}")
            out = self.system.create(draft, False)
            out.write(bytearray(json.dumps(new).encode()))
            out.close()
            if self._put(draft, self._version(number + 1)):
                return True

    def _put(self, draft, target) -> bool:
        """Renames unless the target is there already."""
        jvm = self.spark._jvm
        kinds = jvm.org.apache.hadoop.fs.Options.Rename
        context = self.hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        try:
            context.rename(self.system.makeQualified(draft), self.system.makeQualified(target), options)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass().getName()):
                raise
            self.system.delete(draft, False)
            return False


class FilesTable:
    """Upserted table as a log of reduced batches: the last content per key, or with ``first`` the first one.

    Each micro-batch is reduced to one row per key and written to a folder of its own; a manifest names the folders that count. A
    replayed batch takes the place of its folder. Reading merges the log; ``compact`` folds it into one base. Folders
    are never changed, and those that no longer count stay until ``vacuum``, so a reader goes on with the state it began with.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str] = KEYS, first: bool = False):
        self.spark, self.path, self.keys, self.first = spark, path.rstrip("/"), keys, first
        self.manifest = Manifest(spark, self.path)

    def append(self, events: DataFrame, batch_id: int) -> None:
        order = ["ts", "event_id", "content"] if "event_id" in events.columns else ["ts", "content"]
        # Read the source once: the reduction looks at a batch several times.
        events = events.persist()
        if self.first:
            reduced = collect_first_batch(events, self.keys, order=order)
        else:
            reduced = reduce_events(events, self.keys, "content", "ts", order)
        folder = self._write(reduced, f"log-{batch_id}")
        events.unpersist()

        def update(folders: list[dict]) -> list[dict] | None:
            if any(f["base"] and f["batch"] >= batch_id for f in folders):
                return None  # folded already: the same events again change nothing
            others = [f for f in folders if f["base"] or f["batch"] != batch_id]
            return [*others, {"folder": folder, "batch": batch_id, "base": False}]

        self.manifest.change(update)

    def _write(self, rows: DataFrame, name: str) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def folders(self, base: bool | None = None) -> list[dict]:
        """The live folders, or those that are (or are not) a base."""
        return [f for f in self.manifest.latest()[1] if base is None or f["base"] == base]

    def _merged(self, folders: list[dict]) -> DataFrame:
        read = lambda f: self.spark.read.parquet(f"{self.path}/data/{f['folder']}").withColumn("batch", F.lit(f["batch"]).cast("bigint"))
        parts = reduce(DataFrame.unionByName, [read(f) for f in sorted(folders, key=lambda f: f["batch"])])
        return (merge_firsts if self.first else merge_reduced)(parts, self.keys)

    def compact(self) -> None:
        """Fold the log into a new base. What readers have open stays; batches that come meanwhile stay in the log."""
        folded = self.folders()
        if all(f["base"] for f in folded):
            return
        last = max(f["batch"] for f in folded)
        base = {"folder": self._write(self._merged(folded).drop("batch"), f"base-{last}"), "batch": last, "base": True}

        def update(folders: list[dict]) -> list[dict] | None:
            if any(f not in folders for f in folded):
                return None  # a batch was replayed, or another compaction was faster
            return [base, *(f for f in folders if f not in folded)]

        self.manifest.change(update)

    def vacuum(self, keep_hours: float = 24.0) -> int:
        """Removes folders that do not count and were written more than ``keep_hours`` ago, which is longer than any reader runs;
        the number removed."""
        hadoop, live = self.manifest.hadoop, {f["folder"] for f in self.folders()}
        top = hadoop.Path(f"{self.path}/data")
        if not self.manifest.system.exists(top):
            return 0
        oldest = (time.time() - keep_hours * 3600) * 1000
        gone = [s.getPath() for s in self.manifest.system.listStatus(top) if s.getPath().getName() not in live and s.getModificationTime() <= oldest]
        for folder in gone:
            self.manifest.system.delete(folder, True)
        return len(gone)

    def read(self) -> DataFrame:
        return self._merged(self.folders()).select(*self.keys, "content", "date_modified")


def collect_upsert_stream(events: DataFrame, table: FilesTable, checkpoint: str) -> DataStreamWriter:
    """Every save event into ``table``: the last content per (filename, user), or the first one."""
    writer = saved_files(events).writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda batch, batch_id: table.append(batch, batch_id))


def collect_first_stream(events: DataFrame, table: FilesTable, checkpoint: str) -> DataStreamWriter:
    """The first content per (filename, user); ``table`` was made with ``first``. The stream itself keeps no state."""
    if not table.first:
        raise ValueError("needs a table that keeps the first content")
    return collect_upsert_stream(events, table, checkpoint)


def first_arrivals(saved: DataFrame, within: str, keys: list[str] = KEYS) -> DataFrame:
    """The first row of each key to arrive, later ones dropped for ``within`` of event time after it.

    Keys compare without case, accents and trailing blanks. The state holds a row for each key seen in that time and
    no more: what the watermark passes is forgotten, and a key that comes again after that counts as new.
    """
    marked = saved.withColumn("seen_at", F.col("ts").cast("timestamp")).withWatermark("seen_at", within)
    rows, names, _ = folded(marked, keys)
    return rows.dropDuplicatesWithinWatermark(names).drop(*names, "seen_at")


def collect_arrivals_stream(events: DataFrame, table: FilesTable, checkpoint: str, within: str) -> DataStreamWriter:
    """As ``collect_first_stream``, for events that arrive in about their order: repeats within ``within`` do not reach the table's log.

    The table settles what the state has forgotten.
    """
    if not table.first:
        raise ValueError("needs a table that keeps the first content")
    arrivals = first_arrivals(saved_files(events), within)
    writer = arrivals.writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda batch, batch_id: table.append(batch, batch_id))


def stream_dialogue_prompts(dialogues: DataFrame, t: Template, messages: str = "messages") -> DataFrame:
    """Rendering keeps no state: the batch expression runs on a stream."""
    return dialogues.withColumn("text", training_prompt(messages, t, first_part(dialogues)))
