"""Streams: ingest that survives replays, recovery, progress, ordered events and conversation memory."""

from __future__ import annotations

import hashlib
import tempfile
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.blocks import content_hash, push_target

HASHED = "doc_hash string, doc_id long, part int, run string, epoch long"
#: Folders that a table of hashes is divided into, by the first digits of the hash.
PARTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where none is set, and no cluster would miss it (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="proofloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def put_hashes(batch: DataFrame, table: str, run: str, epoch: int) -> None:
    """Add the contents of ``batch`` (doc_id, text) that ``table`` does not have, as the batch ``epoch`` of ``run``.

    The smallest doc_id of a content's first batch stays. Written again, a batch
    replaces itself and nothing else: folders are named by part, run and epoch.
    Only the parts that the batch has hashes of are read.
    """
    spark = batch.sparkSession
    new = batch.withColumn("doc_hash", content_hash(F.coalesce("text", F.lit("")))).groupBy("doc_hash").agg(F.min("doc_id").alias("doc_id"))
    new = new.withColumn("part", (F.conv(F.left("doc_hash", F.lit(4)), 16, 10).cast("int") % PARTS).cast("int"))
    if _exists(spark, table):
        wanted = [r[0] for r in new.select("part").distinct().collect()]  # PARTS at most
        known = spark.read.schema(HASHED).parquet(table).filter(F.col("part").isin(wanted) & ~((F.col("run") == run) & (F.col("epoch") == epoch)))
        new = new.join(known.select("doc_hash"), "doc_hash", "left_anti")
    rows = new.withColumn("run", F.lit(run)).withColumn("epoch", F.lit(epoch).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "run", "epoch").parquet(table)


def run_of(checkpoint: str) -> str:
    """The name that a checkpoint's batches have in a table: another checkpoint starts at epoch 0 again."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def ingest(stream: DataFrame, table: str, checkpoint: str):
    """Add a stream of (doc_id, text) to the Parquet table at ``table``, each content once; returns the query.

    A batch that comes again, after a failure between its write and its commit,
    adds nothing, and neither does what another stream has put there.
    """
    run = run_of(checkpoint)
    put = lambda batch, epoch: put_hashes(batch, table, run, epoch)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recover(spark: SparkSession, table: str) -> DataFrame:
    """(doc_hash, doc_id) of all that streams have put into a table so far; after a restart too. None yet: no rows."""
    found = spark.read.schema(HASHED).parquet(table) if _exists(spark, table) else spark.createDataFrame([], HASHED)
    return found.select("doc_hash", "doc_id")


def push_ingest(messages: DataFrame, files: DataFrame, table: str, dead: str, checkpoint: str):
    """Ingest the files that a stream of push messages (bucket_attr, object_attr, data) names; returns the query.

    ``files``: (bucket, name, doc_id, text). Messages without a target go to
    the dead-letter table; those of other kinds are passed over.
    """
    run = run_of(checkpoint)

    def put(batch: DataFrame, epoch: int) -> None:
        read = push_target(batch)
        read.filter("verdict = 'reject'").select("bucket_attr", "object_attr", "data").write.mode("overwrite").parquet(f"{dead}/{run}-{epoch}")
        put_hashes(files.join(read.filter("verdict = 'take'").select("bucket", "name").distinct(), ["bucket", "name"], "left_semi").select("doc_id", "text"), table, run, epoch)

    return messages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Calls ``tell(name, batch, rows)`` for each batch of the streams of a session."""

    def __init__(self, tell: Callable[[str | None, int, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.tell(event.progress.name, event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def in_order(events: DataFrame, by: str = "qid", seq: str = "seq") -> Iterator:
    """Event rows, those of one key in order, a partition at a time on the driver."""
    return events.orderBy(by, seq).toLocalIterator()


class Cooldown:
    """Which models rest after a failure, and until when."""

    def __init__(self, seconds: float = 60.0, now: Callable[[], float] = time.monotonic):
        self.seconds, self.now, self.until = seconds, now, {}

    def rest(self, model: str) -> None:
        self.until[model] = self.now() + self.seconds

    def ready(self, model: str) -> bool:
        return self.until.get(model, 0.0) <= self.now()


def run_once(spark: SparkSession, path: str) -> DataFrame:
    """(doc_hash, doc_id) of the documents at ``path``, taken as a stream until it is empty."""
    import uuid

    root = f"{shared_dir(spark)}/proofloom/ingest-{uuid.uuid4().hex[:12]}"
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if not name.endswith(".parquet") else spark.readStream.schema(schema).parquet(f"{parent}/{name[:-8]}*.parquet")
    ingest(stream.select("doc_id", "text"), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return recover(spark, f"{root}/table")


def remember(turns: DataFrame, keep: int = 4) -> DataFrame:
    """(conv_id, turn, conversation) of a stream of (conv_id, turn, q, a): the ``keep`` turns before each, from keyed state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for turn, q, a in zip(rows["turn"], rows["q"], rows["a"]):
            out.append((key[0], int(turn), "\n".join(past)))
            past = [*past, f"User: {q}\nAssistant: {(a or '')[:200]}"][-keep:]
        state.update((past,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "conversation"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, conversation string", "past array<string>", "append", "NoTimeout")
