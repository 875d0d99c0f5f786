"""Event-driven entry points: command comments as a stream, queued jobs, and incremental loading of changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.scalars import signature_of
from pathloom.functions.tables import discard, written
from pathloom.operators.graph_store import GraphStore
from pathloom.sources.extract import extract_graph

EVENT_SCHEMA = "event string, signature string, body string"
COMMANDS = ["explain", "generate-fix", "summarize", "ignore", "help"]


def command_pattern(name: str) -> str:
    return rf"(?i) @{name}(?:-x)?\s+(\S+)(?:\s+(.+))?"


def commands(events: DataFrame, name: str, secret: str | None = None) -> DataFrame:
    """Signed events (EVENT_SCHEMA) -> (cmd, args, known, body) of created issue comments that hold a command.

    Without a secret signatures are not checked. Works on streams and on tables alike.
    """
    if secret is not None:
        from pyspark.sql.functions import pandas_udf

        @pandas_udf("boolean")
        def valid(signature, body):
            import hmac

            return (signature.fillna("").combine(body.fillna(""), lambda s, b: hmac.compare_digest(s, signature_of(secret, b.encode())))).astype(bool)

        events = events.where(valid("signature", "body"))
    body = F.from_json("body", "action string, comment struct<body string>")
    rows = events.where("event = 'issue_comment'").select("body", body.alias("j")).where("j.action = 'created'")
    return parse_commands(rows.select("body", F.col("j.comment.body").alias("text")), F.col("text"), name).drop("text")


def parse_commands(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """rows with a command in text, and cmd (lower case), args ('' if none) and whether it is known."""
    p = command_pattern(name)
    out = rows.withColumns({"cmd": F.lower(F.regexp_extract(text, p, 1)), "args": F.regexp_extract(text, p, 2)})
    return out.where("cmd <> ''").withColumn("known", F.col("cmd").isin(COMMANDS))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).json(path)


def dispatch(events: DataFrame, name: str, handle: Callable[[DataFrame, int], None], checkpoint: str, secret: str | None = None):
    """Start a query that hands each batch of commands to `handle` (idempotent by batch id)."""
    return commands(events, name, secret).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()


def queue(jobs: DataFrame, arrival: str) -> DataFrame:
    """Jobs (n_files, ..) in the order in which they are taken: by priority, then arrival."""
    from pathloom.operators.scoring import queue_priority

    return jobs.withColumn("priority", queue_priority(F.col("n_files"))).orderBy(F.desc("priority"), arrival)


def watch_files(spark: SparkSession, files: DataFrame, store_path: str, repo: str, checkpoint: str, once: bool = False, buckets: int = 256):
    """Start a query over a stream of changed files (seq, file_path, text; null text: deleted) that keeps the graph current.

    A batch replaces all its files at once, each by the text of its greatest seq. The graph knows the last batch that it holds of a
    checkpoint, so a batch that comes again, after a failure or late, changes nothing. once: take what is there and end. buckets: of a new graph.
    """
    if "seq" not in files.columns:
        raise ValueError("changed files need a seq, which tells the last text of a file")

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = written(batch.groupBy("file_path").agg(F.max_by("text", "seq").alias("text")), "batch")
        nodes, edges = extract_graph(last.where("text is not null"), repo)
        store = GraphStore(batch.sparkSession, store_path, buckets)
        store.ingest(nodes, edges, repo, f"batch-{batch_id}", changed=last.select("file_path"), batch=(checkpoint, batch_id))
        discard(last)

    stream = files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
