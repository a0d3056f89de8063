"""Scoring of arriving submissions against a stored model.

The model stays frozen: refitting it for each batch would change every score.
Each micro-batch is one batch plan, so a stream gives what a batch would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from arbiter.operators.expertise import Model, emitted, score_new


def score_stream(submissions: DataFrame, model: Model, output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the affinities of every new document below `output`, one folder for each batch number.

    A batch that is tried again overwrites its own folder, so each document is
    scored exactly once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        emitted(score_new(model, rows), model.config).write.mode("overwrite").parquet(f"{output}/batch={number}")

    stream = submissions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
