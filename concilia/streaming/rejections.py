"""Rejection files as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from concilia.sources.rejection_xml import ENCODING, FILES, piece_reader, pieces, rejections_in


def stream_rejections(
    spark: SparkSession,
    path: str,
    each: Callable[[DataFrame, int], None],
    encoding: str = ENCODING,
    files: str = FILES,
    files_per_trigger: int = 1000,
) -> DataStreamWriter:
    """Hands the rows ``read_rejections`` gives to ``each(rows, batch)``, files after files.

    A file is never divided between batches, so whether it is valid is decided inside its
    batch. Set the trigger and the checkpoint of the returned writer and start it.
    """
    arriving = piece_reader(spark.readStream, files).option("maxFilesPerTrigger", files_per_trigger)
    return pieces(arriving.load(path), encoding).writeStream.foreachBatch(
        lambda batch, number: each(rejections_in(batch), number)
    )


def finish_together(writers: Mapping[str, DataStreamWriter], checkpoints: str) -> None:
    """Runs writers over different files at the same time, until all that has arrived is read.

    A batch of a few small files keeps a few cores busy and mostly waits for its own start and
    commit; batches of several streams share the cluster. Each has a checkpoint by its name.
    """
    running = []
    try:
        for name, writer in writers.items():
            running.append(writer.option("checkpointLocation", f"{checkpoints}/{name}").trigger(availableNow=True).start())
        for stream in running:
            stream.awaitTermination()
    finally:
        for stream in running:
            stream.stop()
