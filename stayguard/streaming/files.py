"""Score booking files as they arrive (R1) with a batch status ledger (R2).

Files may carry different headers (aliases), and Spark's CSV reader binds one
header to a whole directory. The stream therefore carries *paths*
(``binaryFile`` source, ``content`` column never selected, so no bytes are
read by the stream itself); each micro-batch reads its files grouped by header
line (``sources.readers.read_csv_files``), maps aliases, prepares, scores and
persists one scoring batch per micro-batch.

A batch is named by the stream's own id and the epoch. The id stands in the stream's
checkpoint folder, so a stream that starts anew in another folder, or a second stream on
the same store, never meets the batches of the first. A micro-batch that is complete in
the store (the engine replays the last epoch after a failure) is skipped; one that died
half-way is written again over its own rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.business import enrich_predictions, score_with_rules
from ..operators.features import prepare_features
from ..operators.store import ROW, batch_status, create_batch, is_complete, persist_predictions, set_status, with_row_id  # noqa: F401
from ..sources.readers import read_csv_files

PATH_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that the engine wrote to the checkpoint folder when the stream first started."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def score_files_batch(spark: SparkSession, paths: list[str], root: str, batch_id: str) -> None:
    """Read, prepare, score and persist the files of one micro-batch."""
    if not paths or is_complete(spark, root, batch_id):
        return
    create_batch(spark, root, f"{len(paths)} files", paths[0] if len(paths) == 1 else None, "file_stream", batch_id, queued=True)
    set_status(spark, root, batch_id, "scoring", files=len(paths))
    try:
        raw = with_row_id(read_csv_files(spark, paths))
        prepared = prepare_features(raw, strict=False, keep=(ROW,))
        scored = enrich_predictions(score_with_rules(prepared))
        persist_predictions(spark, root, raw, scored, source="file_stream", batch_id=batch_id)
    except Exception as e:
        set_status(spark, root, batch_id, "failed", files=len(paths), error=str(e))
        raise


def start_file_scoring(spark: SparkSession, input_dir: str, root: str, checkpoint: str,
                       available_now: bool = True, max_files_per_trigger: int = 1000,
                       glob: str = "*.csv", recursive: bool = False):
    """Start the stream; returns the StreamingQuery."""
    reader = spark.readStream.format("binaryFile").schema(PATH_SCHEMA).option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    paths = reader.load(input_dir).select("path")

    def each(batch: DataFrame, epoch_id: int) -> None:
        # the list of file names of one micro-batch is metadata, bounded by maxFilesPerTrigger
        files = sorted(r["path"] for r in batch.collect())
        session = batch.sparkSession
        score_files_batch(session, files, root, f"stream-{stream_id(session, checkpoint)}-{epoch_id}")

    writer = paths.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
