"""Continuous conversion of arriving PDF files: file sources, stateless maps, Parquet sinks with a checkpoint, and pages
that arrive apart and are put together with state. Broken files arrive as error rows; an empty folder is an empty stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..plans.convert import convert
from ..plans.options import ConvertOptions
from ..sources import pdf


def files_stream(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files of a folder as they come: doc_id (a hash of the path), path, modificationTime, content."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "modificationTime", "content")


def spans_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """All PDFs now in folder that no earlier run took -> spans under out; the checkpoint is the ledger of files."""
    return pdf.read_spans(files_stream(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def convert_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, options: ConvertOptions = ConvertOptions()) -> StreamingQuery:
    """The same -> doc_id, total_pages, error, markdown under out, a batch at a time; a batch that is run again writes the same files."""

    def write(batch: DataFrame, number: int) -> None:
        convert(batch, options).select("doc_id", "total_pages", "error", "markdown").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(requests: DataFrame, key: str = "idempotency_key", time: str = "requested_at", delay: str = "1 hour") -> DataFrame:
    """Of requests with the same key within the delay the first one. Works on streams and on frames."""
    if not requests.isStreaming:
        return requests.dropDuplicates([key])
    return requests.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


class PageAssembler(StatefulProcessor):
    """Pages (doc_id, page_number, total_pages, markdown) in any order -> doc_id, markdown when the last one has come.

    A page that comes twice counts once. The state of a document is its pages, and goes when the document is given out."""

    SCHEMA = "doc_id long, total_pages int, markdown string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page_number int", "markdown string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total = 0
        for frame in rows:
            for page, n, text in zip(frame["page_number"], frame["total_pages"], frame["markdown"]):
                self.pages.updateValue((int(page),), (text,))
                total = int(n)
        found = sorted((k[0], v[0]) for k, v in self.pages.iterator())
        if total and len(found) >= total:
            self.pages.clear()
            yield pd.DataFrame({"doc_id": [int(key[0])], "total_pages": pd.array([total], dtype="int32"), "markdown": ["".join(t or "" for _, t in found)]})

    def close(self) -> None:
        pass


def assemble(pages: DataFrame) -> DataFrame:
    """A stream of pages -> whole documents."""
    return pages.groupBy("doc_id").transformWithStateInPandas(PageAssembler(), PageAssembler.SCHEMA, "Append", "None")


class TaskStatus(StreamingQueryListener):
    """The state of each stream by its id: Pending, Processing, Completed or Failed."""

    def __init__(self):
        self.states: dict[str, str] = {}

    def onQueryStarted(self, event):
        self.states[str(event.id)] = "Pending"

    def onQueryProgress(self, event):
        self.states[str(event.progress.id)] = "Processing"

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.states[str(event.id)] = "Failed" if event.exception else "Completed"
