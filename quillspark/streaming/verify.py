"""Quotes that arrive as a stream, answered from a prepared corpus batch by batch.

The corpus is static, so no state is kept: each micro-batch is the batch plan over its quotes. A
batch's responses are written under its number, so a batch that runs again replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import records
from quillspark.plans import verify


def verify_stream(quotes: DataFrame, papers: DataFrame, corpus: DataFrame, out: str, checkpoint: str, mode: str = "blocked") -> StreamingQuery:
    """Answer all quotes that are there (quote_id, quote..) and end; responses go to ``out``/batch=n."""

    def answer(batch: DataFrame, number: int) -> None:
        verify.verify_quotes(papers, batch, mode, corpus).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return quotes.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def renew_stream(stored: DataFrame, documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Make stale records of a stream anew, pass fresh ones on."""

    def renew(batch: DataFrame, number: int) -> None:
        records.renew(batch, documents).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stored.writeStream.foreachBatch(renew).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
