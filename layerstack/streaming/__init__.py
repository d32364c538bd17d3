"""A trained stack over streams.

Codes and losses depend on one row only, so they are stateless and the batch operators work on
streaming tables unchanged. This starts the usual sink for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from layerstack.plans.estimator import StackedAutoencoderModel


def score_stream(
    model: StackedAutoencoderModel,
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keep: list[str],
    available_now: bool = False,
) -> StreamingQuery:
    """Append `keep` columns, codes and losses of a stream to a parquet table."""
    coded = model.score(model.encode(stream)).select(*keep, "code", "loss")
    writer = coded.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


__all__ = ["score_stream"]
