"""Scripts over streams.

Filter, calc, keep, drop, rename and check_datapoint are stateless: their plan
works on a streaming DataFrame as it is.  Everything else runs per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..errors import InvalidArgument
from ..model import Dataset
from ..session import Session


def run_stream(session: Session, name: str, stream: DataFrame, script: str, result: str, ids=None) -> Dataset:
    """A stateless script over a stream: the result is a streaming dataset to write as any other."""
    if not stream.isStreaming:
        raise InvalidArgument(f"{name} is not a stream")
    session.bind(name, stream, ids=ids)
    out = session.run(script)[result]
    if not isinstance(out, Dataset) or not out.df.isStreaming:
        raise InvalidArgument(f"{result} is not a streaming dataset")
    return out


def run_batches(make_session: Callable[[], Session], name: str, stream: DataFrame, script: str, sink: Callable[[dict, int], None], ids=None) -> DataStreamWriter:
    """Any script, evaluated on each micro-batch by itself; ``sink`` gets the outputs and the batch number."""

    def each(batch: DataFrame, number: int) -> None:
        session = make_session()
        session.bind(name, batch, ids=ids)
        sink(session.run(script), number)

    return stream.writeStream.foreachBatch(each)
