"""Packets and snapshot deltas over Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.delta import diff_documents
from ..functions.jsontext import canonical_text, parse
from ..operators import documents

#: State stores that snapshot_deltas() needs; set before the query starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def packet_stream(stream: DataFrame, doc: str | Column = "doc", **options) -> DataFrame:
    """The packet columns of each document; stateless, the same on a batch."""
    return stream.withColumn("packet", documents.create_packet(F.col(doc) if isinstance(doc, str) else doc, **options))


def distinct_packets(stream: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """Each packet hash once within the watermark."""
    return stream.withColumn("packet_hash", F.col("packet.packet_hash")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["packet_hash"])


class _Deltas(StatefulProcessor):
    """Patches of a key's snapshots; state: the last document, dropped after a time without a new one."""

    def __init__(self, order: str, doc: str, keep_ms: int | None):
        self.order, self.doc, self.keep_ms = order, doc, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "doc string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values([self.order, self.doc])
        last = parse(self.last.get()[0]) if self.last.exists() else None
        out = []
        for seq, text in zip(arrived[self.order], arrived[self.doc]):
            now = parse(text)
            out.append((key[0], seq, None if last is None else canonical_text(diff_documents(last, now))))
            last = now
        self.last.update((canonical_text(last),))
        yield pd.DataFrame(out, columns=["key", "seq", "patch"])

    def close(self) -> None:
        pass


def snapshot_deltas(stream: DataFrame, key: str = "key", order: str = "seq", doc: str = "doc", keep_ms: int | None = None) -> DataFrame:
    """Patch of each snapshot against the one before it of the same key.

    State is the key's last document, kept for `keep_ms` after it came, or for good; the session needs
    STATE_STORE. The first snapshot has a null patch. Within a micro-batch snapshots go by `order`; a
    late one is compared with what was seen last.
    """
    rows = stream.filter(F.col(doc).isNotNull()).select(F.col(key).cast("string").alias(key), F.col(order).cast("long").alias(order), doc)
    return rows.groupBy(key).transformWithStateInPandas(_Deltas(order, doc, keep_ms), "key string, seq long, patch string", "Append", "None" if keep_ms is None else "ProcessingTime")
