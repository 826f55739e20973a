"""Labels over a stream of findings: each matter's counters and values live in state, and outgoing logs expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Labels(StatefulProcessor):
    """Gives every new (label type, canonical) of a matter the next number of its type, in order of (doc_id, start)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getMapState("next", "label_type string", "n int")
        self.known = handle.getMapState("known", "label_type string, canonical string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["doc_id", "start"])
        out = []
        for t, c in zip(frame["label_type"], frame["canonical"]):
            if self.known.containsKey((t, c)):
                continue
            n = (self.next.getValue((t,))[0] if self.next.containsKey((t,)) else 0) + 1
            self.next.updateValue((t,), (n,))
            self.known.updateValue((t, c), (n,))
            out.append((key[0], t, c, n))
        yield pd.DataFrame(out, columns=["matter_id", "label_type", "canonical", "number"])

    def close(self) -> None:
        pass


def label_stream(findings: DataFrame) -> DataFrame:
    """(matter_id, label_type, canonical, number) of values new to a stream of findings (matter_id string, doc_id, start,
    label_type, canonical). The session needs the RocksDB state store."""
    rows = findings.select("matter_id", "doc_id", "start", "label_type", "canonical")
    return rows.groupBy("matter_id").transformWithStateInPandas(Labels(), "matter_id string, label_type string, canonical string, number int", "append", "none")


def expired(files: DataFrame, now, days: int = 30) -> DataFrame:
    """Files (with a timestamp `modified`) older than the retention."""
    return files.where(F.col("modified") < F.lit(now) - F.expr(f"interval {days} days"))
