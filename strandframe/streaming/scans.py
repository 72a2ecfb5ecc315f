"""Streams: motif scan of new files, skipping known sequences, running responder state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strandframe.operators.motifs import scan_motifs
from strandframe.sources.fasta import KeyFunction, parse_records


def stream_fasta(spark: SparkSession, path: str, key: KeyFunction | None = None) -> DataFrame:
    """Sequences of FASTA files as they land in a folder."""
    raw = spark.readStream.option("lineSep", "\n>").text(path).withColumn("arrived", F.current_timestamp())
    return parse_records(raw, key).select("seq_id", "seq", "arrived")


def stream_scan(seqs: DataFrame, motifs: list[tuple[str, str]]) -> DataFrame:
    """Motif hits of a stream of sequences; no state is kept."""
    return scan_motifs(seqs, motifs)


def stream_dedupe(seqs: DataFrame, time: str = "arrived", delay: str = "1 day", seq: str = "seq") -> DataFrame:
    """Sequences not seen within the watermark, by content. State expires with the watermark."""
    return seqs.withColumn("digest", F.md5(seq)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"])


class ResponderState(StatefulProcessor):
    """Weekly sums of one patient: at most one entry per study week, whatever the number of readings."""

    def __init__(self, need: int):
        self.need = need

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weeks = handle.getMapState("weeks", "week int", "total double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for week, g in pdf.groupby("week")["val"]:
                k = (int(week),)
                total, n = self.weeks.getValue(k) if self.weeks.containsKey(k) else (0.0, 0)
                self.weeks.updateValue(k, (float(total) + float(g.sum()), int(n) + int(len(g))))
        line = sorted((k[0], v[0] / v[1]) for k, v in self.weeks.iterator())
        calm = sum(b[1] - a[1] <= 0 for a, b in zip(line, line[1:]))
        yield pd.DataFrame({"pat": [key[0]], "n_weeks": [len(line)], "n_steps": [calm], "responder": [calm > self.need]})

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_responder(tl: DataFrame, need: int = 3) -> DataFrame:
    """Latest responder state of each patient with new readings ``(pat, week, val)``.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return tl.select("pat", "week", "val").groupBy("pat").transformWithStateInPandas(
        statefulProcessor=ResponderState(need), outputStructType="pat long, n_weeks int, n_steps int, responder boolean",
        outputMode="Update", timeMode="None")


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process everything available now into Parquet under ``path`` and return the result.

    Update streams are written batch by batch with the batch number.
    """
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/_state")
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/data").start()
    else:
        query = writer.outputMode(mode).foreachBatch(
            lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{path}/data")).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/data")
