"""Packets as a stream: every micro-batch of raw records is looked up in the historical blocking index."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kinweave.operators import blocking, candidates, values
from kinweave.operators.rules import STRONG, Rule


def lookup_stream(packets: DataFrame, history_index: DataFrame, rules: list[Rule], path: str, checkpoint: str, per_profile: int = 300):
    """Starts a query that writes the candidate events of each batch to ``path``/batch=<id>; repeating a batch replaces it."""

    def run(batch: DataFrame, number: int) -> None:
        rows = blocking.block_rows(values.profile_values(batch), rules)
        events = candidates.limit_history(candidates.history_pairs(rows, history_index), STRONG, per_profile)
        events.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return packets.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
