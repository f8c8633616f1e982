"""Replay of logs as they grow: each lake's fold is a state that Structured Streaming keeps, so a batch reads its new records, and
writes the state of the lakes that it touches, whose size the limits of compaction bound."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import state

OUT = "lake string, tbl_id int, version int, location string, dropped boolean"


def replay_stream(log: DataFrame) -> DataFrame:
    """log(lake, pos, record), records of a lake in order of pos within and between batches: the tables that each batch changed,
    and those that it dropped, with the version that they had."""

    def fold(key, frames, kept):
        s = state.from_checkpoint(bytes(kept.get[0])) if kept.exists else state.State()
        s.sealed = bool(kept.get[1]) if kept.exists else False
        before = {i: (t.version, t.location) for i, t in s.tables.items()}
        rows = pd.concat(list(frames)).sort_values("pos")
        if not s.sealed:
            s.replay(bytes(r) for r in rows["record"])
        kept.update((state.to_checkpoint(s), s.sealed))
        out = [(key[0], i, t.version, t.location, False) for i, t in s.tables.items() if before.get(i) != (t.version, t.location)]
        out += [(key[0], i, *was, True) for i, was in before.items() if i not in s.tables]
        yield pd.DataFrame(out, columns=["lake", "tbl_id", "version", "location", "dropped"]).astype(object)

    return log.groupBy("lake").applyInPandasWithState(fold, OUT, "checkpoint binary, sealed boolean", "append", GroupStateTimeout.NoTimeout)
