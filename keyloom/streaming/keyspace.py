"""The reducer on Structured Streaming: one state value per key, replies as they come.

Rows of a micro-batch are sorted by seq per key. A row at or below the last seq applied to its key is late: it isn't applied
again and gets a reply of kind late, so that replays can't count twice. Deadlines stay in the state and are checked lazily.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyloom.model import REPLY
from keyloom.plans.fold import Key

OUT = f"key string, seq bigint, reply {REPLY}"


class KeyspaceProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("key", "last bigint, entry binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last, one = -1, Key()
        if self.state.exists():
            last, raw = self.state.get()
            one = Key(pickle.loads(raw))
        for r in sorted(rows, key=lambda r: r.seq):
            if r.seq <= last:
                yield Row(key=key[0], seq=r.seq, reply=Row(kind="late", int=None, str=None, arr=None))
                continue
            kind, n, s, arr = one.step(r.cmd, key[0], list(r.rest), r.ts_us)
            last = r.seq
            yield Row(key=key[0], seq=r.seq, reply=Row(kind=kind, int=n, str=s, arr=arr))
        self.state.update((last, pickle.dumps(one.entry)))

    def close(self) -> None:
        pass


def stream_replies(commands: DataFrame) -> DataFrame:
    """commands: a stream of key, seq, ts_us, cmd, rest (arity checked) -> key, seq, reply."""
    return commands.groupBy("key").transformWithState(statefulProcessor=KeyspaceProcessor(), outputStructType=OUT, outputMode="Update", timeMode="None")
