"""Last-answer links on a stream: the latest earlier answer for each address, in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "address string, seq long, link long"


def last_answers(rows: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(address, seq, link) for each query of the stream ``rows`` (address, seq, answer boolean): the seq of the latest answer before it.

    Rows of one trigger are put in order of ``seq``. The state of an address is one number; with ``keep_ms`` it goes
    after so long without an answer.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        # A query comes before an answer of the same seq: only strictly earlier answers count.
        for seq, answer in sorted((int(s), bool(a)) for b in batches for s, a in zip(b["seq"], b["answer"], strict=True)):
            if answer:
                last = seq
            else:
                out.append((keys[0], seq, last))
        if last is not None:
            state.update((last,))
            if keep_ms:
                state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=["address", "seq", "link"]).astype({"link": "Int64"})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("address").applyInPandasWithState(update, OUTPUT, "last long", "append", timeout)
