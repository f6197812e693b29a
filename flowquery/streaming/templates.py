"""A collector's templates as state: messages in, records out, while the stream goes on.

For each exporter and domain a map holds the templates by number, and a list the data sets that wait for one, because messages may come late.
Event-time timers drop templates that were not sent again and sets that waited in vain. The session's state store must be one that
``transformWithState`` supports (``spark.sql.streaming.stateStore.providerClass``: the RocksDB one).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from flowquery.sources import exports

COLUMNS = [c.split()[0] for c in exports.SCHEMA.split(", ")]
HELD = "seq long, part int, at long, version int, scopes int, body binary"
WAITING = "seq long, part int, at long, template int, body binary"


class Collector(StatefulProcessor):
    """A data set is read by the latest definition of its number before it that has come so far. If none has come, it waits for ``wait`` seconds."""

    def __init__(self, expire: int, wait: int):
        self.expire, self.wait = expire, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.templates = handle.getMapState("templates", "template int", HELD)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["seq", "part"], kind="stable")
        out: list[tuple] = []
        held = {k[0]: v for k, v in self.templates.iterator()}
        before = list(self.waiting.get())
        now = timerValues.getCurrentWatermarkInMs() // 1000
        waiting = [w for w in before if now - w[2] <= self.wait]  # timers come after a trigger's rows
        changed = set()
        for r in batch.itertuples():
            if r.defines:
                if r.template not in held or (held[r.template][0], held[r.template][1]) < (r.seq, r.part):
                    held[r.template] = (int(r.seq), int(r.part), int(r.at), int(r.version), int(r.scopes), bytes(r.body))
                    changed.add(r.template)
            elif not self._read(key, held.get(r.template), (r.seq, r.part, r.at, r.template, r.body), out):
                waiting.append((int(r.seq), int(r.part), int(r.at), int(r.template), bytes(r.body)))
        if changed:  # a late definition may be before sets that wait
            waiting = [w for w in waiting if w[3] not in changed or not self._read(key, held[w[3]], w, out)]
        for number in changed:
            self.templates.updateValue((number,), held[number])
        if waiting != before:
            self._keep(waiting)
        for at in {int(a) for a in batch["at"]}:
            for later in {self.expire, self.wait}:
                self.handle.registerTimer((at + later + 1) * 1000)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        for number in [k for k, v in self.templates.iterator() if now - v[2] > self.expire]:
            self.templates.removeKey(number)
        waiting = list(self.waiting.get())
        left = [w for w in waiting if now - w[2] <= self.wait]
        if len(left) != len(waiting):
            self._keep(left)
        yield pd.DataFrame([], columns=COLUMNS)

    def close(self) -> None:
        pass

    def _keep(self, waiting: list[tuple]) -> None:
        if waiting:
            self.waiting.put([tuple(w) for w in waiting])
        else:
            self.waiting.clear()

    def _read(self, key: tuple, definition: tuple | None, data: tuple, out: list[tuple]) -> bool:
        """Whether the set is settled: its records were added to ``out``, or its template is withdrawn or expired."""
        seq, part, at, _, body = data
        if definition is None or (definition[0], definition[1]) > (seq, part):
            return False
        _, _, seen, version, scopes, fields = definition
        if at - seen <= self.expire:
            out += [(*key, seq, part, n, scopes >= 0, found) for n, found in enumerate(exports.records_of(bytes(body), bytes(fields), version))]
        return True


def collect(messages: DataFrame, expire: int = exports.EXPIRE, wait: int = 60, delay: str = "0 seconds") -> DataFrame:
    """``exports.decode`` of a stream of messages (exporter, seq, payload), to be written in append mode.

    As in a batch, but that a data set is not read anew if a later definition before it comes after it was settled. ``delay``: of the watermark over the messages' times.
    """
    parts = exports.sets(messages).withColumn("_time", F.timestamp_seconds("at")).withWatermark("_time", delay)
    return parts.groupBy("exporter", "domain").transformWithStateInPandas(Collector(expire, wait), exports.SCHEMA, "Append", "EventTime")
