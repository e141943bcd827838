"""Packets of a recording that is still being written: the gate of decodable packets as a stream.

State for each recording is typed: whether its gate is open, the places of the parameter packets before its first key frame, and the
packets that have come but may still be overtaken by earlier ones. Packets are decided in the order of `place` once the watermark has passed
their time, so packets that come late within the watermark's delay are decided in their place, whatever the micro-batches; later ones are
dropped by the watermark. Nothing of a recording is held but packets of about that delay and parameter packets before its first key frame.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "recording string, place bigint"
#: The store of typed state.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gate(StatefulProcessor):
    """The packets that can be decoded: all from the first key frame on that has parameter sets in it or before it.

    Parameter packets before a key frame without its own come with it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "open boolean")
        self.held = handle.getListState("held", "place bigint")
        self.waiting = handle.getMapState("waiting", "place bigint", "ms bigint, has_idr boolean, has_sps boolean, params_only boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        times = set()
        for r in rows:
            ms = int(r["time"].timestamp() * 1000)
            self.waiting.updateValue((r["place"],), (ms, bool(r["has_idr"]), bool(r["has_sps"]), bool(r["params_only"])))
            times.add(ms)
        for ms in times:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        due = sorted((k[0], *v) for k, v in self.waiting.iterator() if v[0] <= mark)
        is_open = self.open.exists() and bool(self.open.get()[0])
        for place, _, idr, sps, params in due:
            self.waiting.removeKey((place,))
            held = [] if is_open else [h[0] for h in self.held.get()]
            if not is_open and idr and (sps or held):
                is_open = True
                self.open.update((True,))
                self.held.clear()
                for h in [] if sps else held:
                    yield Row(recording=key[0], place=h)
            if is_open:
                yield Row(recording=key[0], place=place)
            elif params:
                self.held.appendValue((place,))

    def close(self) -> None:
        pass


def gated(packets: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """packets: a stream of recording, place, time (a timestamp that grows with place), has_idr, has_sps, params_only.

    delay: how late a packet may come. Needs STORE as spark.sql.streaming.stateStore.providerClass.
    """
    rows = packets.withWatermark("time", delay)
    return rows.groupBy("recording").transformWithState(
        statefulProcessor=Gate(), outputStructType=OUT, outputMode="Append", timeMode="EventTime"
    )
