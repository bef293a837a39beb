"""De-duplication of the activities of live videos.

Input is one row per described window, in any order: ``video_id, window_idx, window_start, is_last,
activities`` (activities in video time, starting no earlier than their window). Once all windows up
to one have arrived, nothing can start before the next window, so everything up to there is scanned
and what can no longer overlap is emitted. State is what overlaps the horizon plus windows that
came early, whatever the length of the video. Each early window is a state row of its own, written
when it comes and removed when it is taken up; other updates do not touch it.

A video that gets no window for ``timeout_ms`` is closed by its timer without its missing windows. Of
a closed video a mark stays for as long again, so that windows delivered once more are not taken
for a new video; then nothing of it is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.overlap import Kept, OverlapScan
from ..operators.dedup import THRESHOLD
from ..operators.windows import WINDOW_STRIDE

OUTPUT = "video_id string, kept_no bigint, start double, end double, description string"
_COLUMNS = ["video_id", "kept_no", "start", "end", "description"]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Book:
    """A video's counters: first window not yet taken up, the final one once known, slots given."""

    next: int = 0
    last: int | None = None
    kept: int = 0
    closed: bool = False
    timer: int | None = None


_BOOK = "next bigint, last bigint, kept bigint, closed boolean, timer bigint"
_WINDOW = "start array<double>, end array<double>, description array<string>"
_OPEN = "slot bigint, start double, end double, description string"
_WAITING = "start double, window bigint, no bigint, end double, description string"


class LiveScan(StatefulProcessor):
    """The overlap scan of each video, carried on from window to window."""

    def __init__(self, threshold: float, stride: float, timeout_ms: int | None, by_event: bool):
        self.threshold, self.stride, self.timeout_ms, self.by_event = threshold, stride, timeout_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", _BOOK)
        self.early = handle.getMapState("early", "window bigint", _WINDOW)
        self.open = handle.getListState("open", _OPEN)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        book = Book(*self.book.get()) if self.book.exists() else Book()
        came: dict[int, list] = {}
        seen_ms = 0
        for frame in rows:
            if self.by_event:
                seen_ms = max(seen_ms, int(frame["event_ms"].max()))
            if not book.closed:
                self._take(book, frame, came)
        if book.closed:
            self._watch(book, timerValues, seen_ms)
            self.book.update(astuple(book))
            return
        fresh = []
        while True:
            if book.next in came:
                fresh += came.pop(book.next)
            elif self.early.containsKey((book.next,)):
                fresh += self._early(book.next)
            else:
                break
            book.next += 1
        for window, activities in came.items():
            self.early.updateValue((window,), tuple([a[i] for a in activities] for i in (0, 3, 4)))
        ended = book.last is not None and book.next > book.last
        yield from self._settled(key[0], book, fresh, ended)
        self._watch(book, timerValues, seen_ms)
        self.book.update(astuple(book))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        book = Book(*self.book.get()) if self.book.exists() else Book(closed=True)
        if book.closed:
            self.book.clear()
            return
        # Missing windows are given up: everything that came is scanned.
        late = sorted(w for (w,) in self.early.keys())
        fresh = [a for w in late for a in self._early(w)]
        yield from self._settled(key[0], book, fresh, True)
        book.timer = None
        self._watch(book, timerValues, expiredTimerInfo.getExpiryTimeInMs())
        self.book.update(astuple(book))

    def close(self) -> None:
        pass

    def _take(self, book: Book, frame: pd.DataFrame, came: dict[int, list]) -> None:
        for row in frame.itertuples(index=False):
            window = int(row.window_idx)
            if row.is_last:
                book.last = window
            if window < book.next or window in came or self.early.containsKey((window,)):
                continue  # a window that was delivered twice
            spans = [a for a in row.activities if a["start"] is not None and a["end"] is not None]
            came[window] = [(a["start"], window, i, a["end"], a["description"]) for i, a in enumerate(spans)]

    def _early(self, window: int) -> list[tuple]:
        start, end, description = self.early.getValue((window,))
        self.early.removeKey((window,))
        return [(s, window, i, e, d) for i, (s, e, d) in enumerate(zip(start, end, description))]

    def _settled(self, video_id: str, book: Book, fresh: list[tuple], ended: bool) -> Iterator[pd.DataFrame]:
        """Scan what starts before the horizon; emit what is settled by then."""
        horizon = float("inf") if ended else book.next * self.stride
        held = [tuple(a) for a in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((a for a in held + fresh if a[0] < horizon), key=lambda a: a[:3])
        rest = [a for a in held + fresh if a[0] >= horizon]
        was_open = [tuple(k) for k in self.open.get()] if self.open.exists() else []
        scan = OverlapScan(self.threshold, [Kept(slot, False, *span) for slot, *span in was_open])
        done: list[Kept] = []
        for start, _, _, end, description in due:
            done += scan.settle(start)
            book.kept += scan.push(Kept(book.kept, False, start, end, description))
        done += scan.live if ended else scan.settle(horizon)
        now_open = [] if ended else [(k.slot, k.start, k.end, k.description) for k in scan.live]
        for state, before, after in ((self.open, was_open, now_open), (self.waiting, held, rest)):
            if not after and before:
                state.clear()
            elif after != before:
                state.put(after)
        book.closed = ended
        if ended:
            self.early.clear()
        if done:
            yield pd.DataFrame([(video_id, k.slot, k.start, k.end, k.description) for k in done], columns=_COLUMNS)

    def _watch(self, book: Book, timers, seen_ms: int) -> None:
        """Put the video's only timer ``timeout_ms`` after the last thing heard of it."""
        if self.timeout_ms is None:
            return
        now = seen_ms if self.by_event else timers.getCurrentProcessingTimeInMs()
        due = now + self.timeout_ms
        if self.by_event:
            due = max(due, book.timer or 0, timers.getCurrentWatermarkInMs() + 1)
        if book.timer != due:
            if book.timer is not None:
                self.handle.deleteTimer(book.timer)
            self.handle.registerTimer(due)
            book.timer = due


def dedup_stream(
    windows: DataFrame,
    threshold: float = THRESHOLD,
    stride: float = WINDOW_STRIDE,
    timeout_ms: int | None = None,
    event_time: str | None = None,
) -> DataFrame:
    """Kept activities as they are settled; the same rows as the batch form gives in the end.

    ``timeout_ms`` counts on the clock, and Spark then keeps triggering to watch it; or, with the name
    of an ``event_time`` column that has a watermark, on event time, so that a run may end with its input
    (``availableNow``). Without it a video with a missing window stays open and closed ones keep
    their mark. State is kept in RocksDB; the session's setting is made here if there is none.
    """
    if event_time is not None and timeout_ms is None:
        raise ValueError("an event time column is only used with a timeout")
    spark = windows.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)
    mode = "none" if timeout_ms is None else "processingTime" if event_time is None else "eventTime"
    columns = ["video_id", "window_idx", "window_start", "is_last", "activities"]
    rows = windows.select(*columns)
    if event_time is not None:
        rows = windows.select(*columns, event_time, F.unix_millis(event_time).alias("event_ms"))
    return rows.groupBy("video_id").transformWithStateInPandas(
        LiveScan(threshold, stride, timeout_ms, event_time is not None), OUTPUT, "Append", mode
    )
