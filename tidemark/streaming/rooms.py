"""Live rooms with state and timers: windows anchored at messages, and sessions that end by themselves.

Messages wait in a list until the watermark has passed them, so they are worked off in the order of their times whatever order they
came in. An event-time timer at the oldest waiting message wakes a room that gets no more messages.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Spark starts a stateful processor in a Python process beside the driver too, which may not have this package on its path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Message times are microseconds; timers and the watermark are milliseconds.
MILLI = 1000


class _Settled(StatefulProcessor):
    """Keeps (us, word, n, ends) rows until the watermark passes them; ``settle`` gets them in order of time, endings last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, word string, n bigint, ends boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [r for pdf in rows for r in zip(pdf["us"].tolist(), pdf["word"].tolist(), pdf["n"].tolist(), pdf["ends"].tolist())]
        yield from self._work(key, came, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._work(key, [], timerValues)

    def _work(self, key, came: list[tuple], timerValues) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * MILLI
        rows = sorted([*(self.waiting.get() if self.waiting.exists() else ()), *came], key=lambda r: (r[0], bool(r[3]), r[1] or ""))
        done = [r for r in rows if r[0] <= limit]
        left = rows[len(done):]
        out = self.settle(key, done, left, limit)
        if done or came:
            self.waiting.clear()
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(left[0][0] // MILLI + 1)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def settle(self, key, done: list[tuple], left: list[tuple], limit: int) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class AnchoredTopics(_Settled):
    """A window opens at a message and closes at the first message ``width`` microseconds later or after that.

    State: the open window's start, last message and count, and its words. Closed windows are reported once. After every
    change the open one, and those that the waiting messages would make, are reported as they stand (``closed`` false).
    """

    columns = ["session", "start_us", "end_us", "msg_count", "words", "closed"]

    def __init__(self, width: int, k: int):
        self.width, self.k = width, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.window = handle.getValueState("window", "start bigint, last bigint, n bigint")
        self.words = handle.getMapState("words", "word string", "n bigint")

    def settle(self, key, done: list[tuple], left: list[tuple], limit: int) -> list[tuple]:
        window = list(self.window.get()) if self.window.exists() else None
        words = {w: int(n) for (w,), (n,) in self.words.iterator()} if window else {}
        out, window, words = self._advance(key[0], done, window, words, True)
        if done:
            self.window.update(tuple(window))
            self.words.clear()
            for w, n in words.items():
                self.words.updateValue((w,), (n,))
        if done or left:
            more, window, words = self._advance(key[0], left, window and list(window), dict(words), False)
            out += [*more, self._row(key[0], window, window[1], words, False)]
        return out

    def _advance(self, session, rows: list[tuple], window, words: dict, closed: bool):
        out = []
        for us, word, n, _ in rows:
            us, n = int(us), int(n)
            if window is None or us >= window[0] + self.width:
                if window is not None:
                    out.append(self._row(session, window, us, words, closed))
                window, words = [us, us, 0], {}
            window[1] = us
            if word is None:  # the row that counts the messages of an instant
                window[2] += n
            else:
                words[word] = words.get(word, 0) + n
        return out, window, words

    def _row(self, session, window, end: int, words: dict, closed: bool) -> tuple:
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:self.k]
        return session, int(window[0]), int(end), int(window[2]), ",".join(f"{w}:{n}" for w, n in top), closed


def anchored_topics(messages: DataFrame, session: str, ts: str, words, minutes: int = 5, k: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Anchored windows of a stream: session, start_us, end_us, msg_count, words (the first ``k``, as word:n) and closed.

    ``words`` is a column with the array of a message's words. Messages and words of one instant are combined before the shuffle of state.
    Rows later than the watermark are left out. State holds one window and ``delay`` of messages for each session. ``latest_windows``
    reads what was written.
    """
    d = messages.withWatermark(ts, delay).select(F.col(session).alias("session"), F.col(ts).alias("_ts"), words.alias("_words"))
    one = F.array(F.struct(F.lit(None).cast("string").alias("word"), F.lit(1).cast("long").alias("n")))
    each = F.transform(F.array_distinct("_words"), lambda w: F.struct(w.alias("word"), F.size(F.filter("_words", lambda x: x == w)).cast("long").alias("n")))
    rows = d.select("session", "_ts", F.explode(F.concat(one, F.coalesce(each, F.array().cast("array<struct<word:string,n:bigint>>")))).alias("r"))
    rows = rows.select("session", F.unix_micros("_ts").alias("us"), "r.word", "r.n", F.lit(False).alias("ends"), "_ts")
    kind = messages.schema[session].dataType.simpleString()
    return rows.groupBy("session").transformWithStateInPandas(
        AnchoredTopics(minutes * 60_000_000, k), f"session {kind}, start_us bigint, end_us bigint, msg_count bigint, words string, closed boolean", "Append", "EventTime")


def latest_windows(batches: DataFrame) -> DataFrame:
    """The windows as they stand after the last batch: all closed ones, and each session's newest report of the others."""
    newest = batches.groupBy("session").agg(F.max("batch_id").alias("batch_id"))
    live = batches.where("not closed").join(newest, ["session", "batch_id"])
    return batches.where("closed").unionByName(live.select(*batches.columns)).select(
        "session", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), "msg_count", "words", "closed")


class RoomSessions(_Settled):
    """A session opens at a message; its end message, or ``idle`` microseconds without any, closes it and clears its state."""

    columns = ["session", "started_us", "last_us", "n_messages", "ended_us", "status"]

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.room = handle.getValueState("room", "start bigint, last bigint, n bigint")

    def settle(self, key, done: list[tuple], left: list[tuple], limit: int) -> list[tuple]:
        room, out = list(self.room.get()) if self.room.exists() else None, []

        def silent() -> None:
            nonlocal room
            out.append((key[0], *map(int, room), int(room[1]) + self.idle, "timed_out"))
            room = None

        for us, _, n, ends in done:
            if room is not None and us > room[1] + self.idle:
                silent()
            room = [us, us, n] if room is None else [room[0], us, room[2] + n]
            if ends:
                out.append((key[0], *map(int, room), int(us), "ended"))
                room = None
        if room is not None and room[1] + self.idle <= limit and not (left and left[0][0] <= room[1] + self.idle):
            silent()
        if room is None:
            self.room.clear()
        else:
            self.room.update(tuple(int(x) for x in room))
            self.handle.registerTimer((int(room[1]) + self.idle) // MILLI + 1)
        return out


def room_sessions(messages: DataFrame, session: str, ts: str, ends, idle: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Finished sessions of a stream: session, started_us, last_us, n_messages, ended_us and status (ended or timed_out).

    ``ends`` tells the messages that end a room; of one instant they come last. A room that goes on after its end has a new session.
    A finished room has no state; messages later than the watermark are left out.
    """
    d = messages.withWatermark(ts, delay).select(F.col(session).alias("session"), F.unix_micros(F.col(ts)).alias("us"), F.lit(None).cast("string").alias("word"),
                                                 F.lit(1).cast("long").alias("n"), F.coalesce(ends, F.lit(False)).alias("ends"), F.col(ts).alias("_ts"))
    kind = messages.schema[session].dataType.simpleString()
    micros = int(pd.Timedelta(idle).total_seconds() * 1_000_000)
    return d.groupBy("session").transformWithStateInPandas(
        RoomSessions(micros), f"session {kind}, started_us bigint, last_us bigint, n_messages bigint, ended_us bigint, status string", "Append", "EventTime")
