"""The new-item decisions on a stream of listing runs, with the account's items as state."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.new_items import HEAD_WINDOW, RELEASE_LIMIT

# as in ``rooms``: the process beside the driver may not have this package on its path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "account string, item string, run bigint, event string"


class NewItemProcessor(StatefulProcessor):
    """State per account: whether its baseline is built, its last post count, and its items.

    Input rows: account, run, item, pos, total, kind ('listing' or 'done'). Events out: queued,
    deep_position or known, ready (also the retries), reported. An item counts as reported only
    when its details arrived ('done').
    """

    def __init__(self, mode: str = "head", head: int = HEAD_WINDOW, limit: int = RELEASE_LIMIT):
        self.mode, self.head, self.limit = mode, head, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.account = handle.getValueState("account", "base_run bigint, last_run bigint, total bigint, before bigint, queued int, ready int")
        self.items = handle.getMapState("items", "item string", "seen int, notified int, run bigint")
        self.open = handle.getMapState("open", "item string", "run bigint")  # confirmed items whose details have not arrived

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows), ignore_index=True).sort_values(["run", "pos", "item"])
        out: list[tuple] = []
        for run, part in data.groupby("run", sort=True):
            for item in part.loc[part["kind"] == "done", "item"]:
                if self.items.containsKey((item,)):
                    seen, _, last = self.items.getValue((item,))
                    self.items.updateValue((item,), (int(seen), 1, last))
                    if self.open.containsKey((item,)):
                        self.open.removeKey((item,))
                    out.append((item, run, "reported"))
            listing = part[part["kind"] == "listing"].drop_duplicates("item")
            if not listing.empty:
                out += self._listing(int(run), listing)
        if out:
            yield pd.DataFrame([(key[0], i, int(r), e) for i, r, e in out], columns=["account", "item", "run", "event"])

    def _listing(self, run: int, listing: pd.DataFrame) -> list[tuple]:
        """Events of a run's listing or of a further part of it. Items already seen in the run, and older runs, are replays."""
        known = [int(t) for t in listing["total"] if not pd.isna(t)]
        total, state = (known[0] if known else None), self.account.get()
        if state is None:
            base, last, before, queued, ready = run, run, None, 0, 0
        else:
            base, last, stored, before, queued, ready = state
            if run < last:
                return []
            if run == last:
                total = stored if stored is not None else total
            else:
                before, queued, ready = stored, 0, 0
        out = []
        # an unknown total, now or in the run before, allows nothing
        quota = max(0, total - int(before)) if total is not None and before is not None else 0
        if self.mode == "head" and state is not None and run > last:
            listed = set(listing["item"])
            for (item,), _ in list(self.open.iterator()):
                if item not in listed:
                    seen, notified, _ = self.items.getValue((item,))
                    self.items.updateValue((item,), (int(seen), int(notified), run))
                    out.append((item, run, "ready"))
        for item, pos in zip(listing["item"], listing["pos"]):
            if self.items.containsKey((item,)):
                seen, notified, at = (int(x) for x in self.items.getValue((item,)))
                if notified or at == run:
                    continue
                free = self.mode == "head" or ready < self.limit
                if free:
                    ready += 1
                    out.append((item, run, "ready"))
                    if self.mode == "head":
                        self.open.updateValue((item,), (run,))
                self.items.updateValue((item,), (seen + 1, 1 if self.mode == "quota" and free else 0, run))
            elif run == base:
                self.items.updateValue((item,), (2, 1, run))
                out.append((item, run, "baseline"))
            elif (self.mode == "head" and pos < self.head) or (self.mode == "quota" and queued < quota):
                queued += 1
                self.items.updateValue((item,), (1, 0, run))
                out.append((item, run, "queued"))
            else:
                self.items.updateValue((item,), (2, 1, run))
                out.append((item, run, "deep_position" if self.mode == "head" else "known"))
        self.account.update((base, run, total, before, queued, ready))
        return out

    def close(self) -> None:
        pass


def detect_new_items(listings: DataFrame, mode: str = "head", head: int = HEAD_WINDOW, limit: int = RELEASE_LIMIT) -> DataFrame:
    """New-item events of a listing stream. Needs the RocksDB state store."""
    return listings.groupBy("account").transformWithStateInPandas(
        statefulProcessor=NewItemProcessor(mode, head, limit), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
