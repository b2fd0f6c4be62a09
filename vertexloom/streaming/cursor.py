"""Cursors of a feed: how far it was processed and how far it was delivered.

Processing advances before delivery; a failed delivery keeps its cursor, and
the same changes are delivered again.  A cursor is a small file that is
replaced whole.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fnv1a
from . import feed


class Cursor:
    """``start``: where a feed without a cursor begins: ``replay`` all, or at the ``head``."""

    def __init__(self, folder: str, store: str, kind: str):
        self.path = Path(folder) / f"{fnv1a(store)}.{kind}.json"
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def get(self) -> int | None:
        """None if there is none, or if it can't be read (it is then removed)."""
        try:
            return int(json.loads(self.path.read_text())["tx"])
        except FileNotFoundError:
            return None
        except (ValueError, KeyError, TypeError):
            self.path.unlink()
            return None

    def set(self, tx: int) -> None:
        temporary = self.path.with_suffix(".tmp")
        temporary.write_text(json.dumps({"tx": tx}))
        temporary.replace(self.path)


class Feed:
    """Polls a log; ``drain`` processes and delivers what is new.

    Calls from several threads are merged into one run that goes on until
    nothing is pending.
    """

    def __init__(self, log: Callable[[], DataFrame], folder: str, store: str, me: str, process: Callable[[DataFrame], None], deliver: Callable[[DataFrame, bool], None], start: str = "replay"):
        self.log, self.me, self.process, self.deliver, self.start = log, me, process, deliver, start
        self.processing, self.delivery = Cursor(folder, store, "processing"), Cursor(folder, store, "delivery")
        self._lock, self._pending, self._running = threading.Lock(), False, False

    def _from(self, cursor: Cursor, head: int) -> int:
        found = cursor.get()
        if found is None:
            found = -1 if self.start == "replay" else head
            cursor.set(found)
        return found

    def drain(self) -> None:
        with self._lock:
            self._pending = True
            if self._running:
                return
            self._running = True
        # running ends under the lock that pending is set under, so no call falls between
        while True:
            with self._lock:
                if not self._pending:
                    self._running = False
                    return
                self._pending = False
            try:
                self._cycle()
            except BaseException:
                with self._lock:
                    self._running = False
                raise

    def _cycle(self) -> None:
        log = self.log()
        head = feed.newest(log)
        if head is None:
            return
        done = self._from(self.processing, head)
        shown = self.delivery.get()
        if shown is None:
            self.delivery.set(shown := done)
        if head > done:
            self.process(feed.from_others(log.where((F.col("tx") > done) & (F.col("tx") <= head)), self.me))
            self.processing.set(head)
        if head > shown:
            gap = shown >= 0 and feed.missing_transactions(log, shown)
            due = log.where(F.col("tx") <= head) if gap else log.where((F.col("tx") > shown) & (F.col("tx") <= head))
            self.deliver(feed.ordered(feed.events(feed.surviving(due, self.me))), gap)
            self.delivery.set(head)
