"""Opening a graph: readiness, why it fails, and what it tells its listeners."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field
from typing import Any


class OpenFailure(Exception):
    """A store could not be opened; it was left untouched."""


class PreflightFailed(OpenFailure): ...


class MigrationFailed(OpenFailure): ...


class IncompatibleStore(OpenFailure): ...


class StoreUnreadable(OpenFailure): ...


class AlreadyOpen(OpenFailure): ...


@dataclass(frozen=True)
class Event:
    """kind: state, warning or error."""

    kind: str
    name: str
    detail: Any = None


@dataclass
class Bus:
    """Events wait until a listener is there, and come in order."""

    listener: Callable[[Event], None] | None = None
    waiting: list[Event] = field(default_factory=list)

    def attach(self, listener: Callable[[Event], None]) -> None:
        self.listener = listener
        for event in self.waiting:
            listener(event)
        self.waiting.clear()

    def emit(self, event: Event) -> None:
        self.waiting.append(event) if self.listener is None else self.listener(event)


_open: dict[str, "Opening"] = {}


class Opening:
    """Runs preflight, the phases before opening, the opening itself and the
    phases after it, and resolves ``ready`` exactly once."""

    def __init__(self, path: str, open_store: Callable[[], Any], *, migrations=None, preflight: Callable[[], None] | None = None, bus: Bus | None = None):
        self.path, self.bus, self.ready, self.state = path, bus or Bus(), Future(), "initializing"
        if path in _open:
            self._fail(AlreadyOpen(path))
            return
        try:
            self._step(PreflightFailed, preflight)
            self._step(MigrationFailed, migrations and (lambda: migrations.handle("preInit")))
            store = self._step(StoreUnreadable, open_store)
            for phase in ("postInit", "postMigration", "ready"):
                self._step(MigrationFailed, migrations and (lambda p=phase: migrations.handle(p, store)))
        except OpenFailure as e:
            self._fail(e)
            return
        _open[path] = self
        self.state = "ready"
        self.bus.emit(Event("state", "ready"))
        self.ready.set_result(store)

    def _step(self, failure: type[OpenFailure], run):
        try:
            return run() if run else None
        except OpenFailure:
            raise
        except Exception as e:
            raise failure(str(e)) from e

    def _fail(self, error: OpenFailure) -> None:
        self.state = "failed"
        self.bus.emit(Event("error", type(error).__name__, str(error)))
        self.ready.set_exception(error)

    def when_ready(self, told: Callable[[Any, Exception | None], None]) -> None:
        self.ready.add_done_callback(lambda f: told(None, f.exception()) if f.exception() else told(f.result(), None))

    def close(self) -> None:
        if _open.get(self.path) is self:
            del _open[self.path]
