"""Migrations by lifecycle phase: registered once, run in order, recorded."""

from __future__ import annotations

import json
import shutil
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from .ledger import Ledger

PHASES = ("preInit", "postInit", "postMigration", "ready")


class Migration(ABC):
    """A job that a store needs once a version."""

    id: str
    version: int = 1
    phase: str = "postInit"
    needs_backup: bool = False

    def needs_run(self, context) -> bool:
        return True

    @abstractmethod
    def run(self, context) -> None: ...

    def remote_changes(self, context, inserted: list[str], updated: list[str]) -> None:
        """Called with the ids that another author inserted or updated."""


@dataclass
class Manager:
    """Runs what is registered; ``progress`` and ``failed`` are told of each step."""

    folder: str
    store_path: str | None = None
    progress: Callable[[str, str, str], None] | None = None
    failed: Callable[[str, Exception], None] | None = None
    migrations: list[Migration] = field(default_factory=list)
    callbacks: dict[str, list[Callable]] = field(default_factory=dict)

    def register(self, *migrations: Migration) -> None:
        for m in migrations:
            if all(x.id != m.id for x in self.migrations):
                self.migrations.append(m)

    def on(self, phase: str, callback: Callable) -> None:
        self.callbacks.setdefault(phase, []).append(callback)

    def ledger(self, m: Migration) -> Ledger:
        return Ledger(self.folder, m.id, m.version)

    def handle(self, phase: str, context=None) -> None:
        """Callbacks, then the phase's migrations in order; the first failure
        is recorded and raised, and what follows does not run."""
        if phase not in PHASES:
            raise ValueError(phase)
        for callback in self.callbacks.get(phase, []):
            callback(context)
        for m in (m for m in self.migrations if m.phase == phase):
            self._run(m, phase, context)

    def open(self, context=None) -> None:
        for phase in PHASES:
            self.handle(phase, context)

    def _run(self, m: Migration, phase: str, context) -> None:
        ledger, tell = self.ledger(m), self.progress or (lambda *a: None)
        forced = ledger.take_force()
        last = ledger.latest()
        if not forced and last is not None and last.state == "done":
            return
        if not forced and not m.needs_run(context):
            ledger.record("notRequired", phase=phase, reason="not needed")
            return
        if m.needs_backup and self.store_path:
            backup(self.store_path, m.id, f"{self.folder}/backups")
        ledger.record("started", phase=phase, reason=forced)
        tell(m.id, phase, "started")
        try:
            m.run(context)
        except Exception as e:
            ledger.record("failed", phase=phase, errorDescription=str(e))
            if self.failed:
                self.failed(m.id, e)
            raise
        ledger.record("done", phase=phase)
        tell(m.id, phase, "done")

    def remote_changes(self, context, inserted: list[str], updated: list[str]) -> None:
        for m in self.migrations:
            m.remote_changes(context, inserted, updated)


def backup(path: str, migration: str, root: str, policy: str = "duplicate") -> Path:
    """Copy a local store or file; policy if there is a backup already: skip,
    overwrite or duplicate (-1, -2 ...)."""
    source, target = Path(path), Path(root) / f"{migration}-{Path(path).name}"
    if target.exists():
        if policy == "skip":
            return target
        if policy == "overwrite":
            shutil.rmtree(target)
        else:
            n = 1
            while (again := target.with_name(f"{target.name}-{n}")).exists():
                n += 1
            target = again
    target.mkdir(parents=True)
    (shutil.copytree if source.is_dir() else shutil.copy2)(source, target / source.name)
    (target / "backup-info.json").write_text(json.dumps({"originalPath": str(source), "migrationID": migration, "createdAt": time.time()}, sort_keys=True))
    return target


def find_backups(path: str, migration: str, root: str) -> list[Path]:
    """Backups of a path by a migration, oldest first."""
    found = []
    for info in Path(root).glob("*/backup-info.json"):
        told = json.loads(info.read_text())
        if (told["originalPath"], told["migrationID"]) == (str(Path(path)), migration):
            found.append((told["createdAt"], info.parent))
    return [p for _, p in sorted(found)]


def restore(folder: Path, overwrite: bool = True) -> Path:
    """Put a backup back where it came from."""
    target = Path(json.loads((folder / "backup-info.json").read_text())["originalPath"])
    if target.exists():
        if not overwrite:
            raise FileExistsError(target)
        shutil.rmtree(target) if target.is_dir() else target.unlink()
    source = folder / target.name
    (shutil.copytree if source.is_dir() else shutil.copy2)(source, target)
    return target
