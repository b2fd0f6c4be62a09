"""Where a store lies and what it is called."""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import Path

BACKENDS = ("sqlite", "inMemory", "cloud")
ENVIRONMENTS = ("development", "production", "local")


def first_named(*candidates: str | None) -> str | None:
    """The first that is not blank, trimmed: configuration, runtime, default."""
    return next((c.strip() for c in candidates if c and c.strip()), None)


@dataclass(frozen=True)
class StoreConfiguration:
    root: str
    name: str = "default"
    container: str | None = None
    environment: str | None = None
    backend: str = "sqlite"
    model_version: int = 1
    app_data_version: int | None = None
    legacy_routes: tuple[str, ...] = ()

    def __post_init__(self):
        if self.backend not in BACKENDS:
            raise ValueError(self.backend)

    def resolved(self, runtime: str | None = None) -> StoreConfiguration:
        """With its environment fixed: a store without a container is local."""
        found = first_named(self.environment, runtime) or ("local" if not self.container or self.backend != "cloud" else "production")
        if found not in ENVIRONMENTS:
            raise ValueError(found)
        return replace(self, environment=found)

    @property
    def canonical_path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.name}"

    def path(self, is_there=lambda p: Path(p).exists()) -> str:
        """The canonical path if there is a store; else the first legacy one
        that has one; else the canonical path."""
        for p in (self.canonical_path, *(f"{r.rstrip('/')}/{self.name}" for r in self.legacy_routes)):
            if is_there(p):
                return p
        return self.canonical_path

    @property
    def scope(self) -> str:
        """What ledgers are kept by."""
        fixed = self.resolved()
        return f"{self.name}|{self.container or ''}|{fixed.environment}|{self.backend}|{self.model_version}"
