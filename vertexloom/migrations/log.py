"""An opt-in log of migrations: one JSON object a line, members by name."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "at timestamp, event string, migrationID string, version int, phase string, reason string, error string"


class MigrationLog:
    """Appends lines to a file on the driver; writes nothing unless enabled."""

    def __init__(self, path: str | Path, *, enabled: bool = False):
        self.path, self.enabled = Path(path), enabled

    def log(self, event: str, **details) -> None:
        if not self.enabled:
            return
        self.path.parent.mkdir(parents=True, exist_ok=True)
        line = {k: v for k, v in details.items() if v is not None} | {"event": event, "at": dt.datetime.now(dt.UTC).isoformat()}
        with self.path.open("a") as f:
            f.write(json.dumps(line, sort_keys=True) + "\n")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(COLUMNS).json(str(self.path))
