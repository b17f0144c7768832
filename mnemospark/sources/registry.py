"""The registry of projects: one JSON file, and how fresh each project is."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RETRIES, POOL = 5, 8


def write_atomically(path: Path, text: str) -> None:
    """Write beside the file and rename; a busy target is tried again, each time later."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, fresh = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w") as f:
        f.write(text)
    for turn in range(RETRIES + 1):
        try:
            os.replace(fresh, path)
            return
        except PermissionError:
            if turn == RETRIES:
                raise
            time.sleep(0.01 * 2**turn)


class Registry:
    def __init__(self, file: str):
        self.file = Path(file)

    def entries(self) -> list[dict]:
        return json.loads(self.file.read_text()) if self.file.exists() else []

    def register(self, name: str, path: str, store: str, commit: str = "") -> None:
        rest = [e for e in self.entries() if e["path"] != path]
        write_atomically(self.file, json.dumps([*rest, {"name": name, "path": path, "store": store, "commit": commit}], indent=1))

    def forget(self, path: str) -> bool:
        rest = [e for e in self.entries() if e["path"] != path]
        found = len(rest) < len(self.entries())
        write_atomically(self.file, json.dumps(rest, indent=1))
        return found

    def listed(self, spark: SparkSession) -> DataFrame:
        """(name, path, store, head, state): fresh, stale, or unknown where git has no answer."""

        def one(e: dict) -> tuple[str, str, str, str | None, str]:
            done = subprocess.run(["git", "-C", e["path"], "rev-parse", "HEAD"], capture_output=True, text=True)
            head = done.stdout.strip() if done.returncode == 0 else None
            state = "unknown" if head is None else "fresh" if head == e["commit"] else "stale"
            return e["name"], e["path"], e["store"], head, state

        with ThreadPoolExecutor(POOL) as pool:
            rows = list(pool.map(one, self.entries()))
        return spark.createDataFrame(rows, "name string, path string, store string, head string, state string")
