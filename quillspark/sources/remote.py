"""Files handed to a remote service: upload, wait until they are ready, clean up."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WAITING, READY, FAILED = "PROCESSING", "ACTIVE", "FAILED"


class Store(Protocol):
    """A service that takes files; a handle names one, ``state`` is one of the states above."""

    def put(self, name: str, content: bytes) -> str: ...

    def state(self, handle: str) -> str: ...

    def delete(self, handle: str) -> None: ...


class OfflineStore:
    """A stand-in: a PDF is ready at the second look, other files fail there."""

    def __init__(self) -> None:
        self.kept: dict[str, tuple[bytes, int]] = {}

    def put(self, name: str, content: bytes) -> str:
        self.kept[f"files/{name}"] = content, 0
        return f"files/{name}"

    def state(self, handle: str) -> str:
        content, looks = self.kept[handle]
        self.kept[handle] = content, looks + 1
        return WAITING if looks < 1 else READY if content[:5] == b"%PDF-" else FAILED

    def delete(self, handle: str) -> None:
        del self.kept[handle]


def upload(files: DataFrame, make_store: Callable[[], Store] = OfflineStore, use: Callable[[Store, str], str] | None = None, delay: float = 2.0, most_looks: int = 150) -> DataFrame:
    """``path, handle, state, result, error`` of each file of ``path, content``.

    A file is put, looked at every ``delay`` seconds until it is no longer ``PROCESSING``, used if it is
    ready (``use`` gets the store and the handle), and deleted again whatever happened. One that
    fails, or that is not ready after ``most_looks``, says so and does not end the run.
    """

    def one(store: Store, path: str, content: bytes | None) -> tuple:
        handle, state, result = None, None, None
        try:
            handle = store.put(path.rpartition("/")[2], bytes(content or b""))
            for _ in range(most_looks):
                state = store.state(handle)
                if state != WAITING:
                    break
                time.sleep(delay)
            if state != READY:
                return path, handle, state, None, f"file processing failed: {state}"
            result = use(store, handle) if use else None
            return path, handle, state, result, None
        except Exception as e:  # isolated by row
            return path, handle, state, None, f"{type(e).__name__}: {e}"
        finally:
            if handle is not None:
                try:
                    store.delete(handle)
                except Exception:  # cleaning up must not hide what happened  # noqa: S110
                    pass

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = make_store()
        for b in batches:
            yield pd.DataFrame([one(store, p, c) for p, c in zip(b["path"], b["content"])], columns=["path", "handle", "state", "result", "error"])

    return files.select(F.col("path"), F.col("content")).mapInPandas(run, "path string, handle string, state string, result string, error string")
