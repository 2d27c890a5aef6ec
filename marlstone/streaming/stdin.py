"""Standard input as a table: a bounded stream, spooled to a file that Spark can read, usable once in a script."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
from typing import Any, BinaryIO

from pyspark.sql import SparkSession

from ..errors import PlanFault
from ..sources.files import is_uri


class Spool:
    """folder: one that all executors share, a path or URI; None: the local one for temporary files."""

    def __init__(self, stream: BinaryIO | None = None, folder: str | None = None, spark: SparkSession | None = None):
        self.stream, self.spark, self.path, self.used = stream, spark, "", False
        self.folder = folder.removeprefix("file://") if folder else folder

    def take(self) -> str:
        """The spooled file's path; a second call fails."""
        if self.used:
            raise PlanFault("__STDIN can be used once in a script")
        self.used = True
        return self.file()

    def file(self) -> str:
        if not self.path:
            far = is_uri(self.folder or "")
            if self.folder and not far:
                os.makedirs(self.folder, exist_ok=True)
            handle, path = tempfile.mkstemp(prefix="stdin-", suffix=".txt", dir=None if far else self.folder)
            with os.fdopen(handle, "wb") as f:
                shutil.copyfileobj(self.stream or sys.stdin.buffer, f)
            self.path = path
            if far:
                self.path = f"{self.folder.rstrip('/')}/{os.path.basename(path)}"
                self._filesystem().copyFromLocalFile(True, self._path(path), self._path(self.path))
        return self.path

    def _path(self, path: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(path if is_uri(path) else f"file://{path}")

    def _filesystem(self) -> Any:
        return self._path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def reset(self) -> None:
        self.used = False

    def close(self) -> None:
        if self.path and is_uri(self.path):
            self._filesystem().delete(self._path(self.path), False)
        elif self.path and os.path.exists(self.path):
            os.remove(self.path)
        self.path = ""
