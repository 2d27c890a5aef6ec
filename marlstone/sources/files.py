"""File names: a table's name finds a file by the exact name, then without regard to case, extension, or both."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..errors import PlanFault

HIDDEN = (".", "_")


def is_uri(path: str) -> bool:
    return "://" in path or path.startswith("file:")


@dataclass
class Finder:
    """Looks names up under a base folder, which may be a URI that only Spark reads."""

    spark: SparkSession
    base: str
    strict: bool = False
    _lists: dict[str, list[str]] = field(default_factory=dict)

    def listing(self, folder: str) -> list[str]:
        if not is_uri(folder):
            return sorted(os.listdir(folder or ".")) if os.path.isdir(folder or ".") else []
        if folder not in self._lists:
            jvm, jsc = self.spark._jvm, self.spark._jsc
            path = jvm.org.apache.hadoop.fs.Path(folder)
            fs = path.getFileSystem(jsc.hadoopConfiguration())
            self._lists[folder] = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
        return self._lists[folder]

    def place(self, name: str) -> str:
        """The path a new file of this name has."""
        return name if os.path.isabs(name) or is_uri(name) else f"{self.base.rstrip('/')}/{name}" if is_uri(self.base) else os.path.join(self.base, name)

    def find(self, name: str) -> str:
        path = self.place(name)
        folder, _, wanted = path.rpartition("/")
        names = self.listing(folder)
        if wanted in names:
            return path
        if self.strict:
            raise PlanFault(f"no file is named {name}")
        stem = lambda x: x.rpartition(".")[0] or x
        for same in (lambda x: x.lower() == wanted.lower(), lambda x: stem(x) == wanted, lambda x: stem(x).lower() == wanted.lower()):
            found = [x for x in names if same(x) and not x.startswith(HIDDEN)]
            if len(found) == 1:
                return f"{folder}/{found[0]}"
            if found:
                raise PlanFault(f"{name} is ambiguous: {', '.join(found)}")
        raise PlanFault(f"no file for table {name}")

    def exists(self, path: str) -> bool:
        folder, _, name = path.rpartition("/")
        return name in self.listing(folder) if is_uri(path) else os.path.exists(path)
