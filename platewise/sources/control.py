"""Control table: which versions of which tables are complete.

One folder per table, ``<root>/_control/<table>/``, with a small JSON file for
each committed version (metadata, written through Spark's file-system layer,
so it works wherever the tables are).  A version that is committed again goes
to a new file, ``<version>.<attempt>.json``, and the newest attempt counts, so
that there is no moment without it:

* ``version`` — 0, 1, 2 …, one sequence per table for batch loads and streams
  alike, so a stream carries on where a load stopped;
* ``run`` — what wrote it (``load:20250101``, ``stream:customers:4``); a
  replayed run gets its own version again and replaces its own output;
* ``kind`` — ``full`` (replaces what came before) or ``delta``;
* ``max_key`` — the largest surrogate key issued so far, so that the next run
  needs no scan for it;
* ``parts`` — what else a reader has to know: the buckets of a dimension, the
  segment of a key index, the months of a fact's rows.

A version is committed after its data is written: readers see committed
versions only.  A table has one writer at a time (the scheduler's job).
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Version:
    version: int
    run: str
    kind: str
    max_key: int
    parts: dict = field(default_factory=dict)


class Control:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._seen: dict[str, list[Version]] = {}

    def _folder(self, table: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, "_control", table))
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[Version]:
        """Committed versions in order (one for each run of the table)."""
        if table not in self._seen:
            jvm, _, fs = self._folder(table)
            found = []
            for file in self._files(table).values():
                stream = fs.open(max(file)[1])
                found.append(Version(**json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))))
                stream.close()
            self._seen[table] = sorted(found, key=lambda v: v.version)
        return self._seen[table]

    def _files(self, table: str) -> dict[int, list]:
        """version: its (attempt, path) list"""
        _, path, fs = self._folder(table)
        files: dict[int, list] = {}
        for status in fs.listStatus(path) if fs.exists(path) else ():
            version, *attempt, end = status.getPath().getName().split(".")
            if version and end == "json":
                files.setdefault(int(version), []).append((int(attempt[0]), status.getPath()))
        return files

    def version_for(self, table: str, run: str) -> int:
        """The version that ``run`` writes: its own again, or the next one."""
        done = self.versions(table)
        own = [v.version for v in done if v.run == run]
        return own[0] if own else done[-1].version + 1 if done else 0

    def before(self, table: str, version: int) -> Version | None:
        """The newest committed version older than ``version``."""
        older = [v for v in self.versions(table) if v.version < version]
        return older[-1] if older else None

    def last(self, table: str) -> Version | None:
        done = self.versions(table)
        return done[-1] if done else None

    def commit(self, table: str, version: int, run: str, kind: str = "delta", max_key: int = 0,
               parts: dict | None = None) -> None:
        jvm, path, fs = self._folder(table)
        row = json.dumps(asdict(Version(version, run, kind, int(max_key), parts or {})))
        earlier = self._files(table).get(version, [])
        attempt = max((n for n, _ in earlier), default=-1) + 1
        part = jvm.org.apache.hadoop.fs.Path(path, f".{version}.{attempt}.part")
        out = fs.create(part, True)
        out.write(bytearray(row.encode()))
        out.close()
        if not fs.rename(part, jvm.org.apache.hadoop.fs.Path(path, f"{version}.{attempt}.json")):
            raise OSError(f"cannot commit version {version} of {table}")
        for _, old in earlier:
            fs.delete(old, False)
        self._seen.pop(table, None)

    def forget(self, table: str, version: int) -> None:
        """Drop a version that no reader needs any more."""
        _, _, fs = self._folder(table)
        for _, file in self._files(table).get(version, []):
            fs.delete(file, False)
        self._seen.pop(table, None)
