"""Several tables published together: a log of manifests, each a snapshot of pointers to tables that never change.

A table is written under a name of its own; a manifest, whose number is the version, then names the tables of all names at once. A version is there when its manifest is there whole, so
readers see all tables of one version or of another, whatever happens between. A writer that fails leaves tables that no manifest names, or half a manifest, which is none; clean() removes
them. Manifests are made only where none of their number is, so of two writers one goes on to the next number, unless it said which version it builds on: then it is refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has published since the version that this one builds on."""


class Published:
    """Tables by name at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _manifest(self, version: int) -> dict | None:
        """A manifest's tables, or None where it isn't there whole."""
        at = self._at(f"log/{version:012d}.json")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            found = json.loads(bytes(stream.readAllBytes()))
        except ValueError:
            return None
        finally:
            stream.close()
        return found["tables"] if isinstance(found, dict) and found.get("version") == version else None

    def versions(self) -> list[int]:
        return [v for name in self._names("log") if name.endswith(".json") and self._manifest(v := int(name[:-5])) is not None]

    def tables(self, version: int | None = None) -> dict[str, str]:
        """The names of a version, the last one by default, and where their rows are."""
        if version is None:
            version = max(self.versions(), default=0)
        found = self._manifest(version) if version else {}
        if found is None:
            raise ValueError(f"there is no version {version}")
        return found

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.tables(version)[name]}")

    def publish(self, tables: dict[str, DataFrame], without: tuple[str, ...] = (), builds_on: int | None = None) -> int:
        """A new version with these tables, those of the last version that are not among them, and not those in `without`; its number. The frames may read what is published now."""
        written = {}
        for name, df in tables.items():
            written[name] = f"data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{written[name]}")
        while True:
            last = max(self.versions(), default=0)
            if builds_on is not None and last != builds_on:
                raise Conflict(f"built on version {builds_on}, but {last} is there")
            kept = {name: at for name, at in self.tables(last or None).items() if name not in without}
            numbers = [int(x[:-5]) for x in self._names("log") if x.endswith(".json")]
            version = max([0, *numbers]) + 1  # half a manifest keeps its number
            if self._put(version, kept | written):
                return version

    def _put(self, version: int, tables: dict[str, str]) -> bool:
        """Makes a manifest where none of its number is; whether it did."""
        try:
            stream = self._fs.create(self._at(f"log/{version:012d}.json"), False)
        except Exception as e:
            if "already exists" in str(e):
                return False
            raise
        stream.write(bytearray(json.dumps({"version": version, "tables": tables}, sort_keys=True).encode()))
        stream.close()
        return True

    def clean(self, keep: int = 2) -> list[str]:
        """Removes the tables that none of the last `keep` versions names, and their manifests; what was removed. Not while a writer is at work."""
        kept = self.versions()[-keep:]
        wanted = {at for v in kept for at in self.tables(v).values()}
        gone = [f"data/{x}" for x in self._names("data") if f"data/{x}" not in wanted]
        gone = [f"log/{x}" for x in self._names("log") if not x.endswith(".json") or int(x[:-5]) not in kept] + gone
        for x in gone:
            self._fs.delete(self._at(x), True)
        return gone
