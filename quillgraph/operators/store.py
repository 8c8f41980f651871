"""The graph on disk: versioned Parquet snapshots, a pointer file and the journal."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .journal import RETAINED
from .sync import Graph

SCHEMA_VERSION = 3


class GraphStore:
    """Snapshots under ``root/v=N``; the greatest file of ``root/pointers`` names the one to read.

    A writer puts a whole new version beside the old ones and then adds a pointer,
    by one rename; pointers are never replaced, so at any moment a reader finds a
    whole version.  ``KEPT`` versions and pointers stay, and as many journal entries
    as ``journal.retain`` keeps.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _fs(self):
        return self._paths(self.root).getFileSystem(self._conf)

    def meta(self) -> dict:
        """Version, sequence and project; version 0 before the first write."""
        names = self._names("pointers")
        if not names:
            return {"version": 0, "sequence": 0, "schema": SCHEMA_VERSION, "project": None}
        found = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/pointers/{names[-1]}").collect()))
        if found["schema"] > SCHEMA_VERSION:
            raise ValueError(f"the store's schema {found['schema']} is newer than {SCHEMA_VERSION}")
        return found

    def read(self) -> Graph | None:
        v = self.meta()["version"]
        return Graph(*[self.spark.read.parquet(f"{self.root}/v={v}/{t}") for t in ("nodes", "revisions", "edges")]) if v else None

    def journal(self) -> DataFrame:
        """(sequence, synced_at, entity, op, id)."""
        schema = "synced_at string, entity string, op string, id string, sequence bigint"
        if not self._fs().exists(self._paths(f"{self.root}/journal")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/journal")

    def write(self, graph: Graph, delta: DataFrame, project: str | None, now: str) -> dict:
        """Write the next version, append the delta to the journal, move the pointer."""
        meta = self.meta()
        if meta["project"] not in (None, project):
            raise ValueError(f"the store belongs to {meta['project']}")
        v, seq = meta["version"] + 1, meta["sequence"] + 1
        for name, t in graph.tables().items():
            t.write.mode("overwrite").parquet(f"{self.root}/v={v}/{name}")
        delta.select(F.lit(now).alias("synced_at"), "entity", "op", "id").write.mode("overwrite").parquet(f"{self.root}/journal/sequence={seq}")
        new = {"version": v, "sequence": seq, "schema": SCHEMA_VERSION, "project": project}
        self._put(f"{v:012d}", json.dumps(new))
        self._trim(v, seq)
        return new

    def _names(self, folder: str) -> list[str]:
        path = self._paths(f"{self.root}/{folder}")
        found = [f.getPath().getName() for f in self._fs().listStatus(path)] if self._fs().exists(path) else []
        return sorted(n for n in found if not n.endswith(".part"))

    def _trim(self, version: int, sequence: int) -> None:
        """Delete what is no longer kept, pointers before their versions."""
        for name in self._names("pointers"):
            if int(name) <= version - self.KEPT:
                self._fs().delete(self._paths(f"{self.root}/pointers/{name}"), False)
                self._fs().delete(self._paths(f"{self.root}/v={int(name)}"), True)
        for name in self._names("journal"):
            if name.startswith("sequence=") and int(name[9:]) <= sequence - RETAINED:
                self._fs().delete(self._paths(f"{self.root}/journal/{name}"), True)

    def _put(self, name: str, body: str) -> None:
        fs, part = self._fs(), self._paths(f"{self.root}/pointers/{name}.part")
        out = fs.create(part, True)
        out.write(bytearray(body.encode()))
        out.close()
        if not fs.rename(part, self._paths(f"{self.root}/pointers/{name}")):
            raise RuntimeError(f"another writer made version {int(name)}")
