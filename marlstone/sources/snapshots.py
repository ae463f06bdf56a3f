"""Tables of an index that change together: immutable Parquet files, and a manifest for each generation.

A commit writes new files first, and then the manifest of the next generation, which is renamed into place; readers see the
last generation or any earlier one, and never a mixture. Rows of a file die when a later generation replaces or drops the file:
such files are listed by generation, and reads leave the dead rows out, until compact() writes the tables anew.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column of stored rows: the generation that wrote them. Files that are gone are broadcast up to so many.
GENERATION, BROADCAST_FILES = "_generation", 1_000_000
#: Bytes that a task sorts and writes of a table that is laid out without a shuffle.
TASK_BYTES = 64 << 20
#: Spark then deletes the shuffles of a write when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Snapshots:
    """Tables with a column file_path in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = lambda *parts: jvm.Path("/".join((folder, *parts)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        at = self._path("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, generation: int | None = None) -> dict:
        """Tables, their schemas and their loads at a generation, by default the last; without any, an empty one."""
        known = self.generations()
        if generation is None and not known:
            return {"generation": 0, "tables": {}, "gone": []}
        if generation is not None and generation not in known:
            raise LookupError(f"generation {generation} is not in {self.folder}")
        name = f"{known[-1] if generation is None else generation:012d}.json"
        text = self.spark.read.text(f"{self.folder}/manifests/{name}", wholetext=True).first().value
        return json.loads(text)

    def _publish(self, manifest: dict) -> int:
        name = f"{manifest['generation']:012d}.json"
        hidden, final = self._path("manifests", f".{uuid.uuid4().hex}"), self._path("manifests", name)
        out = self._fs.create(hidden, False)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(hidden, final):
            self._fs.delete(hidden, False)
            raise RuntimeError(f"generation {manifest['generation']} of {self.folder} was written by another")
        return manifest["generation"]

    def _bytes(self, table: str, loads: list[str]) -> int:
        return sum(self._fs.getContentSummary(self._path(table, f"load={x}")).getLength() for x in loads)

    def _load(self, table: str, rows: DataFrame, generation: int, layout: dict, size: int | None = None) -> str:
        """Writes rows as a load of a table and returns its name.

        layout: partition (a column), order (columns in a file), local. Tasks of a local one write a file for each partition of
        their own rows, sorted, so that rows are not shuffled; size, the bytes that they are made of, says how many tasks.
        """
        load = f"{generation:012d}-{uuid.uuid4().hex[:8]}"
        named = rows.withColumn(GENERATION, F.lit(generation).cast("long"))
        if layout.get("local"):
            named = named if size is None else named.coalesce(max(-(-size // TASK_BYTES), self.spark.sparkContext.defaultParallelism))
        elif layout.get("partition"):
            named = named.repartition(layout["partition"])
        if layout.get("order"):
            named = named.sortWithinPartitions(*layout["order"])
        writer = named.write.option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd")
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            (writer.partitionBy(layout["partition"]) if layout.get("partition") else writer).parquet(f"{self.folder}/{table}/load={load}")
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return load

    def _rows(self, table: str, schema: T.StructType, loads: list[str]) -> DataFrame:
        stored = T.StructType([*schema.fields, T.StructField(GENERATION, T.LongType())])
        paths = [f"{self.folder}/{table}/load={x}" for x in loads]
        return self.spark.read.schema(stored).option("basePath", f"{self.folder}/{table}").parquet(*paths)

    def _gone(self, manifest: dict) -> DataFrame | None:
        """file_path, last: files whose rows of generations before last are dead."""
        if not manifest["gone"]:
            return None
        paths = [f"{self.folder}/gone/load={g['load']}" for g in manifest["gone"]]
        rows = self.spark.read.schema(f"file_path string, {GENERATION} long").parquet(*paths)
        last = rows.groupBy("file_path").agg(F.max(GENERATION).alias("_last"))
        return F.broadcast(last) if sum(g["files"] for g in manifest["gone"]) <= BROADCAST_FILES else last

    def read(self, table: str, generation: int | None = None, where=None) -> DataFrame:
        """Live rows of a table at a generation, of those that fit where, a condition on stored columns."""
        m = self.manifest(generation)
        known = m["tables"].get(table)
        if known is None:
            raise LookupError(f"no table {table} in {self.folder}")
        schema = T.StructType.fromJson(known["schema"])
        if not known["loads"]:
            return self.spark.createDataFrame([], schema)
        rows = self._rows(table, schema, known["loads"])
        rows = rows if where is None else rows.filter(where)
        gone = self._gone(m)
        if gone is not None:
            dead = (rows["file_path"] == gone["file_path"]) & (rows[GENERATION] < gone["_last"])
            rows = rows.join(gone, dead, "left_anti")
        return rows.select(*schema.names)

    def commit(self, tables: dict, gone: DataFrame | None = None, layouts: dict[str, dict] | None = None, settings: dict | None = None) -> int:
        """Adds rows to tables, the rows of all files in gone(file_path) dying, and returns the new generation.

        Rows are a DataFrame, or a pair: the name of an earlier one of tables, and a function that makes a DataFrame of the rows
        that were written of it.
        Raises if another commit was faster; what was written is then unused, as after a failed write.
        """
        m = self.manifest()
        generation, known = m["generation"] + 1, m["tables"]
        layouts = layouts or {}
        for name, rows in tables.items():
            if isinstance(rows, DataFrame) and name in known and sorted(T.StructType.fromJson(known[name]["schema"]).names) != sorted(rows.columns):
                raise ValueError(f"{name} has other columns than before")
        if gone is not None and m["generation"]:
            files = gone.select("file_path").distinct()
            load = self._load("gone", files, generation, {})
            n = self.spark.read.schema("file_path string").parquet(f"{self.folder}/gone/load={load}").count()
            m["gone"].append({"load": load, "files": n})
        for name, rows in tables.items():
            layout, size = layouts.get(name) or known.get(name, {}).get("layout") or {}, None
            if not isinstance(rows, DataFrame):
                of, make = rows
                made = known[of]["loads"][-1:]
                rows, size = make(self._rows(of, T.StructType.fromJson(known[of]["schema"]), made)), self._bytes(of, made)
            load = self._load(name, rows, generation, layout, size)
            before = known.get(name, {"loads": [], "schema": rows.schema.jsonValue()})
            known[name] = before | {"loads": [*before["loads"], load], "layout": layout}
        settings = m.get("settings", {}) | (settings or {})
        return self._publish(m | {"generation": generation, "tables": known, "settings": settings})

    def settings(self) -> dict:
        return self.manifest().get("settings", {})

    def drop(self, files: DataFrame) -> int:
        """Rows of all files(file_path) die in every table."""
        return self.commit({}, files)

    def compact(self) -> int:
        """Writes the live rows of all tables as one load each; earlier generations can still be read."""
        m = self.manifest()
        generation = m["generation"] + 1
        for name, known in m["tables"].items():
            size = self._bytes(name, known["loads"])
            known["loads"] = [self._load(name, self.read(name), generation, known["layout"], size)]
        return self._publish(m | {"generation": generation, "gone": []})
