"""Tables as immutable versions: files are written first, and one small entry of a log publishes them.

`<folder>/data/batch=<name>` holds what one write put there, `<folder>/_log/<number>.json` says which of these folders a version
adds to the one before it, and which it drops. Readers follow the log: files without an entry don't exist for them. An
entry appears by a rename that fails where its number is taken, so of two writers one is told to read again. A batch that
is in the log already changes nothing, so a writer may be killed anywhere and run again. A table keeps one layout: either
rows are appended and replaced, always in folders by the same columns, or they are merged and removed by key.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.relational import upsert

_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has published since this one read the table."""


class Versions:
    """A table at `folder`, on any file system that Spark can write."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, *more: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *more)))

    def log(self) -> list[dict]:
        """The entries in order: version, parent, batch, add, drop, by, schema, facts."""
        at = self._path("_log")
        fs = at.getFileSystem(self._conf)
        if not fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        out = []
        for name in names:
            stream = fs.open(self._path("_log", name))
            try:
                out.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
        return out

    @staticmethod
    def _folders(log: list[dict], version: int | None = None) -> list[str]:
        held: dict[str, None] = {}
        for e in log:
            if version is None or e["version"] <= version:
                for x in e["drop"]:
                    held.pop(x, None)
                held |= dict.fromkeys(e["add"])
        return list(held)

    def _read(self, folders: list[str], schema: str, keep_bucket: bool = False) -> DataFrame:
        if not folders:
            rows = self.spark.createDataFrame([], schema)
        else:
            rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/{x}" for x in folders])
        return rows.drop("batch", *([] if keep_bucket else [_BUCKET]))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the last one if none is given. ValueError where nothing was ever published."""
        log = self.log()
        if not log:
            raise ValueError(f"{self.folder} has no version")
        return self._read(self._folders(log, version), log[-1]["schema"])

    def _write(self, rows: DataFrame, by: tuple[str, ...], log: list[dict]) -> list[str]:
        """Write a new folder; its parts by the columns of `by`, those that have files."""
        if log and log[-1]["by"] != list(by) and self._folders(log):
            raise ValueError(f"{self.folder} is laid out by {log[-1]['by']}, not by {list(by)}")
        name = f"batch={uuid.uuid4().hex}"
        (rows.write.partitionBy(*by) if by else rows.write).parquet(f"{self.folder}/data/{name}")
        if by != (_BUCKET,):
            return [name]
        at = self._path("data", name)
        return [f"{name}/{s.getPath().getName()}" for s in at.getFileSystem(self._conf).listStatus(at) if s.getPath().getName().startswith(f"{_BUCKET}=")]

    def _publish(self, log: list[dict], batch: str, add: list[str], drop: list[str], schema: str, facts: dict, by: tuple[str, ...] = ()) -> int:
        version = log[-1]["version"] + 1 if log else 0
        entry = {"version": version, "parent": version - 1 if log else None, "batch": batch, "add": add, "drop": drop, "by": list(by), "schema": schema, "facts": facts}
        ready, final = self._path("_log", f".{uuid.uuid4().hex}"), self._path("_log", f"{version:020d}.json")
        fs = ready.getFileSystem(self._conf)
        stream = fs.create(ready, False)
        stream.write(json.dumps(entry).encode())
        stream.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(ready).toUri(), self._conf)
        try:
            files.rename(fs.makeQualified(ready), fs.makeQualified(final), self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0))
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            fs.delete(ready, False)
            raise Conflict(f"version {version} of {self.folder} is taken") from error
        return version

    def _known(self, log: list[dict], batch: str | None) -> int | None:
        return next((e["version"] for e in log if batch is not None and e["batch"] == batch), None)

    def append(self, rows: DataFrame, *, batch: str | None = None, by: tuple[str, ...] = (), facts: dict | None = None) -> int:
        """A version with rows added, in folders by the columns of `by`; the version number. Writers that only append don't conflict."""
        log = self.log()
        if (known := self._known(log, batch)) is not None:
            return known
        add = self._write(rows, by, log)
        while True:
            try:
                return self._publish(log, batch or add[0], add, [], rows.schema.toDDL(), facts or {}, by)
            except Conflict:
                log = self.log()
                if (known := self._known(log, batch)) is not None:  # the same batch, by a twin of this writer
                    return known

    def replace(self, rows: DataFrame, *, batch: str | None = None, facts: dict | None = None) -> int:
        """A version that holds rows alone."""
        log = self.log()
        if (known := self._known(log, batch)) is not None:
            return known
        add = self._write(rows, (), [])
        return self._publish(log, batch or add[0], add, self._folders(log), rows.schema.toDDL(), facts or {})

    def _rewritten(self, keys: DataFrame, key: str, log: list[dict]) -> tuple[DataFrame, list[str]]:
        """The rows and the folders of the buckets that the keys lie in."""
        touched = {f"{_BUCKET}={r[0]}" for r in keys.select(self._bucket(key)).distinct().collect()}
        old = [x for x in self._folders(log) if x.partition("/")[2] in touched]
        return self._read(old, log[-1]["schema"]) if log else keys.limit(0), old

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int").alias(_BUCKET)

    def merge(self, rows: DataFrame, key: str, *, keep: tuple[str, ...] = (), batch: str | None = None, facts: dict | None = None) -> int:
        """A version with rows in place of those of their keys; `keep`: columns whose held value stays. Only the buckets (by a hash of the key) that
        get rows are written anew. Rows without a key are left out, of rows that share one, one counts."""
        log = self.log()
        if (known := self._known(log, batch)) is not None:
            return known
        new = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
        old, drop = self._rewritten(new, key, log)
        both = upsert(old, new, key, keep) if log else new
        return self._swap(both.select(*(old.columns if log else new.columns)), key, log, drop, batch, facts)

    def remove(self, keys: DataFrame, key: str, *, batch: str | None = None, facts: dict | None = None) -> int:
        """A version without the rows of these keys."""
        log = self.log()
        if (known := self._known(log, batch)) is not None:
            return known
        old, drop = self._rewritten(keys, key, log)
        return self._swap(old.join(keys.select(key), key, "left_anti").select(*old.columns), key, log, drop, batch, facts)

    def _swap(self, rows: DataFrame, key: str, log: list[dict], drop: list[str], batch: str | None, facts: dict | None) -> int:
        bucketed = rows.withColumn(_BUCKET, self._bucket(key)).hint("rebalance", _BUCKET)
        add = self._write(bucketed, (_BUCKET,), log)
        return self._publish(log, batch or uuid.uuid4().hex, add, drop, rows.schema.toDDL(), facts or {}, (_BUCKET,))

    def history(self) -> DataFrame:
        """version, parent, batch, added, dropped, facts: a row for each version."""
        rows = [(e["version"], e["parent"], e["batch"], len(e["add"]), len(e["drop"]), {k: str(v) for k, v in e["facts"].items()}) for e in self.log()]
        return self.spark.createDataFrame(rows, "version long, parent long, batch string, added int, dropped int, facts map<string,string>")
