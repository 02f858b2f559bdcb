"""A keyed store on files: one row per key, kept up to date by runs that are merged as they grow.

A load writes one run: the newest row per key of its batch, in folders by a hash of the key. Runs are kept in order of
age, and each holds at least twice as many rows as the next newer one; a load that breaks this rule
merges the runs at the end of the list. So there are at most log2(rows) runs, a read sees at most twice
the rows of the oldest run, and a row is rewritten about log2(rows / rows of a load) times.

The list of runs is a manifest, a small JSON file with a number. It is written under another name
and renamed last (the file system must rename in one step): readers take the highest number and never see half a load, and a load that broke off leaves only
folders that no manifest names. A manifest names the last batch, so a replayed batch changes nothing.
Manifests older than the one before the current are deleted with all folders that no manifest is left to name, so a
reader may be one load behind. One writer at a time.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinefold.sources.store import mart_overwrite, upsert_latest

BATCH, BUCKET = "load_batch", "key_bucket"
#: A run has at least this many times the rows of the next newer one.
RATIO = 2
KEPT_MANIFESTS = 2


class KeyedStore:
    """The store below `path`: the last batch of a key wins, inside a batch the greatest `newest` columns.

    `buckets` is fixed by the first load; take so many that one holds some gigabytes. Null keys are one key. The store has
    the columns of all its loads; a column that a load lacks is null in its rows. An empty batch only moves the number on.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], newest: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.newest, self.buckets = spark, path.rstrip("/"), keys, newest, buckets

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, folder = self._files(), self._at("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json"))

    def _read(self, number: int) -> dict:
        stream = self._files().open(self._at(f"manifests/{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The current list of runs, oldest first, each with its folder and rows."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "last_batch": -1, "buckets": self.buckets, "runs": []}
        return self._read(numbers[-1])

    def _publish(self, manifest: dict) -> None:
        fs, number = self._files(), manifest["number"]
        draft = self._at(f"manifests/{uuid.uuid4().hex}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._at(f"manifests/{number}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"manifest {number} of {self.path} was written by another writer")

    def _clean(self) -> None:
        """Delete all manifests but the last ones, then the runs that none of those names."""
        fs, numbers = self._files(), self._numbers()
        for number in numbers[:-KEPT_MANIFESTS]:
            fs.delete(self._at(f"manifests/{number}.json"), False)
        needed = {r["folder"] for n in numbers[-KEPT_MANIFESTS:] for r in self._read(n)["runs"]}
        for status in fs.listStatus(self._at("runs")):
            if f"runs/{status.getPath().getName()}" not in needed:
                fs.delete(status.getPath(), True)

    def _rows(self, runs: list[dict]) -> DataFrame:
        frames = [self.spark.read.schema(T.StructType.fromJson(r["schema"])).parquet(f"{self.path}/{r['folder']}") for r in runs]
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def _latest(self, rows: DataFrame) -> DataFrame:
        return upsert_latest(rows, [BUCKET, *self.keys], [BATCH, *self.newest])

    def _write(self, rows: DataFrame) -> dict:
        folder = f"runs/{uuid.uuid4().hex}"
        mart_overwrite(rows, f"{self.path}/{folder}", [BUCKET])
        run = {"folder": folder, "schema": rows.schema.jsonValue()}
        # Row counts come from the footers.
        return run | {"rows": self._rows([run]).count()}

    def load(self, batch: DataFrame, batch_id: int) -> None:
        """Bring one batch in. Batches come in the order of their ids; an id that was loaded changes nothing."""
        old = self.manifest()
        if batch_id <= old["last_batch"]:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(old["buckets"])).cast("int")
        rows = upsert_latest(batch, self.keys, self.newest)
        new = self._write(rows.withColumn(BATCH, F.lit(batch_id).cast("bigint")).withColumn(BUCKET, bucket))
        runs = old["runs"] + ([new] if new["rows"] else [])
        start, size = len(runs) - 1, new["rows"]
        while start > 0 and runs[start - 1]["rows"] < RATIO * size:
            start -= 1
            size += runs[start]["rows"]
        if start < len(runs) - 1:
            runs = runs[:start] + [self._write(self._latest(self._rows(runs[start:])))]
        self._publish({"number": old["number"] + 1, "last_batch": batch_id, "buckets": old["buckets"], "runs": runs})
        self._clean()

    def read(self) -> DataFrame:
        """One row per key, as of the current manifest."""
        runs = self.manifest()["runs"]
        if not runs:
            raise ValueError(f"{self.path} has no rows")
        return self._latest(self._rows(runs)).drop(BATCH, BUCKET)

    def lookup(self, *key) -> DataFrame:
        """The row of one key; reads one folder of each run."""
        manifest = self.manifest()
        rows = self._rows(manifest["runs"])
        types = {f.name: f.dataType for f in rows.schema.fields}
        values = [F.lit(v).cast(types[k]) for k, v in zip(self.keys, key, strict=True)]
        bucket = F.pmod(F.xxhash64(*values), F.lit(manifest["buckets"])).cast("int")
        for k, v in zip(self.keys, values, strict=True):
            rows = rows.filter(F.col(k).eqNullSafe(v))
        return self._latest(rows.filter(F.col(BUCKET) == bucket)).drop(BATCH, BUCKET)
