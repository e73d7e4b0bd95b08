"""An index in buckets that is saved at once and patched in part.

Rows lie in buckets by a hash of their key. A save writes the buckets it touches to a new folder and then puts down one manifest, a small file that
names the folder of every bucket, by a rename that fails if that version is there. So a reader sees one version or the one before it, a
writer that dies leaves nothing but folders that no manifest names, of two writers one gets an error, and what a patch writes grows with
the buckets it touches and not with the index. A reader keeps the version it has opened.

Defined results: of rows of one key in a patch the largest of ``order`` wins, ties by a hash of the row, and against stored rows the patch wins ties; a key both fresh and gone is fresh; a null key
is a key; a patch without rows makes no version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from notelake.session import materialize

BUCKETS = 64


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS, order: str | None = None):
        self.spark, self.path, self.key, self.buckets, self.order = spark, path.rstrip("/"), key, buckets, order

    # ---- files of all file systems that Spark knows

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._at("manifests"), self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """Version, schema, epoch and the folder of each bucket; None if nothing was saved yet."""
        known = self.versions()
        if not known:
            return None
        version = known[-1] if version is None else version
        return json.loads(self.spark.sparkContext.wholeTextFiles(self._at("manifests", f"v{version}.json").toString()).first()[1])

    def _commit(self, manifest: dict) -> int:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        draft, final = self._at("manifests", f".{uuid.uuid4().hex}"), self._at("manifests", f"v{manifest['version']}.json")
        out = self._fs().create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), none)  # fails if the version is there
        except Exception as e:
            self._fs().delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} was saved by another writer") from e
        return manifest["version"]

    # ---- rows

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _folder(self, rows: DataFrame) -> dict[str, str]:
        """The rows written, and the folder of each of their buckets."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        found = [x.getPath().getName() for x in self._fs().listStatus(self._at(name)) if x.isDirectory()]
        return {n.removeprefix("_bucket="): f"{name}/{n}" for n in found if n.startswith("_bucket=")}

    def _one_each(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c != "_late"]
        by = F.struct(*([self.order] if self.order else []), *(["_late"] if "_late" in rows.columns else []), F.xxhash64(*columns))
        return rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*columns), by).alias("_row")).select("_row.*")

    def read(self, version: int | None = None) -> DataFrame:
        held = self.manifest(version)
        if held is None:
            raise FileNotFoundError(f"{self.path} holds no index")
        return self._rows(held, held["folders"].values())

    def _rows(self, held: dict, folders) -> DataFrame:
        schema = StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def save(self, rows: DataFrame, epoch: int | None = None) -> int:
        """A new version of these rows alone."""
        known, folders = self.versions(), self._folder(self._one_each(rows))
        return self._commit({"version": (known or [0])[-1] + 1, "schema": json.loads(rows.schema.json()), "epoch": epoch, "folders": folders})

    def patch(self, fresh: DataFrame, gone: DataFrame | None = None, epoch: int | None = None) -> int | None:
        """A new version with ``fresh`` in place of the rows of its keys and without the keys of ``gone``; of ``order``, if there is one, no row gives way to a smaller one.

        ``epoch`` is that of a stream's batch: one that the last version has seen makes no version.
        """
        held = self.manifest()
        if held is None:
            return self.save(fresh, epoch)
        if epoch is not None and held["epoch"] is not None and epoch <= held["epoch"]:
            return None
        fresh = materialize(self._one_each(fresh), "patch")
        keys = fresh.select(self.key) if gone is None else fresh.select(self.key).union(gone.select(self.key))
        touched = sorted(r["b"] for r in keys.select(self._bucket().alias("b")).distinct().collect())  # at most the buckets
        if not touched:
            return None
        old = self._rows(held, [held["folders"][str(b)] for b in touched if str(b) in held["folders"]])
        if gone is not None:
            keep = old[self.key].eqNullSafe(F.col("_gone"))
            old = old.join(gone.select(F.col(self.key).alias("_gone")).distinct(), keep, "left_anti")
        merged = self._one_each(old.withColumn("_late", F.lit(0)).unionByName(fresh.withColumn("_late", F.lit(1)))) if self.order else old.join(fresh.select(F.col(self.key).alias("_new")), old[self.key].eqNullSafe(F.col("_new")), "left_anti").unionByName(fresh)
        made = self._folder(merged)
        folders = {b: f for b, f in held["folders"].items() if int(b) not in touched} | made
        return self._commit({"version": held["version"] + 1, "schema": held["schema"], "epoch": epoch if epoch is not None else held["epoch"], "folders": folders})

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions but the last ``keep``, and folders that no version names; how many. Writers must be at rest."""
        known, fs = self.versions(), self._fs()
        live = {f.rsplit("/", 1)[0] for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in known[:-keep]:
            fs.delete(self._at("manifests", f"v{v}.json"), False)
        at = self._at("data")
        old = [x.getPath() for x in fs.listStatus(at) if f"data/{x.getPath().getName()}" not in live] if fs.exists(at) else []
        for p in old:
            fs.delete(p, True)
        return len(old) + len(known[:-keep])
