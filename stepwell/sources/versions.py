"""Versions of a table of files: snapshots, restores and promotions behind one pointer.

A version is a manifest (path, digest, holder); contents lie once, with the version that
first held them.  A snapshot writes only what changed, a restore or a promotion writes no
content at all.  Which version is current is said by the last file of a log, whose names
are taken by a rename that fails if the name is there: readers see the old or the new
version whole, and of two writers that began at one version the second is refused.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, digest string, holder string"


class Versions:
    """The versions under one folder, which all executors must share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()
        self._log = self._hadoop.fs.Path(f"{self.root}/log")
        self._fs = self._log.getFileSystem(self._conf)

    def history(self) -> list[str]:
        """Versions in the order in which they became current: one short file each."""
        if not self._fs.exists(self._log) or not any(f.getPath().getName()[0].isdigit() for f in self._fs.listStatus(self._log)):
            return []
        entries = self.spark.read.text(f"{self.root}/log").select("value", F.input_file_name().alias("file"))
        return [r.value for r in sorted(entries.collect(), key=lambda r: r.file)]

    def current(self) -> str | None:
        return (self.history() or [None])[-1]

    def _switch(self, version: str, seen: int) -> None:
        """Make a version current, unless the log has grown beyond the ``seen`` entries."""
        path = self._hadoop.fs.Path
        draft, entry = path(f"{self.root}/log/_{uuid.uuid4().hex}"), path(f"{self.root}/log/{seen:012d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(version, "utf-8"))
        out.close()
        context = self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(entry), no_overwrite)
        except Py4JJavaError as refused:
            self._fs.delete(draft, False)
            if not self._fs.exists(entry):
                raise
            raise RuntimeError("another writer made a version current; read it and try again") from refused

    def manifest(self, version: str | None = None) -> DataFrame:
        """(path, digest, holder) of a version, the current one if none is named; empty before the first."""
        version = version or self.current()
        if version is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{version}")

    def read(self, version: str | None = None) -> DataFrame:
        """(path, content) of a version."""
        held = self.manifest(version)
        if not self._fs.exists(self._hadoop.fs.Path(f"{self.root}/contents")):
            return held.select("path", F.lit(None).cast("string").alias("content"))
        contents = self.spark.read.schema("path string, content string, holder string").parquet(f"{self.root}/contents")
        return held.join(contents, ["holder", "path"]).select("path", "content")

    def snapshot(self, files: DataFrame) -> str:
        """Write ``files`` (path, content; other columns are left out) as the next version.

        A null content is kept as such.  A null or repeated path is refused, before anything is current.
        """
        seen, version = self.history(), f"v{uuid.uuid4().hex}"
        new = files.select("path", "content", F.sha2("content", 256).alias("digest"))
        old = self.manifest(seen[-1] if seen else None).select("path", F.col("digest").alias("was"), "holder")
        both = new.join(old, "path", "left").withColumn("same", F.col("holder").isNotNull() & F.col("digest").eqNullSafe(F.col("was")))
        both.filter(~F.col("same")).select("path", "content").write.parquet(f"{self.root}/contents/holder={version}")
        holder = F.when(F.col("same"), F.col("holder")).otherwise(version).alias("holder")
        both.select("path", "digest", holder).write.parquet(f"{self.root}/manifests/{version}")
        wrong = self.manifest(version).groupBy("path").count().filter("path IS NULL OR count > 1").limit(1).collect()
        if wrong:
            raise ValueError(f"a path is null or repeated: {wrong[0].path!r}")
        self._switch(version, len(seen))
        return version

    def restore(self, version: str) -> None:
        """Make an earlier version current again."""
        seen = self.history()
        if version not in seen:
            raise ValueError(f"no such version: {version}")
        self._switch(version, len(seen))

    def promote(self, base: str, candidate: str, allowed: DataFrame) -> str:
        """The next version: ``base``, but the ``allowed`` paths (column path) as ``candidate`` has them.

        An allowed path that the candidate lacks goes; what else the candidate changed stays out.
        """
        seen, version = self.history(), f"v{uuid.uuid4().hex}"
        allowed = allowed.select("path").distinct()
        kept = self.manifest(base).join(allowed, "path", "left_anti")
        taken = self.manifest(candidate).join(allowed, "path", "left_semi")
        kept.unionByName(taken).write.parquet(f"{self.root}/manifests/{version}")
        self._switch(version, len(seen))
        return version
