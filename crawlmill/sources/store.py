"""State as versioned Parquet snapshots with a manifest that is swapped last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class SnapshotStore:
    """Tables under one root on any file system Spark can write; readers see a whole version or the one before.

    A version is written to folders of its own, then the manifest that names them
    replaces the old one by one rename. A batch that fails leaves no trace in it.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._fs.mkdirs(self._path(self.root))
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    @property
    def _manifest(self):
        return self._path(f"{self.root}/manifest.json")

    def version(self) -> dict[str, str]:
        """Folder of each table of the current version."""
        if not self._fs.exists(self._manifest):
            return {}
        stream = self._fs.open(self._manifest)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.version()[name])

    def batch(self, stream: str) -> int:
        """The last micro-batch of ``stream`` that the current version holds; -1 for none."""
        return int(self.version().get(f"batch of {stream}", -1))

    def commit(self, tables: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> dict[str, str]:
        """Writes ``tables`` and makes them current together, with (stream, micro-batch) they come from; other tables stay."""
        stamp, new = uuid.uuid4().hex, self.version()
        if batch is not None:
            new[f"batch of {batch[0]}"] = str(batch[1])
        for name, df in tables.items():
            path = f"{self.root}/{name}/{stamp}"
            df.write.parquet(path)
            new[name] = path
        draft = self._path(f"{self.root}/manifest-{stamp}.json")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(new, indent=1).encode()))
        stream.close()
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark._sc._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._files.rename(draft, self._manifest, how)
        return new


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    key: str | None = None,
    parts: int = 16,
    bounds: tuple[int, int] | None = None,
    **options: str,
) -> DataFrame:
    """A table of a database, read in ``parts`` ranges of ``key`` if bounds are given; its driver must be installed."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        low, high = bounds
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()
