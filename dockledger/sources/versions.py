"""A partitioned table whose versions share what did not change.

Below the table's path, ``rows/version=N/attempt=ID`` holds the partitions that a writer of version N wrote,
and ``versions/N.json`` the manifest of that version: for each partition of the table the folder that holds
it now, and that folder's files. A version exists once its manifest does; what an attempt without one left
is in no version. The manifest is moved into place whole by a rename that refuses an existing name, so of
two writers that start from one version the later fails, and readers see a version or do not. That needs a
file system whose rename is atomic, as HDFS's is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StaleVersion(RuntimeError):
    """Another writer made the next version first; read the newest and compute again."""


class VersionedTable:
    """One table, partitioned by the columns ``partitions``; no index column, no rewrite of a file."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partitions: Sequence[str]):
        self.spark, self.path, self.schema, self.partitions = spark, path.rstrip("/"), schema, list(partitions)
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions ---------------------------------------------------------

    def _folder(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """Numbers of all versions, oldest first."""
        folder = self._folder("versions")
        if not self._files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def version(self) -> int:
        """The newest version; -1 for a table that has none."""
        return max(self.versions(), default=-1)

    def manifest(self, version: int) -> dict[str, dict]:
        """Partition folders of a version: name to {at, files}; ``at`` is the folder above, files have their sizes."""
        stream = self._files.open(self._folder(f"versions/{version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    # --- reading ----------------------------------------------------------

    def read(self, version: int | None = None, where: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version, the newest by default, with ``version``: the one that wrote a row.

        ``where`` names partition folders; others are not even listed.
        """
        number = self.version() if version is None else version
        if number < 0:
            raise ValueError(f"no version at {self.path}")
        held = self.manifest(number)
        names = list(held) if where is None else [n for n in where if n in held]
        schema = T.StructType([*self.schema.fields, T.StructField("version", T.LongType())])
        if not names:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/rows/{held[n]['at']}/{n}" for n in names]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*folders)
        return rows.select(*[f.name for f in schema.fields])

    # --- writing ----------------------------------------------------------

    def create(self, rows: DataFrame) -> int:
        """Version 0, with all rows."""
        return self._commit(0, {}, rows)

    def replace(self, rows: DataFrame, base: int, replaced: Sequence[str]) -> int:
        """The version after ``base``: the named partitions hold ``rows``, the others stay where they are.

        ``rows`` may be computed from the table itself. A named partition without rows is gone from
        the new version. Raises :class:`StaleVersion` if the next version exists.
        """
        kept = {name: entry for name, entry in self.manifest(base).items() if name not in set(replaced)}
        return self._commit(base + 1, kept, rows)

    def update(self, change: Callable[[DataFrame], DataFrame], where: DataFrame, base: int | None = None) -> int:
        """Write back a change to the partitions that ``where`` names; ``base`` is the version it was computed from.

        ``where`` has the partition columns of every row that may change, in any number of copies; their
        distinct values, at most one row a partition, come to the driver. ``change`` gets the rows of these
        partitions, whole, and returns them changed, in the same partitions.
        """
        base = self.version() if base is None else base
        named = [self._name(row) for row in where.select(*self.partitions).distinct().collect()]
        held = self.manifest(base)
        named = [n for n in named if n in held]
        if not named:
            return base
        before = self.read(base, named).drop("version")
        return self.replace(change(before), base, named)

    def _name(self, row) -> str:
        """The folder that Spark's writer gives a partition."""
        utils = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return "/".join(
            utils.getPartitionPathString(c, None if row[c] is None else str(row[c])) for c in self.partitions
        )

    def _commit(self, number: int, kept: dict[str, dict], rows: DataFrame) -> int:
        if number in self.versions():
            raise StaleVersion(f"version {number} exists at {self.path}")
        # Each attempt has its own folder, so two writers never mix files; readers follow manifests only.
        at = f"version={number}/attempt={uuid.uuid4().hex}"
        columns = [f.name for f in self.schema.fields]
        # Adaptive execution gives a partition as many tasks as its size asks for.
        spread = rows.select(*columns).hint("rebalance", *[F.col(c) for c in self.partitions])
        spread.write.partitionBy(*self.partitions).parquet(f"{self.path}/rows/{at}")
        entries, root = dict(kept), self._folder(f"rows/{at}")
        listing, above = self._files.listFiles(root, True), self._files.makeQualified(root).toString()
        while listing.hasNext():
            status = listing.next()
            name = status.getPath().getName()
            if name.endswith(".parquet"):
                folder = status.getPath().getParent().toString().removeprefix(f"{above}/")
                if folder in kept:
                    self._files.delete(root, True)
                    raise ValueError(f"rows for {folder}, which is not replaced")
                entries.setdefault(folder, {"at": at, "files": {}})["files"][name] = status.getLen()
        claim = self._folder(f"versions/_{uuid.uuid4().hex}")
        out = self._files.create(claim, False)
        out.write(bytearray(json.dumps(entries, ensure_ascii=False).encode()))
        out.close()
        try:
            self._rename(claim, self._folder(f"versions/{number}.json"))
        except Py4JJavaError as error:
            self._files.delete(claim, False)
            self._files.delete(root, True)
            if "FileAlreadyExists" in str(error.java_exception) or "already exists" in str(error.java_exception):
                raise StaleVersion(f"version {number} exists at {self.path}") from None
            raise
        return number

    def _rename(self, source, target) -> None:
        """Move a file to a name that no other file may have."""
        context = self._hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 1)
        options[0] = self._hadoop.Options.Rename.NONE
        context.rename(source, target, options)
