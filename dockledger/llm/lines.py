"""Repeated lines across documents, found batch by batch against levelled sorted runs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.llm.ranges import fresh, slices
from dockledger.operators.skew import attach
from dockledger.session import scratch_path

# White space stripped from both ends of a line, shortest key in code points.
STRIPPED = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
BATCHES = 4
# Runs of one level before they are merged into one run of the next.
FANOUT = 2
# Stands for a null doc_id, which counts as later than every other.
_LAST = 2**63 - 1


def line_key(line: str) -> bytes | None:
    """UTF-8 of the line without outer white space and with A-Z in lower case; None if too short."""
    key = line.strip(STRIPPED)
    return key.encode("utf-8", "replace").lower() if len(key) >= MIN_CHARS else None


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _halves(key: bytes) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(key)
    return _signed(whole >> 64), _signed(whole & (1 << 64) - 1)


def line_hashes(docs: DataFrame, cuts: list[int]) -> DataFrame:
    """(batch, doc, h1, h2) for each different key of a document; 128 bits tell keys apart.

    ``cuts`` are the first ids of every batch but the first.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, h1, h2 = [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = {line_key(x) for x in (text or "").split("\n")}
                keys.discard(None)
                for key in keys:
                    a, b = _halves(key)
                    h1.append(a)
                    h2.append(b)
                doc.extend([d] * len(keys))
            columns = [pa.array(x, pa.int64()) for x in (doc, h1, h2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "h1", "h2"])

    known = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text")
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("doc") >= cut).cast("int")
    return known.mapInArrow(hashed, "doc long, h1 long, h2 long").withColumn("batch", number)


class LineStore:
    """Keys of all lines seen so far, each with the smallest document that holds it.

    The store is a set of runs: tables bucketed by key and sorted in each bucket, so a new
    batch is shuffled to the buckets and merged with them, and no run is shuffled
    again. A batch adds one run; FANOUT runs of a level are compacted into one of the next
    level, so a store of n batches has about log(n) runs. Runs are never changed in place.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"lines_{uuid.uuid4().hex}"
        (
            keys.select("h1", "h2", "owner").repartition(self.buckets, "h1", "h2").write
            .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            .option("path", scratch_path(self.spark, name)).saveAsTable(name)
        )
        return name

    def _add_run(self, name: str, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for other in full[1:]:
                merged = merged.unionByName(self.spark.table(other))
            self._add_run(self._write(merged), level + 1)  # keys of runs never repeat
            self._forget(full)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (doc, h1, h2), all later than those before; returns the lines to drop.

        A line is dropped if a run holds its key or an earlier document of the batch does.
        Keys are combined before they are shuffled, so a line of very many documents is one row a task.
        """
        first = lines.groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
        for run in [r for level in self.levels for r in level]:
            first = first.join(self.spark.table(run).select("h1", "h2"), ["h1", "h2"], "left_anti")
        new = self._write(first)
        # What the runs before did not hold has its owner in the new run.
        owned = self.spark.table(new)
        # A line of too many documents for one task is salted.
        dropped = attach(lines, owned, ["h1", "h2"], "left").where(
            F.col("owner").isNull() | (F.col("owner") < F.col("doc"))
        ).select("doc", "h1", "h2")
        path = scratch_path(self.spark, "dropped")
        dropped.write.parquet(path)
        self._add_run(new)
        return self.spark.read.schema(dropped.schema).parquet(path)

    def close(self) -> None:
        self._forget([r for level in self.levels for r in level])
        self.levels = []


def repeated_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc, hashes): for each document the first hash halves of its lines that an earlier one holds."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("double").alias("d")).where("d is not null")
    steps = [k / batches for k in range(1, batches)]
    cuts = sorted({int(x) for x in ids.approxQuantile("d", steps, 0.01)}) if steps else []
    path = scratch_path(spark, "lines")
    line_hashes(docs, cuts).write.partitionBy("batch").parquet(path)
    store = LineStore(spark)
    schema = T.StructType([
        *(T.StructField(n, T.LongType()) for n in ("doc", "h1", "h2")), T.StructField("batch", T.IntegerType())
    ])
    lines = spark.read.schema(schema).parquet(path)
    dropped = [
        store.add(lines.where(F.col("batch") == number).select("doc", "h1", "h2"))
        for number in range(len(cuts) + 1)
    ]
    store.close()
    every = dropped[0]
    for more in dropped[1:]:
        every = every.unionByName(more)
    return every.groupBy("doc").agg(F.collect_list("h1").alias("hashes"))


def drop_lines(
    docs: DataFrame, batches: int = BATCHES, names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept")
) -> DataFrame:
    """Documents without the lines that a document with a smaller id holds.

    Adds n_lines, n_dropped and kept (the lines left, joined by a line end) under ``names``;
    columns called so are replaced. Only lines whose
    key has at least MIN_CHARS code points count; a repetition inside one document stays. A
    null text is one empty line and has kept ''. A null doc_id counts as the
    largest id; rows that share an id are one document to the rule and are cleaned each. Ids are whole numbers.
    """
    n_lines, n_dropped, kept = names
    docs = docs.drop(*names)
    doc, hashes = fresh(docs.columns, "__doc", "__hashes")
    found = repeated_lines(docs, batches).select(F.col("doc").alias(doc), F.col("hashes").alias(hashes))
    rows = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).join(found, doc, "left")
    rows = rows.drop(doc)
    schema = T.StructType([
        *docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType()),
        T.StructField(kept, T.StringType()),
    ])
    at = docs.columns.index("text")

    def cleaned(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches_):
            total, gone, texts = [], [], []
            drop_at = batch.schema.get_field_index(hashes)
            for text, drop in zip(batch.column(at).to_pylist(), batch.column(drop_at).to_pylist()):
                text = text or ""
                lines = text.split("\n")
                if drop:
                    drop = set(drop)
                    stay = [x for x in lines if (k := line_key(x)) is None or _halves(k)[0] not in drop]
                    text = "\n".join(stay)
                else:
                    stay = lines
                total.append(len(lines))
                gone.append(len(lines) - len(stay))
                texts.append(text)
            own = [batch.column(i) for i in range(batch.num_columns) if i != drop_at]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())],
                names=[f.name for f in schema],
            )

    return rows.mapInArrow(cleaned, schema)


def line_report(docs: DataFrame) -> DataFrame:
    """Per document how many lines it had and lost, and the digest of what is left."""
    out = drop_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with their repeated lines gone, n_chars counted anew; untouched texts stay as they are."""
    _, n_dropped, kept = names = tuple(fresh(docs.columns, "__n_lines", "__n_dropped", "__kept"))
    out = drop_lines(docs, names=names)
    changed = F.col(n_dropped) > 0
    text = F.when(changed, F.col(kept)).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, n_chars).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
