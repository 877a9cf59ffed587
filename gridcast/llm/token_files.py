"""Tokenised documents in files of wavelet matrices (``wavelet.py``), in the order of their ids.

Documents are dealt out by ranges of their id and tokenised in the same task that
writes them: whole documents fill a shard until it holds ``shard_tokens`` ids. A
shard is one compressed file; files travel as binary values of a Parquet table, so
any storage that Spark writes will do. Places are counted inside a range while it
is written, and the sizes of the ranges (one row for each shuffle partition) make
them places in the whole corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.frames import arrow_pass, give_back, small_batches
from gridcast.llm.tokens import encoder
from gridcast.llm.wavelet import WaveletMatrix
from gridcast.plans.order import PART_BITS, range_starts

SHARD_TOKENS = 1 << 20
#: Pieces remembered by a Python worker (twice this many, about 200 bytes each): it holds little else.
REMEMBERED = 400_000


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Tokenise all documents and write them to ``path`` in rising order of their id.

    Null ids come first; rows of one id are ordered by a hash of their text. A null or
    empty text is ``end_id`` alone; every row is written, repeated ones too; other
    columns are ignored. A document longer than ``shard_tokens`` fills a shard alone.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    # rows that are equal in all else are told apart by their place, so that copies do not meet in one range
    keys = [F.asc_nulls_first("id"), F.col("h"), F.col("tie")]
    laid = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["id"].dataType))])
    schema = schema.add("start", "long").add("n_tokens", "long").add("file", "binary")
    kind, end = _arrow_type(rows), np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start = encoder(tokenizer, REMEMBERED).encode, 0
        ids: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            splits = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            file = WaveletMatrix.build(np.concatenate(tokens), splits).to_bytes()
            names = pa.ListArray.from_arrays([0, len(splits) - 1], pa.concat_arrays(ids))
            columns = [names.cast(pa.list_(kind)), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([file], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            row = 0
            for found, splits in encode(batch.column("text")):
                ended = np.insert(found, splits[1:], end)
                splits = splits + np.arange(len(splits))
                first = 0
                while first < len(splits) - 1:
                    # as many rows as fit, one at least
                    room = splits[first] + shard_tokens - held
                    last = max(int(np.searchsorted(splits, room, "right")) - 1, first + (held == 0))
                    if last > first:
                        ids.append(batch.column("id").slice(row + first, last - first))
                        tokens.append(ended[splits[first] : splits[last]])
                        sizes.append(np.diff(splits[first : last + 1]))
                        held += int(splits[last] - splits[first])
                    if last < len(splits) - 1:
                        yield shard()
                        start, held = start + held, 0
                        ids, tokens, sizes = [], [], []
                    first = last
                row += len(splits) - 1
            give_back()
        if held:
            yield shard()

    small_batches(docs)
    written = laid.select("id", "text").mapInArrow(run, schema)
    written.withColumn("at", F.monotonically_increasing_id()).write.option("compression", "none").parquet(path)


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["id"].dataType)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The files, with the place of their first id in the whole corpus."""
    files = spark.read.parquet(path)
    return files.join(range_starts(files, "at", F.sum("n_tokens")), F.shiftright("at", PART_BITS) == F.col("__part")).select(
        "ids", (F.col("start") + F.col("__base")).alias("start"), "n_tokens", "file"
    )


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files."""
    files = _shards(spark, path)
    kind = files.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind)]).add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k, base in enumerate(batch.column("start").to_pylist()):
            matrix = WaveletMatrix.from_bytes(batch.column("file")[k].as_buffer())
            tokens, splits = matrix.decode().astype("<u4"), matrix.splits
            view = memoryview(tokens.view(np.uint8))
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(splits[:-1].tolist(), splits[1:].tolist())]
            columns = [
                batch.column("ids")[k].values,
                pa.array(base + splits[:-1], pa.int64()),
                pa.array(np.diff(splits), pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(splits.astype(np.int32), pa.array(tokens.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from step(batch)
            give_back()

    small_batches(files)
    return files.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def count_tokens(spark: SparkSession, path: str, tokens: Sequence[int]) -> DataFrame:
    """(token, n): how often each of a few tokens stands in the corpus, by rank alone."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        matrices = [WaveletMatrix.from_bytes(f.as_buffer()) for f in batch.column("file")]
        n = [sum(m.count(t) for m in matrices) for t in tokens]
        return pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(n, pa.int64())], names=["token", "n"])

    parts = arrow_pass(_shards(spark, path).select("file"), step, "token long, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


def find_tokens(spark: SparkSession, path: str, tokens: Sequence[int], id_col: str = "doc_id") -> DataFrame:
    """(id, token, place, offset) of every occurrence of a few tokens: in the corpus, and in its document."""
    files = _shards(spark, path)
    schema = T.StructType([T.StructField("id", files.schema["ids"].dataType.elementType)])
    schema = schema.add("token", "long").add("place", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, base in enumerate(batch.column("start").to_pylist()):
                matrix = WaveletMatrix.from_bytes(batch.column("file")[k].as_buffer())
                for token in tokens:
                    at = matrix.occurrences(token)
                    row = np.searchsorted(matrix.splits, at, "right") - 1
                    columns = [batch.column("ids")[k].values.take(pa.array(row))]
                    columns += [pa.array(c, pa.int64()) for c in (np.full(len(at), token), base + at, at - matrix.splits[row])]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return files.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def tokens_at(spark: SparkSession, path: str, places: Sequence[int]) -> DataFrame:
    """(place, token) of a few places of the corpus; only the shards that hold one are opened."""
    wanted = np.unique(np.asarray(places, np.int64))
    holds = F.exists(F.array(*[F.lit(int(p)) for p in wanted]), lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_tokens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, base in enumerate(batch.column("start").to_pylist()):
                matrix = WaveletMatrix.from_bytes(batch.column("file")[k].as_buffer())
                at = wanted[(wanted >= base) & (wanted < base + matrix.n)]
                columns = [pa.array(at), pa.array(matrix.access(at - base).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "token"])

    return _shards(spark, path).where(holds).mapInArrow(run, "place long, token long")
