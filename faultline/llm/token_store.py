"""Token ids in ORC files: run-length encoded stripes, row indexes and a Bloom filter on document ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucket_count
from .token_ids import default_path, encoder

#: Files at most: one row for each is summed up in one place, and sent to all tasks, to number documents throughout.
MOST_FILES = 100_000
ROWS = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
#: Stripes small enough for many parallel readers; index entries every 1,000 rows.
ORC_OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true"}


def write(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2, tokenizer: str | None = None, file_bytes: int = 16 << 20) -> None:
    """Encodes every text, appends the end id, and writes ORC files in ascending order of ids.

    Files hold disjoint ranges of ids (part numbers them in order); within a file rows are sorted, so stripe and row
    index statistics prune by id, and the Bloom filter answers point look-ups. Ids fit int and are stored as an
    array<int>, which ORC run-length encodes. local_start counts the ids of the file's earlier rows. Missing ids
    come first; rows that share an id are ordered by a hash of their text; null and empty texts are the end id alone.
    Files grow beyond file_bytes once there would be more than MOST_FILES of them.
    """
    file = tokenizer or default_path("word_bpe_49k.json")
    parts = min(MOST_FILES, bucket_count(docs, text_column, file_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(file), int(end_id).to_bytes(4, "little")
        start = 0

        def rows(docs: list, raws: list[bytes], part: int) -> pa.RecordBatch:
            nonlocal start
            sizes = np.fromiter((len(r) // 4 for r in raws), np.int64, len(raws))
            edges = np.r_[0, np.cumsum(sizes)]
            ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.frombuffer(b"".join(raws), "<i4")))
            out = pa.record_batch([pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(edges[:-1] + start, pa.int64()), pa.array(sizes, pa.int64()), ids], names=["part", "doc_id", "local_start", "n_tokens", "ids"])
            start += int(edges[-1])
            return out

        for batch in batches:
            held: list = []
            raws: list[bytes] = []
            size, part = 0, batch["part"][0].as_py() if batch.num_rows else 0
            for doc, raw in zip(batch["doc_id"].to_pylist(), code.encode(batch["body"]), strict=True):
                held.append(doc)
                raws.append(raw + end)
                size += len(raw)
                if size > 4 << 20:
                    yield rows(held, raws, part)
                    held, raws, size = [], [], 0
            if held:
                yield rows(held, raws, part)

    flat = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("body"))
    # Rows that share an id may be split between ranges: the hash orders them there, too.
    ranged = flat.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("body")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("body"))
    encoded = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "body").mapInArrow(run, ROWS)
    encoded.write.mode("overwrite").options(**ORC_OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, local_start, n_tokens and ids of each document; filters on doc_id reach stripes and row groups."""
    return spark.read.schema(ROWS).orc(path)


def summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (the ids of all documents before it), n_tokens and ids_crc32, all from the files.

    Only one row per file, MOST_FILES at most, is summed up in one place and broadcast.
    """

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            lists = batch["ids"]
            edges = lists.offsets.to_numpy().tolist()
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.record_batch([batch["part"], batch["doc_id"], batch["local_start"], pa.array(np.diff(edges), pa.int64()), pa.array(sums, pa.int64())], names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    rows = read(spark, path)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    begin = files.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("begin"))
    sums = rows.mapInArrow(crc, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return sums.join(F.broadcast(begin), "part").select("doc_id", (F.col("begin") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
