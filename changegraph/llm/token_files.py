"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped for reading.

A shard holds the ids of a range of documents in ascending order of id: ``NNNNNN.bin`` (16-bit
unsigned where the vocabulary allows, else 32-bit, little-endian), ``NNNNNN.off`` (n + 1
offsets, 64-bit unsigned, in ids) and ``NNNNNN.ids`` (the documents' ids, 64-bit signed; the
first ``n_null`` documents have none). Where each shard begins among all ids is the
prefix sum of the shards' counts, taken from the manifest of one row a shard.

A task writes under a name of its own attempt and renames at the end, so a retried task
replaces its shard by the same bytes.

Defined results: a null text counts as empty and has only the end id. Null ids come first.
Rows with the same id are written one after the other, by the text's hash. An empty table
gives no files and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changegraph.llm.text import materialise, n_groups
from changegraph.llm.tokens import encoder


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 256 << 20,
    remembered: int = 1_000_000,
) -> DataFrame:
    """Writes shards of at most about ``shard_bytes`` of text to ``out_dir`` (a URI that all executors reach); returns the manifest.

    Manifest: (shard, bytes_per_id, n_docs, n_null, n_ids, base), base being the number of
    ids in all shards before it. A worker remembers the ids of up to ``remembered`` pieces, some 200 bytes each."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = [F.asc_nulls_first("id"), F.asc("h")]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(2 * n_groups(docs.sparkSession), -(-size // shard_bytes))
    rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def write(batches):
        enc = encoder(tokenizer_path, remembered)
        kind = "<u2" if max(enc.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], dtype="<u4").tobytes()
        shard = TaskContext.get().partitionId()
        filesystem, folder = _filesystem(out_dir)
        filesystem.create_dir(folder)
        attempt = f"{folder}/.{shard:06d}-{uuid.uuid4().hex}"
        offsets, ids, n_null = [np.zeros(1, dtype="<u8")], [], 0
        total = 0
        with filesystem.open_output_stream(f"{attempt}.bin") as out:
            for batch in batches:
                counts = []
                for text in batch["text"]:
                    x = np.frombuffer(enc.encode(text.as_py()) + end, dtype="<u4").astype(kind)
                    counts.append(len(x))
                    out.write(x.tobytes())
                ids.append(batch["id"].fill_null(0).to_numpy().astype("<i8"))
                n_null += batch["id"].null_count
                offsets.append((total + np.cumsum(counts)).astype("<u8") if counts else np.zeros(0, "<u8"))
                total += sum(counts)
        n = sum(map(len, ids))
        if n:
            for end_of_name, parts in ((".off", offsets), (".ids", ids)):
                with filesystem.open_output_stream(attempt + end_of_name) as out:
                    out.write(np.concatenate(parts).tobytes())
            for end_of_name in (".bin", ".off", ".ids"):
                filesystem.move(attempt + end_of_name, f"{folder}/{shard:06d}{end_of_name}")
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "bytes_per_id": int(kind[-1]), "n_docs": n, "n_null": n_null, "n_ids": total}]
            ).cast(pa.schema([("shard", pa.int32()), ("bytes_per_id", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64())]))
        else:
            filesystem.delete_file(f"{attempt}.bin")

    manifest = materialise(rows.select("id", "text").mapInArrow(write, "shard int, bytes_per_id int, n_docs long, n_null long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids): each document's place among all ids, and its ids as little-endian 32-bit integers."""

    def read(batches):
        filesystem, folder = _filesystem(out_dir)
        local = filesystem.type_name == "local"

        def file(name: str, kind: str) -> np.ndarray:
            path = f"{folder}/{name}"
            if local:
                return np.memmap(path, dtype=kind, mode="r")
            with filesystem.open_input_file(path) as f:
                return np.frombuffer(f.read(), dtype=kind)

        for batch in batches:
            for s in batch.to_pylist():
                name = f"{s['shard']:06d}"
                off, ids = file(f"{name}.off", "<u8").astype(np.int64), file(f"{name}.ids", "<i8")
                data = file(f"{name}.bin", f"<u{s['bytes_per_id']}")
                for a in range(0, s["n_docs"], 512):
                    b = min(a + 512, s["n_docs"])
                    blobs = [np.asarray(data[off[i] : off[i + 1]], dtype="<u4").tobytes() for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(ids[a:b]), pa.int64(), mask=np.arange(a, b) < s["n_null"]),
                            pa.array(off[a:b] + s["base"], pa.int64()),
                            pa.array(np.diff(off[a : b + 1]), pa.int64()),
                            pa.array(blobs, pa.binary()),
                        ],
                        names=["id", "start", "n_tokens", "ids"],
                    )

    shards = manifest.select("shard", "bytes_per_id", "n_docs", "n_null", "base").repartition(2 * n_groups(spark))
    return shards.mapInArrow(read, "id long, start long, n_tokens long, ids binary")
