"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

The commonest id of the corpus gets rank 0, so most ranks fit a byte. Four ranks share a control byte of 2 bits each
(length - 1), all control bytes of a block stand before its data bytes, and a block is decoded by table lookup for all
ranks at once. Files hold consecutive ranges of doc_id, so that reading them in name order gives ascending doc_id.

A file is a sequence of blocks; integers are little-endian:
    magic "KTF1", documents (u4), ranks (u4), data bytes (u4),
    present flags of doc_id (u1 each), doc_ids (i8 each), lengths (u4 each), control bytes, data bytes
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.bpe import encoder, slices, vocabulary_path
from kinfold.llm.common import cut, documents, fresh_path, join_small, write_table

MAGIC = b"KTF1"
#: Ids in a block, about (a document stays whole).
BLOCK = 1 << 18
#: Ids in a file, about; a file is closed at FILE_BYTES at the latest, and its partition goes on in another.
FILE_IDS, FILE_BYTES = 1 << 24, 1 << 28
#: Lengths of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = ranks.astype("<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = length - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count].astype(np.int64)
    start = np.cumsum(length) - length
    b = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = b[start].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(length > k)
        out[at] |= b[start[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(doc_ids: list, ids: list[bytes], rank_of: np.ndarray) -> bytes:
    lengths = np.array([len(x) // 2 for x in ids], "<u4")
    ranks = rank_of[np.frombuffer(b"".join(ids), "<u2")]
    control, data = pack(ranks)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, struct.pack("<III", len(ids), len(ranks), len(data)), known.tobytes(), numbers.tobytes(), lengths.tobytes(), control, data])


def blocks(content: bytes, id_of: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids, lengths and ids of each block of a file."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"not a token file at byte {at}")
        docs, count, size = struct.unpack_from("<III", content, at + 4)
        at += 16
        known = np.frombuffer(content, np.uint8, docs, at)
        numbers = np.frombuffer(content, "<i8", docs, at + docs)
        lengths = np.frombuffer(content, "<u4", docs, at + 9 * docs)
        at += 13 * docs
        control = content[at : at + (count + 3) // 4]
        at += len(control)
        ids = id_of[unpack(control, content[at : at + size], count)]
        at += size
        yield [int(d) if k else None for d, k in zip(numbers, known)], lengths, ids


def encode_ids(docs: DataFrame, path: str, end: int | None) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 16-bit integers) of each row, the end id last; null texts are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, tail = encoder(path), b"" if end is None else np.array([end], "<u2").tobytes()
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for part in slices(texts):
                ids = [np.frombuffer(x, "<u4") for x in enc.encode(texts[part])]
                if any(len(x) and x.max() > 0xFFFF for x in ids):
                    raise ValueError("token files hold vocabularies of up to 65,536 ids")
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[part], "ids": [x.astype("<u2").tobytes() + tail for x in ids]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id bigint, ids binary")


def id_frequencies(encoded: DataFrame) -> pd.DataFrame:
    """id and n by falling frequency over all documents, ties to the smaller id; at most 65,536 rows, whatever the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, np.int64)
        for pdf in batches:
            for part in slices(pdf["ids"].tolist()):
                total += np.bincount(np.frombuffer(b"".join(pdf["ids"].iloc[part]), "<u2"), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    rows = encoded.select("ids").mapInPandas(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return rows.sort_values(["n", "id"], ascending=[False, True], ignore_index=True)


def write_token_files(docs: DataFrame, folder: str, path: str, end: int | None = None, file_ids: int = FILE_IDS, file_bytes: int = FILE_BYTES) -> None:
    """Encode docs (doc_id, text; other columns, whatever their names, are ignored) into files part-<partition>-<number>.ktf in
    ascending doc_id order, with the table of ids by rank in `ranks` and a row for each file in `manifest` beside them. Files
    are in order of these two numbers, which the manifest holds as such; in names they have ten digits.

    Partitions are ranges of doc_id of about file_ids ids, so files grow in number and not in size. A task writes its files
    under other names and then moves them, so a task that runs again leaves the same files. Rows of equal or null doc_id are
    ordered by a hash of their ids, and so spread over files; null doc_ids come first. Null and empty texts have the end id
    only; a very long text is one document in one file. No documents: no file. The folder must be one that pyarrow's and
    Spark's file systems both know.
    """
    spark = docs.sparkSession
    encoded = write_table(encode_ids(docs, path, end), "ids")
    counts = id_frequencies(encoded)
    by_rank = counts["id"].to_numpy(np.int64)
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        fs.create_dir(base, recursive=True)
        number, held, ids, count, size, total, out = 0, [], [], 0, 0, 0, None
        name = temporary = ""

        def close() -> pd.DataFrame:
            out.close()
            fs.move(temporary, f"{base}/{name}")
            return pd.DataFrame({"part": [part], "number": [number], "n": [total]})

        def flush() -> int:
            data = block(held, ids, rank_of)
            out.write(data)
            return len(data)

        for pdf in batches:
            for d, x in zip(pdf["doc_id"], pdf["ids"]):
                if out is None:
                    name, temporary = file_name(part, number), f"{base}/.part-{part}-{uuid.uuid4().hex}"
                    out, size, total = fs.open_output_stream(temporary), 0, 0
                held.append(None if pd.isna(d) else int(d))
                ids.append(bytes(x))
                count += len(x) // 2
                if count >= BLOCK:
                    size, total = size + flush(), total + count
                    count, held, ids = 0, [], []
                    if size >= file_bytes:
                        yield close()
                        number, out = number + 1, None
        if held:
            flush()
            total += count
        if out is not None:
            yield close()

    from pyarrow.fs import FileSystem

    fs, base = FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)  # also where no task writes a file
    parts = max(1, -(-int(counts["n"].sum()) // file_ids))
    ordered = encoded.withColumn("h", F.xxhash64("ids")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids")
    ordered.select("doc_id", "ids").mapInPandas(write, _FILE).write.parquet(f"{folder}/manifest")
    spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank bigint, id bigint").coalesce(1).write.parquet(f"{folder}/ranks")


_FILE = "part bigint, number bigint, n bigint"


def file_name(part: int, number: int) -> str:
    return f"part-{part:010d}-{number:010d}.ktf"


def offsets_of(manifest: DataFrame) -> DataFrame:
    """part, number and offset of each file: the ids of all files before it. Files are dealt by ranges of their numbers, so no
    task sees all; the driver gets one sum for each range."""
    files = manifest.dropDuplicates(["part", "number"]).repartitionByRange("part", "number").withColumn("range", F.spark_partition_id())
    files = cut(files)
    sums = files.groupBy("range").agg(F.sum("n").alias("n")).toPandas().sort_values("range")  # a row a shuffle partition
    before = manifest.sparkSession.createDataFrame(list(zip(sums["range"].tolist(), (sums["n"].cumsum() - sums["n"]).tolist())), "range int, before bigint")
    own = F.sum("n").over(Window.partitionBy("range").orderBy("part", "number")) - F.col("n")
    return files.withColumn("own", own).join(F.broadcast(before), "range").select("part", "number", (F.col("own") + F.col("before")).alias("offset"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens and start: the ids of all documents before it."""
    schema = "part bigint, number bigint, doc_id bigint, n_tokens bigint, before bigint, ids binary"
    ranks = spark.read.schema("rank bigint, id bigint").parquet(f"{folder}/ranks").orderBy("rank").limit(1 << 16).toPandas()
    by_rank = ranks["id"].to_numpy(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                before, (part, number) = 0, map(int, name.rpartition("/")[2].removesuffix(".ktf").split("-")[1:])
                for doc_ids, lengths, ids in blocks(bytes(content), by_rank):
                    ends = np.cumsum(lengths.astype(np.int64))
                    rows = {"part": part, "number": number, "doc_id": pd.array(doc_ids, "Int64"), "n_tokens": lengths.astype(np.int64), "before": before + ends - lengths}
                    data = ids.astype("<u4").tobytes()
                    yield pd.DataFrame(rows | {"ids": [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]})
                    before += int(ends[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ktf").load(folder).select("path", "content")
    offsets = offsets_of(spark.read.schema(_FILE).parquet(f"{folder}/manifest"))
    return join_small(files.mapInPandas(run, schema), offsets, ["part", "number"], salts=1).select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids")


def crc32_of(rows: DataFrame) -> DataFrame:
    """Replace ids by ids_crc32."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, encoded, written and read back; cases as in write_token_files."""
    folder = fresh_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), folder, vocabulary_path(), end=2)
    return crc32_of(read_token_files(spark, folder))
