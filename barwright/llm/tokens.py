"""Token ids in patched frame-of-reference files.

Documents are sorted by doc_id into ranges; a range is one file. A file is a run of sections, each written as one
record of Spark's text sink (so any file system Spark can write to will do, and its commit protocol covers lost
executors); the sink ends a record with one byte 0x0A, which readers skip. All numbers are little-endian.

    section   "PFR1", then unsigned 32-bit: file number, section number, bytes of the section, documents, ids, blocks
    documents for each: doc_id (signed 64), flags (8: 1 no doc_id, 2 continues the one before), ids here (unsigned 32)
    index     for each block: its start in the block area (unsigned 32)
    blocks    of 128 ids: minimum (unsigned 32), width (8), exceptions (8); then 128 differences to the minimum
              packed at `width` bits in 64-bit words, low bits first; then the exceptions' positions (8 each) and
              the bits above `width` of each (16 each)

The width is the bit length of the 95th percentile of a block's differences, at least the longest less 16. The last
block of a section is filled up with its minimum.

Defined results: a null or empty text has only the end id. Rows without doc_id come first, rows that repeat a
doc_id follow each other by text. An empty table makes files without sections and no rows. Other columns are
ignored. A text of any length is cut into sections of bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.shared import partitions, stored, text_chunks
from barwright.llm.units import units
from barwright.session import work_folder

MAGIC = b"PFR1"
HEAD = np.dtype([("magic", "S4"), ("file", "<u4"), ("section", "<u4"), ("bytes", "<u4"), ("docs", "<u4"), ("ids", "<u4"), ("blocks", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("flags", "u1"), ("n", "<u4")])
BLOCK = 128
PERCENTILE = 0.95
SECTION_IDS = 1 << 18
FILE_CHARS = 64_000_000
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
BLOCK_HEAD = 6


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, 0, (x.astype(np.float64).view(np.int64) >> 52) - 1022).astype(np.int64)


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Block starts and the bytes of all blocks of an array of unsigned 32-bit ids."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, "<u4"), b""
    filled = np.full(n * BLOCK, ids[(n - 1) * BLOCK :].min(), np.uint32)
    filled[: len(ids)] = ids
    rows = filled.reshape(n, BLOCK)
    low = rows.min(1)
    gap = (rows - low[:, None]).astype(np.uint64)
    bits = bit_length(gap)
    width = np.maximum(np.partition(bits, int(np.ceil(percentile * BLOCK)) - 1, axis=1)[:, int(np.ceil(percentile * BLOCK)) - 1], bits.max(1) - 16)
    over = gap >> width[:, None].astype(np.uint64)
    body = gap & ((np.uint64(1) << width[:, None].astype(np.uint64)) - np.uint64(1))
    extra = np.count_nonzero(over, axis=1)
    lengths = BLOCK_HEAD + width * (BLOCK // 8) + 3 * extra
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros(starts[-1], np.uint8)
    at = starts[:-1]
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[at + 4], out[at + 5] = width, extra
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        value = body[mine].reshape(-1, BLOCK // 64, 64)
        words = np.zeros((len(mine), BLOCK // 64, int(w) + 1), np.uint64)
        for i in range(64):
            word, shift = divmod(i * int(w), 64)
            words[:, :, word] |= value[:, :, i] << np.uint64(shift)
            if shift + w > 64:
                words[:, :, word + 1] |= value[:, :, i] >> np.uint64(64 - shift)
        packed = np.ascontiguousarray(words[:, :, : int(w)]).astype("<u8").reshape(len(mine), -1).view(np.uint8)
        out[at[mine][:, None] + BLOCK_HEAD + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(over)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(extra) - extra, extra)
    tail = at[block] + BLOCK_HEAD + width[block] * (BLOCK // 8)
    out[tail + nth] = place
    high = over[block, place].astype("<u2").view(np.uint8).reshape(-1, 2)
    out[(tail + extra[block] + 2 * nth)[:, None] + np.arange(2)] = high
    return at.astype("<u4"), out.tobytes()


def unpack(starts: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The first `count` ids of packed blocks (`data` as unsigned bytes)."""
    at, n = starts.astype(np.int64), len(starts)
    low = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4").ravel() if n else np.zeros(0, np.uint32)
    width, extra = data[at + 4].astype(np.int64), data[at + 5].astype(np.int64)
    gap = np.zeros((n, BLOCK), np.uint64)
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        raw = np.ascontiguousarray(data[at[mine][:, None] + BLOCK_HEAD + np.arange(int(w) * BLOCK // 8)])
        words = raw.view("<u8").reshape(len(mine), BLOCK // 64, int(w))
        mask = (np.uint64(1) << np.uint64(w)) - np.uint64(1)
        part = np.empty((len(mine), BLOCK // 64, 64), np.uint64)
        for i in range(64):
            word, shift = divmod(i * int(w), 64)
            value = words[:, :, word] >> np.uint64(shift)
            if shift + w > 64:
                value |= words[:, :, word + 1] << np.uint64(64 - shift)
            part[:, :, i] = value & mask
        gap[mine] = part.reshape(len(mine), BLOCK)
    block = np.repeat(np.arange(n), extra)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(extra) - extra, extra)
    tail = at[block] + BLOCK_HEAD + width[block] * (BLOCK // 8)
    place = data[tail + nth].astype(np.int64)
    high = np.ascontiguousarray(data[(tail + extra[block] + 2 * nth)[:, None] + np.arange(2)]).view("<u2").ravel().astype(np.uint64)
    gap[block, place] |= high << width[block].astype(np.uint64)
    return (gap + low[:, None]).astype(np.uint32).ravel()[:count]


def section(file: int, number: int, docs: list[tuple[int, int, int]], ids: np.ndarray) -> bytes:
    starts, blocks = pack(ids)
    rows = np.array(docs, DOC).tobytes()
    size = HEAD.itemsize + len(rows) + starts.nbytes + len(blocks)
    head = np.array([(MAGIC, file, number, size, len(docs), len(ids), len(starts))], HEAD).tobytes()
    return head + rows + starts.tobytes() + blocks


def sections(path: str, end_id: int = END_ID, most: int = SECTION_IDS):
    """For mapInPandas: sorted (doc_id, text) of one range to the sections of its file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        file, number, enc = TaskContext.get().partitionId(), 0, units(path, spaced=True)
        docs: list[tuple[int, int, int]] = []
        held: list[np.ndarray] = []
        room = most
        end = np.uint32(end_id)
        for batch in batches:
            ids_of = iter(batch["doc_id"])
            for chunk in text_chunks(batch["text"], 4_000_000):
                ready, at = [], 0
                flat, counts = enc.encode(pa.array(chunk, pa.string()))
                for n in counts.tolist():
                    doc_id = next(ids_of)
                    none = doc_id is None or doc_id is pd.NA
                    ids, flag, at = np.append(flat[at : at + n], end), int(none), at + n
                    while len(ids):
                        part = ids[:room]
                        docs.append((0 if none else int(doc_id), flag, len(part)))
                        held.append(part)
                        ids, room, flag = ids[room:], room - len(part), int(none) | 2
                        if not room:
                            ready.append(section(file, number, docs, np.concatenate(held)))
                            docs, held, room, number = [], [], most, number + 1
                if ready:
                    yield pd.DataFrame({"section": ready})
        if docs:
            yield pd.DataFrame({"section": [section(file, number, docs, np.concatenate(held))]})

    return run


def read_sections(content: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(file, section, document rows, ids) of each section of a file."""
    at = 0
    while at < len(content):
        head = np.frombuffer(content, HEAD, 1, at)[0]
        if head["magic"] != MAGIC:
            raise ValueError(f"no section at byte {at}")
        here = at + HEAD.itemsize
        rows = np.frombuffer(content, DOC, head["docs"], here)
        here += rows.nbytes
        starts = np.frombuffer(content, "<u4", head["blocks"], here)
        here += starts.nbytes
        at += int(head["bytes"])
        data = np.frombuffer(content, np.uint8, at - here, here)
        yield int(head["file"]), int(head["section"]), rows, unpack(starts, data, int(head["ids"]))
        at += 1  # the sink's line end


def write_tokens(docs: DataFrame, folder: str, path: str) -> None:
    """Encode docs (doc_id, text) into files of `folder`, ascending by doc_id."""
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    files = max(partitions(docs.sparkSession), -(-chars // FILE_CHARS))
    place = F.xxhash64("text")
    ranged = docs.select("doc_id", "text", place.alias("place")).repartitionByRange(files, F.col("doc_id").asc_nulls_first(), "place")
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "place").select(F.col("doc_id").cast("string"), "text")
    ordered.mapInPandas(sections(path), "section binary").select(F.col("section").cast("string")).write.text(folder)


def read_tokens(spark, folder: str) -> DataFrame:
    """doc_id, file, local_start, n_tokens and ids_crc32 of every document in the files of `folder`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out, start = [], 0
                for file, _, rows, ids in read_sections(content):
                    at = 0
                    for doc_id, flags, n in rows.tolist():
                        part = ids[at : at + n].astype("<u4").tobytes()
                        if flags & 2:
                            last = out[-1]
                            out[-1] = (*last[:3], last[3] + n, zlib.crc32(part, last[4]))
                        else:
                            out.append((None if flags & 1 else doc_id, file, start, n, zlib.crc32(part)))
                        at, start = at + n, start + n
                yield pd.DataFrame(out, columns=["doc_id", "file", "local_start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("content")
    return files.mapInPandas(run, "doc_id long, file int, local_start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark, folder: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    made = work_folder(spark, "tokens")
    write_tokens(docs, made, path or public_tokenizers.path(TOKENIZER))
    found = stored(read_tokens(spark, made), "token-index")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    offsets = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(F.broadcast(offsets), "file").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
