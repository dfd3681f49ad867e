"""Token ids in length-delimited binary records.

A record is framed as  length (uint64), masked CRC-32C of the length, payload, masked CRC-32C of the payload,  all little
endian; the payload is doc_id (int64), width of an id in bytes (uint32), number of ids (uint32), the ids (uint16 where
the vocabulary allows it, else uint32). A file has a sibling of the same name with .idx, which holds the place of each
record (uint64) and a masked CRC-32C of them all, so that records can be read in any order.

Documents are dealt to files by ranges of doc_id and written in that order. A task writes to names of its own attempt
and its row of the manifest names them; the manifest is written once, by Spark, from the attempts that succeeded, so
files of lost tasks are never read. Files go through pyarrow's file systems (file, hdfs, s3, gs), the folder is a
parameter, and by default it lies in the shared folder.

Defined cases: a null text is an empty one, whose record holds the end id alone; a null doc_id is written as -2**63 and
comes first, and is read as null; rows with equal doc_id are ordered by a hash of their text, then by it; a text of any
length is one record; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import _spark as S
from tessella.llm import _text as X
from tessella.llm import byte_ids
from tessella.operators.order import running

END = 0
CHUNK = 4 << 20
NO_ID = -(2**63)
_HEAD = "<qII"
_STEP = 128


def _table() -> np.ndarray:
    """CRC-32C of each byte, then of each byte followed by 1, 2, 3 zero bytes, and how a CRC moves over _STEP zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0x82F63B78), t >> np.uint32(1))
    return t


_CRC = _table()


def _shifted(crc: np.ndarray, zeros: int) -> np.ndarray:
    for _ in range(zeros):
        crc = (crc >> np.uint32(8)) ^ _CRC[crc & np.uint32(255)]
    return crc


_OVER = [_shifted(np.arange(256, dtype=np.uint32) << np.uint32(8 * j), _STEP) for j in range(4)]


def crc32c(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32C of each run data[first[i] : first[i + 1]] of at least four bytes, all runs at once."""
    size = np.diff(first)
    n = len(size)
    if not n:
        return np.zeros(0, np.uint32)
    data = data.copy()
    for j in range(4):  # the register's start of all ones
        data[first[:-1] + j] ^= 255
    rows = -(-size // _STEP)
    grid = np.zeros((int(rows.sum()), _STEP), np.uint8)
    ends = np.cumsum(rows) * _STEP
    grid.reshape(-1)[np.arange(len(data)) + np.repeat(ends - first[1:], size)] = data  # zeros come before each run
    state = np.zeros(len(grid), np.uint32)
    for column in np.ascontiguousarray(grid.T):
        state = (state >> np.uint32(8)) ^ _CRC[(state ^ column) & np.uint32(255)]
    at, out, left = np.cumsum(rows) - rows, np.zeros(n, np.uint32), np.arange(n)
    for k in range(int(rows.max())):
        left = left[rows[left] > k]
        crc = out[left]
        moved = _OVER[0][crc & np.uint32(255)] ^ _OVER[1][(crc >> np.uint32(8)) & np.uint32(255)] ^ _OVER[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ _OVER[3][crc >> np.uint32(24)]
        out[left] = moved ^ state[at[left] + k]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The records of payloads, and the size of each."""
    if not payloads:
        return b"", np.zeros(0, np.int64)
    size = np.array([len(p) for p in payloads], np.uint64)
    lengths = size.view(np.uint8)
    head = masked(crc32c(lengths, np.arange(len(size) + 1) * 8))
    body = masked(crc32c(np.frombuffer(b"".join(payloads), np.uint8), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)))
    pack = struct.Struct("<QI").pack
    out = b"".join(x for n, h, p, c in zip(size.tolist(), head.tolist(), payloads, body.tolist(), strict=True) for x in (pack(n, h), p, struct.pack("<I", c)))
    return out, size.astype(np.int64) + 16


def unframe(data: bytes, places: np.ndarray) -> list[bytes]:
    """The payloads of the records at these places; a wrong checksum is an error."""
    out, sizes = [], []
    heads = []
    for at in places.tolist():
        n, h = struct.unpack_from("<QI", data, at)
        if at + 16 + n > len(data):
            raise ValueError(f"a record at {at} ends beyond its file")
        out.append(data[at + 12 : at + 12 + n])
        sizes.append(n)
        heads.append((h, struct.unpack_from("<I", data, at + 12 + n)[0]))
    size = np.array(sizes, np.uint64)
    given = np.array(heads, np.uint32).reshape(-1, 2)
    if len(out):
        head = masked(crc32c(size.view(np.uint8), np.arange(len(size) + 1) * 8))
        body = masked(crc32c(np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)))
        if not (np.array_equal(given[:, 0], head) and np.array_equal(given[:, 1], body)):
            raise ValueError("a record's checksum is wrong")
    return out


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


MANIFEST = "part int, file string, n_records long, n_tokens long, n_bytes long"


def _written(folder: str, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, at = _files(folder)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder = byte_ids.load(path, plain=False)
        kind, width = (np.uint16, 2) if encoder.vocabulary <= 1 << 16 else (np.uint32, 4)
        records = tokens = place = 0
        places: list[np.ndarray] = []
        out = None
        try:
            for batch in batches:
                data, off = X.utf8(batch.column("text"))
                doc = np.asarray(batch.column("doc_id").fill_null(NO_ID), np.int64)
                for a, b, d, o in X.chunks(data, off, CHUNK):
                    ids, count = encoder.encode(d, o)
                    ends = np.concatenate([[0], np.cumsum(count)])
                    ids, end = ids.astype(kind), np.array([END], kind).tobytes()
                    payloads = [struct.pack(_HEAD, i, width, n + 1) + ids[x : x + n].tobytes() + end for i, x, n in zip(doc[a:b].tolist(), ends[:-1].tolist(), count.tolist(), strict=True)]
                    framed, size = frames(payloads)
                    if out is None:
                        files.create_dir(at, recursive=True)
                        out = files.open_output_stream(f"{at}/{name}.rec")
                    out.write(framed)
                    places.append(place + np.cumsum(size) - size)
                    place += len(framed)
                    S.trim()
                    records += b - a
                    tokens += int(count.sum()) + b - a
        finally:
            if out is not None:
                out.close()
        if out is not None:
            index = np.concatenate(places).astype("<u8")
            crc = masked(crc32c(index.view(np.uint8), np.array([0, index.nbytes])))
            with files.open_output_stream(f"{at}/{name}.idx") as to:
                to.write(index.tobytes() + crc.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), *[pa.array([x], pa.int64()) for x in (records, tokens, place)]], names=["part", "file", "n_records", "n_tokens", "n_bytes"])
            S.trim()

    return run


def write(docs: DataFrame, folder: str | None = None, path: str | None = None) -> tuple[str, DataFrame]:
    """Writes the ids of docs(doc_id, text) and returns the folder and the manifest: a row for each file, in the order of `part`."""
    import public_tokenizers

    spark = docs.sparkSession
    folder = folder or f"{S.shared(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("by"))
    dealt = rows.repartitionByRange(S.partitions(docs), "doc_id", "by").sortWithinPartitions("doc_id", "by", "text").drop("by")
    return folder, S.cut(dealt.mapInArrow(_written(folder, path or public_tokenizers.path(byte_ids.FILE)), MANIFEST))


def _records(folder: str, shuffle: int | None):
    """(doc_id, start, ids) of each file's records; with `shuffle`, each file in an order of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, np.ndarray]]:
        files, at = _files(folder)
        for batch in batches:
            for part, name, start in zip(*[batch.column(c).to_pylist() for c in ("part", "file", "start")], strict=True):
                with files.open_input_stream(f"{at}/{name}.idx") as x:
                    held = x.read()
                index = np.frombuffer(held[:-4], "<u8").astype(np.int64)
                if masked(crc32c(np.frombuffer(held[:-4], np.uint8), np.array([0, len(held) - 4])))[0] != struct.unpack("<I", held[-4:])[0]:
                    raise ValueError(f"the index of {name} is damaged")
                with files.open_input_file(f"{at}/{name}.rec") as x:
                    end = x.size()
                    order = np.arange(len(index)) if shuffle is None else np.random.default_rng([shuffle, part]).permutation(len(index))
                    if shuffle is None:  # runs of records, a few megabytes at a time
                        lo = 0
                        while lo < len(index):
                            hi = max(lo + 1, int(np.searchsorted(index, index[lo] + (4 << 20))))
                            to = int(index[hi]) if hi < len(index) else end
                            x.seek(int(index[lo]))
                            for payload in unframe(x.read(to - int(index[lo])), index[lo:hi] - index[lo]):
                                doc, ids = _parsed(payload)
                                yield doc, start, ids
                                start += len(ids)
                            lo = hi
                    else:
                        for i in order.tolist():
                            to = int(index[i + 1]) if i + 1 < len(index) else end
                            x.seek(int(index[i]))
                            doc, ids = _parsed(unframe(x.read(to - int(index[i])), np.zeros(1, np.int64))[0])
                            yield doc, -1, ids

    return run


def _parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc, width, n = struct.unpack_from(_HEAD, payload)
    return None if doc == NO_ID else doc, np.frombuffer(payload, "<u2" if width == 2 else "<u4", n, struct.calcsize(_HEAD))


def _parts(manifest: DataFrame, shuffle: int | None = None) -> DataFrame:
    """(part, file, start): a row for each file, with the ids of all files before it, dealt to as many tasks."""
    started = running(manifest.select("part", "file", "n_tokens"), [], "part", {"upto": "n_tokens"})
    rows = started.select("part", "file", (F.col("upto") - F.col("n_tokens")).alias("start"))
    n = max(1, manifest.count())
    return rows.repartitionByRange(n, "part") if shuffle is None else rows.repartitionByRange(n, F.xxhash64("part", F.lit(shuffle))).sortWithinPartitions(F.xxhash64("part", F.lit(shuffle)))


def read(spark: SparkSession, folder: str, manifest: DataFrame, shuffle: int | None = None) -> DataFrame:
    """(doc_id, ids) of all records; with `shuffle`, files and the records in each in an order drawn from it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for doc, _, ids in _records(folder, shuffle)(batches):
            held.append((doc, ids.astype(np.int32)))
            if len(held) == 2000:
                yield _lists(held)
                held = []
        if held:
            yield _lists(held)

    return _parts(manifest, shuffle).mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]))


def _lists(held: list) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(i) for _, i in held])])
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([i for _, i in held])))], names=["doc_id", "ids"])


def digests(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = [[], [], [], []]
        for doc, start, ids in _records(folder, None)(batches):
            for to, v in zip(found, (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                to.append(v)
            if len(found[0]) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                found = [[], [], [], []]
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _parts(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return digests(spark, folder, manifest)
