"""Record kinds, manifests and partitioned stores."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from corploom.functions.arrays import indices

DOCUMENT = "inputs array<bigint>, pos_seq array<bigint>, type_id array<bigint>"
SENTENCE = "inputs array<bigint>, type_id array<bigint>"
LM = "inputs array<bigint>, target array<bigint>"
SEQ2SEQ = "source array<bigint>, target array<bigint>"


def parsed(records: DataFrame, pos_seq: bool = False) -> DataFrame:
    """Document or sentence records as examples: type_id for every token, positions counted where there are none, ints."""
    n = F.size("inputs")
    out = records.withColumn("type_id", F.array_repeat(F.col("type_id")[0], n))
    if pos_seq and "pos_seq" not in records.columns:
        out = out.withColumn("pos_seq", indices(n))
    return out.select(*[F.transform(c, lambda x: x.cast("int")).alias(c) if t.startswith("array") else F.col(c) for c, t in out.dtypes])


def fixed(records: DataFrame, seq_len: int, columns: tuple[str, ...] = ("inputs", "target")) -> DataFrame:
    """records, failing on a row whose arrays don't have seq_len places."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.size(c) == seq_len)
    return records.where(F.assert_true(ok, F.lit(f"a record doesn't have {seq_len} places")).isNull())


def truncated(rows: DataFrame, max_source: int = 0, max_target: int = 0) -> DataFrame:
    """source and target cut to limits above 0."""
    for c, n in (("source", max_source), ("target", max_target)):
        if n > 0:
            rows = rows.withColumn(c, F.slice(c, 1, n))
    return rows


def valid_length(columns: list[str], least: int, most: int) -> Column:
    return F.greatest(*[F.size(c) for c in columns]).between(least, most) if len(columns) > 1 else F.size(columns[0]).between(least, most)


def store(spark: SparkSession, path: str, split: str, kinds: tuple[str, ...], uncased: bool) -> DataFrame:
    """Rows of kinds (doc, sent; semidoc reads doc) of a store partitioned by split, kind and uncased, with partition pruning."""
    real = ["doc" if k == "semidoc" else k for k in kinds]
    return spark.read.parquet(path).where((F.col("split") == split) & F.col("kind").isin(real) & (F.col("uncased") == uncased))


def read_manifests(spark: SparkSession, dirs: str, name: str = "*pass-*.json*", count: str = "num_batch") -> DataFrame:
    """(dir, pass_id, filenames, count) of the manifest files called name in comma-separated folders; pass_id is the number after "pass-" in
    the file's name, null without one. A manifest that lacks filenames or its count raises when the row is computed."""
    out = None
    for folder in [x.strip().rstrip("/") for x in dirs.split(",") if x.strip()]:
        rows = spark.read.schema(f"filenames array<string>, {count} bigint").option("multiLine", True).option("pathGlobFilter", name).json(folder)
        pass_id = F.regexp_extract(F.col("_metadata.file_name"), r"pass-([0-9]+)", 1)
        known = F.col("filenames").isNotNull() & F.col(count).isNotNull()
        n = F.when(known, F.col(count)).otherwise(F.raise_error(F.concat(F.lit("no filenames or counts in "), F.col("_metadata.file_path"))))
        own = rows.select(F.lit(folder).alias("dir"), F.when(pass_id != "", pass_id.cast("int")).alias("pass_id"), "filenames", n.cast("long").alias(count))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no folders")
    return out


def merged_manifests(manifests: DataFrame, count: str, n_passes: int | None = None) -> DataFrame:
    """(filename, n, n_total) of manifest rows (dir, pass_id, filenames, count), names re-rooted at their manifest's folder.

    With n_passes, manifests of that pass or later ones go, each other keeps its first n_passes files at most, and its count is scaled by the share
    of files kept, rounded down. n_total is the manifest's count, n the file's share of it: even, earlier files have one more. A
    manifest without files gives no rows."""
    rows = manifests if n_passes is None else manifests.where(F.col("pass_id") < n_passes)
    size = F.size("filenames")
    kept = size if n_passes is None else F.least(size, F.lit(n_passes))
    # in doubles, as those who wrote such manifests scale them
    total = F.col(count).cast("long") if n_passes is None else F.floor(F.col(count).cast("double") * (kept.cast("double") / size.cast("double"))).cast("long")
    out = rows.where(size > 0).select("dir", kept.alias("_k"), total.alias("n_total"), F.posexplode(F.slice("filenames", F.lit(1), kept)).alias("_i", "_f"))
    each = F.floor(F.col("n_total") / F.col("_k")) + (F.col("_i") < F.col("n_total") % F.col("_k")).cast("long")
    return out.select(F.concat("dir", F.lit("/"), F.regexp_extract("_f", "([^/]*)$", 1)).alias("filename"), each.cast("long").alias("n"), "n_total")


def shard_name(prefix: str, suffix: str, shard: Column, shards: int, uncased: bool, seq_len: int | None = None, bsz: int | None = None) -> Column:
    """The compatible file name of a shard."""
    middle = f".lm.seq-{seq_len}.bsz-{bsz}" if seq_len is not None else ""
    case = (".lower" if seq_len is not None else ".uncased") if uncased else ""
    return F.format_string(f"{prefix}{middle}{case}.{suffix}-%05d-of-%05d", shard, F.lit(shards))


# --- the length-prefixed, checksummed record format with protobuf examples -----------------------------------------------


@cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0x82F63B78 if n & 1 else 0)  # Castagnoli, reflected
        out.append(n)
    return tuple(out)


def masked_crc(data: bytes) -> int:
    table, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = table[(c ^ b) & 255] ^ (c >> 8)
    c ^= 0xFFFFFFFF
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def example_bytes(features: dict[str, list[int]]) -> bytes:
    """A protobuf example of named int64 lists, names in order."""
    entries = b"".join(_field(1, _field(1, k.encode()) + _field(2, _field(3, _field(1, b"".join(map(_varint, v)))))) for k, v in sorted(features.items()))
    return _field(1, entries)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        if tag & 7 == 2:
            n, at = _read_varint(data, at)
            yield tag >> 3, data[at : at + n]
            at += n
        elif tag & 7 == 0:
            n, at = _read_varint(data, at)
            yield tag >> 3, n
        else:
            at += 4 if tag & 7 == 5 else 8


def _int(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def parse_example(data: bytes) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for _, features in _fields(data):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            values: list[int] = []
            for kind, blob in _fields(parts.get(2, b"")):
                if kind == 3:
                    for _, v in _fields(blob):
                        if isinstance(v, int):
                            values.append(_int(v))
                        else:
                            at = 0
                            while at < len(v):
                                n, at = _read_varint(v, at)
                                values.append(_int(n))
            out[parts[1].decode()] = values
    return out


def record_bytes(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked_crc(size)) + data + struct.pack("<I", masked_crc(data))


def records_of(data: bytes, verify: bool = True) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        size = data[at : at + 8]
        (n,) = struct.unpack("<Q", size)
        body = data[at + 12 : at + 12 + n]
        if verify and (struct.unpack("<I", data[at + 8 : at + 12])[0] != masked_crc(size) or struct.unpack("<I", data[at + 12 + n : at + 16 + n])[0] != masked_crc(body)):
            raise ValueError("a record's checksum is wrong")
        yield body
        at += 16 + n


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Examples of record files as rows of int64 arrays; files come through Spark's own readers, one at a time in a task."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for files in batches:
            for data in files["content"]:
                rows = [parse_example(r) for r in records_of(data)]
                for k in range(0, len(rows), 1024):
                    yield pd.DataFrame([[r.get(n) for n in names] for r in rows[k : k + 1024]], columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


class _Part(InputPartition):
    pass


class RecordSource(DataSource):
    """Format 'records': writes rows of int64 arrays as record files into the shared folder given as path."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SENTENCE

    def reader(self, schema: StructType) -> DataSourceReader:
        raise NotImplementedError("read_records() reads record files")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _RecordWriter(self.options["path"], schema.names, int(self.options.get("max_bytes", str(1 << 28))))


class _RecordWriter(DataSourceWriter):
    """Each task writes one file under a name of its own and attempt and tells it; committed files are renamed to their final names."""

    def __init__(self, path: str, names: list[str], max_bytes: int):
        self.path, self.names, self.max_bytes = path.removeprefix("file://"), names, max_bytes

    def write(self, iterator) -> WriterCommitMessage:
        import os

        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        name = f"_part-{task.partitionId():05d}-{task.taskAttemptId()}"
        n = 0
        with open(os.path.join(self.path, name), "wb") as f:
            for row in iterator:
                f.write(record_bytes(example_bytes({k: list(row[k]) for k in self.names if row[k] is not None})))
                n += 1
        message = WriterCommitMessage()
        message.file, message.rows, message.part = name, n, task.partitionId()
        return message

    def commit(self, messages) -> None:
        import json
        import os

        done = [m for m in messages if m is not None]
        files = []
        for m in done:
            final = f"part-{m.part:05d}-of-{len(done):05d}.tfrecord"
            os.replace(os.path.join(self.path, m.file), os.path.join(self.path, final))
            files.append(final)
        with open(os.path.join(self.path, "manifest.json"), "w") as f:
            json.dump({"filenames": sorted(files), "num_example": sum(m.rows for m in done)}, f)

    def abort(self, messages) -> None:
        import os

        for m in messages:
            if m is not None and os.path.exists(os.path.join(self.path, m.file)):
                os.remove(os.path.join(self.path, m.file))
