"""Schemas of many dataset directories, read by the executors.

The first data file of each directory is opened in a task and only its header is read: the
footer of a Parquet file, the start of an Avro file.  What comes back is a fingerprint of the
schema; directories with equal format and fingerprint form a family, whose schema Spark itself
then reads once.  Nullability and file metadata are left out of the fingerprint, as readers
ignore them; names, types and their order count.

Files in a store that Arrow can't open are marked, so that the caller asks Spark for them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.sources import files

#: An Avro header is read in steps of this size until it is whole.
_STEP = 1 << 16
NO_STORE = "no_store"
_FIELDS = "dataset_name string, partition_date date, raw_date string, directory string, format string, fingerprint string, problem string"


def _reader():
    """The functions as closures, so that they travel to Python workers by value."""

    def parquet(store, path: str) -> str:
        import pyarrow.parquet as pq

        with store.open_input_file(path) as source:
            columns = pq.ParquetFile(source).schema
        return json.dumps([
            [x.path, x.physical_type, x.logical_type.to_json(), x.max_repetition_level, x.length]
            for x in (columns.column(k) for k in range(len(columns)))
        ])

    def avro(store, path: str) -> str:
        with store.open_input_file(path) as source:
            size, data = source.size(), b""
            while True:
                data += source.read(_STEP)
                try:
                    return json.dumps(plain(json.loads(avro_schema(data))))
                except IndexError:
                    if len(data) >= size:
                        raise ValueError("the header ends early") from None

    def avro_schema(data: bytes) -> bytes:
        if data[:4] != b"Obj\x01":
            raise ValueError("not an Avro file")
        at = 4

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value >> 1 ^ -(value & 1)

        def text() -> bytes:
            nonlocal at
            length = number()
            if at + length > len(data):
                raise IndexError
            at += length
            return data[at - length:at]

        while count := number():
            if count < 0:
                count = -count
                number()
            for _ in range(count):
                key, value = text(), text()
                if key == b"avro.schema":
                    return value
        raise ValueError("the header has no schema")

    def plain(schema):
        """The schema without documentation and defaults."""
        if isinstance(schema, dict):
            return {k: plain(v) for k, v in schema.items() if k not in ("doc", "default", "aliases", "order")}
        return [plain(x) for x in schema] if isinstance(schema, list) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        stores: dict[str, object] = {}
        for batch in batches:
            prints, problems = [], []
            for path, kind in zip(batch.column(5).to_pylist(), batch.column(4).to_pylist()):
                print_, problem = None, None
                scheme = path.split(":", 1)[0]
                try:
                    if scheme not in stores:
                        stores[scheme] = fs.FileSystem.from_uri(path)[0]
                    # a listing gives names as they are, and not as escaped parts of a URI
                    plain_path = path.split(":", 1)[1]
                    plain_path = "/" + plain_path.lstrip("/") if scheme == "file" else fs.FileSystem.from_uri(path)[1]
                except (pa.ArrowInvalid, OSError):
                    prints.append(None)
                    problems.append("no_store")
                    continue
                try:
                    found = (parquet if kind == "PARQUET" else avro)(stores[scheme], plain_path)
                    print_ = hashlib.sha256(found.encode()).hexdigest()
                except FileNotFoundError:
                    problem = "no_store"
                except (pa.ArrowInvalid, OSError, ValueError) as error:
                    problem = f"{type(error).__name__}: {error}"[:200]
                prints.append(print_)
                problems.append(problem)
            columns = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(prints, pa.string()), pa.array(problems, pa.string())],
                names=["dataset_name", "partition_date", "raw_date", "directory", "format", "fingerprint", "problem"],
            )

    return run


def directories(inventory: DataFrame) -> DataFrame:
    """One row per dataset directory: names, format and the first file of that format."""
    raw = inventory.withColumn("directory", F.regexp_extract("path", r"/src_sys_nm=([^/]+)/[^/]+$", 1))
    kind = F.when(F.col("file_name").endswith(".avro"), files.AVRO).when(F.col("file_name").endswith(".parquet"), files.PARQUET)
    first = F.min(F.when(kind.isNotNull(), F.struct("path", kind.alias("format"))))
    return raw.groupBy("raw_date", "src_sys_nm", "directory").agg(first.alias("first")).select(
        F.concat(F.lit("src_sys_nm="), "src_sys_nm").alias("dataset_name"), F.to_date("raw_date", "yyyyMMdd").alias("partition_date"),
        "raw_date", "directory", F.coalesce("first.format", F.lit(files.UNSUPPORTED)).alias("format"), F.col("first.path").alias("path"),
    )


def fingerprints(found: DataFrame) -> DataFrame:
    """The directories with the fingerprint of their schema, or the problem with it."""
    known = found.filter(F.col("format") != files.UNSUPPORTED)
    spread = known.repartition("dataset_name", "partition_date")
    opened = spread.select("dataset_name", "partition_date", "raw_date", "directory", "format", "path").mapInArrow(_reader(), _FIELDS)
    none = F.lit(None).cast("string")
    unknown = found.filter(F.col("format") == files.UNSUPPORTED).select(
        "dataset_name", "partition_date", "raw_date", "directory", "format", none.alias("fingerprint"), none.alias("problem"))
    return opened.unionByName(unknown)
