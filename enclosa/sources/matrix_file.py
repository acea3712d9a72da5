"""Binary matrix files: the portable format and the legacy one, as Spark data sources.

``spark.read.format("matbin").load(path)`` reads the elements of a file as
(i, j, value columns); ``df.write.format("matbin").option("rows", ...)`` writes
one.  load() and save() do both for a Matrix.  A file is written under a
temporary name and renamed, so it is there whole or not at all.

Tasks read and write elements at their places in the file, as Arrow batches, so
neither they nor the driver hold a whole matrix.  The checksum is made of stripes
that are checked on their own and joined; load() has tasks check them.

Paths are on a file system that driver and executors share.
"""

from __future__ import annotations

import dataclasses
import os
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from enclosa.types import SQL_TYPES, VALUES, FileError, Matrix, throw

# The portable format's magic, version, layout and type numbers,
# and the legacy format's type tags and file name endings.
MAGIC = b"VCPMAT2\0"
VERSION = 2
COLUMN_MAJOR = 1
TYPES = {"int": 1, "double": 2, "interval": 3, "dd": 4, "interval_dd": 5}
TAGS = {"int": b"integer", "double": b"double", "interval": b"interval_double", "dd": b"kv_doubledouble", "interval_dd": b"interval_kv_dd"}
ENDINGS = {"int": ".matrix_int", "double": ".matrix_d", "interval": ".matrix_id", "dd": ".matrix_kvdd", "interval_dd": ".matrix_ikvdd"}
POLYNOMIAL = 0x42F0E1EBA9EA3693

_HEADER = struct.Struct("<8sIIIIQQQ")


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 56
        for _ in range(8):
            c = ((c << 1) ^ POLYNOMIAL if c >> 63 else c << 1) & (1 << 64) - 1
        out.append(c)
    return out


_CRC = _crc_table()


_CRC_OF = np.array(_CRC, np.uint64)
#: Lanes of a vectorised checksum, and the bytes of a stripe that is checked at once.
LANES, STRIPE = 4096, 8 << 20


def _applied(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 64-bit numbers, given by its values at each byte in each of 8 places."""
    out = np.zeros_like(x)
    for k in range(8):
        out ^= op[k][(x >> np.uint64(8 * k)) & np.uint64(255)]
    return out


#: How the checksum changes over 1, 2, 4, ... zero bytes.
_ZEROS: list[np.ndarray] = []


def _after_zeros(n: int, crc: np.ndarray) -> np.ndarray:
    """Checksums after n further zero bytes: the checksum is linear, so two stripes join by this and an exclusive or."""
    k = 0
    while n >> k:
        if len(_ZEROS) == k:
            byte = np.arange(256, dtype=np.uint64)
            if k:
                _ZEROS.append(np.stack([_applied(_ZEROS[-1], x) for x in _ZEROS[-1]]))
            else:
                places = [byte << np.uint64(8 * j) for j in range(8)]
                _ZEROS.append(np.stack([(x << np.uint64(8)) ^ _CRC_OF[x >> np.uint64(56)] for x in places]))
        if n >> k & 1:
            crc = _applied(_ZEROS[k], crc)
        k += 1
    return crc


def joined(first: int, second: int, length: int) -> int:
    """The checksum of two stripes one after the other, the second of ``length`` bytes, from the checksums of each."""
    return int(_after_zeros(length, np.array([first], np.uint64))[0]) ^ second


def crc64(data: bytes, crc: int = 0) -> int:
    """CRC-64, highest bit first, from 0 and without a final exclusive or.

    Long data is cut into LANES stretches that advance together.
    """
    short = len(data) % LANES if len(data) >= 4 * LANES else len(data)
    for b in memoryview(data)[:short]:
        crc = ((crc << 8) & (1 << 64) - 1) ^ _CRC[(crc >> 56) ^ b]
    if short == len(data):
        return crc
    each = (len(data) - short) // LANES
    x = np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=short).reshape(LANES, each).T).astype(np.uint64)
    c = np.zeros(LANES, np.uint64)
    for row in x:
        c = (c << np.uint64(8)) ^ _CRC_OF[(c >> np.uint64(56)) ^ row]
    length = each
    while len(c) > 1:
        c = _after_zeros(length, c[0::2]) ^ c[1::2]
        length *= 2
    return joined(crc, int(c[0]), length)


def stripe_crc(path: str, first: int, last: int) -> int:
    """The checksum of the bytes first <= k < last of a file."""
    crc = 0
    with open(path, "rb") as f:
        f.seek(first)
        while first < last:
            part = f.read(min(last - first, STRIPE))
            if not part:
                throw(FileError, path, ": ends early")
            crc, first = crc64(part, crc), first + len(part)
    return crc


def stripes(size: int) -> list[tuple[int, int]]:
    return [(k, min(size, k + STRIPE)) for k in range(0, size, STRIPE)]


def element_type(elem: str) -> np.dtype:
    return np.dtype("<i4") if elem == "int" else np.dtype("<f8")


def element_bytes(elem: str) -> int:
    return element_type(elem).itemsize * len(VALUES[elem])


def portable(cells: np.ndarray, elem: str) -> bytes:
    """A file of an array rows x columns x value columns."""
    if elem not in TYPES:
        raise FileError(f"no file holds {elem} elements")
    rows, cols = cells.shape[:2]
    body = np.ascontiguousarray(cells.transpose(1, 0, 2)).astype(element_type(elem)).tobytes()
    data = _HEADER.pack(MAGIC, VERSION, TYPES[elem], COLUMN_MAJOR, 0, rows, cols, len(body)) + body
    return data + struct.pack("<Q", crc64(data))


@dataclasses.dataclass(frozen=True)
class Header:
    elem: str
    rows: int
    cols: int
    payload: int
    start: int = _HEADER.size


def header(data: bytes, size: int, path: str) -> Header:
    """The checked header of a portable file of ``size`` bytes."""
    if len(data) < _HEADER.size:
        throw(FileError, path, ": too short for a header")
    magic, version, kind, layout, reserved, rows, cols, payload = _HEADER.unpack(data[: _HEADER.size])
    names = {n: e for e, n in TYPES.items()}
    for ok, what in ((magic == MAGIC, "magic"), (version == VERSION, "version"), (kind in names, "type"), (layout == COLUMN_MAJOR, "layout"), (reserved == 0, "reserved field")):
        if not ok:
            throw(FileError, path, ": wrong ", what)
    elem = names[kind]
    if rows > 2**31 - 1 or cols > 2**31 - 1 or rows * cols * element_bytes(elem) != payload:
        throw(FileError, path, ": wrong size ", rows, " x ", cols)
    if size != _HEADER.size + payload + 8:
        throw(FileError, path, ": ", size, " bytes in place of ", _HEADER.size + payload + 8)
    return Header(elem, rows, cols, payload)


def opened(path: str) -> tuple[Header, int]:
    """The checked header of a portable file and its size."""
    try:
        size = os.path.getsize(path)
        with open(path, "rb") as f:
            return header(f.read(_HEADER.size), size, path), size
    except OSError as e:
        raise FileError(f"{path}: {e}") from None


def verified(path: str, spark: SparkSession | None = None) -> Header:
    """The header of a portable file whose checksum is right; with ``spark``, tasks check the stripes."""
    h, size = opened(path)
    cut = stripes(size - 8)
    if spark is None or len(cut) < 2:
        found = [stripe_crc(path, *x) for x in cut]
    else:
        def part(batches):
            for b in batches:
                k = b.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([stripe_crc(path, *cut[i]) for i in k.tolist()], pa.uint64()).view(pa.int64())], ["id", "crc"])

        rows = spark.range(0, len(cut), 1, len(cut)).mapInArrow(part, "id long, crc long").collect()
        found = [r["crc"] % 2**64 for r in sorted(rows)]
    crc = 0
    for (lo, hi), own in zip(cut, found, strict=True):
        crc = joined(crc, own, hi - lo)
    with open(path, "rb") as f:
        f.seek(size - 8)
        if struct.unpack("<Q", f.read(8))[0] != crc:
            throw(FileError, path, ": wrong checksum")
    return h


def legacy(cells: np.ndarray, elem: str) -> bytes:
    """Tag, two native ints, elements in rows."""
    rows, cols = cells.shape[:2]
    return TAGS[elem] + struct.pack("=ii", rows, cols) + np.ascontiguousarray(cells).astype(element_type(elem).newbyteorder("=")).tobytes()


def legacy_shape(path: str, elem: str) -> tuple[int, int]:
    """Rows and columns of a legacy file whose tag, size and length are right."""
    tag = TAGS[elem]
    try:
        size = os.path.getsize(path)
        with open(path, "rb") as f:
            data = f.read(len(tag) + 8)
    except OSError as e:
        raise FileError(f"{path}: {e}") from None
    if data[: len(tag)] != tag:
        throw(FileError, path, ": not a file of ", elem, " elements")
    if len(data) < len(tag) + 8:
        throw(FileError, path, ": no size")
    rows, cols = struct.unpack_from("=ii", data, len(tag))
    if rows < 0 or cols < 0 or size < len(tag) + 8 + rows * cols * element_bytes(elem):
        throw(FileError, path, ": wrong size ", rows, " x ", cols)
    return rows, cols


def _schema(elem: str) -> str:
    return "i int, j int, " + ", ".join(f"{c} {SQL_TYPES[elem]}" for c in VALUES[elem])


@dataclasses.dataclass
class _Lines(InputPartition):
    """Columns of a portable file or rows of a legacy one, first <= k < last."""

    first: int
    last: int


class _Reader(DataSourceReader):
    """One partition for each stripe of a file's lines."""

    CELLS = 1 << 20
    BATCH = 1 << 16

    def __init__(self, path: str, kind: str, elem: str, checked: bool):
        self.path, self.kind, self.elem, self.checked = path, kind, elem, checked

    def _layout(self) -> tuple[int, int, int]:
        """Lines, elements of a line, and where they begin."""
        if self.kind == "legacy":
            rows, cols = legacy_shape(self.path, self.elem)
            return rows, cols, len(TAGS[self.elem]) + 8
        h = opened(self.path)[0]
        return h.cols, h.rows, h.start

    def partitions(self) -> list[InputPartition]:
        if self.kind != "legacy" and not self.checked:
            verified(self.path)
        lines, each, _ = self._layout()
        step = max(1, self.CELLS // max(1, each))
        return [_Lines(k, min(lines, k + step)) for k in range(0, lines, step)] or [_Lines(0, 0)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        _, each, start = self._layout()
        kind, n = element_type(self.elem), len(VALUES[self.elem])
        with open(self.path, "rb") as f:
            f.seek(start + part.first * each * element_bytes(self.elem))
            at, end = part.first * each, part.last * each
            while at < end:
                m = min(self.BATCH, end - at)
                cells = np.frombuffer(f.read(m * element_bytes(self.elem)), kind).reshape(m, n)
                line, place = np.divmod(np.arange(at, at + m), each)
                i, j = (line, place) if self.kind == "legacy" else (place, line)
                columns = [pa.array(x.astype(np.int32)) for x in (i, j)] + [pa.array(np.ascontiguousarray(cells[:, k])) for k in range(n)]
                yield pa.RecordBatch.from_arrays(columns, ["i", "j", *VALUES[self.elem]])
                at += m


@dataclasses.dataclass
class _Written(WriterCommitMessage):
    elements: int


class _Writer(DataSourceArrowWriter):
    """Tasks write their elements at their places in a file beside the target; commit adds the checksum and renames it.

    A task that is repeated writes the same elements once more.
    """

    def __init__(self, path: str, kind: str, elem: str, rows: int, cols: int, overwrite: bool):
        self.path, self.kind, self.elem, self.rows, self.cols = path, kind, elem, rows, cols
        if elem not in TYPES:
            raise FileError(f"no file holds {elem} elements")
        if os.path.exists(path) and not overwrite:
            raise FileError(f"{path} exists")
        self.whole = f"{path}.{uuid.uuid4().hex}.tmp"
        self.payload = rows * cols * element_bytes(elem)
        head = TAGS[elem] + struct.pack("=ii", rows, cols) if kind == "legacy" else _HEADER.pack(MAGIC, VERSION, TYPES[elem], COLUMN_MAJOR, 0, rows, cols, self.payload)
        self.start = len(head)
        with open(self.whole, "wb") as f:
            f.write(head)
            f.truncate(self.start + self.payload)

    def write(self, iterator) -> WriterCommitMessage:
        n, kind, seen = len(VALUES[self.elem]), element_type(self.elem), 0
        with open(self.whole, "r+b") as f:
            for b in iterator:
                i, j = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in "ij")
                if len(i) and (i.min() < 0 or j.min() < 0 or i.max() >= self.rows or j.max() >= self.cols):
                    raise FileError(f"an element outside {self.rows} x {self.cols}")
                place = i * self.cols + j if self.kind == "legacy" else j * self.rows + i
                cells = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(kind) for c in VALUES[self.elem]], 1).reshape(len(i), n)
                o = np.argsort(place, kind="stable")
                place, cells, seen = place[o], cells[o], seen + len(o)
                cut = np.flatnonzero(np.concatenate([[True], np.diff(place) != 1, [True]])) if len(o) else np.zeros(1, np.int64)
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    f.seek(self.start + int(place[lo]) * element_bytes(self.elem))
                    f.write(cells[lo:hi].tobytes())
        return _Written(seen)

    def commit(self, messages) -> None:
        seen = sum(m.elements for m in messages if m is not None)
        if seen != self.rows * self.cols:
            self.abort(messages)
            raise FileError(f"{seen} elements for {self.rows} x {self.cols}")
        if self.kind != "legacy":
            size = self.start + self.payload
            with open(self.whole, "r+b") as f:
                f.seek(size)
                f.write(struct.pack("<Q", stripe_crc(self.whole, 0, size)))
        os.replace(self.whole, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.whole):
            os.remove(self.whole)


class MatrixFile(DataSource):
    KIND = "portable"

    @classmethod
    def name(cls) -> str:
        return "matbin"

    def _path(self) -> str:
        path = self.options.get("path", "")
        if not path:
            raise FileError("no file name")
        return path.removeprefix("file://")

    def _elem(self) -> str:
        return self.options.get("elem") or opened(self._path())[0].elem

    def schema(self) -> str:
        return _schema(self._elem())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._path(), self.KIND, self._elem(), self.options.get("checked") == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self._path(), self.KIND, self.options.get("elem") or "double", int(self.options["rows"]), int(self.options["cols"]), overwrite)


class LegacyMatrixFile(MatrixFile):
    KIND = "legacy"

    @classmethod
    def name(cls) -> str:
        return "matbin_legacy"

    def _elem(self) -> str:
        return self.options.get("elem") or "double"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixFile)
    spark.dataSource.register(LegacyMatrixFile)


def save(a: Matrix, path: str | Path, kind: str = "portable") -> None:
    """Writes one matrix; a legacy file gets the ending of its element kind."""
    if a.by:
        raise FileError("a file holds one matrix")
    spark = a.df.sparkSession
    register(spark)
    path = f"{path}{ENDINGS[a.elem]}" if kind == "legacy" else str(path)
    a.df.select("i", "j", *a.values).write.format("matbin_legacy" if kind == "legacy" else "matbin").option("elem", a.elem).option("rows", a.rows).option("cols", a.cols).mode("overwrite").save(path)


def load(spark: SparkSession, path: str | Path, elem: str | None = None, kind: str = "portable") -> Matrix:
    """Reads one matrix; a legacy file is looked for under the ending of ``elem``."""
    register(spark)
    if kind == "legacy":
        elem = elem or "double"
        path = f"{path}{ENDINGS[elem]}"
        shape = legacy_shape(path, elem)
    else:
        h = verified(str(path), spark)
        if elem is not None and elem != h.elem:
            raise FileError(f"{path}: {h.elem} elements in place of {elem}")
        elem, shape = h.elem, (h.rows, h.cols)
    df = spark.read.format("matbin_legacy" if kind == "legacy" else "matbin").option("elem", elem).option("checked", "true").load(str(path))
    return Matrix(df.select("i", "j", *VALUES[elem]), *shape, elem)
