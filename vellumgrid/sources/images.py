"""Image files as tables of cells: a Python data source that decodes 8-bit PNG and PGM, and a sink that writes PNG.

    register(spark)
    spark.read.format("vellum_images").load("/maps/*.png")      # (img, r, c, v)

A partition is a run of files up to a number of bytes. Colour becomes grey by luminance. A file that isn't a whole image is one row
with nulls, so that readers can drop or count it.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

#: Bytes of files in a partition, and cells in a batch.
PARTITION_BYTES, BATCH_CELLS = 16 << 20, 1 << 18
#: Greatest image, in cells: a damaged header must not ask for more memory.
MOST_CELLS = 1 << 30
#: Fixed values of PNG: its signature, and samples of a pixel by colour type.
SIGNATURE, SAMPLES = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Luminance of red, green and blue in 65,536ths.
LUMINANCE = (19595, 38470, 7471)


class NotAnImage(ValueError):
    pass


def luminance(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> np.ndarray:
    r, g, b = (x.astype(np.uint32) * w for x, w in zip((red, green, blue), LUMINANCE))
    return ((r + g + b + 32768) >> 16).astype(np.uint8)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def _predicted(kind: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What each row's filter expects of left, upper and upper left samples."""
    return np.choose(kind, [np.zeros_like(a), a, b, (a + b) >> 1, _paeth(a, b, c)])


def unfiltered(kind: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Undo row filters (0 none, 1 left, 2 upper, 3 mean, 4 nearest of three) of data[row, column, sample].

    A sample needs its left, upper and upper left ones, so the diagonals from upper right to lower left follow each other, each at once.
    """
    if kind.max(initial=0) > 4:
        raise NotAnImage("row filter")
    if not kind.any():
        return data
    h, w, n = data.shape
    out = np.zeros((h + 1, w + 1, n), np.int16)
    for d in range(h + w - 1):
        r = np.arange(max(0, d - w + 1), min(h - 1, d) + 1)
        c = d - r
        expected = _predicted(kind[r][:, None], out[r + 1, c], out[r, c + 1], out[r, c])
        out[r + 1, c + 1] = (data[r, c] + expected) & 0xFF
    return out[1:, 1:].astype(np.uint8)


def _chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if at + 12 + size > len(content) or zlib.crc32(kind + body) != struct.unpack_from(">I", content, at + 8 + size)[0]:
            raise NotAnImage("chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise NotAnImage("no end")


def decoded_png(content: bytes) -> np.ndarray:
    head, palette, packed = None, None, []
    for kind, body in _chunks(content):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise NotAnImage("no header")
    w, h, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in SAMPLES or interlaced or not 0 < w * h <= MOST_CELLS or colour == 3 and palette is None:
        raise NotAnImage("kind")
    n = SAMPLES[colour]
    try:
        rows = zlib.decompressobj().decompress(b"".join(packed), h * (1 + w * n))
    except zlib.error as e:
        raise NotAnImage("data") from e
    if len(rows) != h * (1 + w * n):
        raise NotAnImage("data")
    rows = np.frombuffer(rows, np.uint8).reshape(h, 1 + w * n)
    pixels = unfiltered(rows[:, 0], rows[:, 1:].reshape(h, w, n))
    if colour == 3:
        if int(pixels.max()) >= len(palette):
            raise NotAnImage("palette")
        pixels = palette[pixels[:, :, 0]]
    return luminance(*(pixels[:, :, k] for k in range(3))) if colour in (2, 3, 6) else pixels[:, :, 0]


_PGM = re.compile(rb"P([25])(?:\s|#[^\n]*\n)+(\d{1,9})(?:\s|#[^\n]*\n)+(\d{1,9})(?:\s|#[^\n]*\n)+(\d{1,3})\s")


def decoded_pgm(content: bytes) -> np.ndarray:
    m = _PGM.match(content)
    if not m:
        raise NotAnImage("header")
    w, h, most = (int(m[k]) for k in (2, 3, 4))
    if not 0 < w * h <= MOST_CELLS or not 0 < most < 256:
        raise NotAnImage("kind")
    if m[1] == b"5":
        values = np.frombuffer(content, np.uint8, offset=m.end())
    else:
        try:
            values = np.array(content[m.end() :].split()[: w * h], np.int64)
        except ValueError as e:
            raise NotAnImage("data") from e
    if len(values) < w * h or values[: w * h].max() > most:
        raise NotAnImage("data")
    values = values[: w * h].reshape(h, w).astype(np.uint32)
    return (values if most == 255 else (values * 255 + most // 2) // most).astype(np.uint8)


def decoded(content: bytes) -> np.ndarray:
    """Grey values [row, column] of an 8-bit PNG or PGM; NotAnImage for anything else, cut short or damaged."""
    if content.startswith(SIGNATURE):
        return decoded_png(content)
    if content[:2] in (b"P2", b"P5"):
        return decoded_pgm(content)
    raise NotAnImage("unknown kind")


def encoded(pixels: np.ndarray) -> bytes:
    """A PNG of grey [row, column] or colour [row, column, 3] values; each row has the filter with the least sum of differences."""
    data = pixels.reshape(*pixels.shape[:2], -1).astype(np.int16)
    h, w, n = data.shape
    wide = np.zeros((h + 1, w + 1, n), np.int16)
    wide[1:, 1:] = data
    left, up, corner = wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1]
    ways = np.stack([(data - _predicted(np.full((h, 1, 1), k), left, up, corner)) & 0xFF for k in range(5)]).astype(np.uint8)
    kind = np.abs(ways.view(np.int8).astype(np.int32)).sum(axis=(2, 3)).argmin(axis=0)
    rows = np.concatenate([kind[:, None].astype(np.uint8), ways[kind, np.arange(h)].reshape(h, w * n)], axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if n == 1 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


# files


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


def listed(path: str, names: set[str] | None = None) -> list[tuple[str, int]]:
    """Paths and sizes of the files of a folder (at any depth), of a glob in the last part of a path, or of one file, by name.

    names: file names to keep.
    """
    store, base = arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)
    folder, last = posixpath.split(base.rstrip("/"))
    if any(c in last for c in "*?["):
        found = [x for x in store.get_file_info(arrow_fs.FileSelector(folder)) if fnmatch.fnmatchcase(x.base_name, last)]
    else:
        info = store.get_file_info(base.rstrip("/"))
        found = store.get_file_info(arrow_fs.FileSelector(base, recursive=True)) if info.type == arrow_fs.FileType.Directory else [info]
    kept = [x for x in found if x.type == arrow_fs.FileType.File and not x.base_name.startswith(("_", ".")) and (names is None or x.base_name in names)]
    return sorted((x.path, x.size or 0) for x in kept)


def packed(files: list[tuple[str, int]], size: int) -> list[Files]:
    """Runs of files with at most `size` bytes together; a larger file goes alone."""
    out: list[Files] = []
    run, held = [], 0
    for name, n in files:
        if run and held + n > size:
            out.append(Files(tuple(run)))
            run, held = [], 0
        run.append(name)
        held += n
    return out + [Files(tuple(run))] * bool(run)


class ImageReader(DataSourceReader):
    """Partitions of whole files. Equalities on img are pushed down: other files aren't read."""

    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("partitionbytes", PARTITION_BYTES))
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("img",):
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def partitions(self) -> list[Files]:
        return packed(listed(self.path, self.names), self.size)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file
            return
        store = arrow_fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else arrow_fs.LocalFileSystem()
        for path in partition.names:
            with store.open_input_file(path) as f:
                yield from cell_batches(posixpath.basename(path), f.read())


CELLS = pa.schema([("img", pa.string()), ("r", pa.int32()), ("c", pa.int32()), ("v", pa.int32())])


def cell_batches(img: str, content: bytes) -> Iterator[pa.RecordBatch]:
    """Cells of one file in row order, in batches of bounded size; one row of nulls if it is no image."""
    try:
        pixels = decoded(content)
    except NotAnImage:
        yield pa.RecordBatch.from_arrays([pa.array([img]), *([pa.nulls(1, pa.int32())] * 3)], schema=CELLS)
        return
    h, w = pixels.shape
    step = max(1, BATCH_CELLS // w)
    for r in range(0, h, step):
        part = pixels[r : r + step]
        n = part.size
        rows, columns = np.divmod(np.arange(n, dtype=np.int32), np.int32(w))
        yield pa.RecordBatch.from_arrays([pa.array([img] * n, pa.string()), pa.array(rows + np.int32(r)), pa.array(columns), pa.array(part.ravel().astype(np.int32))], schema=CELLS)


@dataclass
class Written(WriterCommitMessage):
    files: int


class ImageWriter(DataSourceWriter):
    """Writes rows (img, content) to <path>/<img>: first under a name of its own, then moved, so a task that is run again does no harm."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator: Iterator) -> Written:
        store, base = arrow_fs.FileSystem.from_uri(self.path) if "://" in self.path else (arrow_fs.LocalFileSystem(), self.path)
        store.create_dir(base, recursive=True)
        n = 0
        for row in iterator:
            own = f"{base}/_{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(bytes(row["content"]))
            store.move(own, f"{base}/{row['img']}")
            n += 1
        return Written(n)


class ImageCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vellum_images"

    def schema(self) -> str:
        return "img string, r int, c int, v int"

    def reader(self, schema) -> ImageReader:
        return ImageReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the source known to a session; without the setting Spark refuses readers that take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageCells)


def read_images(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(img, r, c, v) of the image files at a path; a file that is no whole image is a row with nulls."""
    register(spark)
    return spark.read.format("vellum_images").option("partitionBytes", partition_bytes).load(path)


def decoded_files(files: DataFrame) -> DataFrame:
    """The same from rows of Spark's binaryFile source (path, content), for folders that only Spark reads."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from cell_batches(posixpath.basename(path), content or b"")

    return files.select("path", "content").mapInArrow(kernel, "img string, r int, c int, v int")


def encoded_images(cells: DataFrame, colour: bool = False, background: int = 0) -> DataFrame:
    """(img, content): PNG of each image from its cells (img, r, c, v) or, in colour, (img, r, c, red, green, blue).

    Cells that aren't there are background; values are cut to 0 to 255; of cells given twice the greatest counts. An image is as large
    as its last row and column. One image is one task's work at a time, as its file is.
    """
    values = ("red", "green", "blue") if colour else ("v",)

    def run(table: pa.Table) -> pa.Table:
        r, c = (table.column(x).to_numpy() for x in ("r", "c"))
        pixels = np.full((int(r.max()) + 1, int(c.max()) + 1, len(values)), background, np.uint8)
        pixels[r, c] = 0
        for k, x in enumerate(values):
            np.maximum.at(pixels, (r, c, k), np.clip(table.column(x).to_numpy(), 0, 255).astype(np.uint8))
        return pa.table({"img": table.column("img")[:1], "content": pa.array([encoded(pixels)], pa.binary())})

    own = cells.select("img", *(F.col(x).cast("int").alias(x) for x in ("r", "c", *values))).where("r >= 0 and c >= 0")
    return own.na.drop().groupBy("img").applyInArrow(run, "img string, content binary")


def write_images(images: DataFrame, path: str) -> None:
    """Write rows (img, content) as files <path>/<img>."""
    register(images.sparkSession)
    images.select("img", "content").write.format("vellum_images").mode("append").save(path)
