"""Arrays on storage: Parquet with their sizes, and the raw formats (header and data pair, .ra, .coo).

Raw files are split into ranges of bytes; a task reads its range alone. Parquet is the format to work with."""

from __future__ import annotations

import json
import math
import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import ArrayFrame, normalise_dims, ravel, unravel

CHUNK = 1 << 20  # cells that one task reads at a time
_RA_MAGIC = 8746397786917265778


def write_parquet(a: ArrayFrame, path: str, overwrite: bool = True) -> None:
    """Rows, and the sizes as a one-row table beside them; cells that are zero are left out. overwrite=False guards what is there."""
    mode = "overwrite" if overwrite else "error"
    a.sparsify().df.write.mode(mode).parquet(f"{path}/cells")
    a.spark.createDataFrame([(json.dumps(a.dims),)], "dims string").coalesce(1).write.mode(mode).parquet(f"{path}/dims")


def write_many(arrays: dict[str, ArrayFrame], path: str, overwrite: bool = True) -> None:
    """Several arrays in one folder, by name."""
    for name, a in arrays.items():
        write_parquet(a, f"{path}/{name}", overwrite)


def read_many(spark: SparkSession, path: str, names: list[str]) -> dict[str, ArrayFrame]:
    return {n: read_parquet(spark, f"{path}/{n}") for n in names}


def read_parquet(spark: SparkSession, path: str) -> ArrayFrame:
    dims = normalise_dims(json.loads(spark.read.parquet(f"{path}/dims").first()[0]))
    return ArrayFrame.of(spark.read.parquet(f"{path}/cells"), dims)


def _cells(batches, path, offset, n):
    data = np.memmap(path, np.complex64, "r", offset, (n,))
    for b in batches:
        for start in b.column(0).to_pylist():
            x = np.asarray(data[start : start + CHUNK])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(x))), pa.array(x.real.astype(float)), pa.array(x.imag.astype(float))], names=["lin", "re", "im"])


def _read(spark, path, offset, dims) -> ArrayFrame:
    n = math.prod(dims)
    starts = spark.range(0, n, CHUNK, max(1, min(1024, n // CHUNK)))
    df = starts.mapInArrow(partial(_cells, path=path, offset=offset, n=n), "lin long, re double, im double")
    return ArrayFrame.of(df.select(*(c.alias(f"d{k}") for k, c in unravel(F.col("lin"), dims).items()), "re", "im"), dims)


def read_raw(spark: SparkSession, path: str) -> ArrayFrame:
    """By suffix: .ra, .coo, else <path>.hdr and <path>.cfl. The file must be readable on every worker."""
    if path.endswith(".ra"):
        head = np.fromfile(path, "<u8", 6)
        if head[0] != _RA_MAGIC or head[2] != 4 or head[3] != 8:
            raise ValueError("not a raw array of complex floats")
        dims = np.fromfile(path, "<u8", int(head[5]), offset=48)
        return _read(spark, path, 48 + 8 * len(dims), normalise_dims(dims))
    if path.endswith(".coo"):
        with open(path, "rb") as f:
            text = f.read(4096).split(b"\0")[0].decode()
        dims = [int(w) for w in text.split() if w.isdigit()]
        dims = dims[1:] if len(dims) and len(dims) == int(dims[0]) + 1 else dims
        if dims[0] != 2:
            raise ValueError("the first dimension must be 2")
        return _read(spark, path, 4096, normalise_dims(dims[1:]))
    lines = open(f"{path}.hdr").read().splitlines()
    dims = next(lines[i + 1] for i, x in enumerate(lines) if x.strip() == "# Dimensions")
    return _read(spark, f"{path}.cfl", 0, normalise_dims(int(d) for d in dims.split()))


def write_raw(a: ArrayFrame, path: str) -> None:
    """Header and data pair, or .ra; rows come to the driver in order, a partition at a time, and zeros between them are gaps of the file."""
    rows = a.df.groupBy(ravel(a.dims).alias("lin")).agg(F.sum("re").alias("re"), F.sum("im").alias("im")).orderBy("lin")
    single = path.endswith(".ra")
    with open(path if single else f"{path}.cfl", "wb") as f:
        if single:
            np.array([_RA_MAGIC, 0, 4, 8, 8 * a.size, len(a.dims), *a.dims], "<u8").tofile(f)
        begin, held, start = f.tell(), [], 0

        def flush():
            f.seek(begin + 8 * start)
            f.write(np.array(held, np.complex64).tobytes())

        for r in rows.toLocalIterator(prefetchPartitions=True):
            if held and (r.lin != start + len(held) or len(held) >= CHUNK):
                flush()
                held = []
            if not held:
                start = r.lin
            held.append(complex(r.re, r.im))
        if held:
            flush()
        f.truncate(begin + 8 * a.size)
    if not single:
        with open(f"{path}.hdr", "w") as f:
            f.write("# Dimensions\n" + " ".join(map(str, a.dims)) + "\n")


def show(a: ArrayFrame, rows: int = 1000, separator: str = "\t", form: str = "{:+.6e}{:+.6e}i") -> str:
    """Values in index order as text, a line for each index beyond dimension 0; for arrays of at most so many cells."""
    if a.size > rows * max(1, a.dims[0]):
        raise ValueError("the array is too large to be shown; extract a part")
    got = {r.lin: (r.re, r.im) for r in a.df.select(ravel(a.dims).alias("lin"), "re", "im").collect()}
    values = [form.format(*got.get(i, (0.0, 0.0))) for i in range(a.size)]
    n = a.dims[0]
    return "\n".join(separator.join(values[i : i + n]) for i in range(0, a.size, n))


def _png(pixels: np.ndarray) -> bytes:
    """An 8-bit grey image (rows x columns)."""
    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = pixels.shape
    lines = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels, np.uint8))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def toimg(a: ArrayFrame, top: float | None = None, gamma: float = 1.0):
    """(index columns beyond dims 0 and 1, png): every slice's magnitudes as an image, dim 0 down; white is `top`, or the slice's largest."""
    from ..operators.kernels import BLOCK_CELLS, by

    if a.dims[0] * a.dims[1] > BLOCK_CELLS:
        raise ValueError("slices are too large for images")
    rest, shape = a.complement(3), (a.dims[0], a.dims[1])

    def run(key, t):
        import pandas as pd

        x = np.zeros(shape)
        at = tuple(t[f"d{k}"].to_numpy() if shape[k] > 1 else np.zeros(len(t), int) for k in (0, 1))
        x[at] = np.hypot(t["re"], t["im"])
        white = top or x.max() or 1.0
        png = _png(np.floor(np.clip(x / white, 0, 1) ** gamma * 255 + 0.5))
        return pd.DataFrame({c: [key[i]] for i, c in enumerate(rest)} | {"png": [png]})

    return by(a.df, rest).applyInPandas(run, ", ".join([*(f"{c} int" for c in rest), "png binary"]))


def read_stl(spark: SparkSession, path: str):
    """(triangle, corner, x, y, z) of binary surface meshes."""
    def triangles(data: bytes):
        n = int.from_bytes(data[80:84], "little")
        raw = np.frombuffer(data, np.dtype([("v", "<f4", (4, 3)), ("a", "<u2")]), n, 84)["v"][:, 1:]
        return [(i, c, *map(float, raw[i, c])) for i in range(n) for c in range(3)]

    def run(batches):
        import pandas as pd

        for p in batches:
            for data in p["content"]:
                yield pd.DataFrame(triangles(bytes(data)), columns=["triangle", "corner", "x", "y", "z"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "triangle long, corner int, x double, y double, z double")
