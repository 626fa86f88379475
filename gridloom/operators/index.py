"""Index algebra: slicing, reshaping, padding, concatenation. Projections and filters on index columns."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..frame import ArrayFrame, key_type, normalise_dims, ravel, unravel

D = F.col


def _project(a: ArrayFrame, dims, index: dict, where=None, df=None) -> ArrayFrame:
    """New index expressions by dimension; trivial dims lose their column."""
    df = df if df is not None else a.df
    df = df if where is None else df.where(where)
    cols = [index.get(k, D(f"d{k}") if a.dims[k] > 1 else F.lit(0)).cast(key_type(d)).alias(f"d{k}") for k, d in enumerate(dims) if d > 1]
    return ArrayFrame(df.select(*cols, "re", "im"), tuple(dims))


def _at(a: ArrayFrame, k: int):
    return D(f"d{k}") if a.dims[k] > 1 else F.lit(0)


def slice_(a, **positions: int):
    """Fix indices, d<k>=position; those dimensions become 1."""
    cond = F.lit(True)
    for name, p in positions.items():
        if not 0 <= p < a.dims[int(name[1:])]:
            raise ValueError(f"{name}={p} is outside")
        cond = cond & (_at(a, int(name[1:])) == p)
    return _project(a, a.replace_dims(**dict.fromkeys(positions, 1)), {}, cond)


def extract(a, dim: int, start: int, end: int):
    """[start, end) along a dimension."""
    if not 0 <= start < end <= a.dims[dim]:
        raise ValueError("bounds outside the array")
    return _project(a, a.replace_dims(**{f"d{dim}": end - start}), {dim: _at(a, dim) - start}, (_at(a, dim) >= start) & (_at(a, dim) < end))


def flip(a, flags: int):
    return _project(a, a.dims, {k: a.dims[k] - 1 - D(f"d{k}") for k in a.selected(flags)})


def circshift(a, dim: int, shift: int):
    return _project(a, a.dims, {dim: F.pmod(D(f"d{dim}") + shift, F.lit(a.dims[dim]))}) if a.dims[dim] > 1 else a


def fftshift(a, flags: int, inverse: bool = False):
    for k in a.selected(flags):
        a = circshift(a, k, (a.dims[k] + 1) // 2 if inverse else a.dims[k] // 2)
    return a


def transpose(a, i: int, j: int):
    dims = list(a.dims)
    dims[i], dims[j] = dims[j], dims[i]
    return _project(a, dims, {i: _at(a, j), j: _at(a, i)})


def permute(a, order):
    """Dimension k of the result is dimension order[k]."""
    if sorted(order) != list(range(len(order))):
        raise ValueError("an order of dimensions is needed")
    order = [*order, *range(len(order), len(a.dims))]
    return _project(a, [a.dims[j] for j in order], {k: _at(a, j) for k, j in enumerate(order)})


def swap_halves(a, dim: int):
    """The halves of an even dimension change places."""
    if a.dims[dim] % 2:
        raise ValueError("an even size is needed")
    return circshift(a, dim, a.dims[dim] // 2)


#: How cells beyond the ends are made: index of the cell that stands there, from the place and the size.
PADDINGS = {
    "cyclic": lambda i, n: F.pmod(i, F.lit(n)),
    "symmetric": lambda i, n: F.least(F.pmod(i, F.lit(2 * n)), 2 * n - 1 - F.pmod(i, F.lit(2 * n))),
    "reflect": lambda i, n: F.least(F.pmod(i, F.lit(max(1, 2 * n - 2))), 2 * n - 2 - F.pmod(i, F.lit(max(1, 2 * n - 2)))) if n > 1 else F.lit(0),
}


def pad(a, dim: int, before: int, after: int, kind: str = "zero"):
    """Cells before and after a dimension: zeros ("valid" cuts them off instead), or cyclic, symmetric or reflected copies; "causal" and "same" are zeros before only or evenly."""
    n = a.dims[dim]
    if kind == "valid":
        return extract(a, dim, before, n - after)
    if kind == "causal":
        before, after = before + after, 0
    elif kind == "same":
        before, after = (before + after) // 2, (before + after + 1) // 2
    size = n + before + after
    dims = a.replace_dims(**{f"d{dim}": size})
    if kind in ("zero", "causal", "same"):
        return _project(a, dims, {dim: _at(a, dim) + before})
    if kind not in PADDINGS:
        raise ValueError(f"unknown padding {kind}")
    places = a.spark.range(size).select(F.col("id").cast("int").alias("to"), PADDINGS[kind](F.col("id").cast("int") - before, n).cast("int").alias("at"))
    df = a.df.withColumn("at", _at(a, dim).cast("int")).join(F.broadcast(places) if size <= 1 << 16 else places, "at")
    return _project(a, dims, {dim: D("to")}, df=df)


def reshape(a, flags: int, sizes):
    """Column-major ravel over the flagged dimensions, then the given sizes for them."""
    own = [k for k in range(len(a.dims)) if flags >> k & 1]
    if math.prod(sizes) != math.prod(a.dims[k] for k in own) or len(sizes) != len(own):
        raise ValueError("sizes must keep the number of cells")
    lin = ravel([a.dims[k] for k in own], [f"d{k}" for k in own])
    dims = list(a.dims)
    new = unravel(lin, sizes)
    for k, s in zip(own, sizes, strict=True):
        dims[k] = s
    return _project(a, dims, {own[i]: c for i, c in new.items()})


def flatten(a):
    return _project(a, normalise_dims([a.size]), {0: ravel(a.dims)})


def squeeze(a):
    own = [k for k, d in enumerate(a.dims) if d > 1] or [0]
    return _project(a, normalise_dims([a.dims[k] for k in own]), {i: _at(a, k) for i, k in enumerate(own)})


def resize(a, where: str = "end", **sizes: int):
    """Truncate or pad with zeros (absent rows) at the end, the front, or around the centre."""
    index, cond = {}, F.lit(True)
    for name, o in sizes.items():
        k = int(name[1:])
        i = a.dims[k]
        shift = {"end": 0, "front": o - i, "centre": abs(o // 2 - i // 2) * (1 if o >= i else -1)}[where]
        new = _at(a, k) + shift
        index[k] = new
        cond = cond & (new >= 0) & (new < o)
    return _project(a, a.replace_dims(**sizes), index, cond)


def crop(a, dim: int, size: int):
    return resize(a, "centre", **{f"d{dim}": size})


def repmat(a, dim: int, times: int):
    if a.dims[dim] != 1:
        raise ValueError("only a dimension of size 1 can be repeated")
    if times == 1:
        return a
    df = a.df.withColumn(f"d{dim}", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return _project(a, a.replace_dims(**{f"d{dim}": times}), {dim: D(f"d{dim}")}, df=df)


def join(dim: int, *arrays: ArrayFrame) -> ArrayFrame:
    """Concatenation along a dimension."""
    total = sum(a.dims[dim] for a in arrays)
    dims = arrays[0].replace_dims(**{f"d{dim}": total})
    out, at = None, 0
    for a in arrays:
        if a.replace_dims(**{f"d{dim}": 1}) != arrays[0].replace_dims(**{f"d{dim}": 1}):
            raise ValueError("sizes differ beside the joined dimension")
        part = _project(a, dims, {dim: _at(a, dim) + at}).df
        out = part if out is None else out.unionByName(part)
        at += a.dims[dim]
    return ArrayFrame(out, dims)


def casorati(a, **kernel: int):
    """Rows (dim 0) are window positions, columns (dim 1) the places in the window, both column-major."""
    own = [int(n[1:]) for n in kernel]
    if any(a.dims[k] > 1 and k not in own for k in range(len(a.dims))):
        raise ValueError("every non-trivial dimension needs a kernel size")
    ker = [kernel[f"d{k}"] for k in own]
    pos = [a.dims[k] - kk + 1 for k, kk in zip(own, ker, strict=True)]
    df = a.df
    for k, kk in zip(own, ker, strict=True):  # each cell belongs to a bounded number of windows
        df = df.withColumn(f"w{k}", F.explode(F.sequence(F.lit(0), F.lit(kk - 1))))
    row, col, s, t, cond = F.lit(0).cast("long"), F.lit(0).cast("long"), 1, 1, F.lit(True)
    for k, kk, p in zip(own, ker, pos, strict=True):
        at = _at(a, k) - D(f"w{k}")
        cond = cond & (at >= 0) & (at < p)
        row, col = row + at * s, col + D(f"w{k}") * t
        s, t = s * p, t * kk
    return _project(a, normalise_dims([s, t]), {0: row, 1: col}, cond, df=df)


def compress(a, mask):
    """Cells where the mask is not zero, numbered densely in column-major order."""
    keys = a.keys
    kept = a.df.join(mask.df.where("re <> 0").select(*keys), keys, "left_semi")
    n = mask.df.where("re <> 0").count()
    # the number of a cell: ranks within buckets of the linear index, plus cells in the buckets before
    lin = ravel(a.dims)
    kept = kept.withColumn("lin", lin).withColumn("bucket", F.call_function("div", D("lin"), F.lit(1 << 20)))
    sizes = kept.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("lin")) - 1 + D("before")
    df = kept.join(before, "bucket").select(rank.cast(key_type(n)).alias("d0"), "re", "im")
    return ArrayFrame(df, normalise_dims([max(n, 1)])) if n > 1 else ArrayFrame(df.drop("d0"), normalise_dims([1]))


def decompress(packed, mask):
    """Scatter of a compressed array to the places of a mask; zero elsewhere."""
    ones = ArrayFrame(mask.df.where("re <> 0"), mask.dims)
    keys = ones.keys
    places = compress(ArrayFrame(ones.df.select(*keys, ravel(mask.dims).cast("double").alias("re"), F.lit(0.0).alias("im")), mask.dims), mask)
    at = places.df.withColumn("lin", D("re").cast("long")).drop("re", "im")
    df = at.join(packed.df, packed.keys) if packed.keys else at.crossJoin(packed.df)
    cols = [c.alias(f"d{k}") for k, c in unravel(D("lin"), mask.dims).items()]
    return ArrayFrame(df.select(*cols, "re", "im"), mask.dims)


def casorati_adjoint(m, dims, **kernel: int):
    """The adjoint of casorati: every cell of the matrix is added back to the place it was read from."""
    dims = normalise_dims(dims)
    own = [int(n[1:]) for n in kernel]
    ker = [kernel[f"d{k}"] for k in own]
    pos = [dims[k] - kk + 1 for k, kk in zip(own, ker, strict=True)]
    row, col = unravel(_at(m, 0).cast("long"), pos), unravel(_at(m, 1).cast("long"), ker)
    places = {k: row.get(i, F.lit(0)) + col.get(i, F.lit(0)) for i, k in enumerate(own)}
    out = _project(m, dims, places)
    return ArrayFrame(out.df.groupBy(*out.keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im")), dims)


def calmat(a, sizes, **kernel: int):
    """Calibration matrix: the Casorati matrix of the centre region of a, channels (dim 3) side by side as columns."""
    for k, s in enumerate(sizes):
        a = crop(a, k, min(s, a.dims[k])) if s else a
    if a.dims[3] == 1:
        return casorati(a, **kernel)
    parts = [casorati(slice_(a, d3=c), **kernel) for c in range(a.dims[3])]
    return join(1, *parts)


def fill_diagonal(a, flags: int, value: complex = 1.0):
    """The array with a value where all flagged indices are equal."""
    from .generate import delta, ones

    own = a.selected(flags)
    n = min(a.dims[k] for k in own)
    line = delta(a.spark, len(a.dims), flags, n)
    rest = [k for k in range(len(a.dims)) if a.dims[k] > 1 and k not in own]
    cells = line.df.select(*line.keys)
    if rest:
        others = ones(a.spark, [a.dims[k] if k in rest else 1 for k in range(len(a.dims))])
        cells = cells.crossJoin(others.df.select(*others.keys))
    cells = ArrayFrame.of(cells.withColumns({"re": F.lit(complex(value).real), "im": F.lit(complex(value).imag)}), a.dims)
    return ArrayFrame(a.df.join(cells.df.select(*a.keys), a.keys, "left_anti").unionByName(cells.df), a.dims)


def compare(a, b) -> bool:
    """Whether two arrays are equal cell by cell; absent cells are zeros."""
    if a.dims != b.dims:
        return False
    both = a.df.withColumn("s", F.lit(1.0)).unionByName(b.df.withColumn("s", F.lit(-1.0)))
    differ = both.groupBy(*a.keys).agg(F.sum(D("re") * D("s")).alias("re"), F.sum(D("im") * D("s")).alias("im")).where("re <> 0 or im <> 0")
    return differ.isEmpty()


def shuffle_blocks(a, dim: int, parts: int, adjoint: bool = False):
    """Every parts-th cell along a dimension comes together: the index i goes to (i mod parts) * size / parts + i div parts."""
    n = a.dims[dim]
    if n % parts:
        raise ValueError("the size must be a multiple of the number of parts")
    i, inner = _at(a, dim), parts if not adjoint else n // parts
    return _project(a, a.dims, {dim: F.pmod(i, F.lit(inner)) * (n // inner) + F.call_function("div", i, F.lit(inner))})


def decompose(a, dim: int, parts: int, new_dim: int):
    """A dimension as parts interleaved ones: the index i goes to (i div parts, i mod parts) of dim and new_dim."""
    n = a.dims[dim]
    if n % parts or a.dims[new_dim] != 1:
        raise ValueError("a multiple of the number of parts and a new dimension of size 1 are needed")
    i = _at(a, dim)
    return _project(a, a.replace_dims(**{f"d{dim}": n // parts, f"d{new_dim}": parts}), {dim: F.call_function("div", i, F.lit(parts)), new_dim: F.pmod(i, F.lit(parts))})


def mask_compress(a):
    """A mask as words of 32 cells: (word, bits), words of zeros left out."""
    lin = ravel(a.dims)
    words = a.df.where("re <> 0 or im <> 0").select(F.call_function("div", lin, F.lit(32)).alias("word"), F.pmod(lin, F.lit(32)).cast("int").alias("bit"))
    return words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"))


def mask_decompress(words, dims):
    """The mask (ones) that mask_compress packed."""
    dims = normalise_dims(dims)
    bits = words.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit")).where("(shiftright(bits, bit) & 1) = 1")
    lin = D("word") * 32 + D("bit")
    return ArrayFrame.of(bits.select(*(c.alias(f"d{k}") for k, c in unravel(lin, dims).items()), F.lit(1.0).alias("re"), F.lit(0.0).alias("im")), dims)


def copy_into(target, source, **position: int):
    """The target with a block overwritten: cells outside the block by an anti-join, then a union."""
    index, cond = {}, F.lit(True)
    for k in range(len(target.dims)):
        p = position.get(f"d{k}", 0)
        if target.dims[k] > 1:
            index[k] = _at(source, k) + p
            cond = cond & D(f"d{k}").between(p, p + source.dims[k] - 1)
    moved = _project(source, target.dims, index)
    return ArrayFrame(target.df.where(~cond).unionByName(moved.df), target.dims)
