"""python -m gridloom NAME [key=value ...] INPUT ... OUTPUT: an operator over arrays that are stored as Parquet.

Values are Python literals; `python -m gridloom` alone lists the operators."""

from __future__ import annotations

import ast
import sys

from pyspark.sql import SparkSession

from .frame import ArrayFrame
from .registry import OPERATORS, run
from .sources.arrays import read_parquet, write_parquet

#: Operators that make an array from nothing take the session first.
SOURCES = {"zeros", "ones", "vec", "delta", "index", "poly", "upat", "grid", "traj", "raga", "phantom", "signal", "mandelbrot", "pulse", "bloch", "wavepsf", "pol2mask", "coils", "sim"}


def value(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def main(argv: list[str]) -> int:
    if not argv:
        print("\n".join(sorted(OPERATORS)))
        return 0
    name, *rest = argv
    options = {k: value(v) for k, v in (a.split("=", 1) for a in rest if "=" in a)}
    paths = [a for a in rest if "=" not in a]
    if name not in OPERATORS:
        print(f"unknown operator {name}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    source = name in SOURCES or name.startswith("signal_")
    inputs = paths[:-1] if paths else []
    out = run(name, *([spark] if source else []), *(read_parquet(spark, p) for p in inputs), **options)
    if isinstance(out, ArrayFrame) and paths:
        write_parquet(out, paths[-1])
    else:
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
