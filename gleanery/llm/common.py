"""What the operators share: the shared scratch folder, written tables, checked broadcasts."""

from __future__ import annotations

import os
import pickle

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.shared import dropped, shared_dir, written

__all__ = ["BLANKS", "BROADCAST_ROWS", "apart", "ascii_lower", "dropped", "placed", "shared_dir", "table", "written"]

#: Rows up to which a written table is broadcast; those tables have a few numbers a row.
BROADCAST_ROWS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def placed(df: DataFrame, names: list[str]) -> tuple[list[Column], list[Column]]:
    """Columns of ``df`` by their place (c0, c1, ...), so that no name can clash with an operator's own, and the way back."""
    there = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    return there, [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]


def apart(f, *args):
    """``f(*args)`` in a process of its own, which gives all its memory back when it ends; Python workers outlive their stages."""
    read, write = os.pipe()
    pid = os.fork()
    if not pid:
        code = 1
        try:
            os.close(read)
            with os.fdopen(write, "wb") as to:
                pickle.dump(f(*args), to)
            code = 0
        finally:
            os._exit(code)
    os.close(write)
    with os.fdopen(read, "rb") as from_:
        data = from_.read()
    _, status = os.waitpid(pid, 0)
    if status:
        raise RuntimeError(f"a process of a task ended with {status}")
    return pickle.loads(data)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
