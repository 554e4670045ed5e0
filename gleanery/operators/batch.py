"""Batches of files: what goes in, what is shown, what a clean copy would help."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files of a batch unless more are asked for.
MOST_FILES = 1_000
# Formats of which no copy is made, and those that need a removable block.
NO_COPY = ("unknown", "eml", "msg")
AUDIO = ("mp3", "flac", "ogg", "wav", "rifx", "rf64", "bw64")
SHOWS = ("all", "reveals", "problems", "incomplete", "policy")


def canonical(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts, doubled slashes and a slash at its end."""
    parts = F.filter(F.split(F.regexp_replace(path, r"^file:(//)?", ""), "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def collected(files: DataFrame, output: str | None = None, most: int | None = MOST_FILES) -> DataFrame:
    """Each file of a batch once, by its canonical ``path``, without those under the ``output`` folder.

    More than ``most`` files are an error, not a shorter batch; None lifts the bound.
    """
    rows = files.withColumn("path", canonical(F.col("path")))
    if output:
        at = rows.sparkSession.range(1).select(canonical(F.lit(output)).alias("p")).first()["p"]
        rows = rows.where((F.col("path") != at) & ~F.col("path").startswith(at.rstrip("/") + "/"))
    rows = rows.dropDuplicates(["path"])
    if most is not None and (n := rows.select("path").limit(most + 1).count()) > most:
        raise ValueError(f"a batch has at most {most} files, and here are {n} or more")
    return rows


def cleanable(batch: DataFrame) -> DataFrame:
    """``batch`` (format, state, n_facts, concerns, has_removable) with ``cleanable``: something that a clean copy takes out."""
    done = F.col("state") == "done"
    found = (F.col("n_facts") > 0) | F.array_contains("concerns", "hidden")
    can = F.when(F.col("format").isin(*AUDIO), F.coalesce("has_removable", F.lit(False))).when(F.col("format").isin(*NO_COPY), False).otherwise(found)
    return batch.withColumn("cleanable", F.coalesce(done & can, F.lit(False)))


def shown(batch: DataFrame, show: str = "all", format_: str | None = None) -> DataFrame:
    """Rows of a batch to show: all, or those that reveal, have problems, are incomplete, or that a policy holds back or can't judge."""
    if show not in SHOWS:
        raise ValueError(f"no such view: {show}")
    rule = {
        "all": F.lit(True), "reveals": F.col("n_facts") > 0, "problems": F.col("n_problems") > 0,
        "incomplete": ~F.col("complete"), "policy": F.col("result").isin("blocked", "unchecked"),
    }[show]
    rows = batch.where(rule)
    return rows if format_ is None else rows.where(F.col("format") == format_)
