"""Relations between files: repeated serials, places near each other, orders of dates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.components import components
from gleanery.shared import written

# Serials that say nothing; the earth's radius in metres.
NO_SERIAL = ["", "unknown", "none", "n/a", "0"]
EARTH = 6_371_000.0
DATE = r"^(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(Z|[+-]\d{2}:\d{2})?$"


def repeated_serials(signals: DataFrame, *, most_bytes: int = 512) -> DataFrame:
    """Serials that two files or more carry, with the files' indexes in order."""
    s = F.trim("serial")
    said = signals.where(s.isNotNull() & ~F.lower(s).isin(*NO_SERIAL) & (F.octet_length(s) <= most_bytes))
    return said.groupBy(s.alias("serial")).agg(F.array_sort(F.collect_list("index")).alias("indexes")).where(F.size("indexes") > 1)


def on_sphere(lat: Column, lon: Column) -> list[Column]:
    a, o = F.radians(lat), F.radians(lon)
    return [EARTH * F.cos(a) * F.cos(o), EARTH * F.cos(a) * F.sin(o), EARTH * F.sin(a)]


def located(signals: DataFrame) -> DataFrame:
    """Signals with a place on earth, as x, y, z in metres."""
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return signals.where(ok).select("index", *[c.alias(n) for c, n in zip(on_sphere(F.col("lat"), F.col("lon")), "xyz")])


def near_pairs(points: DataFrame, within: float) -> DataFrame:
    """Pairs (a, b, distance), a < b, of points no further apart than ``within``.

    One side goes to its own cell of a cubic grid, the other to the 27 around its own, so the join is
    an equi-join on cells and every near pair meets once.
    """
    cell = lambda d: [F.floor(F.col(c) / within + d[i]).cast("long").alias(f"c{c}") for i, c in enumerate("xyz")]
    a = points.select(F.col("index").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *cell((0, 0, 0)))
    around = F.array(*[F.struct(*[F.lit(i).alias(n) for i, n in zip((i, j, k), "ijk")]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    b = points.withColumn("d", F.explode(around)).select(
        F.col("index").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"],
        *[(F.floor(F.col(c) / within) + F.col(f"d.{n}")).cast("long").alias(f"c{c}") for c, n in zip("xyz", "ijk")],
    )
    far = F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"), F.lit(0.0)))
    return a.join(b, ["cx", "cy", "cz"]).where("a < b").select("a", "b", far.alias("distance")).where(F.col("distance") <= within)


def serial_members(signals: DataFrame, *, most_bytes: int = 512) -> DataFrame:
    """``serial``, ``index``, ``n`` of the files that share a serial with others: a row a file, so a serial that very many carry is no
    row of its own size."""
    s = F.trim("serial")
    said = signals.where(s.isNotNull() & ~F.lower(s).isin(*NO_SERIAL) & (F.octet_length(s) <= most_bytes)).select(s.alias("serial"), "index")
    shared = said.groupBy(F.col("serial").alias("of")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return said.join(shared, F.col("serial") == F.col("of")).drop("of")


def greedy_clusters(points: DataFrame, within: float) -> DataFrame:
    """``index``, ``first``: in order of index, a point joins the lowest group whose first point is within
    reach, else begins one. The greedy pass runs inside each connected component of near pairs, which are found by contraction, in a
    number of rounds that grows with the logarithm of a component."""
    pairs = written(near_pairs(points, within).select("a", "b"), "near")
    at = components(pairs)
    labels = points.select(F.col("index").alias("a")).join(at.select(F.col("id").alias("a"), F.col("component").alias("c")), "a", "left").withColumn("c", F.coalesce("c", "a"))
    near = pairs.groupBy(F.col("b").alias("a")).agg(F.array_sort(F.collect_list(F.col("a"))).alias("near"))
    alone = labels.where("a = c").join(at.select(F.col("id").alias("a")), "a", "left_anti").select(F.col("a").alias("index"), F.col("a").alias("first"))
    rows = labels.join(at.select(F.col("id").alias("a")), "a", "left_semi").join(near, "a", "left")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        firsts: set[int] = set()
        out = []
        for r in pdf.sort_values("a").itertuples():
            mine = next((int(b) for b in (r.near if r.near is not None else []) if b in firsts), None)
            if mine is None:
                firsts.add(int(r.a))
            out.append((int(r.a), int(r.a) if mine is None else mine))
        return pd.DataFrame(out, columns=["index", "first"])

    return rows.groupBy("c").applyInPandas(greedy, "index long, first long").unionByName(alone)


def parsed_date(text: Column) -> list[Column]:
    """Strict reading of ``YYYY:MM:DD hh:mm:ss`` with or without zone: ``seconds`` and ``zoned``; null for no date.

    A date without zone is a wall clock's; its seconds only compare with those of its like.
    """
    part = lambda i: F.regexp_extract(text, DATE, i)
    iso = F.concat_ws("", part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), part(4), F.lit(":"), part(5), F.lit(":"), part(6))
    real = F.try_to_timestamp(F.concat(iso, F.when((part(7) == "") | (part(7) == "Z"), "+00:00").otherwise(part(7))))
    ok = text.rlike(DATE)
    return [F.when(ok, F.unix_seconds(real)).alias("seconds"), F.when(ok & real.isNotNull(), part(7) != "").alias("zoned")]


def date_orders(signals: DataFrame, group: list[str], index: str, taken: str) -> DataFrame:
    """For each group the indexes in order of time, zoned dates and wall clocks apart."""
    seconds, zoned = parsed_date(F.col(taken))
    rows = signals.select(*group, F.col(index).alias("i"), seconds, zoned).where("seconds is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seconds", "i"))), lambda x: x["i"])
    return rows.groupBy(*group, "zoned").agg(ordered.alias("indexes"))
