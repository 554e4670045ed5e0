"""Line dedup: lines that many documents share are dropped from all of them.

Lines are exploded, normalised and hashed; the documents of each hash are counted; lines whose
count reaches the threshold go, the others are put together again by position. Built from
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import BLANKS, BROADCAST_ROWS, ascii_lower, written

#: Ways that a hash is dealt when the frequent lines are too many to broadcast.
SALTS = 16


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: ends stripped of ASCII blanks, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))


def line_dedup(
    docs: DataFrame,
    *,
    min_docs: int = 10,
    min_key_chars: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """All columns of ``docs`` with ``text_col`` cleaned, plus ``n_lines`` and ``n_dropped``.

    Each row is a document of its own, so repeated rows count as often as they stand there. A null
    or empty text is one empty line and comes back empty. Keys shorter than ``min_key_chars`` code
    points never count and are never dropped. Keys meet as 128-bit hashes. Other columns pass
    through whatever their names, except that ``n_lines`` and ``n_dropped`` are replaced; a null id
    is an id like any other. A line counts once in a document however often it stands there, and at
    exactly ``min_docs`` documents it goes. Texts of any length are taken whole. An empty table gives none.
    """
    at = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_of"),
        line_keys(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_keys"),
    )
    hashed = lambda k: F.when(F.char_length(k) >= min_key_chars, F.md5(k))
    counted = (
        at.select(F.explode(F.array_distinct(F.transform("_keys", hashed))).alias("_line"))
        .where(F.col("_line").isNotNull())
        .groupBy(F.unhex("_line").alias("_line"))
        .agg(F.count(F.lit(1)).alias("_docs"))
        .where(F.col("_docs") >= min_docs)
        .select("_line")
    )
    frequent = written(counted, "lines")
    lines = at.select("_id", "_of", F.posexplode("_keys").alias("_pos", "_key")).where(
        F.char_length("_key") >= min_key_chars
    ).select("_id", "_of", "_pos", F.unhex(F.md5("_key")).alias("_line"))
    if frequent.limit(broadcast_rows + 1).count() <= broadcast_rows:
        found = lines.join(F.broadcast(frequent), "_line")
    else:
        salted = frequent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = lines.withColumn("_salt", F.pmod(F.xxhash64("_id", "_pos"), F.lit(SALTS)).cast("int")).join(
            salted, ["_line", "_salt"]
        )
    drops = found.groupBy("_id", "_of").agg(F.array_sort(F.collect_set("_pos")).alias("_drop"))
    return _without(docs, drops, id_col, text_col)


def _without(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The lines that are left, by position. A byte for each line up to the last drop marks the drops."""
    marks = F.transform(
        "_drop",
        lambda p, i: F.concat(
            F.repeat(F.lit("0"), (p - F.when(i == 0, -1).otherwise(F.try_element_at("_drop", i)) - 1).cast("int")),
            F.lit("1"),
        ),
    )
    marked = drops.select(
        F.col("_id").alias("drop_id"),
        F.col("_of").alias("drop_of"),
        F.size("_drop").cast("long").alias("n_drop"),
        F.array_join(marks, "").cast("binary").alias("marks"),
    )
    # the caller's columns go by their place, so no name can clash
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in place.items()])
    text = F.coalesce(F.col(place[text_col]), F.lit(""))
    joined = named.withColumn("of", F.md5(text)).join(
        marked, F.col(place[id_col]).eqNullSafe(F.col("drop_id")) & (F.col("of") == F.col("drop_of")), "left"
    )
    lines = F.split(text, "\n", -1)
    left = F.filter(
        lines,
        lambda x, i: F.coalesce(F.substring("marks", i + 1, F.lit(1)), F.lit(b"")) != F.lit(b"1"),
    )
    kept = F.when(F.col("n_drop").isNull(), text).otherwise(F.array_join(left, "\n"))
    names = [kept.alias(c) if c == text_col else F.col(p).alias(c) for c, p in place.items() if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *names, F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_drop", F.lit(0).cast("long")).alias("n_dropped")
    )
