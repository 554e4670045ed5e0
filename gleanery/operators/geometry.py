"""Pages: glyphs, fills and marks as boxes; what is covered, hidden, cut or said elsewhere.

Boxes are (left, bottom, right, top) columns ``l, b, r, t``; every join is an equi-join on file, page and, where boxes
meet many others, a band of the page. All of them are sort-merge joins: painted rows pack so well that the size of their files
says nothing of how large they are as a broadcast side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Shares and limits of what counts as covering.
INSIDE, DARK, OPAQUE = 0.5, 0.25, 0.9
PICTURE_INSIDE, PICTURE_OF_PAGE, FILL_OF_PICTURE = 0.9, 0.1, 0.3
LEAST_WIDTH, LEAST_HEIGHT, TINY, OCR_SHARE, WORD_GAP = 8.0, 4.0, 1.0, 0.5, 0.2
PAGE = ["file_id", "page"]


def area(p: str = "") -> Column:
    return (F.col(f"{p}r") - F.col(f"{p}l")) * (F.col(f"{p}t") - F.col(f"{p}b"))


def shared_area(p: str, q: str) -> Column:
    w = F.least(F.col(f"{p}r"), F.col(f"{q}r")) - F.greatest(F.col(f"{p}l"), F.col(f"{q}l"))
    h = F.least(F.col(f"{p}t"), F.col(f"{q}t")) - F.greatest(F.col(f"{p}b"), F.col(f"{q}b"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def merged(side: DataFrame) -> DataFrame:
    """A join's side that is sorted and merged, whatever size the planner takes it for."""
    return side.hint("merge")


def _as(df: DataFrame, p: str) -> DataFrame:
    return df.select(*PAGE, *[F.col(c).alias(p + c) for c in df.columns if c not in PAGE])


#: Height of the bands in which boxes of a page meet, in points.
BAND = 36.0


def _banded(df: DataFrame) -> DataFrame:
    """``df`` once for each band of the page that its boxes reach, so that joins meet within (file, page, band) only."""
    band = lambda c: F.floor(F.col(c) / BAND).cast("long")
    return df.withColumn("band", F.explode(F.sequence(band("b"), F.greatest(band("b"), band("t")))))


def boxes_met(glyphs: DataFrame, boxes: DataFrame, share: float, of: str = "g") -> DataFrame:
    """Pairs of a glyph (columns ``g…``) and a box (``f…``) of one page that share at least ``share`` of the area of one of them.
    A pair counts in the lowest band that both reach, so it comes once."""
    g = _as(_banded(glyphs), "g").withColumnRenamed("gband", "band")
    f = _as(_banded(boxes), "f").withColumnRenamed("fband", "band")
    lowest = F.floor(F.greatest(F.col("gb"), F.col("fb")) / BAND) == F.col("band")
    return g.join(merged(f), [*PAGE, "band"]).where(lowest & (shared_area("g", "f") >= share * area(of))).drop("band")


def covered_glyphs(glyphs: DataFrame, fills: DataFrame) -> DataFrame:
    """Glyphs (file_id, page, ordinal) under a later dark opaque fill, or dark ones over an earlier dark fill.

    Of the earlier fills that hold a glyph only the most recent counts: light paper over a dark box is light.
    """
    met = boxes_met(glyphs, fills.where(F.col("alpha") >= OPAQUE), INSIDE)
    dark = F.col("flightness") <= DARK
    later = met.where((F.col("fordinal") > F.col("gordinal")) & dark)
    last = met.where(F.col("fordinal") < F.col("gordinal")).groupBy(*PAGE, "gordinal", "gdark").agg(F.max_by(dark, "fordinal").alias("on_dark"))
    out = later.select(*PAGE, "gordinal").unionByName(last.where("on_dark and gdark").select(*PAGE, "gordinal"))
    return out.distinct().withColumnRenamed("gordinal", "ordinal")


def marked_glyphs(glyphs: DataFrame, marks: DataFrame) -> DataFrame:
    """Glyphs inside a mark that was never applied, whatever was painted first."""
    return boxes_met(glyphs, marks, INSIDE).select(*PAGE, F.col("gordinal").alias("ordinal")).distinct()


def covered_pictures(pictures: DataFrame, fills: DataFrame, page_area: float) -> DataFrame:
    """Pictures of some size with a dark box over a part of them."""
    f = fills.where((F.col("lightness") <= DARK) & (F.col("alpha") >= OPAQUE) & (F.col("r") - F.col("l") >= LEAST_WIDTH) & (F.col("t") - F.col("b") >= LEAST_HEIGHT))
    met = boxes_met(pictures.where(area() >= PICTURE_OF_PAGE * page_area), f, PICTURE_INSIDE, "f")
    hit = met.where((area("f") <= FILL_OF_PICTURE * area("g")) & (F.col("fordinal") > F.col("gordinal")))
    return hit.select(*PAGE, F.col("gordinal").alias("ordinal")).distinct()


def scanned_pages(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages (file_id, page, with box ``l b r t`` in ``pages``) half of which or more one image covers: invisible text on them
    is what a reader of scans has put there."""
    met = _as(images, "g").join(merged(_as(pages, "f")), PAGE).where(shared_area("g", "f") >= OCR_SHARE * area("f"))
    return met.select(*PAGE).distinct()


def hidden_glyphs(glyphs: DataFrame, fills: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """Glyphs that can't be seen, with the ``reason``: invisible (but not on scanned pages), off page, tiny, or white with nothing
    painted under them."""
    why = glyphs.withColumn("reason", hidden_reason(F.col("mode"), F.col("lightness"), F.col("t") - F.col("b"), F.col("off_page"))).where("reason is not null")
    seen = why.join(merged(scanned_pages(images, pages).withColumn("scanned", F.lit(True))), PAGE, "left").where("reason <> 'invisible' or scanned is null").drop("scanned")
    under = fills.select(*PAGE, "ordinal", *"lbrt").unionByName(images.select(*PAGE, "ordinal", *"lbrt"))
    white = seen.where("reason = 'white'")
    painted = boxes_met(white, under, INSIDE).where("fordinal < gordinal").select(*PAGE, F.col("gordinal").alias("ordinal")).distinct()
    return seen.where("reason <> 'white'").unionByName(white.join(merged(painted), [*PAGE, "ordinal"], "left_anti"))


def link_words(glyphs: DataFrame, links: DataFrame) -> DataFrame:
    """Links (file_id, page, ordinal, href, box) with the ``words`` whose glyphs have their middle in the link, in drawing order."""
    from gleanery.functions.text import host, says_elsewhere

    middle = glyphs.select(*PAGE, "ordinal", "text", *[((F.col(a) + F.col(z)) / 2).alias(c) for c, a, z in (("l", "l", "r"), ("r", "l", "r"), ("b", "b", "t"), ("t", "b", "t"))])
    g = _as(_banded(middle), "g").withColumnRenamed("gband", "band")
    f = _as(_banded(links), "f").withColumnRenamed("fband", "band")
    inside = F.col("gl").between(F.col("fl"), F.col("fr")) & F.col("gb").between(F.col("fb"), F.col("ft"))
    met = g.join(merged(f), [*PAGE, "band"]).where(inside)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gordinal", "gtext"))), lambda x: x["gtext"]), "")
    out = met.groupBy(*PAGE, F.col("fordinal").alias("ordinal"), F.col("fhref").alias("href")).agg(words.alias("words"))
    return out.withColumn("elsewhere", says_elsewhere(F.col("words"), host(F.col("href"))))


def hidden_reason(mode: Column, lightness: Column, size: Column, off_page: Column) -> Column:
    """Why a glyph can't be seen; null if it can."""
    return F.when(mode.isin(3, 7), "invisible").when(off_page, "off page").when(size < TINY, "tiny").when(lightness > 0.95, "white")


def words_of(glyphs: DataFrame) -> DataFrame:
    """Glyphs with the number of their word on the page: a gap wider than a fifth of the height or another line begins one."""
    w = W.partitionBy(*PAGE).orderBy("ordinal")
    new = (F.abs(F.col("b") - F.lag("b").over(w)) > 0.01) | (F.col("l") - F.lag("r").over(w) > WORD_GAP * (F.col("t") - F.col("b")))
    return glyphs.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("word", F.sum("new").over(w)).drop("new")


def hidden_not_cut(glyphs: DataFrame) -> DataFrame:
    """Words that are off the page as a whole; a word with a glyph in sight is only cut."""
    return words_of(glyphs).groupBy(*PAGE, "word").agg(F.bool_and("off_page").alias("off"), F.count(F.lit(1)).alias("n")).where("off").drop("off")


def latest_versions(objects: DataFrame) -> DataFrame:
    """The last definition of each object number."""
    rn = F.row_number().over(W.partitionBy("file_id", "number").orderBy(F.desc("position")))
    return objects.withColumn("rn", rn).where("rn = 1").drop("rn")


def taken_off(earlier: DataFrame, final: DataFrame) -> DataFrame:
    """Texts of an earlier revision that are not on the final page."""
    return earlier.join(merged(final), [*PAGE, "text"], "left_anti").select(*PAGE, "text").distinct()


def last_checkpoint(places: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """For each place the last checkpoint at or before it: one sorted pass over both, no inequality join."""
    both = places.select("stream", F.col("pos"), F.lit(1).alias("kind"), "id").unionByName(
        checkpoints.select("stream", F.col("pos"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"))
    )
    w = W.partitionBy("stream").orderBy("pos", "kind").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("checkpoint", F.max(F.when(F.col("kind") == 0, F.col("pos"))).over(w)).where("kind = 1").select("stream", "id", "pos", "checkpoint")


def glob_pattern(glob: str) -> str:
    """A label pattern in which ``*`` is anything, as a regular expression."""
    import re

    return "(?s)^" + ".*".join(re.escape(x) for x in glob.split("*")) + "$"


def first_label_match(rows: DataFrame, patterns: DataFrame, label: str, most: int = 2_000) -> DataFrame:
    """Rows with the first of the ordered glob ``patterns`` (position, pattern, doc) that their label matches. The patterns are a small
    table and become one ordered CASE; ``most`` or more of them are an error."""
    table = patterns.orderBy("position").limit(most).collect()
    if len(table) >= most:
        raise ValueError(f"a table of patterns has fewer than {most} rows")
    doc = F.lit(None).cast("string")
    for p in reversed(table):
        doc = F.when(F.col(label).rlike(glob_pattern(p["pattern"])), F.lit(p["doc"])).otherwise(doc)
    return rows.withColumn("doc", doc)
