"""Visits: which count, what they add, and questions over the totals and the messages people leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a visit's fields may hold, the clients that are no people, the start that "new" is counted from.
PERIODS = ("day", "month", "new")
DEVICES = ("phone", "tablet", "computer")
LANGS = ("uk", "en")
ROBOTS = r"(?i)bot|crawl|spider|slurp|headless|lighthouse|preview|externalhit|curl|wget|python|go-http|java/"
EVER = "2026-01-01 00:00:00"
NO_COUNTRY = ("XX", "T1")
SITE_NAME = 100
_LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


def visit_country(code: Column) -> Column:
    """Two capitals, or ``unknown``."""
    return F.when(code.rlike("^[A-Z]{2}$") & ~code.isin(*NO_COUNTRY), code).otherwise("unknown")


def visit_page(path: Column) -> Column:
    """A page's address without its ending or ``index``; ``other`` for what no page has, null for none."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), "/index$", "/")
    return F.when(F.coalesce(path, F.lit("")) != "", F.when(bare.rlike("^/[a-z0-9-]{0,64}$"), bare).otherwise("other"))


def visit_from(host: Column, own: list[str]) -> Column:
    """The site a visit came from, by name; null for none and for one's ``own``, ``other`` for what is no name."""
    name = F.regexp_replace(F.lower(F.trim(host)), r"^www\.", "")
    mine = F.lit(False)
    for h in own:
        mine = mine | (name == h) | name.endswith("." + h)
    site = (F.char_length(name) <= SITE_NAME) & name.rlike(rf"^{_LABEL}(?:\.{_LABEL})+$")
    return F.when((F.coalesce(name, F.lit("")) != "") & ~mine, F.when(site, name).otherwise("other"))


def one_of(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(value.isin(*allowed), value)


def period_start(period: Column, now: Column) -> Column:
    return F.when(period == "day", F.date_trunc("day", now)).when(period == "month", F.date_trunc("month", now)).otherwise(F.lit(EVER).cast("timestamp_ntz"))


def counted_rows(visits: DataFrame, own: list[str]) -> DataFrame:
    """``visit_id``, ``period``, ``metric``, ``value``: what each of ``visits`` adds one to.

    ``visits``: visit_id, period, now, seen_before (the start of the period of an earlier answer, or null), agent, site
    (where the request came from, as the browser says), country, page, device, lang, came_from. Repeats within a period, robots and
    requests from other sites add nothing; null fields are left out.
    """
    start = period_start(F.col("period"), F.col("now"))
    fresh = ~F.coalesce(F.col("seen_before") >= start, F.lit(False))
    person = ~F.coalesce(F.col("agent"), F.lit("")).rlike(ROBOTS) & F.coalesce(F.col("site") == "same-origin", F.lit(True))
    day, month = F.date_format("now", "yyyy-MM-dd"), F.date_format("now", "yyyy-MM")
    row = lambda p, m, v: F.struct(p.alias("period"), F.lit(m).alias("metric"), v.alias("value"))
    told = {
        "country": visit_country(F.coalesce("country", F.lit(""))), "from": visit_from(F.col("came_from"), own), "page": visit_page(F.col("page")),
        "device": one_of(F.col("device"), DEVICES), "lang": one_of(F.col("lang"), LANGS),
    }
    rows = (
        F.when(F.col("period") == "month", F.array(row(month, "people", F.lit(""))))
        .when(F.col("period") == "new", F.array(row(day, "new", F.lit(""))))
        .when(F.col("period") == "day", F.filter(F.array(row(day, "people", F.lit("")), *[row(day, m, v) for m, v in told.items()]), lambda r: r["value"].isNotNull()))
    )
    return visits.where(fresh & person).select("visit_id", F.explode(rows).alias("r")).select("visit_id", "r.period", "r.metric", "r.value")


def counts_since(counts: DataFrame, since: str) -> DataFrame:
    """Totals of days from ``since`` (a date) on, and of months from its month on."""
    return counts.where((F.length("period") > 7) & (F.col("period") >= since) | (F.length("period") == 7) & (F.col("period") >= since[:7]))


def open_messages(feedback: DataFrame, everything: bool = False, most: int = 100) -> DataFrame:
    """The newest messages not yet done (or of all), at most ``most``: a report by its nature."""
    rows = feedback if everything else feedback.where("done = 0")
    return rows.orderBy(F.desc("id")).limit(most)


def marked_done(feedback: DataFrame, ids: list[int]) -> DataFrame:
    """The messages with those of ``ids`` done."""
    return feedback.withColumn("done", F.when(F.col("id").isin(*ids), 1).otherwise(F.col("done")) if ids else F.col("done"))
