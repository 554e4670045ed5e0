"""Summaries of findings: tags, coverage, policies, category lists, counters in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Tags that fail a check unless others are asked for.
FAIL_ON = ("reveals", "hidden", "damage", "incomplete")


def inspection_status(format_: Column, complete: Column) -> Column:
    return F.when(format_ == "unknown", "unsupported").when(complete, "complete").otherwise("partial")


def is_unread(concern: Column, label: Column) -> Column:
    """Problems after which some of a file has not been read."""
    rest = label.rlike("^(data (after|before)|unclaimed)") | label.rlike("(after the end of the archive|nothing points at)$")
    return (concern == "damage") | ((concern == "hidden") & rest)


def summaries(files: DataFrame, facts: DataFrame, problems: DataFrame) -> DataFrame:
    """One row for each of ``files`` (file_id, format, misnamed, metadata_complete): sorted kinds and
    concerns, numbers, ``complete`` and ``status``. Facts and problems are aggregated before they meet the files."""
    f = facts.groupBy("file_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count(F.lit(1)).alias("n_facts"))
    p = problems.groupBy("file_id").agg(
        F.array_sort(F.collect_set("concern")).alias("concerns"),
        F.count(F.lit(1)).alias("n_problems"),
        F.bool_or(is_unread(F.col("concern"), F.col("label"))).alias("unread"),
    )
    out = files.join(f, "file_id", "left").join(p, "file_id", "left")
    none = F.array().cast("array<string>")
    complete = F.col("metadata_complete") & ~F.coalesce("unread", F.lit(False))
    return out.select(
        "file_id", "format", "misnamed", F.coalesce("kinds", none).alias("kinds"), F.coalesce("concerns", none).alias("concerns"),
        F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_problems", F.lit(0)).alias("n_problems"),
        complete.alias("complete"), inspection_status(F.col("format"), complete).alias("status"),
    )


def tagged(summary: DataFrame) -> DataFrame:
    """``summary`` with its sorted ``tags``."""
    when = lambda c, t: F.when(c, F.array(F.lit(t))).otherwise(F.array().cast("array<string>"))
    parts = [
        when(F.col("misnamed").isNotNull(), "misnamed"), F.col("concerns"), when(F.col("n_facts") > 0, "reveals"),
        when(~F.col("complete"), "incomplete"), F.col("kinds"),
    ]
    return summary.withColumn("tags", F.array_sort(F.array_distinct(F.concat(*parts))))


def failing(tags: DataFrame, on: tuple[str, ...] = FAIL_ON) -> DataFrame:
    return tags.withColumn("fails", F.arrays_overlap("tags", F.array(*map(F.lit, on))))


def quiet(summary: DataFrame) -> DataFrame:
    """Files about which there is nothing to say."""
    return summary.where((F.col("format") != "unknown") & F.col("complete") & (F.col("n_problems") == 0) & (F.col("n_facts") == 0) & F.col("misnamed").isNull())


def _statuses() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("files"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "partial", "unsupported")],
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"),
    ]


def coverage(rows: DataFrame, by: str = "format") -> DataFrame:
    """Numbers by status and bytes for each format; rows have ``status``, ``bytes`` and ``by``."""
    return rows.groupBy(by).agg(*_statuses())


def coverage_with_total(rows: DataFrame, by: str = "format") -> DataFrame:
    """The same and a row of totals, whose format is ``*``."""
    got = rows.rollup(by).agg(F.grouping(by).alias("g"), *_statuses())
    return got.withColumn(by, F.when(F.col("g") == 1, "*").otherwise(F.col(by))).drop("g")


def batch_summary(tags: DataFrame) -> DataFrame:
    """All counters of a batch in one pass over one partial aggregate."""
    has = lambda c, x: F.count_if(F.array_contains(c, x))
    return tags.agg(
        F.count(F.lit(1)).alias("files"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "partial", "unsupported")],
        F.count_if(F.col("n_facts") > 0).alias("reveals"), F.count_if(F.col("n_problems") > 0).alias("with_problems"),
        *[has("concerns", c).alias(c) for c in ("damage", "hidden", "oddity")],
        F.count_if(F.col("misnamed").isNotNull()).alias("misnamed"),
        F.coalesce(F.sum("n_facts"), F.lit(0)).alias("facts"), F.coalesce(F.sum("n_problems"), F.lit(0)).alias("problems"),
    )


def top_unread(rows: DataFrame, ext: Column, most: int = 5) -> DataFrame:
    """Extensions of unsupported rows: the most frequent, ties by name."""
    n = rows.where("status = 'unsupported'").groupBy(ext.alias("extension")).agg(F.count(F.lit(1)).alias("files"))
    return n.orderBy(F.desc("files"), "extension").limit(most)


def category_list(facts: DataFrame, kinds: DataFrame) -> DataFrame:
    """The kinds of each file in catalogue order, as one line."""
    known = facts.select("file_id", "kind").distinct().join(kinds, "kind")
    sorted_ = F.array_sort(F.collect_list(F.struct("position", "kind")))
    return known.groupBy("file_id").agg(F.array_join(F.transform(sorted_, lambda x: x["kind"]), ", ").alias("categories"))


def policy_result(summary: DataFrame, kinds: DataFrame, blocked: list[str], require_complete: bool) -> DataFrame:
    """Which blocked kinds a file shows, which can't be checked, and whether it passes.

    Kinds that are not registered and those of scanned codes can't be checked; a file that was not
    read in full is unchecked where the policy requires that.
    """
    names = sorted(set(blocked))
    known = {r["kind"] for r in kinds.where(F.col("kind").isin(names)).collect()} if names else set()
    open_ = [k for k in names if k not in known or k.startswith("qr")]
    want = F.array(*map(F.lit, names)).cast("array<string>")
    hit = F.array_sort(F.array_intersect(want, F.col("kinds")))
    unchecked = F.lit(bool(open_)) | (F.lit(require_complete) & (F.col("status") != "complete"))
    state = F.when(F.size(hit) > 0, "blocked").when(unchecked, "unchecked").otherwise("passed")
    return summary.select("file_id", hit.alias("blocked"), F.array(*map(F.lit, open_)).cast("array<string>").alias("unchecked_kinds"), state.alias("result"))


def planned_removals(facts: DataFrame, files: DataFrame, contract: DataFrame) -> DataFrame:
    """Findings whose removal a clean copy of the file could prove."""
    stable = facts.where(F.trim("text") != "").select("file_id", "kind").distinct()
    whole = files.where("complete").select("file_id", "format")
    return stable.join(whole, "file_id").join(contract.where("scope = 'file'").select("format", "kind"), ["format", "kind"], "left_semi")


def differing_fields(fields: DataFrame, by: list[str], label: str, value: str, most: int = 20) -> DataFrame:
    """Labels that stand in one group with two values or more: how many values and rows, and the first ``most`` values in order."""
    once = fields.where(F.col(value).isNotNull()).groupBy(*by, label, value).agg(F.count(F.lit(1)).alias("k"))
    rank = F.row_number().over(W.partitionBy(*by, label).orderBy(value))
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.col(value))))
    n = once.withColumn("rank", rank).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n_values"), F.sum("k").alias("n"), first.alias("values"))
    return n.where("n_values > 1")


def filled(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by ``key``: of each other column the first side's value where it has one, else the second's."""
    other = second.select([F.col(c).alias(f"_{i}") for i, c in enumerate(second.columns)])
    place = {c: f"_{i}" for i, c in enumerate(second.columns)}
    on = None
    for k in key:
        same = F.col(k).eqNullSafe(F.col(place[k]))
        on = same if on is None else on & same
    names = [*first.columns, *[c for c in second.columns if c not in first.columns]]
    value = lambda c: F.coalesce(F.col(c), F.col(place[c])) if c in first.columns and c in place else F.col(c if c in first.columns else place[c])
    return first.join(other, on, "full_outer").select([value(c).alias(c) for c in names])


def ndjson(summary: DataFrame, facts: DataFrame) -> DataFrame:
    """A JSON line for each file; values that are null are left out, ``complete`` stands only where it is false."""
    reveals = facts.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("kind", "text"))).alias("reveals"))
    rows = summary.join(reveals, "file_id", "left").select(
        "file_id",
        F.to_json(F.struct(F.col("file_id").alias("file"), "format", F.col("concerns").alias("problems"), "reveals", "misnamed", F.when(~F.col("complete"), F.lit(False)).alias("complete"))).alias("line"),
    )
    return rows


def sarif(spark, problems: DataFrame, most: int = 10_000) -> str:
    """One SARIF 2.1.0 log, a driver-side document by its nature. More than ``most`` problems do not fit one: the log then says how many
    it leaves out (``sinks.sarif_parts`` has them all)."""
    import json

    rows = problems.orderBy("file_id", "label").limit(most).collect()
    left = problems.count() - len(rows) if len(rows) == most else 0
    rules = sorted({r["label"] for r in rows})
    level = {"damage": "error", "hidden": "warning"}
    run = {
        "tool": {"driver": {"name": "gleanery", "rules": [{"id": r} for r in rules]}},
        "results": [
            {
                "ruleId": r["label"], "level": level.get(r["concern"], "note"), "message": {"text": r["label"]},
                "locations": [{"physicalLocation": {"artifactLocation": {"uri": str(r["file_id"])}}}],
            }
            for r in rows
        ],
    }
    if left:
        run["invocations"] = [{"executionSuccessful": False, "toolExecutionNotifications": [{"message": {"text": f"{left} more problems are not in this log"}}]}]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]})
