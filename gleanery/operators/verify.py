"""Comparisons: findings of an original and its copy as multisets, structural and semantic differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gleanery.shared import written


def _stable(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy("ordinal")))


def compare_copies(source: DataFrame, copy: DataFrame, snapshots: DataFrame, contract: DataFrame) -> DataFrame:
    """What became of each finding in a copy: ``file_id, kind, status, reason, unexpected``.

    ``source`` and ``copy`` are findings (file_id, ordinal, kind, scope, value); ``snapshots`` has for
    each file source_format, copy_format, source_complete, copy_complete. Findings are matched
    one to one: equal ones first, then those of one kind and scope whose value changed. What is left of
    the source is removed, if both sides were read in full and the contract covers it, else unchecked; what is left
    of the copy is unexpected. Files without findings get one row of kind ``file``.
    """
    null_safe = [F.coalesce("value", F.lit("")).alias("v")]
    base = ["file_id", "kind", "scope"]
    source, copy = written(source, "source"), written(copy, "copy")  # each pass reads them again
    s = source.join(snapshots, "file_id").select(*base, "ordinal", "value", *null_safe, (F.col("source_format") == F.col("copy_format")).alias("same"))
    c = copy.join(snapshots, "file_id").select(*base, "ordinal", "value", *null_safe, (F.col("source_format") == F.col("copy_format")).alias("same"))
    s1 = _numbered(s, [*base, "v"]).withColumn("side", F.lit("s"))
    c1 = _numbered(c, [*base, "v"]).withColumn("side", F.lit("c"))

    def matched(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        x = a.where("same").select(*keys, "rn", F.col("ordinal").alias("os"), F.col("value").alias("vs"))
        y = b.where("same").select(*keys, "rn", F.col("ordinal").alias("oc"), F.col("value").alias("vc"))
        both = x.join(y, [*keys, "rn"])
        left = a.join(both.select("file_id", F.col("os").alias("ordinal")), ["file_id", "ordinal"], "left_anti")
        right = b.join(both.select("file_id", F.col("oc").alias("ordinal")), ["file_id", "ordinal"], "left_anti")
        return both, written(left.drop("rn"), "left"), written(right.drop("rn"), "right")

    row = lambda df, status, reason, unexpected=False: df.select(
        "file_id", "kind", F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(unexpected).alias("unexpected"),
    )
    equal, s2, c2 = matched(s1, c1, [*base, "v"])
    stable = _stable(F.col("vs"))
    out = row(equal, F.when(stable, "present").otherwise("unchecked"), F.when(stable, "still_present").otherwise("no_stable_value"))
    steady = lambda df: df.where(_stable(F.col("value")))
    changed, s3a, c3a = matched(_numbered(steady(s2), base), _numbered(steady(c2), base), base)
    out = out.unionByName(row(changed, "present", "value_changed_same_kind"))
    vague = lambda df: df.where(~_stable(F.col("value")))
    s3, c3 = s3a.unionByName(vague(s2)), c3a.unionByName(vague(c2))
    unknown, s4, c4 = matched(_numbered(s3, base), _numbered(c3, base), base)
    out = out.unionByName(row(unknown, "unchecked", "no_stable_value"))
    covered = contract.select(F.col("format").alias("source_format"), "kind", "scope", F.lit(True).alias("covered"))
    rest = s4.join(snapshots, "file_id").join(covered, ["source_format", "kind", "scope"], "left")
    reason = (
        F.when(~F.col("same"), "format_changed").when(~_stable(F.col("value")), "no_stable_value")
        .when(~(F.col("source_complete") & F.col("copy_complete")), "parse_incomplete")
        .when(F.col("covered").isNull(), "coverage_incomplete").otherwise("removed")
    )
    out = out.unionByName(row(rest, F.when(reason == "removed", "removed").otherwise("unchecked"), reason))
    known = _stable(F.col("value"))
    extra = c4.where("same").select(
        "file_id", "kind", F.when(known, "present").otherwise("unchecked").alias("status"),
        F.when(known, "unexpected_output").otherwise("no_stable_value").alias("reason"), known.alias("unexpected"),
    )
    out = out.unionByName(extra)
    seen = source.select("file_id").unionByName(copy.select("file_id")).distinct()
    empty = snapshots.join(seen, "file_id", "left_anti").select(
        "file_id", F.lit("file").alias("kind"), F.lit("unchecked").alias("status"),
        F.when(F.col("source_complete") & F.col("copy_complete"), "no_comparable_findings").otherwise("parse_incomplete").alias("reason"),
        F.lit(False).alias("unexpected"),
    )
    return out.unionByName(empty)


def comparison_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("kind").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("removed", "present", "unchecked")], F.count_if("unexpected").alias("unexpected"))


def numbered_paths(rows: DataFrame, group: list[str], path: str, order: str) -> DataFrame:
    """``rows`` with ``unique_path``: the second of one path in a group is ``path#2``, and so on."""
    n = F.row_number().over(W.partitionBy(*group, path).orderBy(order))
    return rows.withColumn("unique_path", F.when(n == 1, F.col(path)).otherwise(F.concat(F.col(path), F.lit("#"), n.cast("string"))))


def structural_diff(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys of both sides with ``only_a``, ``only_b``, ``changed`` or ``same``."""
    x = a.select(*key, F.col(value).alias("va"), F.lit(True).alias("ina"))
    y = b.select(*key, F.col(value).alias("vb"), F.lit(True).alias("inb"))
    change = F.when(F.col("inb").isNull(), "only_a").when(F.col("ina").isNull(), "only_b").when(F.col("va").eqNullSafe(F.col("vb")), "same").otherwise("changed")
    return x.join(y, key, "full_outer").select(*key, change.alias("change"))


def semantic_diff(a: DataFrame, b: DataFrame, group: str, kind: str, value: str) -> DataFrame:
    """By group and kind: only in one side, or in both with other values (as sorted multisets)."""
    listed = lambda df, name: df.groupBy(group, kind).agg(F.array_sort(F.collect_list(value)).alias(name))
    both = listed(a, "va").join(listed(b, "vb"), [group, kind], "full_outer")
    change = F.when(F.col("vb").isNull(), "only_a").when(F.col("va").isNull(), "only_b").when(F.col("va") == F.col("vb"), "same").otherwise("changed")
    return both.select(group, kind, change.alias("change"))
