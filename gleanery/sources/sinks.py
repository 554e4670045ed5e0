"""What goes out: reports as JSON, text, annotations and CSV, copies written whole or not at all, stored archives."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import csv_cell

#: Rows of a summary table before the rest is only counted.
SUMMARY_ROWS = 500


# ---- JSON documents: one line each, with schema name and version first


def document(name: str, version: int, rows: DataFrame, fields: list[str], order: list[str], **more) -> DataFrame:
    """``rows`` as one versioned JSON document with a list ``rows`` of ``fields`` in order. A report by its nature: its rows are
    totals or a batch, not a corpus."""
    listed = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*fields).alias("row"))))
    head = [F.lit(f"gleanery.{name}").alias("schema"), F.lit(version).alias("version"), *[F.lit(v).alias(k) for k, v in more.items()]]
    return rows.agg(listed.alias("l")).select(F.to_json(F.struct(*head, F.transform("l", lambda x: x["row"]).alias("rows"))).alias("json"))


def coverage_json(coverage: DataFrame) -> DataFrame:
    return document("coverage", 1, coverage, ["format", "files", "complete", "partial", "unsupported", "bytes"], ["format"])


def plan_json(planned: DataFrame) -> DataFrame:
    """What clean copies will take out: file, format, kind."""
    return document("plan", 1, planned, ["file_id", "format", "kind"], ["file_id", "kind"])


def policy_json(results: DataFrame, name: str) -> DataFrame:
    return document("policy-result", 1, results, ["file_id", "blocked", "result"], ["file_id"], policy=name)


def mosaic_json(groups: DataFrame) -> DataFrame:
    """Files that belong together: by serial, by place, in order of time."""
    return document("mosaic", 1, groups, ["relation", "indexes"], ["relation", "indexes"])


def receipt_json(receipts: DataFrame) -> DataFrame:
    """A line of its own for each copy; no value of any finding is in it."""
    body = F.struct(
        F.lit("gleanery.receipt").alias("schema"), F.lit(1).alias("version"), F.col("file_id").alias("file"), "format", "copy_sha256", "copy_bytes",
        "removed_bytes", "removed_kinds", "present_kinds", "error", "complete",
    )
    return receipts.select("file_id", F.to_json(body).alias("json"))


def check_receipts(receipts: DataFrame, copies: DataFrame) -> DataFrame:
    """``file_id``, ``state`` of each receipt (file_id, json) against the copies (file_id, content) there are now: ``same``,
    ``changed``, ``missing``, or ``invalid`` where it is no receipt of version 1."""
    parsed = F.from_json("json", "schema string, version int, file string, copy_sha256 string, copy_bytes bigint")
    read = receipts.select("file_id", parsed.alias("r"))
    now = copies.select(F.col("file_id").alias("of"), F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("long").alias("n"))
    good = (F.col("r.schema") == "gleanery.receipt") & (F.col("r.version") == 1) & F.col("r.copy_sha256").rlike("^[0-9a-f]{64}$")
    same = (F.col("sha") == F.col("r.copy_sha256")) & (F.col("n") == F.col("r.copy_bytes"))
    state = F.when(~F.coalesce(good, F.lit(False)), "invalid").when(F.col("of").isNull(), "missing").when(same, "same").otherwise("changed")
    return read.join(now, F.col("r.file") == F.col("of"), "left").select("file_id", state.alias("state"))


def sarif_parts(problems: DataFrame) -> DataFrame:
    """SARIF results as JSON lines (file_id, ordinal, json), all of them: parts of a log that is put together where it is read."""
    level = F.when(F.col("concern") == "damage", "error").when(F.col("concern") == "hidden", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("file_id").cast("string").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    body = F.struct(F.col("label").alias("ruleId"), level.alias("level"), F.struct(F.col("label").alias("text")).alias("message"), F.array(place).alias("locations"))
    return problems.select("file_id", "ordinal", F.to_json(body).alias("json"))


# ---- text


def _property(x: Column) -> Column:
    for char, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (":", "%3A"), (",", "%2C")):
        x = F.replace(x, F.lit(char), F.lit(code))
    return x


def annotations(summary: DataFrame, facts: DataFrame, problems: DataFrame) -> DataFrame:
    """``file_id``, ``line``: workflow commands that name the file and the kind of each finding, never its value."""
    at = lambda level, what, say: F.concat(F.lit(f"::{level} file="), _property(F.col("file_id").cast("string")), F.lit(",title="), what, F.lit("::"), say)
    level = F.when(F.col("concern") == "oddity", "notice").otherwise("error")
    said = F.concat(F.lit("::"), level, F.lit(" file="), _property(F.col("file_id").cast("string")), F.lit(",title="), F.col("concern"), F.lit("::"), F.regexp_replace("label", "[\r\n]", " "))
    named = summary.where("misnamed is not null").select("file_id", at("notice", F.lit("misnamed"), F.concat(F.lit("named as "), "misnamed", F.lit(", but it is "), "format")).alias("line"))
    kinds = facts.select("file_id", "kind").distinct().select("file_id", at("warning", F.concat(F.lit("reveals "), "kind"), F.lit("this file may reveal more than it should")).alias("line"))
    return named.unionByName(problems.select("file_id", said.alias("line"))).unionByName(kinds)


def human_text(summary: DataFrame, facts: DataFrame, problems: DataFrame) -> DataFrame:
    """``file_id``, ``text``: what a person is told about each file; findings of a file only, so a row is as long as its report."""
    p = problems.groupBy("file_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("  "), F.rpad("concern", 8, " "), F.lit(" "), F.col("label")))).alias("p"))
    f = facts.groupBy("file_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("  reveals  "), "kind", F.lit(": "), "text"))).alias("f"))
    none = F.array().cast("array<string>")
    rows = summary.join(p, "file_id", "left").join(f, "file_id", "left").withColumns({"p": F.coalesce("p", none), "f": F.coalesce("f", none)})
    head = F.array(F.concat(F.col("file_id").cast("string"), F.lit("  "), "format"))
    named = F.when(F.col("misnamed").isNotNull(), F.array(F.concat(F.lit("  misnamed as "), "misnamed"))).otherwise(none)
    quiet = (F.col("format") != "unknown") & F.col("complete") & (F.size("p") + F.size("f") + F.size(named) == 0)
    end = F.when(F.col("format") == "unknown", F.array(F.lit("  not read: the format is not known"))).when(quiet, F.array(F.lit("  nothing found"))).otherwise(none)
    return rows.select("file_id", F.array_join(F.concat(head, named, "p", "f", end), "\n").alias("text"))


def summary_table(tags: DataFrame, most: int = SUMMARY_ROWS) -> DataFrame:
    """A Markdown table of the files with findings, one text: the first ``most`` by id, then how many more there are."""
    cell = lambda c: F.regexp_replace(F.replace(c, F.lit("|"), F.lit(r"\|")), "[\r\n]", " ")
    dash = lambda c: F.when(c == "", "-").otherwise(c)
    found = tags.where((F.col("n_facts") > 0) | (F.col("n_problems") > 0) | F.col("misnamed").isNotNull())
    row = F.concat_ws(
        " | ", F.concat(F.lit("| "), cell(F.col("file_id").cast("string"))), F.col("format"), dash(F.array_join("kinds", ", ")), dash(F.array_join("concerns", ", ")),
        F.concat(F.when(F.col("fails"), "yes").otherwise(""), F.lit(" |")),
    )
    first = found.orderBy("file_id").limit(most).agg(F.array_sort(F.collect_list(F.struct("file_id", row.alias("r")))).alias("rows"))
    n = found.agg(F.count(F.lit(1)).alias("n"))
    head = "| File | Format | Reveals | Problems | Fails |\n| --- | --- | --- | --- | --- |"
    rest = F.when(F.col("n") > most, F.concat(F.lit("\nand "), (F.col("n") - most).cast("string"), F.lit(" more files"))).otherwise("")
    # one row a side
    return first.withColumn("one", F.lit(1)).join(n.withColumn("one", F.lit(1)), "one").select(
        F.concat(F.lit(head), F.lit("\n"), F.array_join(F.transform("rows", lambda x: x["r"]), "\n"), rest).alias("text")
    )


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``line``: cells guarded and quoted, nulls empty. With CR LF between them they are a CSV file."""
    return rows.withColumn("line", F.concat_ws(",", *[F.coalesce(csv_cell(F.col(c).cast("string")), F.lit("")) for c in columns]))


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """CSV files under ``path``, each with a header, lines ended by CR LF."""
    lines = csv_lines(rows, columns).select(F.concat(F.col("line"), F.lit("\r")).alias("value"))
    head = rows.sparkSession.createDataFrame([(",".join(columns) + "\r",)], "value string")
    head.coalesce(1).write.mode("overwrite").text(path + "/header")
    lines.write.mode("overwrite").text(path + "/rows")


# ---- bytes


def write_copies(copies: DataFrame, folder: str) -> DataFrame:
    """Copies (file_id, name, copy) written to a folder that all executors see: each to a file beside its place first, then
    renamed, so a lost executor leaves no half of one. Returns ``file_id``, ``path``, ``bytes``; a copy that is null is not written.
    """

    def run(batches):
        for b in batches:
            out = []
            for ident, name, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                if data is None:
                    continue
                path = os.path.join(folder, os.path.basename(name.replace("\\", "/")) or ident)
                part = f"{path}.{os.getpid()}.part"
                mode = os.stat(path).st_mode & 0o7777 if os.path.exists(path) else None
                with open(part, "wb") as f:
                    f.write(data)
                    f.flush()
                    os.fsync(f.fileno())
                if mode is not None:
                    os.chmod(part, mode)
                os.replace(part, path)
                out.append((ident, path, len(data)))
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["file_id", "path", "bytes"])

    return copies.select(F.col("file_id").cast("string"), "name", "copy").mapInArrow(run, "file_id string, path string, bytes bigint")


def stored_archives(files: DataFrame, group: str, most_bytes: int = 1 << 30) -> DataFrame:
    """Files (``group``, name, content) as one stored ZIP a group: ``group``, ``archive``, ``files``, ``error``. Names that leave the
    folder are an error, repeated ones are numbered; more than ``most_bytes`` in a group are an error, found from
    the sizes alone, before contents are moved."""
    import io
    import zipfile

    files = files.select(F.col(group).cast("string").alias("group"), "name", "content")
    size = files.groupBy(F.col("group").alias("of")).agg(F.sum(F.octet_length("content").cast("long")).alias("n"), F.bool_or(_leaves(F.col("name"))).alias("bad"))
    good = size.where((F.col("n") <= most_bytes) & ~F.col("bad")).select("of")
    ok = files.join(good, F.col("group").eqNullSafe(F.col("of")), "left_semi")

    def made(key, table):
        out, seen, rows = io.BytesIO(), {}, sorted(zip(table["name"].to_pylist(), table["content"].to_pylist()))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, data in rows:
                seen[name] = seen.get(name, 0) + 1
                stem, dot, ext = name.rpartition(".")
                shown = name if seen[name] == 1 else f"{stem} ({seen[name]}).{ext}" if dot else f"{name} ({seen[name]})"
                z.writestr(zipfile.ZipInfo(shown, (1980, 1, 1, 0, 0, 0)), data or b"")
        return pa.table({"group": [str(key[0].as_py())], "archive": pa.array([out.getvalue()], pa.binary()), "files": pa.array([len(rows)], pa.int64()), "error": pa.array([None], pa.string())})

    stored = ok.groupBy("group").applyInArrow(made, "group string, archive binary, files bigint, error string")
    bad = size.where((F.col("n") > most_bytes) | F.col("bad")).select(
        F.col("of").alias("group"), F.lit(None).cast("binary").alias("archive"), F.lit(0).cast("long").alias("files"),
        F.when(F.col("bad"), "a name leaves the folder").otherwise("too large").alias("error"),
    )
    return stored.unionByName(bad)


def _leaves(name: Column) -> Column:
    from gleanery.functions.text import unsafe_path

    return F.coalesce(unsafe_path(name), F.lit(True))
