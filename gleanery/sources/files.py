"""Files as rows: folders of binaries, tables of texts, fixed JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are not looked into, the largest file read, that of a batch, and the largest documents of settings.
SKIPPED = [".git", "node_modules", "target", ".venv", "__pycache__"]
MOST_BYTES, MOST_BATCH_BYTES = 512 << 20, 50 << 20
MOST_POLICY, MOST_RECEIPT, MOST_RECIPE = 64 << 10, 16 << 20, 16 << 10
POLICY = "schema string, version int, blocked_kinds array<string>, require_complete boolean"
RECEIPT = "schema string, version int, file string, format string, copy_sha256 string, copy_bytes bigint, removed_bytes bigint, removed_kinds array<string>, present_kinds array<string>, error string, complete boolean"
RECIPE = "schema string, version int, mode string, exposure double, contrast double, base array<int>, crop array<double>"


def binary_files(spark: SparkSession, path: str, *, glob: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``file_id, name, length, content, error`` of all files under ``path``, in every folder but the skipped ones. A file larger than
    ``most_bytes`` is a row without content that says so; its bytes are never read, as contents are read for the others only."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    for skipped in SKIPPED:
        rows = rows.where(~F.col("path").contains(f"/{skipped}/"))
    named = [F.md5(F.encode("path", "UTF-8")).alias("file_id"), F.col("path").alias("name"), "length"]
    read = rows.where(F.col("length") <= most_bytes).select(*named, "content", F.lit(None).cast("string").alias("error"))
    large = rows.where(F.col("length") > most_bytes).select(*named, F.lit(None).cast("binary").alias("content"), F.lit("too large").alias("error"))
    return read.unionByName(large)


def checked_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path``, ``error`` of the entries under ``paths``, sorted: a symbolic link and a folder that can't be read are errors, not
    left out. Walks folders that driver and executors share, one folder of the top level a task."""
    import pyarrow as pa

    def walked(batches):
        import os

        for b in batches:
            out: list[tuple[str, str | None]] = []
            todo = sorted(b.column(0).to_pylist(), reverse=True)
            while todo:
                at = todo.pop()
                if os.path.islink(at):
                    out.append((at, "symbolic links are not followed"))
                elif os.path.isdir(at):
                    try:
                        todo += sorted((os.path.join(at, n) for n in os.listdir(at) if n not in SKIPPED), reverse=True)
                    except OSError as e:
                        out.append((at, e.strerror or "can't be read"))
                else:
                    out.append((at, None if os.path.exists(at) else "not there"))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], names=["path", "error"])

    tops = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return tops.mapInArrow(walked, "path string, error string")


def from_table(rows: DataFrame, ident: str, body: str, *, name: str | None = None) -> DataFrame:
    content = F.col(body) if dict(rows.dtypes)[body] == "binary" else F.encode(F.col(body), "UTF-8")
    return rows.select(
        F.col(ident).cast("string").alias("file_id"), (F.col(name) if name else F.col(ident).cast("string")).alias("name"),
        F.octet_length(content).cast("long").alias("length"), content.alias("content"),
    )


def _document(spark: SparkSession, path: str, schema: str, name: str, most: int) -> dict:
    """One JSON document with its schema name and version; larger ones, other fields' types and other names fail."""
    size = spark.read.format("binaryFile").load(path).select("length").first()
    if size is None or size["length"] > most:
        raise ValueError(f"{path}: no {name} document of {most} bytes at most")
    row = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path).first()
    if row is None or row["schema"] != f"gleanery.{name}" or row["version"] != 1:
        raise ValueError(f"{path}: not a {name} document of version 1")
    return row.asDict()


def read_policy(spark: SparkSession, path: str) -> dict:
    row = _document(spark, path, POLICY, "policy", MOST_POLICY)
    return {"blocked": row["blocked_kinds"] or [], "require_complete": bool(row["require_complete"])}


def read_receipt(spark: SparkSession, path: str) -> dict:
    return _document(spark, path, RECEIPT, "receipt", MOST_RECEIPT)


def read_recipe(spark: SparkSession, path: str):
    """Settings of a film rendering."""
    from gleanery.sources.film import Settings

    row = _document(spark, path, RECIPE, "film", MOST_RECIPE)
    base = tuple(row["base"]) if row["base"] else None
    given = {k: v for k, v in (("mode", row["mode"]), ("exposure", row["exposure"]), ("contrast", row["contrast"]), ("base", base), ("crop", tuple(row["crop"]) if row["crop"] else None)) if v is not None}
    return Settings(**given)
