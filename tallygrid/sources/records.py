"""Readers and writers: JSON lines, CSV, nested payloads, allow-listed exports, catalogs and run manifests."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.operators import ordering
from tallygrid.operators.lineage import fixed


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines, gzip by suffix; blank lines are skipped, and other text fails when ``strict``.

    A gzip file is one split, so what it holds is dealt out again before anything heavy.
    """
    paths = [path] if isinstance(path, str) else path
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(paths)
    return rows.repartition(spark.sparkContext.defaultParallelism) if any(p.endswith(".gz") for p in paths) else rows


def write_jsonl(rows: DataFrame, path: str, compressed: bool = False) -> None:
    """Columns in the order of their names; an existing path is an error."""
    ordered = rows.select(*sorted(rows.columns))
    ordered.write.mode("errorifexists").option("compression", "gzip" if compressed else "none").option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").csv(path, header=True)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


#: Rows of a file of a sorted sink.
FILE_ROWS = 1_000_000


def write_sorted(rows: DataFrame, path: str, order: list[str], files: int | None = None, compressed: bool = False, file_rows: int = FILE_ROWS) -> None:
    """JSON lines whose bytes depend on the rows alone: one order of all rows cut at fixed places, columns by name; gzip headers have no time.

    A file holds ``file_rows`` rows, or its share of ``files``, and each is written by a task of its own.  Rows equal in
    ``order`` follow that of their JSON.
    """
    ordered = rows.select(*sorted(rows.columns))
    placed = fixed(ordering.numbered(ordered, [*order, F.to_json(F.struct(*ordered.columns))], "_place"))
    total = max(1, placed.count())
    size = file_rows if files is None else -(-total // files)
    cut = placed.repartitionById(-(-total // size), ((F.col("_place") - 1) / size).cast("int")).sortWithinPartitions("_place").drop("_place")
    cut.write.mode("errorifexists").option("compression", "gzip" if compressed else "none").option("ignoreNullFields", "false").json(path)


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_whole(rows: DataFrame, path: str) -> None:
    """Parquet that replaces what was there, or leaves it if anything fails: written beside it, then renamed."""
    spark = rows.sparkSession
    part = f"{path}.{uuid.uuid4().hex}.part"
    rows.write.mode("errorifexists").parquet(part)
    files, where = _file_system(spark, path)
    files.delete(where, True)
    if not files.rename(_file_system(spark, part)[1], where):
        raise OSError(f"{part} could not be renamed to {path}")


def write_private(rows: DataFrame, path: str) -> None:
    """A new JSON-lines folder that its owner alone may read; an existing path is an error."""
    spark = rows.sparkSession
    files, where = _file_system(spark, path)
    if files.exists(where):
        raise FileExistsError(path)
    mode = lambda bits: spark._jvm.org.apache.hadoop.fs.permission.FsPermission(bits)
    files.mkdirs(where)
    files.setPermission(where, mode("700"))
    rows.write.mode("append").json(path)
    for status in files.listStatus(where):
        files.setPermission(status.getPath(), mode("600"))


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    """A copy of each table under a new folder."""
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{folder}/{name}")


def one_input(spark: SparkSession, folder: str, name: str) -> str:
    """The plain or the gzip file of a name; having both, or neither, is an error."""
    found = [p for p in (f"{folder}/{name}.jsonl", f"{folder}/{name}.jsonl.gz") if _exists(spark, p)]
    if len(found) != 1:
        raise FileNotFoundError(f"{folder}/{name}: {'ambiguous' if found else 'missing'} input")
    return found[0]


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def labelled_union(inputs: dict[tuple[str, ...], DataFrame], labels: list[str]) -> DataFrame:
    """One table of several inputs, each with its labels as literal columns."""
    out = None
    for values, rows in inputs.items():
        rows = rows.withColumns({k: F.lit(v) for k, v in zip(labels, values, strict=True)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no inputs")
    return out


def overlaid(rows: DataFrame, payload: str, schema: str) -> DataFrame:
    """The JSON payload's fields as columns; an outer column of the same name wins where it isn't null."""
    parsed = rows.withColumn("_p", F.from_json(payload, schema))
    fields = T._parse_datatype_string(schema).fieldNames()
    outer = [c for c in rows.columns if c != payload]
    both = {c: F.coalesce(F.col(c).cast("string"), F.col(f"_p.{c}").cast("string")).alias(c) for c in outer if c in fields}
    return parsed.select(*[both.get(c, F.col(c)) for c in outer], *[F.col(f"_p.{c}") for c in fields if c not in outer])


class NotAllowed(ValueError):
    """An export has columns or rows that may not leave."""


def exported(rows: DataFrame, allowed: list[str], dropped: list[str] = (), key: str = "request_id", pattern: str = "^[0-9a-f]{20}$", error: str = "api_error") -> DataFrame:
    """Only the allowed columns.  Unknown columns, error rows and malformed keys are errors, found before anything is written."""
    unknown = sorted(set(rows.columns) - set(allowed) - set(dropped) - {error})
    if unknown:
        raise NotAllowed(f"columns {', '.join(unknown)}")
    bad = ~F.coalesce(F.col(key).rlike(pattern), F.lit(False))
    if error in rows.columns:
        bad = bad | (F.coalesce(F.col(error), F.lit("")) != "")
    if not rows.filter(bad).isEmpty():
        raise NotAllowed("rows with an error or a malformed key")
    return rows.select(*[c for c in allowed if c in rows.columns])


def pseudonyms(people: DataFrame, name: str, known: DataFrame | None, prefix: str = "P") -> DataFrame:
    """(name, alias): known aliases stay; new names get the next numbers in the order of the names.

    Numbers of more than four digits are written whole.
    """
    from tallygrid.operators.ordering import numbered

    names = people.select(name).distinct()
    if known is None:
        known = people.sparkSession.createDataFrame([], f"{name} string, alias string")
    base = known.agg(F.coalesce(F.max(F.regexp_extract("alias", r"(\d+)$", 1).cast("int")), F.lit(0)).alias("n")).first()["n"]
    new = names.join(known.select(name), name, "left_anti")
    number = (F.col("_place") + base).cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    fresh = numbered(new, [name], "_place").select(name, F.concat(F.lit(prefix), padded).alias("alias"))
    return known.join(names, name, "left_semi").select(name, "alias").unionAll(fresh)


class IdentityMismatch(ValueError):
    """An identity map and the identities of a table aren't the same."""


def covered(people: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """The map, if it has each identity of ``people`` once and no other."""
    names, mapped = people.select(name).distinct(), known.select(name)
    wrong = names.join(mapped, name, "left_anti").withColumn("side", F.lit("unmapped")).unionAll(mapped.join(names, name, "left_anti").withColumn("side", F.lit("unknown")))
    wrong = wrong.unionAll(mapped.groupBy(name).count().filter("count > 1").select(name, F.lit("repeated")))
    if first := wrong.first():
        raise IdentityMismatch(f"{first['side']} identity")
    return known


# The columns that a de-identified answer keeps, and what it is marked with.
KEPT_FIELDS = (
    "puzzle_id", "puzzle_type", "family_id", "block_id", "module", "condition", "sequence_id", "sequence_position", "is_correct", "bad_record", "timeout", "gave_up",
    "response_time_ms", "solution_id", "abstract_solution_id", "accepted_solution_id", "accepted_abstract_solution_id",
)
MARKS = {"feedback_mode": "human_feedback", "attempt_index": 1, "source": "HUMAN"}


def deidentified(rows: DataFrame, aliases: DataFrame, name: str, alias: str) -> DataFrame:
    """The kept fields of the rows of mapped people, under their alias; a field that the table lacks is null, and an accepted class wins."""
    said = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    solution = F.coalesce(said("accepted_solution_id"), said("solution_id"))
    fields = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in KEPT_FIELDS}
    fields |= {"solution_id": solution, "abstract_solution_id": F.coalesce(said("accepted_abstract_solution_id"), said("abstract_solution_id"), solution)}
    own = rows.join(aliases.select(name, F.col(alias).alias("participant_id")), name)
    valid = F.coalesce(F.col("is_correct").cast("boolean"), F.lit(False)) if "is_correct" in rows.columns else F.lit(False)
    return own.select(*[c.alias(k) for k, c in fields.items()], "participant_id", valid.alias("is_valid"), *[F.lit(v).alias(k) for k, v in MARKS.items()])


def evolved(tables: list[DataFrame]) -> DataFrame:
    """Tables of several versions as one: columns that a version lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def backfilled(rows: DataFrame, column: str, *key: str) -> DataFrame:
    """Null or empty ids get one made of the row's key."""
    fresh = F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), 256), 1, 20)
    return rows.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), fresh))


def solution_catalog(puzzles: DataFrame, features: dict[str, Column] | None = None, cluster: Column | None = None) -> DataFrame:
    """One row for each solution of ``puzzles`` (puzzle_id, solutions), numbered from 1; ids default to the puzzle's and the number.

    ``features`` and ``cluster`` are columns over the solution ``s``; features become one map.
    """
    rows = puzzles.select("puzzle_id", F.posexplode("solutions").alias("_k", "s"))
    own = F.concat(F.col("puzzle_id"), F.lit("_sol_"), F.lpad((F.col("_k") + 1).cast("string"), 2, "0"))
    extra = []
    if features:
        extra.append(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*[c.cast("double") for c in features.values()])).alias("solution_features"))
    if cluster is not None:
        extra.append(cluster.alias("solution_cluster"))
    return rows.select(
        "puzzle_id",
        (F.col("_k") + 1).alias("solution_index"),
        F.coalesce(F.col("s.solution_id"), own).alias("solution_id"),
        F.coalesce(F.col("s.abstract_solution_id"), F.col("s.solution_id"), own).alias("abstract_solution_id"),
        F.col("s.answer").alias("canonical_answer"),
        *extra,
    )


def stable_hash(*columns: Column) -> Column:
    """SHA-256 of the columns as compact JSON."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def file_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, sha256) of the files, read by tasks wherever Spark can read."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, path: str, parameters: dict, inputs: dict[str, str], status: str, started: float) -> None:
    """A run's parameters, the hashes of its input files (by label) and its outcome as one JSON text, written whole or not at all."""
    hashes = {k: {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in file_hashes(spark, p).collect()} for k, p in inputs.items()}  # a run's few inputs
    text = json.dumps({"parameters": parameters, "inputs": hashes, "status": status, "elapsed_seconds": round(time.time() - started, 3)}, indent=1, sort_keys=True)
    files, part = _file_system(spark, f"{path}.part")
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    where = _file_system(spark, path)[1]
    files.delete(where, False)
    if not files.rename(part, where):
        raise OSError(f"{path} could not be written")
