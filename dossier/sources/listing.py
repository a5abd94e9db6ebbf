"""Listing of a folder tree on a file system that every executor can see.

Spark's own file sources leave out names starting with ``_`` or ``.`` and empty files, and
empty folders have no row there. All of these matter here, so directories are listed by
tasks, one tree level per step: a very large folder is split by its subfolders, and no
task or driver holds the tree.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.manifests import changed_files
from dossier.session import ensure_checkpoint_dir
from dossier.sources import stores

ENTRY_SCHEMA = (
    "assembly string, rel_path string, path string, is_dir boolean, length bigint, "
    "mtime timestamp, error string"
)


def _level_lister():
    """Task function that lists one level; nested, so that it travels with the job."""
    def list_level(batches):
        import os

        import pandas as pd

        names = ["assembly", "rel_path", "path", "is_dir", "length", "mtime", "error"]

        def frame(rows):
            out = pd.DataFrame(rows, columns=names)
            seconds = pd.to_numeric(out["mtime"])
            out["mtime"] = pd.to_datetime(seconds, unit="s", utc=True).dt.floor("us")
            out["length"] = out["length"].astype("Int64")
            return out

        for batch in batches:
            rows = []
            for assembly, rel_path, path in zip(batch["assembly"], batch["rel_path"], batch["path"]):
                top = not assembly
                try:
                    with os.scandir(path) as entries:
                        for entry in entries:
                            rel = entry.name if top or not rel_path else f"{rel_path}/{entry.name}"
                            owner, below = (entry.name, "") if top else (assembly, rel)
                            # Links to folders count as folders only at the top level.
                            if entry.is_dir(follow_symlinks=top):
                                rows.append((owner, below, entry.path, True, None, None, None))
                            elif not top and entry.is_file():
                                try:
                                    stat = entry.stat()
                                    rows.append((owner, below, entry.path, False,
                                                 stat.st_size, stat.st_mtime, None))
                                except OSError as problem:
                                    rows.append((owner, below, entry.path, False, None, None, str(problem)))
                            if len(rows) >= 10_000:
                                yield frame(rows)
                                rows = []
                except OSError as problem:
                    rows.append((assembly, rel_path, path, False, None, None, str(problem)))
            if rows:
                yield frame(rows)

    return list_level


def list_tree(spark: SparkSession, root: str, parallelism: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(files, folders, problems)`` below ``root``; every first-level folder is an assembly.

    ``files(assembly, rel_path, path, length, mtime)``, ``folders(assembly, path)`` with
    empty ones, ``problems(path, error)``.
    """
    ensure_checkpoint_dir(spark)
    tasks = parallelism or spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([("", "", root.rstrip("/") or "/")],
                                     "assembly string, rel_path string, path string")
    levels: list[DataFrame] = []
    while not frontier.isEmpty():
        level = frontier.repartition(tasks, "path").mapInPandas(_level_lister(), ENTRY_SCHEMA).checkpoint()
        levels.append(level)
        frontier = level.where("is_dir").select("assembly", "rel_path", "path")
    entries = reduce(lambda a, b: a.unionByName(b), levels)
    files = entries.where("not is_dir and error is null")
    return (
        files.select("assembly", "rel_path", "path", "length", "mtime"),
        levels[0].where("is_dir").select("assembly", "path"),
        entries.where("error is not null").select("path", "error"),
    )


def require_folders(folders: DataFrame, root: str) -> None:
    if folders.isEmpty():
        raise FileNotFoundError(f"No assembly folders below {root}")


#: Files above this size do not become one value of a row; a task reads them piece by piece.
WHOLE_FILE_BYTES = 64 * 1024 * 1024
PIECE_BYTES = 4 * 1024 * 1024


def file_hashes(spark: SparkSession, root: str, pattern: str = "*.pdf", whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """SHA-256 of the content of every file, whatever its size.

    The size filter reaches the source, so only small files are loaded as values. A larger file
    is hashed in pieces by the task that has its row, which opens it by its URI, in any store; a file that a
    task cannot open is an error, never a row without a hash.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).load(root)
    )
    facts = ["path", "length", F.col("modificationTime").alias("mtime")]
    small = files.where(F.col("length") <= whole_bytes).select(*facts, F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole_bytes).select(*facts)

    hashed = large.mapInPandas(_in_pieces(), "path string, length bigint, mtime timestamp, sha256 string")
    return small.unionByName(hashed)


def _in_pieces():
    """Task function that adds the hashes of files, each read piece by piece."""
    def in_pieces(batches):
        for batch in batches:
            hashes = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                system, place = stores.opened(path)
                with system.open_input_stream(place) as file:
                    while piece := file.read(PIECE_BYTES):
                        digest.update(piece)
                hashes.append(digest.hexdigest())
            yield batch.assign(sha256=hashes)

    return in_pieces


def hash_table(spark: SparkSession, root: str, table: str, pattern: str = "*.pdf") -> int:
    """Bring the table of known hashes at ``table`` up to date with the files below ``root``.

    ``path, length, mtime, sha256, version``: only files that are new, or whose size or time
    differs from the last version's, are read. Each run with changes writes a whole version beside
    the ones before, so a run that is broken off leaves the last one as it was; the return value is the
    version that now holds, to be read with ``known_hashes``.
    """
    kind = "path string, length bigint, mtime timestamp, sha256 string, version bigint"
    versions = [int(n.removeprefix("v=")) for n in stores.folders_in(table) if "_SUCCESS" in stores.names_in(f"{table}/{n}")]
    last = max(versions, default=0)
    known = spark.read.schema(kind).parquet(f"{table}/v={last}") if last else spark.createDataFrame([], kind)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        .select("path", "length", F.col("modificationTime").alias("mtime"))
    )
    there = ["path", "length", "mtime"]
    kept = known.join(files, there, "left_semi")
    wanted = changed_files(files, known)
    if wanted.isEmpty() and kept.count() == known.count():
        return last
    fresh = hashes_of(spark, wanted).withColumn("version", F.lit(last + 1).cast("bigint"))
    kept.unionByName(fresh).write.mode("overwrite").parquet(f"{table}/v={last + 1}")
    return last + 1


def known_hashes(spark: SparkSession, table: str, version: int) -> DataFrame:
    """A version of the table of hashes; ``version`` in its rows tells when a file was read."""
    return spark.read.parquet(f"{table}/v={version}")


def hashes_of(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``sha256`` of the content of the listed files (``path, length, mtime``), read in pieces.

    Files are dealt out by path over as many tasks as shuffles have, so large ones do not meet.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "length", "mtime").repartition(parts, "path").mapInPandas(
        _in_pieces(), "path string, length bigint, mtime timestamp, sha256 string"
    )


MANIFEST_SCHEMA = (
    "source_pdf string, source_pdf_name string, source_sha256 string, source_mtime double, "
    "page_count bigint, dpi bigint, image_format string, max_side_px bigint, "
    "converted_at_utc string, images array<struct<page_number:bigint,image_path:string,"
    "width_px:bigint,height_px:bigint,file_size_bytes:bigint>>, _corrupt_record string"
)


def read_manifests(spark: SparkSession, root: str, name: str = "manifest.json") -> DataFrame:
    """Page manifests below a folder; unreadable ones are left out."""
    read = (
        spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    )
    rows = read.select("*", F.col("_metadata.file_path").alias("manifest_path"))
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def read_documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON documents, one a line, and the lines that are none: ``file, line``.

    Nothing is dropped: a line that is no document of this schema is in the second table.
    """
    rows = spark.read.text(path, recursiveFileLookup=True).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.from_json("value", f"{schema}, _line string", {"columnNameOfCorruptRecord": "_line", "mode": "PERMISSIVE"}).alias("d"),
    )
    good = rows.where("d is not null and d._line is null").select("d.*").drop("_line")
    return good, rows.where("d is null or d._line is not null").select("file", F.col("value").alias("line"))
