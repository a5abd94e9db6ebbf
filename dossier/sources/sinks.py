"""Writers. One dataset per table; spreadsheets are left to the reader of the CSV."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.sources import stores


def write_report(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "parquet") -> None:
    """A table with fixed columns, also when it has no rows. Quotes in cells are doubled."""
    writer = df.select(*columns).write.mode("overwrite")
    writer.csv(path, header=True, escape='"') if fmt == "csv" else writer.format(fmt).save(path)


def write_tables(tables: Mapping[str, DataFrame], root: str, run_id: str, by_model: Sequence[str] = ()) -> None:
    """Several result tables of one run below ``root/<table>/run_id=<run>``."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if name in by_model:
            writer = writer.partitionBy("model")
        writer.parquet(f"{root.rstrip('/')}/{name}/run_id={run_id}")


def write_named(df: DataFrame, root: str, key: str, name: str, headers: Mapping[str, str]) -> int:
    """Delimited files named after a value of ``key``, in a folder for each task and batch.

    ``name`` has ``{}`` for the value and ``headers`` gives the columns and their headers. A file is
    there whole or not at all, and a task that is run again replaces its own. Rows without a key
    are left out. Returns the number of files; a batch is all that a task holds.
    """
    chosen = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string"), *headers)

    def write(batches):
        files = 0
        for k, batch in enumerate(batches):
            folder = f"{root.rstrip('/')}/{TaskContext.get().partitionId():05d}-{k:05d}"
            stores.make_folder(folder)
            table = pa.Table.from_batches([batch])
            for value in table[key].unique().to_pylist():
                rows = table.filter(pc.equal(table[key], value)).select(list(headers)).rename_columns(list(headers.values()))
                stores.publish(folder, name.format(value), lambda stream, rows=rows: csv.write_csv(rows, stream))
                files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return chosen.mapInArrow(write, "files bigint").agg(F.sum("files")).first()[0] or 0


def append_log(df: DataFrame, path: str) -> None:
    """Append answers to a response log of JSON lines."""
    df.write.mode("append").json(path)


def append_results(df: DataFrame, path: str) -> None:
    """Append finished rows; a later run leaves them out with ``pending``."""
    df.write.mode("append").parquet(path)


def write_manifests(df: DataFrame, path: str) -> None:
    """One JSON document per row, nested structures kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(
        "overwrite"
    ).text(path)
