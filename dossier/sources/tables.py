"""Text tables with varying headers, resolved to fixed columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions.text import (
    cell_text, fold, header_key, model_from_file, participant_from_file, strip, text_or_blank,
)

# Accepted header names per meaning, in order of preference.
PREDICTION_HEADERS = ("Predicted_Label", "Predicted Label", "Prediction", "Vorhersage")
TRUTH_HEADERS = (
    "Ground Truth", "Ground_Truth", "GroundTruth", "ground truth",
    "Funktionsklasse", "Functional class", "Functional_class", "Label_Full",
)
SAP_HEADERS = (
    "SAP-Nummer", "SAP Nummer", "SAP_Nummer", "Baugruppennummer",
    "Baugruppen-ID", "Baugruppen_ID", "BG", "ID",
)
TC_HEADERS = (
    "Teamcenter ID", "Teamcenter-ID", "Teamcenter Nummer", "Teamcenter-Nummer",
    "Teamcenter_ID", "TC ID", "TC-ID", "TC Nummer", "TC-Nummer",
)
LIST_ID_HEADERS = (
    "Baugruppennummer", "Baugruppen-ID", "Baugruppen_ID", "BG", "ID", "SAP-Nummer", "SAP Nummer",
)
NAME_HEADERS = ("Benennung", "Benennung (EN)", "Baugruppenname", "Baugruppenbezeichnung")
CLASS_HEADERS = ("Funktionsklasse", "Functional class", "Functional_class")


def read_text_table(
    spark: SparkSession, path: str | Sequence[str], sep: str = ",", line_breaks_in_cells: bool = False,
    row_no: str | None = None,
) -> DataFrame:
    """A delimited table with every column as text; rows without any value are dropped.

    Quotes in cells are doubled. Files with line breaks inside cells cannot be split over tasks, so this is off unless
    asked for. ``row_no`` names a column for a row's number in its file, the header being 1; rows
    without any value count. One more pass counts the rows of each split, and a table with a row
    for each split goes to all tasks; the rows themselves are not moved.
    """
    paths = [path] if isinstance(path, str) else list(path)
    rows = spark.read.csv(paths, header=True, inferSchema=False, sep=sep, multiLine=line_breaks_in_cells, escape='"')
    if row_no is None:
        return rows.na.drop("all")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    placed = rows.select(
        F.struct(*columns).alias("row"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    ).withColumn("line", F.monotonically_increasing_id())
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy("file", "block").agg(F.min("line").alias("first"), F.count("*").alias("n")).select(
        "file", "block", "first", F.coalesce(F.sum("n").over(in_file), F.lit(0)).alias("before")
    )
    number = (F.col("line") - F.col("first") + F.col("before") + 2).cast("bigint")
    numbered = placed.join(F.broadcast(splits), ["file", "block"]).select("row.*", number.alias(row_no))
    return numbered.na.drop("all", subset=rows.columns)


def find_column(
    columns: Sequence[str], candidates: Sequence[str], meaning: str,
    requested: str | None = None, required: bool = True, normalised: bool = False,
) -> str | None:
    """The requested header, else the first candidate present."""
    if requested:
        if requested in columns:
            return requested
        raise ValueError(f"The header {requested!r}, asked for as {meaning}, is none of {list(columns)}")
    if normalised:
        by_key = {_plain_header(c): c for c in columns}
        hit = next((by_key[_plain_header(c)] for c in candidates if _plain_header(c) in by_key), None)
    else:
        hit = next((c for c in candidates if c in columns), None)
    if hit is None and required:
        raise ValueError(f"No header for {meaning!r} among {list(columns)}")
    return hit


def _plain_header(text: str) -> str:
    return "".join(ch for ch in text.lower() if ch in "abcdefghijklmnopqrstuvwxyz0123456789")


def require_columns(columns: Sequence[str], required: Sequence[str], source: str) -> None:
    missing = [c for c in required if c not in columns]
    if missing:
        raise ValueError(f"{source} lacks the columns {missing}; it has {list(columns)}")


def resolve_columns(
    df: DataFrame, wanted: Mapping[str, Sequence[str]], required: Sequence[str] = (),
    keep: Sequence[str] = (), normalised: bool = False,
) -> DataFrame:
    """Rename the first candidate found for each meaning; absent optional ones are null."""
    picked = []
    for meaning, candidates in wanted.items():
        name = find_column(df.columns, candidates, meaning, required=meaning in required,
                           normalised=normalised)
        value = F.lit(None) if name is None else F.col(f"`{name}`")
        picked.append(value.cast("string").alias(meaning))
    return df.select(*[F.col(f"`{k}`") for k in keep], *picked)


def union_resolved(frames: Sequence[DataFrame], wanted, required=(), keep=()) -> DataFrame:
    """Tables with different headers in one schema."""
    resolved = [resolve_columns(df, wanted, required, keep) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), resolved)


def read_many(
    spark: SparkSession, paths: str | Sequence[str], wanted: Mapping[str, Sequence[str]],
    sep: str = ",", normalised: bool = False, multi_line: bool = False, required: Sequence[str] = (),
    prefix: str = "", with_path: bool = False,
) -> DataFrame:
    """Many delimited files, each with its own header, in one read.

    Every file is read by position; its first row with any value is its header. Returns
    ``file_name, row_no`` (rows with any value, the header being 1) and one text column per
    meaning, null where the file lacks it; a file whose header lacks a ``required`` meaning is an
    error. Lock files of office programs and files whose names lack ``prefix`` are left out. Quotes
    in cells are doubled. With ``multi_line`` quoted cells may hold line breaks, and files are not
    split; without it a line with an open quote is an error.

    One pass finds the widest line, one the first row and number of rows of each split, a
    table of a row for each split that goes to all tasks. The rows themselves are not shuffled.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    name = F.col("_metadata.file_name")
    chosen = ~name.startswith("~$") & name.startswith(prefix)

    def count_of(text: Column, sign: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))

    facts = spark.read.text(paths).where(chosen).agg(
        F.max(count_of(F.col("value"), sep)).alias("most"), F.max(count_of(F.col("value"), '"') % 2).alias("open")
    ).first()
    if facts.open and not multi_line:
        raise ValueError(f"A quoted cell runs over a line break in {paths}; read it with multi_line")
    width = (facts.most or 0) + 1
    schema = ", ".join(f"c{n} string" for n in range(width)) + ", raw string"
    cells = (
        spark.read.schema(schema).csv(paths, header=False, sep=sep, multiLine=multi_line, escape='"', columnNameOfCorruptRecord="raw")
        .where(chosen)
        .select(
            F.col("_metadata.file_path").alias("file_path"), name.alias("file_name"),
            F.col("_metadata.file_block_start").alias("block"),
            F.array(*[F.col(f"c{n}") for n in range(width)]).alias("cells"), "raw",
        )
        .where(F.exists("cells", lambda c: c.isNotNull()))
        .withColumn("line", F.monotonically_increasing_id())
    )
    splits = cells.groupBy("file_path", "block").agg(F.min("line").alias("first"), F.count("*").alias("n"))
    in_file = Window.partitionBy("file_path").orderBy("block")
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = splits.where("before = 0").select("file_path", F.col("first").alias("line"))
    headers = cells.join(F.broadcast(starts), ["file_path", "line"]).select(
        "file_path", "file_name", "raw", F.col("cells").alias("header")
    )
    # Only a header with line breaks in its cells can be wider than every line.
    too_wide = count_of(F.regexp_replace("raw", '"[^"]*"', ""), sep) >= width
    wide = F.raise_error(F.concat(F.lit("A header is wider than any line in "), "file_name")).cast("array<string>")
    header = F.when(F.coalesce(too_wide, F.lit(False)), wide).otherwise(F.col("header"))
    names = F.transform(header, lambda h: header_key(h) if normalised else F.trim(h))

    def place(candidates: Sequence[str]) -> Column:
        looked = [_plain_header(c) for c in candidates] if normalised else list(candidates)
        found = [F.coalesce(F.array_position("names", F.lit(c)), F.lit(0)) for c in looked]
        return F.coalesce(*[F.when(p > 0, p) for p in found]).cast("int")

    def needed(meaning: str, at: Column) -> Column:
        lacking = F.raise_error(F.concat(F.lit(f"No column for {meaning!r} in "), "file_name")).cast("int")
        return F.coalesce(at, lacking) if meaning in required else at

    headers = headers.withColumn("names", names).select(
        "file_path", F.struct(*[needed(m, place(c)).alias(m) for m, c in wanted.items()]).alias("at")
    )
    table = splits.join(headers, "file_path").select("file_path", "block", "first", "before", "at")
    rows = cells.join(F.broadcast(table), ["file_path", "block"]).withColumn(
        "row_no", (F.col("line") - F.col("first") + F.col("before") + 1).cast("bigint")
    )
    place_of = ["file_path"] if with_path else []
    return rows.where("row_no > 1").select(
        *place_of, "file_name", "row_no", *[F.get("cells", F.col("at")[m] - 1).alias(m) for m in wanted]
    )


def read_predictions(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """Result files of many models as one table. The model is the first entry of a file's
    model column, else it is taken from the file's name."""
    wanted = {"sap": SAP_HEADERS, "teamcenter": TC_HEADERS, "predicted": PREDICTION_HEADERS,
              "run_model": ("Run_Model",)}
    rows = read_many(spark, paths, wanted, required=["predicted"], with_path=True, **options)
    # One row for each file.
    named = rows.where("run_model is not null").groupBy("file_path").agg(
        F.min_by(strip(F.col("run_model")), "row_no").alias("first_model")
    )
    model = F.coalesce(F.nullif("first_model", F.lit("")), model_from_file(F.col("file_name")))
    return rows.join(F.broadcast(named), "file_path", "left").select(
        model.alias("model"), "file_name", "row_no", "sap", "teamcenter", "predicted"
    )


def read_forms(spark: SparkSession, paths: str | Sequence[str], prefix: str, **options) -> DataFrame:
    """Annotators' forms as one table; the participant is in the file's name."""
    wanted = {"sap": ("SAP-Nummer", "SAP Nummer"), "teamcenter": ("Teamcenter ID",),
              "label": ("Baugruppen-Klasse", "Baugruppen Klasse")}
    rows = read_many(spark, paths, wanted, normalised=True, required=["label"], prefix=prefix, **options)
    return rows.select(
        participant_from_file(F.col("file_name"), prefix).alias("participant"),
        "row_no", "sap", "teamcenter", "label",
    )


def class_list(df: DataFrame, column: str, row_no: str = "row_no") -> DataFrame:
    """Allowed labels in order of first appearance, trimmed, without blanks and repeats."""
    label = text_or_blank(F.col(column))
    return (
        df.select(label.alias("label"), F.col(row_no).alias("row_no")).where("label <> ''")
        .groupBy("label").agg(F.min("row_no").alias("ord"))
    )


def labels_for_prompt(classes: DataFrame, most: int = 10_000) -> list[str]:
    """The label list as Python values. Every prompt spells it out, so a list that long
    cannot be meant and is refused rather than cut."""
    rows = classes.orderBy("ord").limit(most + 1).collect()
    if not rows:
        raise ValueError("The class list is empty, so there is no label to choose from.")
    if len(rows) > most:
        raise ValueError(f"More than {most} labels: not a class list.")
    return [row.label for row in rows]


def rows_below_header(
    cells: DataFrame, header: str, preferred_sheet: str | None = None
) -> DataFrame:
    """Values of the column named ``header`` below the first row that holds that name.

    ``cells(sheet, sheet_no, row_no, cells array<string>)``; the preferred sheet is
    searched first, then the others in order. Returns ``sheet, row_no, value``; cells without
    the header anywhere are an error.
    """
    wanted = header.casefold()
    rank = F.when(F.col("sheet") == preferred_sheet, F.lit(-1)).otherwise(F.col("sheet_no")) \
        if preferred_sheet else F.col("sheet_no")
    names = F.transform("cells", lambda c: fold(cell_text(c)))
    first = (
        cells.withColumn("at", F.array_position(names, F.lit(wanted))).where("at > 0")
        .agg(F.min(F.struct(rank.alias("rank"), "row_no", "sheet", "at")).alias("h"))
        .select(F.coalesce("h", F.raise_error(F.lit(f"No sheet has the header {header!r}"))).alias("h"))
        .select(F.col("h.sheet").alias("sheet"), F.col("h.row_no").alias("header_row"), F.col("h.at").alias("at"))
    )
    return (
        cells.join(F.broadcast(first), "sheet")  # a single row
        .where(F.col("row_no") > F.col("header_row"))
        .select("sheet", "row_no", cell_text(F.get("cells", (F.col("at") - 1).cast("int"))).alias("value"))
    )
