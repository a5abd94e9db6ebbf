"""The three main jobs and the two smaller ones, end to end.

Costly tables that several outputs read are written once (``settled``); everything else is
one lazy plan per output.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions import answers, text
from dossier.operators import (
    cascade, folders, inventory, keypair, labelling, metrics, questions, resolve, truth,
)
from dossier.operators.spread import PART_SIZE, listed_in_parts, lookup_join, settled, settled_with
from dossier.session import ensure_checkpoint_dir
from dossier.sources import sinks


def _run_folder(df: DataFrame) -> str:
    """A new folder for one run's answers, shared by all executors."""
    return f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/answers-{uuid4().hex}"


def collect(
    items: DataFrame, found: DataFrame, target: str, copy: bool = False, existing: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Match raw folders to the master list: seven reports and the copy plan.

    With ``copy`` any conflict stops the job before a plan is made, and so does a target that
    holds something already (``existing`` lists it); without it the plan names the reason it is
    blocked.
    """
    inventory.require_categories(found)
    matches = settled(folders.folder_matches(items, found))
    matched = matches.where(F.col("status") == folders.MATCHED)
    if copy:
        folders.require_no_conflicts(items, matches)
        if existing is not None:
            folders.require_empty_target(existing)
    counts = folders.conflict_counts(items, matches)
    blocked = "conflicts" if counts.first().blocked else None
    return {
        "matched": matched,
        "unmatched": matches.where(F.col("status") == folders.UNMATCHED).select("category", "folder", "path"),
        "ambiguous_folders": matches.where(F.col("status") == folders.AMBIGUOUS).select(
            "category", "folder", "path", "n_rows", "found_ids"),
        "ambiguous_ids": folders.ambiguous_ids(items),
        "duplicate_names": folders.duplicate_names(matched),
        "several_folders": folders.several_folders(matched),
        "missing_items": folders.missing_items(items, matched),
        "conflict_counts": counts,
        "copy_plan": folders.copy_plan(matched, target, blocked),
    }


def build_inventory(files: DataFrame, all_folders: DataFrame, older: bool = False) -> dict[str, DataFrame]:
    rows = inventory.inventory(files, older)
    tables = {"file_inventory": rows, "type_counts": inventory.type_counts(rows)}
    if not older:
        tables["summary"] = inventory.priority_summary(rows, all_folders)
    return tables


def evaluate(predictions: DataFrame, truth_rows: DataFrame) -> dict[str, DataFrame]:
    """All models against one ground truth."""
    truth.require_consistent_truth(truth_rows)
    matched = settled(truth.match_predictions(predictions, truth_rows))
    metrics.require_evaluable(matched)
    # Everything else comes from one count of the matched rows.
    outcomes = settled(metrics.outcomes(matched))
    counts = metrics.confusion_of(outcomes)
    classes = metrics.per_class(counts)
    summaries = metrics.summary_of(outcomes)
    return {
        "matched_rows": matched, "confusion": counts, "per_class": classes,
        "label_order": metrics.label_order_of(outcomes), "summary": summaries,
        "confusion_square": metrics.confusion_square(outcomes),
        "model_comparison": metrics.model_ranking(summaries),
    }


def classify_all_files(
    items: DataFrame, all_folders: DataFrame, files: DataFrame, labels: Sequence[str],
    make_client: Callable, model: str, run_timestamp: str, parallelism: int,
    done: DataFrame | None = None, answers_path: str | None = None, system: str | None = None,
) -> dict[str, DataFrame]:
    """``results``: one row per item with folder, answer, label and status; ``used_files``:
    the files sent, once per folder.

    ``items(item, sap, teamcenter, name)``, ``all_folders(folder, name)``,
    ``files(folder, path, rel_path, length)``. Files below the ignore directory are left
    out. Items that ``done(item, model)`` lists are not asked again and do not appear. Answers
    are stored at ``answers_path`` bucket by bucket; a run started again with the same path
    asks only for what is missing there. ``system`` goes with every call
    (``answers.SYSTEM_PROMPT`` is the study's text).
    """
    if done is not None:
        items = labelling.pending(items.withColumn("model", F.lit(model)), done, ["item", "model"]).drop("model")
    match = settled(cascade.match_cascade(items.select("item", "sap", "teamcenter"), all_folders))
    sendable = inventory.supported_files(files).where(~F.col("ignored"))
    # Folders rather than items carry the file lists: several items may share a folder.
    per_folder = settled(sendable.groupBy("folder").agg(F.count("*").alias("n_files")))
    rows = (
        lookup_join(items.join(match, "item"), per_folder, ["folder"], ["item"])
        .withColumn("has_id", text.text_or_blank(F.col("sap")) != "")
        .withColumn("blank_name", text.text_or_blank(F.col("name")) == "")
    )
    ready = rows.where("has_id and not blank_name and coalesce(n_files, 0) > 0")
    prompts = ready.select(
        "item", "folder", answers.question_all_files(F.col("name"), labels).alias("prompt"))
    requests = labelling.request_table(prompts, sendable, key="folder")
    replies = labelling.stored_answers(requests, make_client, parallelism, answers_path or _run_folder(items), system=system)
    label = answers.tolerant_label(F.col("response"), labels)
    status = answers.run_status(
        F.col("has_id"), F.col("name"), F.col("n_files"), F.col("status"), F.col("response"), F.col("error"), label
    )
    answered = F.col("response").isNotNull()
    results = rows.join(replies, "item", "left").select(
        "item", "sap", "teamcenter", "name",
        F.when(answered, F.coalesce(label, F.lit(answers.UNRECOGNISED))).alias("predicted_label"),
        F.col("response").alias("raw_response"), status.alias("processing_status"),
        F.coalesce("n_files", F.lit(0)).alias("file_count"),
        F.col("folder").alias("matched_folder"), F.col("status").alias("folder_match_status"),
        F.when(answered, F.lit(model)).alias("run_model"), F.when(answered, F.lit("all_files")).alias("run_mode"),
        F.when(answered, F.lit(run_timestamp)).alias("run_timestamp"),
        F.when(answered, answers.usage_json(F.col("usage"))).alias("token_usage_json"),
    )
    used = sendable.join(prompts.select("folder").distinct(), "folder", "left_semi")
    return {"results": results, "used_files": used.select("folder", "path", "length")}


def classify_prioritised(
    items: DataFrame, inventory_rows: DataFrame, listing: DataFrame, root: str,
    labels: Sequence[str], make_client: Callable, parallelism: int,
    priorities: Sequence[str] = resolve.SENT_PRIORITIES, call: bool = True,
    run: Mapping[str, str] | None = None, answers_path: str | None = None, log_path: str | None = None,
) -> dict[str, DataFrame]:
    """Run on the inventory's prioritised files; one missing file holds an item back.

    ``items(item, row_no, sap, teamcenter, name)``. With ``call`` false only the checks
    are made. ``run`` holds texts for the response log, such as model and time; with ``log_path``
    the log is appended there. Answers are stored at ``answers_path`` as in ``classify_all_files``.
    """
    names = inventory_rows.select(text.cell_text(F.col("assembly")).alias("folder")).where("folder <> ''").distinct()
    match = settled(cascade.match_two_tier(
        items.select("item", "sap", "teamcenter"), names.withColumn("name", F.col("folder"))))
    resolved = settled(resolve.resolve_files(inventory_rows, listing, root, priorities))
    counts = resolve.file_counts(resolved).withColumnRenamed("assembly", "folder")
    name = text.cell_text(F.col("name"))
    cases = (
        lookup_join(items.withColumn("name", name).join(match, "item"), counts, ["folder"], ["item"])
        .na.fill(0, ["existing", "missing"])
        .withColumn("ready", answers.precheck_status(
            F.col("name"), F.col("folder"), F.col("status"), F.col("existing"), F.col("missing")))
    )
    by_folder = resolved.withColumnRenamed("assembly", "folder")
    considered = cases.where("folder is not null and name <> ''").select("folder").distinct()
    used = by_folder.join(considered, "folder", "left_semi")
    if call:
        # The file list of a folder comes in parts; the prompt opens with the first and
        # closes with the last, and the parts are put together when the item is asked.
        lists = listed_in_parts(
            by_folder.where("exists").withColumn("_fold", text.fold(F.col("file_name"))), ["folder"],
            ["_fold", "file_name", "resolved_path"], F.struct("file_name", "resolved_path"), "files",
            total="n_listed",
        )
        first = F.col("part") == 0
        last = (F.col("part") + 1) * PART_SIZE >= F.col("n_listed")
        bullets = answers.bullets(F.transform("files", lambda f: f["file_name"]))
        head, tail = answers.prioritised_ends(F.col("name"), labels)
        prompt = F.concat(F.when(first, head).otherwise("\n"), bullets, F.when(last, tail).otherwise(""))
        requests = cases.where("ready = 'READY'").select("item", "folder", "name").join(lists, "folder").select(
            "item", "part", prompt.alias("prompt"), F.transform("files", lambda f: f["resolved_path"]).alias("paths"))
        requests = settled(requests)
        replies = labelling.stored_answers(requests, make_client, parallelism, answers_path or _run_folder(items))
        cases = cases.join(replies.select("item", "response", "error"), "item", "left")
    else:
        requests = None
        cases = cases.withColumn("response", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string"))
    label = answers.strict_label(F.col("response"), labels)
    status = answers.answered_status(F.col("ready"), F.col("error"), F.col("response"), label)
    results = cases.select(
        "row_no", "item", "sap", "teamcenter", "name", F.col("folder").alias("matched_folder"),
        F.col("status").alias("match_method"), (F.col("existing") + F.col("missing")).alias("file_count"),
        "missing", F.coalesce(label, F.lit("")).alias("label"),
        F.col("response").alias("raw_response"),
        status.alias("status"),
        answers.status_message(status, F.col("message"), F.col("error")).alias("error_message"),
    )
    tables = {"results": results.orderBy("row_no"), "used_files": used, "file_lists": resolve.file_lists(resolved)}
    if requests is not None:
        tables["response_log"] = labelling.response_log(requests, results, run or {})
        if log_path:
            sinks.append_log(tables["response_log"], log_path)
    return tables


def classify_readable_files(
    items: DataFrame, all_folders: DataFrame, files: DataFrame, labels: Sequence[str],
    make_client: Callable, parallelism: int, answers_path: str | None = None, wait_seconds: float = 2.0,
) -> dict[str, DataFrame]:
    """Run on every readable file of the only folder that carries either id of an item.

    ``items(item, sap, teamcenter, name_en, name_de)``, ``all_folders(folder, name)`` and
    ``files(folder, rel_path, path, length)``. Items without one folder are not asked. An answer
    that is no allowed label is asked for once more. Returns ``results`` and ``skipped``, the
    files left out with their reasons.
    """
    match = settled(cascade.match_either(items.select("item", "sap", "teamcenter"), all_folders))
    judged = inventory.eligibility(files)
    readable = judged.where("skip_reason is null").withColumn("file_name", F.element_at(F.split("rel_path", "/"), -1))
    lists = listed_in_parts(
        readable.withColumn("_fold", text.fold(F.col("rel_path"))), ["folder"], ["_fold", "rel_path"],
        F.struct("file_name", "path"), "files", total="n_listed",
    )
    rows = items.join(match.withColumnRenamed("status", "match_status"), "item")
    asked = rows.where("folder is not null").join(lists, "folder", "left")
    none = F.col("n_listed").isNull()
    first = none | (F.col("part") == 0)
    last = none | ((F.col("part") + 1) * PART_SIZE >= F.col("n_listed"))
    cells = [text.cell_text(F.col(c)) for c in ("sap", "teamcenter", "name_en", "name_de")]
    head, tail = answers.described_ends(*cells, labels)
    listed = F.when(none, answers.NO_READABLE_FILES).otherwise(answers.bullets(F.transform("files", lambda f: f["file_name"])))
    prompt = F.concat(F.when(first, head).otherwise("\n"), listed, F.when(last, tail).otherwise(""))
    requests = settled(asked.select(
        "item", F.coalesce("part", F.lit(0).cast("bigint")).alias("part"), prompt.alias("prompt"),
        F.coalesce(F.transform("files", lambda f: f["path"]), F.array().cast("array<string>")).alias("paths"),
    ))
    allowed = [*labels, answers.NOT_CLASSIFIABLE]
    replies = labelling.stored_answers(
        requests, make_client, parallelism, answers_path or _run_folder(items), wait_seconds=wait_seconds,
        accepted=allowed, repeat_hint=answers.REPEAT_HINT,
    )
    sent = requests.groupBy("item").agg(F.sum(F.size("paths")).alias("n_files"))
    results = rows.join(replies, "item", "left").join(sent, "item", "left").select(
        "item", F.col("folder").alias("matched_folder"), "match_status",
        F.coalesce("n_files", F.lit(0).cast("bigint")).alias("file_count"),
        answers.checked_label(F.col("response"), labels).alias("label"),
        F.col("response").alias("raw_response"), "error", "attempts",
    )
    return {"results": results, "skipped": judged.where("skip_reason is not null").select("folder", "path", "skip_reason")}


def answer_questions(
    sheet: DataFrame, id_column: str, files: DataFrame, make_client: Callable, parallelism: int,
    answers_path: str | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Ask every blank cell's question about the files of its row; returns the long sheet.

    ``files(item, path, length)``. Rows without files get an error text in every cell,
    filled ones included; rows without an id stay as they are. Rows of one id share the answer
    to a question, which is asked once. ``keep`` names columns that are no questions and go with
    the row. A run with the ``answers_path`` of an earlier one asks only for cells it lacks.
    """
    keys = [*keep, id_column]
    long = questions.to_long(sheet, keys).withColumn("item", F.col(id_column).cast("string"))
    sendable = labelling.request_files(files)
    with_files = sendable.select("item").distinct().withColumn("has_files", F.lit(True))
    # Rows without an id take no part in the joins.
    nameless = long.where("item is null").select(*keys, "question", "answer")
    cells = long.where("item is not null").join(with_files, "item", "left")
    blank = questions.is_blank(F.col("answer"))
    key = F.to_json(F.struct(F.col("item").alias("i"), F.col("question").alias("q")))
    asked = cells.where(blank & F.col("has_files")).select("item", "question", key.alias("cell")).distinct()
    lists = listed_in_parts(sendable, ["item"], ["path"], F.col("path"), "paths")
    requests = asked.join(lists, "item").select(
        F.col("cell").alias("item"), "part", F.when(F.col("part") == 0, F.col("question")).otherwise("").alias("prompt"), "paths")
    replies = labelling.stored_answers(requests, make_client, parallelism, answers_path or _run_folder(sheet), attempts=1)
    # Filled cells keep what they hold, also where another row of the id has the answer.
    joined = cells.withColumn("cell", F.when(blank, key)).join(
        replies.select(F.col("item").alias("cell"), "response", "error"), "cell", "left")
    answer = (
        F.when(F.col("has_files").isNull(), "ERROR: No documents found.")
        .when(F.col("error").isNotNull(), F.concat(F.lit("ERROR: "), F.col("error")))
        .otherwise(F.coalesce("response", "answer"))
    )
    return joined.select(*keys, "question", answer.alias("answer")).unionAll(nameless)


def annotation_lookups(
    order: DataFrame, truth_rows: DataFrame, forms: DataFrame, participants: Sequence[str], info: Sequence[str] = (),
) -> dict[str, tuple[DataFrame, dict[str, int]]]:
    """The look-ups of the truth and of the forms, each made and written once, with counts of that
    pass: ``rows``, ``found`` and ``contradicting``."""
    made = {
        "ground truth": keypair.find_rows(order, truth_rows, ["label", *info]),
        "participant forms": keypair.annotations_long(order, forms, participants),
    }
    return {name: settled_with(
        found, rows=F.count("*"), found=F.count("found_row"),
        contradicting=F.count_if(F.col("outcome").isin(*keypair.ERRORS)),
    ) for name, found in made.items()}


def annotate(
    order: DataFrame, truth_rows: DataFrame, forms: DataFrame, participants: Sequence[str],
    info: Sequence[str] = (), expected_rows: int = 70,
) -> tuple[DataFrame, Mapping[str, int]]:
    """The annotator overview. Contradicting ids stop the job, a row count other than
    expected is only reported."""
    made = annotation_lookups(order, truth_rows, forms, participants, info)
    for name, (found, counts) in made.items():
        if counts["contradicting"]:
            keypair.require_clean(found, name)
    (entries, counts), (labels, _) = made.values()
    overview = keypair.overview_of(entries, labels, participants, info)
    return overview.orderBy("row_no"), {"rows": counts["rows"], "expected": expected_rows}


def zero_shot(
    items: DataFrame, truth_labels: DataFrame, labels: Sequence[str], make_client: Callable, parallelism: int,
    answers_path: str | None = None, system: str | None = None,
) -> dict[str, DataFrame]:
    """Name-only run with scoring: ``items(item, name)`` against ``truth_labels(item, ground_truth)``.

    Items without a name are not asked. Returns ``results`` and the counts of each pair of
    truth and label.
    """
    named = items.withColumn("name", text.cell_text(F.col("name")))
    requests = labelling.request_table(
        named.where("name <> ''").select("item", answers.question_name_only(F.col("name"), labels).alias("prompt")),
        items.limit(0).select("item", F.lit("").alias("path"), F.lit(0).cast("bigint").alias("length")),
    )
    replies = labelling.stored_answers(requests, make_client, parallelism, answers_path or _run_folder(items), system=system)
    label = answers.tolerant_label(F.col("response"), labels)
    predicted = (
        F.when(F.col("name") == "", "FEHLER: Kein Baugruppenname")
        .when(F.col("error").isNotNull(), F.concat(F.lit("FEHLER: "), F.col("error")))
        .otherwise(F.coalesce(label, F.lit(answers.UNRECOGNISED)))
    )
    results = named.join(replies, "item", "left").join(truth_labels, "item", "left").select(
        "item", "ground_truth", predicted.alias("predicted_label"), F.col("response").alias("raw_response"))
    return {"results": results, "counts": results.groupBy("ground_truth", "predicted_label").agg(F.count("*").alias("n"))}
