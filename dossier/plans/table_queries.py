"""Every operator as a query over the business tables; names match ``table_sql``."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions import answers, paths, text
from dossier.functions.class_rules import CLASSES, FEATURES, feature_label
from dossier.functions.ids import embedded_ids, fragments
from dossier.operators import (
    cascade, folders, inventory, keypair, labelling, manifests, metrics, questions, resolve,
    spread, truth,
)
from dossier.plans import jobs
from dossier.plans import table_inputs as given
from dossier.session import ensure_checkpoint_dir
from dossier.sources import listing, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else c for c in df.columns])


def _matched(spark, sf) -> DataFrame:
    return truth.match_predictions(given.line_predictions(spark, sf), given.order_truth(spark, sf))


# --- evaluation -----------------------------------------------------------------------

@query
def eval_matched_rows(spark, sf):
    return _matched(spark, sf)


@query
def eval_confusion(spark, sf):
    return metrics.confusion(_matched(spark, sf))


@query
def eval_confusion_wide(spark, sf):
    counts = metrics.confusion_of(spread.settled(metrics.outcomes(_matched(spark, sf))))
    labels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "UNRECOGNISED_RESPONSE"]
    wide = metrics.confusion_wide(counts, labels)
    return wide.toDF("model", "ground_truth", "urgent", "high", "medium", "unspecified", "low", "unrecognised")


@query
def eval_confusion_square(spark, sf):
    """Every cell of each model's matrix over its own labels."""
    return metrics.confusion_square(spread.settled(metrics.outcomes(_matched(spark, sf))))


@query
def eval_confusion_ranked(spark, sf):
    """The matrices with a column for each rank of a label."""
    return metrics.confusion_ranked(eval_confusion_square(spark, sf))


@query
def eval_per_class(spark, sf):
    return _rounded(metrics.per_class(metrics.confusion(_matched(spark, sf))))


@query
def eval_summary(spark, sf):
    return _rounded(metrics.model_summary(_matched(spark, sf)))


@query
def eval_run_counts(spark, sf):
    return metrics.run_counts(_matched(spark, sf))


@query
def model_ranking(spark, sf):
    ranked = metrics.model_ranking(metrics.summary(metrics.per_class(metrics.confusion(_matched(spark, sf)))))
    return _rounded(ranked.select("model", "macro_f1", "accuracy"))


@query
def label_order(spark, sf):
    return metrics.label_order(_matched(spark, sf))


@query
def eval_largest_axis(spark, sf):
    return _rounded(metrics.per_class(metrics.confusion(given.embedding_pairs(spark, sf))))


@query
def truth_lookup(spark, sf):
    return truth.truth_lookups(given.order_truth(spark, sf))


@query
def truth_conflicts(spark, sf):
    return truth.truth_conflicts(given.event_truth(spark, sf))


# --- ids and names --------------------------------------------------------------------

@query
def id_normalise(spark, sf):
    sources = [
        given.table(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("k"), F.concat(F.lit(" "), F.col("s_name"), F.lit("\t")).alias("raw")),
        given.table(spark, sf, "part").select(F.lit("part"), "p_partkey", "p_brand"),
        given.table(spark, sf, "orders").select(F.lit("orders"), "o_orderkey", F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit(".0"))),
        given.table(spark, sf, "events").select(F.lit("events"), "event_id", F.when(F.col("event_type") == "error", "NaN").otherwise(F.concat(F.col("event_type"), F.lit("_1")))),
    ]
    rows = sources[0]
    for other in sources[1:]:
        rows = rows.union(other)
    raw = F.col("raw")
    return rows.select(
        "source", "k", text.master_id(raw).alias("master"), text.plain_id(raw).alias("plain"),
        text.cell_text(raw).alias("cell"), text.cell_id(raw).alias("cell_key"),
        text.search_id(raw).alias("search"), text.sheet_key(raw).alias("sheet"),
        text.label_text(raw).alias("label"), text.header_key(raw).alias("header"),
    )


@query
def embedded_id_list(spark, sf):
    rows = given.order_folders(spark, sf)
    return rows.select("path", F.posexplode(embedded_ids(F.upper("folder"))).alias("pos", "id"))


@query
def id_fragments(spark, sf):
    rows = given.part_items(spark, sf).select("item", text.plain_id(F.col("teamcenter")).alias("tc"))
    return rows.select("item", F.posexplode(fragments(F.col("tc"))).alias("pos", "fragment"))


@query
def safe_names(spark, sf):
    pages = given.table(spark, sf, "pages")
    run = F.concat(F.lit("classification_all_files_"), text.safe_model_name(F.col("url")), F.lit("_2026-01-02_03-04-05.csv"))
    return pages.select(
        "page_id", text.safe_name(F.col("url")).alias("safe"), text.model_from_file(run).alias("model"),
        text.participant_from_file(F.concat(F.lit("Form_ - "), F.col("page_id").cast("string"), F.lit(".csv")), "Form_").alias("participant"),
    )


@query
def search_texts(spark, sf):
    docs = given.table(spark, sf, "documents")
    searched = text.search_text(F.col("text"))
    return docs.select("doc_id", F.length(searched).cast("bigint").alias("n"), F.sha2(searched, 256).alias("digest"),
                       text.contains_any(searched, ["license", "copyright", "ansicht"]).alias("hit"))


# --- folders and conflicts ------------------------------------------------------------

def _folder_matches(spark, sf) -> DataFrame:
    return folders.folder_matches(given.customer_items(spark, sf), given.order_folders(spark, sf))


def _matched_folders(spark, sf) -> DataFrame:
    return _folder_matches(spark, sf).where(F.col("status") == folders.MATCHED)


def _settled_folders(spark, sf) -> DataFrame:
    return spread.settled(_matched_folders(spark, sf))


@query
def folder_match(spark, sf):
    return _folder_matches(spark, sf)


@query
def unmatched_folders(spark, sf):
    rows = _folder_matches(spark, sf).where(F.col("status") == folders.UNMATCHED)
    return rows.select("category", "folder", "path")


@query
def ambiguous_ids(spark, sf):
    return folders.ambiguous_ids(given.customer_items(spark, sf))


@query
def duplicate_names(spark, sf):
    return folders.duplicate_names(_settled_folders(spark, sf))


@query
def several_folders(spark, sf):
    return folders.several_folders(_settled_folders(spark, sf))


@query
def ambiguous_id_rows(spark, sf):
    return folders.ambiguous_id_rows(given.customer_items(spark, sf))


@query
def duplicate_name_rows(spark, sf):
    return folders.duplicate_name_rows(_settled_folders(spark, sf))


@query
def several_folder_rows(spark, sf):
    return folders.several_folder_rows(_settled_folders(spark, sf))


@query
def missing_items(spark, sf):
    return folders.missing_items(given.customer_items(spark, sf), _matched_folders(spark, sf))


@query
def collect_gate(spark, sf):
    matches = spread.settled(_folder_matches(spark, sf))
    return folders.conflict_counts(given.customer_items(spark, sf), matches)


@query
def copy_plan(spark, sf):
    return folders.copy_plan(_settled_folders(spark, sf), "/data/processed", "conflicts")


@query
def match_cascade(spark, sf):
    return cascade.match_cascade(given.part_items(spark, sf), given.customer_folders(spark, sf))


@query
def match_two_tier(spark, sf):
    return cascade.match_two_tier(given.part_items(spark, sf), given.customer_folders(spark, sf))


@query
def two_tier_candidates(spark, sf):
    """Candidates of ambiguous items, every folder being there twice."""
    folders = given.customer_folders(spark, sf)
    twice = folders.union(folders.withColumn("folder", F.concat("folder", F.lit("-2"))))
    return cascade.two_tier_candidates(given.part_items(spark, sf), twice)


@query
def match_either(spark, sf):
    return cascade.match_either(given.part_items(spark, sf), given.customer_folders(spark, sf))


@query
def match_candidates(spark, sf):
    return cascade.candidate_folders(given.part_items(spark, sf), given.customer_folders(spark, sf))


@query
def match_by_name(spark, sf):
    items = given.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("sap"))
    names = given.table(spark, sf, "supplier").select(F.col("s_name").alias("folder"), F.col("s_suppkey").cast("string").alias("name"))
    return cascade.match_by_name(items, names)


# --- inventory ------------------------------------------------------------------------

def _listing(spark, sf) -> DataFrame:
    """The derived listing as a stored table in many parts, as a real listing would be."""
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.settled(given.line_files(spark, sf).repartition(parts, "rel_path"))


@query
def file_inventory(spark, sf):
    return inventory.inventory(_listing(spark, sf))


@query
def file_inventory_older(spark, sf):
    return inventory.inventory(given.line_files(spark, sf), older=True)


@query
def type_counts(spark, sf):
    return inventory.type_counts(inventory.typed_files(given.line_files(spark, sf)))


@query
def priority_summary(spark, sf):
    return inventory.priority_summary(
        inventory.inventory(_listing(spark, sf)), given.supplier_folders(spark, sf)
    )


@query
def skip_reasons(spark, sf):
    return inventory.eligibility(given.line_files(spark, sf)).select("assembly", "rel_path", "skip_reason")


@query
def skip_counts(spark, sf):
    return inventory.skip_counts(given.line_files(spark, sf))


@query
def supported_counts(spark, sf):
    return inventory.supported_counts(given.line_files(spark, sf))


@query
def category_folders(spark, sf):
    return inventory.category_folders(given.page_paths(spark, sf))


@query
def directory_index(spark, sf):
    return inventory.directory_index(given.page_paths(spark, sf))


def _resolved(spark, sf) -> DataFrame:
    files = _listing(spark, sf)
    typed = inventory.typed_files(files).withColumn(
        "file_path", F.concat(F.lit("/old/"), "assembly", F.lit("/"), "rel_path")
    )
    # One pass over the listing: every file below today's root, the old one or both.
    def below(root: str, there: Column) -> Column:
        return F.struct(there.alias("there"), F.concat(F.lit(root), "assembly", F.lit("/"), "rel_path").alias("path"))

    places = F.array(below("/data/", F.col("line_status") == "F"), below("/old/", F.col("flag") == "A"))
    existing = files.select(F.inline(places)).where("there").select("path")
    return resolve.resolve_files(typed, existing, "/data")


@query
def resolved_files(spark, sf):
    return _resolved(spark, sf)


@query
def resolved_file_lists(spark, sf):
    return resolve.file_lists(spread.settled(_resolved(spark, sf)))


@query
def precheck(spark, sf):
    """Status of every assembly before requests are made, first for its files, then its name."""
    counts = resolve.file_counts(_resolved(spark, sf))
    suppliers = given.table(spark, sf, "supplier").select(
        given.padded("A", "s_suppkey", 6).alias("assembly"),
        F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("s_name")).alias("name"),
    )
    rows = suppliers.join(counts, "assembly", "left").na.fill(0, ["existing", "missing"])
    status = answers.precheck_status(F.col("name"), F.col("assembly"), F.lit("EXACT_SAP"), F.col("existing"), F.col("missing"))
    return rows.select("assembly", "existing", "missing", status.alias("status"))


@query
def request_table(spark, sf):
    prompts = given.table(spark, sf, "supplier").select(
        given.padded("A", "s_suppkey", 6).alias("item"),
        answers.question_all_files(F.col("s_name"), CLASSES).alias("prompt"),
    )
    files = _listing(spark, sf).select(F.col("assembly").alias("item"), F.col("rel_path").alias("path"), "length")
    requests = labelling.request_table(prompts, files)
    return requests.withColumn("paths", F.array_join("paths", "\n"))


# --- manifests ------------------------------------------------------------------------

@query
def pdf_manifest(spark, sf):
    return manifests.pdf_manifest(given.document_pages(spark, sf))


@query
def assembly_manifest(spark, sf):
    return manifests.assembly_manifest(manifests.pdf_manifest(given.document_pages(spark, sf)))


@query
def batch_manifest(spark, sf):
    pdfs = manifests.pdf_manifest(given.document_pages(spark, sf))
    return manifests.batch_manifest(manifests.assembly_manifest(pdfs))


@query
def manifest_round_trip(spark, sf):
    """Manifests of three levels written as documents, one more file spoilt, and all read back."""
    path = _shared_folder(spark)
    pages = given.document_pages(spark, sf)
    sources = given.document_sources(spark, sf).select(F.concat("source_pdf_name", F.lit(".pdf")).alias("pdf"), "source_sha256", "dpi", "image_format", "max_side_px")
    settings = pages.select("assembly", "pdf").distinct().join(sources, "pdf")
    sinks.write_manifests(manifests.nested_manifests(pages, settings), f"{path}/good")
    spoilt = given.table(spark, sf, "region").select(F.concat(F.lit('{"assembly": "'), "r_name", F.lit('", "pdfs": [{')).alias("value"))
    spoilt.write.text(f"{path}/spoilt")
    good, bad = listing.read_documents(spark, path, manifests.NESTED_SCHEMA)
    columns = ["assembly", "part", "pdf", "source_sha256", "dpi", "page_number", "image_path", "file_size_bytes"]
    lost = bad.select(*[F.col("line").alias(c) if c == "assembly" else F.lit(None).alias(c) for c in columns], F.lit(False).alias("readable"))
    return manifests.pages_of(good).select(*columns, F.lit(True).alias("readable")).unionByName(lost)


@query
def hash_versions(spark, sf):
    """Hashes of files that come in two deliveries; the second run reads the new ones only."""
    root = _shared_folder(spark)
    lines = given.table(spark, sf, "documents").select(
        F.pmod("doc_id", F.lit(20)).alias("box"), "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("value")
    )
    for run in range(2):
        some = lines.where(F.col("box") % 2 == run).repartition("box").sortWithinPartitions("box", "doc_id")
        some.select("box", "value").write.mode("append").partitionBy("box").text(f"{root}/files")
        version = listing.hash_table(spark, f"{root}/files", f"{root}/hashes", "*.txt")
    box = F.regexp_extract("path", r"box=(\d+)", 1).cast("bigint")
    return listing.known_hashes(spark, f"{root}/hashes", version).select(box.alias("box"), "length", "sha256", "version")


@query
def image_batches(spark, sf):
    batches = manifests.image_batches(given.document_pages(spark, sf))
    return batches.withColumn("images", F.array_join("images", "\n"))


@query
def first_pages(spark, sf):
    return manifests.first_pages(given.document_pages(spark, sf)).select("assembly", "pdf", "page_number")


@query
def stale_sources(spark, sf):
    return manifests.stale_sources(
        given.document_sources(spark, sf), given.document_manifests(spark, sf), given.document_images(spark, sf)
    )


@query
def changed_files(spark, sf):
    docs = given.table(spark, sf, "documents").select(
        F.col("doc_id").alias("path"), F.length("text").cast("bigint").alias("length"), F.col("n_chars").alias("mtime")
    )
    known = given.table(spark, sf, "documents").select(
        F.col("doc_id").alias("path"),
        F.length(F.when(F.col("lang") == "fr", F.concat("text", F.lit("."))).otherwise(F.col("text"))).cast("bigint").alias("length"),
        F.col("n_chars").alias("mtime"),
    )
    return manifests.changed_files(docs, known)


@query
def turn_batches(spark, sf):
    turns = given.table(spark, sf, "conversations")
    batches = spread.listed_in_parts(turns, ["conv_id"], ["turn"], F.concat_ws(":", F.col("turn").cast("string"), "role"), "turns", 5)
    return batches.withColumn("turns", F.array_join("turns", ","))


@query
def running_position(spark, sf):
    rows = given.table(spark, sf, "events").select("event_id", "user_id")
    placed = spread.numbered(rows, ["user_id"], ["event_id"])
    return placed.withColumn("total", F.count("*").over(Window.partitionBy("user_id")))


# --- labelling ------------------------------------------------------------------------

@query
def canonical_labels(spark, sf):
    raw = F.col("raw")
    return given.order_answers(spark, sf).select(
        "item", answers.tolerant_label(raw, CLASSES).alias("tolerant"),
        answers.strict_label(raw, CLASSES).alias("strict"),
        answers.strict_label(raw, CLASSES, True).alias("strict_fallback"),
        answers.checked_label(raw, CLASSES).alias("checked"),
        answers.rejection_reason(raw, CLASSES).alias("reason"),
    )


@query
def feature_labels(spark, sf):
    return given.part_names(spark, sf).select("item", feature_label(F.col("name")).alias("label"))


@query
def prompts(spark, sf):
    return given.part_names(spark, sf).select(
        "item", answers.question_all_files(F.col("name"), CLASSES).alias("all_files"),
        answers.question_name_only(F.col("name"), CLASSES).alias("name_only"),
    )


def offline_client(features=FEATURES, combined=CLASSES[3], fallback=answers.NOT_CLASSIFIABLE):
    """Labelling function for runs without a service: the word rules on the prompt's name."""
    def make_client():
        def answer(prompt, _paths, _system=None):
            # The name stands behind a colon, on its line or on the next.
            name = prompt.split(": ", 1)[1] if prompt.startswith("Baugruppenbenennung: ") else prompt.split(":\n", 1)[1]
            name = name.split("\n", 1)[0].casefold()
            hits = [label for label, words in features.items() if any(w in name for w in words)]
            label = hits[0] if len(hits) == 1 else combined if hits else fallback
            return f"`{label.lower()}`", {"totalTokenCount": len(prompt)}

        return answer

    return make_client


def _labelled(spark, sf) -> DataFrame:
    names = given.part_names(spark, sf).where(text.strip(F.col("name")) != "")
    requests = names.select(
        "item", answers.question_all_files(F.col("name"), CLASSES).alias("prompt"),
        F.lit(0).alias("part"), F.expr("array()").cast("array<string>").alias("paths"),
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A first run answers some items; the second goes on with the stored answers.
    path = _shared_folder(spark)
    some = requests.where(F.crc32("item") % 3 == 0)
    labelling.stored_answers(some, offline_client(), tasks, path, wait_seconds=0)
    return labelling.stored_answers(requests, offline_client(), tasks, path, wait_seconds=0, system=answers.SYSTEM_PROMPT)


@query
def label_batch(spark, sf):
    """All named parts through the labelling function; nameless ones are skipped, not dropped."""
    done = _labelled(spark, sf).select("item", "response", "error", "attempts", "usage")
    rows = given.part_names(spark, sf).join(done, "item", "left")
    label = answers.tolerant_label(F.col("response"), CLASSES)
    status = answers.run_status(F.lit(True), F.col("name"), F.lit(1), F.lit("EXACT_ASSEMBLY_ID"), F.col("response"), F.col("error"), label)
    return rows.select(
        "item", F.when(F.col("response").isNotNull(), F.coalesce(label, F.lit(answers.UNRECOGNISED))).alias("predicted_label"),
        status.alias("status"), "attempts", F.col("usage")["totalTokenCount"].alias("tokens"),
    )


@query
def zero_shot_score(spark, sf):
    """Name-only run with inline scoring against the kind of part as truth."""
    truth_label = F.when(F.col("p_type") == "SMALL", CLASSES[2]).when(F.col("p_type") == "LARGE", CLASSES[4]).otherwise(CLASSES[0])
    known = given.table(spark, sf, "part").select(F.concat(F.lit("item"), F.col("p_partkey").cast("string")).alias("item"), truth_label.alias("ground_truth"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = jobs.zero_shot(given.part_names(spark, sf), known, CLASSES, offline_client(), tasks, system=answers.SYSTEM_PROMPT)
    return run["counts"]


@query
def report_round_trip(spark, sf):
    """A report with fixed columns as text files, read back as a table of text."""
    path = _shared_folder(spark)
    rows = given.table(spark, sf, "supplier").withColumn("note", F.concat(F.lit('said "'), "s_name", F.lit('"')))
    sinks.write_report(rows, path, ["s_suppkey", "s_name", "note", "s_nationkey"], "csv")
    return tables.read_text_table(spark, path).select("s_suppkey", "s_name", "note", "s_nationkey")


@query
def numbered_lists(spark, sf):
    """Lists written as a file for each nation and read back with the rows' numbers there."""
    path = _shared_folder(spark)
    rows = given.table(spark, sf, "customer").select(
        "c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.concat(F.lit('"'), "c_name", F.lit('", c'))).alias("c_name")
    )
    order = ["c_nationkey", "c_custkey"]
    rows.repartition("c_nationkey").sortWithinPartitions(*order).write.partitionBy("c_nationkey").csv(path, header=True, escape='"')
    return tables.read_text_table(spark, path, row_no="row_no").select(F.col("c_nationkey").cast("int").alias("nation"), "row_no", "c_custkey", "c_name")


@query
def tables_round_trip(spark, sf):
    """Result tables of a run, one of them by model, read back from the run's folders."""
    root = _shared_folder(spark)
    counted = spread.settled(metrics.outcomes(_matched(spark, sf)))
    sinks.write_tables({"confusion": metrics.confusion_of(counted), "coverage": metrics.run_counts_of(counted)}, root, "r1", ["confusion"])
    counts = spark.read.parquet(f"{root}/confusion").where("run_id = 'r1'").select("model", "ground_truth", "predicted_label", "n")
    coverage = spark.read.parquet(f"{root}/coverage").where("run_id = 'r1'").select(
        "model", F.lit(None).cast("string").alias("ground_truth"), F.lit(None).cast("string").alias("predicted_label"), F.col("prediction_rows").alias("n")
    )
    return counts.unionByName(coverage)


@query
def log_round_trip(spark, sf):
    """A response log appended to by two runs and read back."""
    path = _shared_folder(spark)
    rows = given.table(spark, sf, "events").select("event_id", "event_type", "user_id")
    for run in range(2):
        sinks.append_log(rows.where(F.col("event_id") % 2 == run).withColumn("run", F.lit(run)), path)
    return spark.read.schema("event_id bigint, event_type string, user_id bigint, run int").json(path)


@query
def response_log(spark, sf):
    """What two labelling runs sent and received, appended to one log and read back."""
    root, tasks = _shared_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = given.part_names(spark, sf).where(text.strip(F.col("name")) != "")
    prompts = names.select("item", answers.question_all_files(F.col("name"), CLASSES).alias("prompt"))
    files = given.part_files(spark, sf).withColumn("item", F.concat(F.lit("item"), F.substring("item", 3, 8).cast("bigint").cast("string")))
    requests = spread.settled(labelling.request_table(prompts, files, files_per_part=2))
    for run in range(2):
        asked = requests.where(F.right("item", F.lit(1)).cast("int") % 2 == run)
        replies = labelling.stored_answers(asked, offline_client(), tasks, f"{root}/answers", wait_seconds=0)
        label = answers.tolerant_label(F.col("response"), CLASSES)
        none = F.lit(None).cast("string")
        results = replies.join(names, "item").select(
            "item", none.alias("sap"), F.col("item").alias("teamcenter"), "name", none.alias("matched_folder"),
            F.col("response").alias("raw_response"), F.coalesce(label, F.lit("")).alias("label"),
            F.lit("SUCCESS").alias("status"), F.col("error").alias("error_message"),
        )
        sinks.append_log(labelling.response_log(asked, results, {"run": f"r{run}"}), f"{root}/log")
    log = spark.read.schema(
        "run string, item string, part bigint, prompt string, file_paths array<string>, teamcenter string, "
        "name string, raw_response string, canonical_label string, status string, error string"
    ).json(f"{root}/log")
    return log.withColumn("file_paths", F.array_join("file_paths", "\n")).drop("teamcenter")


@query
def response_texts(spark, sf):
    rows = given.event_responses(spark, sf).withColumn("r", answers.parse_response(F.col("raw_json")))
    return rows.select(
        "event_id", answers.response_text(F.col("r")).alias("first_text"),
        answers.response_text_joined(F.col("r")).alias("joined_text"),
        answers.token_usage(F.col("r"))["totalTokenCount"].alias("total_tokens"),
    )


@query
def block_texts(spark, sf):
    """Texts of answers that come as blocks."""
    events = given.table(spark, sf, "events")
    blocks = F.when(F.col("event_type") != "error", F.array(F.struct(F.col("event_type").alias("text"))))
    parsed = answers.parse_response(F.to_json(F.struct(F.coalesce(blocks, F.array().cast("array<struct<text:string>>")).alias("content"))))
    return events.select("event_id", answers.block_text(parsed).alias("block_text"))


@query
def token_usage(spark, sf):
    rows = given.event_responses(spark, sf).withColumn("r", answers.parse_response(F.col("raw_json")))
    return labelling.usage_by_model(rows.select("model", answers.token_usage(F.col("r")).alias("usage")))


@query
def resume(spark, sf):
    """Requests left after a run that finished the larger purchases and sign-ups."""
    events = given.table(spark, sf, "events")
    requests = events.select("event_id", "event_type", "user_id")
    done = events.where("event_type in ('purchase', 'signup') and value > 5").select("event_id", "event_type")
    return labelling.pending(requests, done, ["event_id", "event_type"])


@query
def first_rows(spark, sf):
    """A pilot run: the first 20 rows of the list in its own order."""
    return given.customer_items(spark, sf).where("row_no <= 21").orderBy("row_no")


# --- forms and sheets -----------------------------------------------------------------

@query
def intersection_match(spark, sf):
    long = keypair.annotations_long(
        given.customer_order_form(spark, sf).drop("label"), given.order_forms(spark, sf), given.PARTICIPANTS
    )
    return long.select("row_no", "participant", "outcome", "found_row", "found_label")


@query
def annotation_overview(spark, sf):
    wide = keypair.annotation_overview(
        given.customer_order_form(spark, sf).drop("label"), given.customer_truth(spark, sf),
        given.order_forms(spark, sf), given.PARTICIPANTS,
    )
    return wide.toDF(*[c.lower() for c in wide.columns])


@query
def annotation_counts(spark, sf):
    """Rows of the overview's look-ups, found and contradicting ones, as the writing pass counts them."""
    made = jobs.annotation_lookups(
        given.customer_order_form(spark, sf).drop("label"), given.customer_truth(spark, sf),
        given.order_forms(spark, sf), given.PARTICIPANTS,
    )
    rows = [(source, counts["rows"], counts["found"], counts["contradicting"]) for source, (_, counts) in made.items()]
    return spark.createDataFrame(rows, "source string, rows_seen bigint, rows_found bigint, rows_contradicting bigint")


@query
def question_cells(spark, sf):
    return questions.to_long(given.part_questions(spark, sf), ["p_partkey", "id"])


@query
def open_questions(spark, sf):
    long = questions.to_long(given.part_questions(spark, sf), ["p_partkey", "id"])
    return questions.open_questions(long, "id").select("p_partkey", "question")


@query
def expected_calls(spark, sf):
    return questions.expected_calls(questions.to_long(given.part_questions(spark, sf), ["p_partkey", "id"]), "id")


@query
def questions_answered(spark, sf):
    """Blank cells filled in, the sheet made wide again."""
    long = questions.to_long(given.part_questions(spark, sf), ["p_partkey", "id"])
    blank = F.col("id").isNotNull() & questions.is_blank(F.col("answer"))
    filled = long.withColumn("answer", F.when(blank, F.concat(F.lit("? "), "question")).otherwise(F.col("answer")))
    return questions.to_wide(filled, ["p_partkey", "id"], given.QUESTIONS).toDF("p_partkey", "id", "brand", "kind", "price")


def file_counter(name: str, most: int):
    """Answering function for runs without a service: names itself, the question and the first file."""
    def make_client():
        def answer(prompt, file_paths):
            if len(file_paths) > most:
                raise RuntimeError("too many files")
            return f"{name}: {prompt} {len(file_paths)} {file_paths[0]}"

        return answer

    return make_client


@query
def questions_asked(spark, sf):
    """A question sheet asked in two runs, the second of which goes on with the answers of the
    first, and made wide again. Some rows have no files, some too many for the service."""
    sheet, files = given.part_questions(spark, sf), given.part_files(spark, sf)
    path, tasks = _shared_folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = sheet.where("p_partkey % 2 = 0")
    jobs.answer_questions(some, "id", files, file_counter("first", 2), tasks, path, ["p_partkey"])
    long = jobs.answer_questions(sheet, "id", files, file_counter("second", 2), tasks, path, ["p_partkey"])
    return questions.to_wide(long, ["p_partkey", "id"], given.QUESTIONS).toDF("p_partkey", "id", "brand", "kind", "price")


@query
def unified_headers(spark, sf):
    """Three tables with different headers in one schema."""
    frames = [
        given.table(spark, sf, "customer").select(F.col("c_name").alias("SAP-Nummer"), F.col("c_mktsegment").alias("Ground_Truth")),
        given.table(spark, sf, "supplier").select(F.col("s_name").alias("ID"), F.col("s_nationkey").alias("Funktionsklasse"), F.col("s_suppkey").alias("TC-ID")),
        given.table(spark, sf, "part").select(F.col("p_type").alias("Functional class"), F.col("p_brand").alias("BG"), F.col("p_name").alias("ground truth")),
    ]
    wanted = {"sap": tables.SAP_HEADERS, "teamcenter": tables.TC_HEADERS, "label": tables.TRUTH_HEADERS}
    return tables.union_resolved(frames, wanted, required=["sap", "label"])


def _shared_folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid4().hex}"


@query
def predictions_from_files(spark, sf):
    """Predictions written as sets of files by model, with other headers, and read back in one
    go. Some cells hold line breaks and quotes."""
    root = _shared_folder(spark)
    headers = [("SAP-Nummer", "Teamcenter ID", "Predicted_Label"), ("ID", "TC-ID", "Prediction"), ("BG", "TC Nummer", "Vorhersage")]
    rows = given.line_predictions(spark, sf).withColumn("kind", F.pmod(F.crc32("model"), F.lit(len(headers))))
    broken = F.when(F.col("row_no") % 5 == 0, F.concat("predicted", F.lit(' "weil"\nso'))).otherwise(F.col("predicted"))
    for kind, (sap, tc, label) in enumerate(headers):
        rows.where(F.col("kind") == kind).select(
            broken.alias(label), F.col("sap").alias(sap), F.col("model").alias("Run_Model"), F.col("teamcenter").alias(tc), "model",
        ).write.partitionBy("model").csv(f"{root}/{kind}", header=True, escape='"')
    read = tables.read_predictions(spark, f"{root}/*/*/*.csv", multi_line=True)
    return read.select("model", "sap", "teamcenter", "predicted")


@query
def forms_from_files(spark, sf):
    """Participants' forms written as files named after them and read back."""
    root = _shared_folder(spark)
    forms = given.order_forms(spark, sf)
    for participant in given.PARTICIPANTS:
        forms.where(F.col("participant") == participant).select(
            F.col("sap").alias("sap nummer"), F.col("teamcenter").alias("TEAMCENTER-ID"), F.col("label").alias("Baugruppen-Klasse")
        ).write.csv(f"{root}/Form_{participant}", header=True, escape='"')
    read = tables.read_many(
        spark, f"{root}/*/*.csv", {"sap": ("SAP-Nummer",), "teamcenter": ("Teamcenter ID",), "label": ("Baugruppen-Klasse",)},
        normalised=True, required=["label"],
    )
    return read.select("sap", "teamcenter", "label")


@query
def participant_forms(spark, sf):
    """Forms in files named after their participants, with other headers, beside lock files and
    files that are no forms; read back with the participant of each."""
    root = _shared_folder(spark)
    forms = given.order_forms(spark, sf).select("participant", "sap", "teamcenter", "label")
    sinks.write_named(forms, root, "participant", "Form_{}.csv", {"sap": "SAP Nummer", "teamcenter": "teamcenter-id", "label": "Baugruppen Klasse"})
    sinks.write_named(forms.limit(1), root, "participant", "~$Form_{}.csv", {"sap": "locked"})
    sinks.write_named(forms.limit(1), root, "participant", "Notes_{}.csv", {"sap": "seen"})
    return tables.read_forms(spark, f"{root}/*/*.csv", "Form_").drop("row_no")


@query
def run_stamps(spark, sf):
    """Time texts of every event."""
    in_utc = F.concat(F.col("ts").cast("string"), F.lit("+00:00")).cast("timestamp")
    return given.table(spark, sf, "events").select(
        "event_id", text.stamp_text(F.col("ts").cast("timestamp")).alias("local"),
        text.utc_stamp_text(in_utc).alias("utc"))


@query
def class_list(spark, sf):
    parts = given.table(spark, sf, "part").select(F.concat(F.lit(" "), F.when(F.col("p_size") > 5, F.col("p_name")).otherwise(" ")).alias("label"), "p_partkey")
    return tables.class_list(parts, "label", "p_partkey")


@query
def rows_below_header(spark, sf):
    return tables.rows_below_header(given.customer_cells(spark, sf), "Funktionsklasse", "HOUSEHOLD")


@query
def path_parts(spark, sf):
    files = given.line_files(spark, sf)
    name = paths.file_name(F.col("rel_path"))
    return files.select(
        "assembly", "rel_path", paths.suffix(name).alias("ext"), paths.stem(name).alias("stem"),
        paths.media_type(paths.suffix(name)).alias("media"),
        paths.current_path(F.lit("/data"), F.col("assembly"), paths.parent_dir(F.col("rel_path")), name).alias("current"),
    )
