"""The operators' input tables, derived from the generic business tables by expressions only.

Every function uses all rows of its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.class_rules import CLASSES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(prefix: str, c: str, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(c).cast("string"), width, "0"))


def order_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ground truth: numeric ids with ``.0``, pending orders without a label."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_no"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("sap"),
        F.concat(F.lit("T-"), F.col("o_orderkey").cast("string")).alias("teamcenter"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("label"),
    )


def line_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as predictions of three models (by return flag) for the order's label."""
    key = F.col("l_orderkey").cast("string")
    guess = (
        F.when(F.round(F.col("l_discount") * 100) == 0, F.lit(None).cast("string"))
        .when(F.round(F.col("l_tax") * 100) == 8, "UNRECOGNISED_RESPONSE")
        .when(F.col("l_quantity") <= 10, "1-URGENT").when(F.col("l_quantity") <= 20, "2-HIGH")
        .when(F.col("l_quantity") <= 30, "3-MEDIUM").when(F.col("l_quantity") <= 40, "4-NOT SPECIFIED")
        .otherwise("5-LOW")
    )
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("model_"), F.col("l_returnflag")).alias("model"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("row_no"),
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("X"), key))
        .when(F.col("l_linestatus") == "F", key).alias("sap"),
        F.when(F.col("l_linenumber") != 7, F.concat(F.lit(" t"), key)).alias("teamcenter"),
        guess.alias("predicted"),
    )


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and largest axis of every vector as a matched row of one model."""
    largest = F.array_position("embedding", F.array_max("embedding")) - 1
    return table(spark, sf_dir, "embeddings").select(
        F.lit("largest_axis").alias("model"), F.col("vec_id").alias("prediction_row"),
        F.col("label").cast("string").alias("ground_truth"),
        (largest % 10).cast("string").alias("predicted_label"),
        F.lit("SAP").alias("match_method"),
    )


def event_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as truth rows: a user and a property value each carry several event types."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_no"), F.col("user_id").cast("string").alias("sap"),
        F.concat(F.lit("K"), F.get_json_object("props", "$.k")).alias("teamcenter"),
        F.col("event_type").alias("label"),
    )


def customer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a master list: own 10-character id, and the nation's id on many rows."""
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 2).alias("row_no"), padded(" c", "c_custkey", 9).alias("sap"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(padded("N", "c_nationkey", 9))
        .alias("teamcenter"),
    )


def order_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as folders whose names carry ids in five different ways."""
    owner, other = padded("C", "o_custkey", 9), padded("C", "o_orderkey", 9)
    month = F.lpad(F.month("o_orderdate").cast("string"), 9, "0")
    priority = F.col("o_orderpriority")
    folder = (
        F.when(priority == "1-URGENT", owner)
        .when(priority == "2-HIGH", F.lower(F.concat(F.lit("bg_"), owner, F.lit("_rev a"))))
        .when(priority == "3-MEDIUM", F.concat(owner, F.lit("-"), other))
        .when(priority == "4-NOT SPECIFIED", F.concat(F.lit("X"), owner, F.lit("Y")))
        .otherwise(F.concat(F.lit("N"), month, F.lit(" "), owner))
    )
    category = F.concat(F.lit("status_"), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        category.alias("category"), folder.alias("folder"),
        F.concat_ws("/", F.lit("raw"), F.col("o_orderkey").cast("string"), category, folder).alias("path"),
    )


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as list items with two ids, some without the first, the second or both."""
    kind = F.col("p_type")
    none = (kind == "MEDIUM") & (F.col("p_size") <= 5)
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("item"), F.col("p_partkey").cast("string")).alias("item"),
        F.when((kind == "SMALL") | none, "").otherwise(padded("PX", "p_partkey", 8)).alias("sap"),
        F.when((kind == "PROMO") | none, "").otherwise(padded("as-", "p_partkey", 8)).alias("teamcenter"),
    )


def customer_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as folders named after the part of the same number in six ways."""
    sap, tc = padded("PX", "c_custkey", 8), padded("AS", "c_custkey", 8)
    number = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    segment = F.col("c_mktsegment")
    name = (
        F.when(F.col("c_acctbal") < 0, F.concat(sap, F.lit("_"), tc))
        .when(segment == "BUILDING", sap)
        .when(segment == "AUTOMOBILE", F.concat(F.lit("BG_"), sap, F.lit("_REV_A")))
        .when(segment == "MACHINERY", F.lower(tc))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("DOC-"), tc, F.lit("-B")))
        .otherwise(F.concat(F.lit("REF_S"), number))
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(name, F.lit("#"), F.col("c_custkey").cast("string")).alias("folder"),
        name.alias("name"),
    )


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files of the supplier's assembly folder."""
    percent = F.round(F.col("l_discount") * 100).cast("int")
    directories = ["", "BOM/", "cad-zugriff/", "Datenblatt/", "Ansichten/", "alt/_LLM_IGNORE/", ".alt/"]
    suffixes = [".pdf", ".PNG", ".jpg", ".xlsx", ".step", ".idw", ".docx", ".png", ".jpeg", ".csv", ""]
    band = F.floor((F.col("l_quantity") - 1) / 10).cast("int")
    stems = {
        "AF": ["x_TLF", "x_TRF", "front", "oben_links", "DFC_Struktur"],
        "AO": ["x_BRB", "x_BLB", "hinten", "unten-rechts", "front"],
        "NF": ["Zeichnung", "plan", "x_TLB", "top", "rear_left"],
        "NO": ["plan", "rechts", "TLFX", "Strukturbaum", "vorne_oben"],
        "RF": ["x_BLF", "x_BRF", "links", "view", "Datasheet"],
        "RO": ["~$lock", "front", "x_TRB", "bottom", "Stückliste"],
    }
    flags = F.concat("l_returnflag", "l_linestatus")
    stem_table = F.create_map(
        *[x for key, names in stems.items()
          for x in (F.lit(key), F.array(*[F.lit(n) for n in names]))]
    )
    name = F.concat(
        F.element_at(stem_table[flags], band + 1), F.lit("_"),
        F.concat_ws("_", *[F.col(c).cast("int").cast("string")
                           for c in ("l_orderkey", "l_partkey", "l_quantity")]),
        F.element_at(F.array(*[F.lit(s) for s in suffixes]), percent + 1),
    )
    directory = F.element_at(F.array(*[F.lit(d) for d in directories]), F.col("l_linenumber"))
    length = F.when(F.round(F.col("l_tax") * 100) == 0, F.lit(0)).otherwise(
        F.floor(F.col("l_extendedprice") * 300)
    ).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        padded("A", "l_suppkey", 6).alias("assembly"), F.concat(directory, name).alias("rel_path"),
        length.alias("length"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line_status"),
    )


def supplier_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(padded("A", "s_suppkey", 6).alias("assembly"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as paths: host, then directories, without scheme, query and anchor."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("url", r"^https?://|[?#].*$", "").alias("path")
    )


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDFs of their source, one page per started 1000 characters."""
    text = F.col("text")
    last = F.greatest(F.lit(1), F.ceil(F.length(text) / 1000).cast("int"))
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "source", "text", F.explode(F.sequence(F.lit(1), last)).alias("page_number"))
        .select(
            F.col("source").alias("assembly"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("pdf"),
            "page_number", F.format_string("page_%03d.png", "page_number").alias("image_path"),
            F.lit(2000).alias("width_px"), F.lit(3000).alias("height_px"),
            F.length(F.substring(text, (F.col("page_number") - 1) * 1000 + 1, F.lit(1000)))
            .cast("bigint").alias("file_size_bytes"),
        )
    )


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with content hash and render settings as they are now."""
    spanish = F.col("lang") == "es"
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("source_pdf_name"),
        F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"), F.lit(200).alias("dpi"),
        F.lit("png").alias("image_format"), F.when(~spanish, F.lit(3000)).alias("max_side_px"),
    )


def document_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of an earlier run: French texts have changed since, German ones were
    rendered at 150 dpi, and source src3 used another longest side."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("lang") == "fr", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    last = F.greatest(F.lit(1), F.ceil(F.length("text") / 1000).cast("int"))
    side = F.when(F.col("source") == "src3", F.lit(2000)).when(F.col("lang") != "es", F.lit(3000))
    doc = F.col("doc_id").cast("string")
    return docs.select(
        F.col("doc_id").alias("path"), F.concat(F.lit("Doc "), doc).alias("source_pdf_name"),
        F.sha2(text.cast("binary"), 256).alias("source_sha256"),
        F.when(F.col("lang") == "de", 150).otherwise(200).alias("dpi"),
        F.lit("png").alias("image_format"), side.alias("max_side_px"),
        F.transform(F.sequence(F.lit(1), last), lambda n: F.concat(doc, F.lit("/"), n.cast("string"))).alias("images"),
    )


def document_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that exist: source src5 lost its second pages."""
    rows = document_manifests(spark, sf_dir).join(
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "source"), "path"
    ).select("source", F.posexplode("images").alias("at", "image"))
    return rows.where(~((F.col("source") == "src5") & (F.col("at") == 1))).select("image")


def order_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text answers as a model gives them: exact, quoted, wordy, double, failed."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    label = F.element_at(names, F.substring("o_orderpriority", 1, 1).cast("int"))
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    raw = (
        F.when(price > 450000, F.concat(label, F.lit(" oder Roboter")))
        .when(price < 10000, "HTTP error 400: bad request")
        .when(price < 20000, " nicht klassifizierbar ")
        .when(status == "F", label)
        .when(status == "O", F.concat(F.lit("`"), F.lower(label), F.lit("`\n")))
        .when(price > 250000, F.concat(F.lit('"'), label, F.lit('"')))
        .otherwise(F.concat(F.lit("Die Klasse ist "), label, F.lit(".")))
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), raw.alias("raw"))


PART_WORDS = {
    "ring": "Greifbacke", "bolt": "Spindel", "plate": "Portal", "rod": "Hubachse",
    "gear": "Drehteller", "gizmo": "Roboterarm", "anvil": "Klemmhalter mit Schwenkeinheit",
}


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as named items: the noun becomes a feature word; widgets have none."""
    words = F.create_map(*[F.lit(x) for pair in PART_WORDS.items() for x in pair])
    noun = F.element_at(F.split("p_name", " "), -1)
    named = F.concat_ws(" ", F.element_at(F.split("p_name", " "), 1), F.coalesce(words[noun], noun))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("item"), F.col("p_partkey").cast("string")).alias("item"),
        F.when(F.col("p_size") == 50, "  ").otherwise(named).alias("name"),
    )


def event_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged service responses in JSON, errors without text."""
    body = F.to_json(F.struct(
        F.array(F.struct(
            F.struct(F.when(F.col("event_type") != "error", F.array(
                F.struct(F.lit(None).cast("string").alias("text")),
                F.struct(F.col("event_type").alias("text")),
                F.struct(F.lit("!").alias("text")))).alias("parts")).alias("content"),
            F.when(F.col("event_type") == "error", "SAFETY").alias("finishReason"))).alias("candidates"),
        F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("totalTokenCount"),
                 F.col("user_id").alias("promptTokenCount")).alias("usageMetadata"),
    ))
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("m_"), F.col("event_type")).alias("model"), body.alias("raw_json")
    )


def customer_order_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_no"),
        F.when(F.col("c_mktsegment") == "FURNITURE", " ").otherwise(F.col("c_name")).alias("sap"),
        padded("D", "c_nationkey", 2).alias("teamcenter"), F.col("c_mktsegment").alias("label"),
    )


def customer_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_no"), F.col("c_name").alias("sap"),
        F.lit("").alias("teamcenter"), F.col("c_mktsegment").alias("label"),
    )


PARTICIPANTS = ["TN_A_F", "TN_A_O", "TN_B_P"]


def order_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filled-in forms of three participants (by order status)."""
    side = F.when(F.col("o_orderstatus") == "P", "TN_B_").otherwise("TN_A_")
    return table(spark, sf_dir, "orders").select(
        F.concat(side, F.col("o_orderstatus")).alias("participant"), F.col("o_orderkey").alias("row_no"),
        padded("Customer#", "o_custkey", 9).alias("sap"),
        F.concat(F.lit("D"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0")).alias("teamcenter"),
        F.col("o_orderpriority").alias("label"),
    )


QUESTIONS = ["Welche Marke?", "Welche Art?", "Welcher Preis?"]


def part_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a question sheet: some cells are filled, some blank; promo parts lack the id."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_type") != "PROMO", padded("AS", "p_partkey", 8)).alias("id"),
        F.when(F.col("p_size") > 20, F.col("p_brand")).alias(QUESTIONS[0]),
        F.when(F.col("p_type") == "SMALL", "  ").otherwise(F.col("p_type")).alias(QUESTIONS[1]),
        F.when(F.col("p_retailprice") > 950, F.floor("p_retailprice").cast("string")).alias(QUESTIONS[2]),
    )


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of parts: the line items of the three smallest quantities, a type for each."""
    kind = F.when(F.col("l_quantity") == 1, ".pdf").when(F.col("l_quantity") == 2, ".PNG").otherwise(".step")
    name = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").where("l_quantity <= 3").select(
        padded("AS", "l_partkey", 8).alias("item"), F.concat(name, kind).alias("path"), F.col("l_orderkey").alias("length"),
    )


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as raw sheet cells: a header text occurs first somewhere below the top."""
    segments = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    return table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("sheet"), F.array_position(segments, F.col("c_mktsegment")).alias("sheet_no"),
        F.col("c_custkey").alias("row_no"),
        F.when(F.col("c_acctbal") > 9000, F.array(F.lit("Nr"), F.lit(" funktionsklasse ")))
        .otherwise(F.array(F.col("c_custkey").cast("string"), F.col("c_name"))).alias("cells"),
    )
