"""Page manifests: roll-up, fixed-size batches and the check for what is still current.

``pages(assembly, pdf, page_number, image_path, file_size_bytes)``: one row per page image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.paths import stem
from dossier.functions.text import safe_name
from dossier.operators.spread import PART_SIZE, listed_in_parts, numbered

BATCH_SIZE = 5
FAMILY_PAGE_CAP = 4
SETTINGS = ("source_sha256", "dpi", "image_format", "max_side_px")


def pdf_manifest(pages: DataFrame) -> DataFrame:
    return pages.groupBy("assembly", "pdf").agg(
        F.count("*").alias("page_count"), F.sum("file_size_bytes").alias("image_bytes")
    )


def assembly_manifest(pdfs: DataFrame) -> DataFrame:
    return pdfs.groupBy("assembly").agg(
        F.count("*").alias("pdf_count"), F.sum("page_count").alias("total_pages"),
        F.sum("image_bytes").alias("image_bytes"),
    ).withColumn("manifest", F.concat(safe_name(F.col("assembly")), F.lit("/baugruppe_manifest.json")))


def batch_manifest(assemblies: DataFrame) -> DataFrame:
    return assemblies.agg(
        F.count("*").alias("assembly_count"), F.sum("pdf_count").alias("total_pdfs"),
        F.sum("total_pages").alias("total_pages"),
    )


def pdf_images(pages: DataFrame) -> DataFrame:
    """Ordered page images per PDF, in arrays of bounded length."""
    image = F.struct("page_number", "image_path", "width_px", "height_px", "file_size_bytes")
    return listed_in_parts(pages, ["assembly", "pdf"], ["page_number"], image, "images")


#: Three levels: an assembly's PDFs and their images.
NESTED_SCHEMA = (
    "assembly string, part bigint, page_count bigint, image_bytes bigint, pdfs array<struct<pdf:string,"
    "settings:struct<source_sha256:string,dpi:bigint,image_format:string,max_side_px:bigint>,images:array<struct<"
    "page_number:bigint,image_path:string,width_px:bigint,height_px:bigint,file_size_bytes:bigint>>>>"
)


def nested_manifests(pages: DataFrame, settings: DataFrame, part_pages: int = PART_SIZE) -> DataFrame:
    """Documents of an assembly, its PDFs with their settings, and their images in order.

    ``settings(assembly, pdf, <settings>)``. A document holds at most ``part_pages`` images; the
    PDFs of a larger assembly go on in further documents (``part``), in order of PDF and page, and a PDF may
    go on from one to the next. ``page_count`` and ``image_bytes`` are those of the document.
    """
    placed = numbered(pages, ["assembly"], ["pdf", "page_number"], "_pos").withColumn(
        "part", F.floor((F.col("_pos") - 1) / part_pages).cast("bigint")
    )
    image = F.struct(*[
        F.col(c).cast("bigint").alias(c) if c != "image_path" else F.col(c)
        for c in ("page_number", "image_path", "width_px", "height_px", "file_size_bytes")
    ])
    pdfs = placed.groupBy("assembly", "part", "pdf").agg(
        F.array_sort(F.collect_list(image)).alias("images"), F.count("*").alias("_n"), F.sum("file_size_bytes").alias("_bytes")
    )
    render = F.struct("source_sha256", F.col("dpi").cast("bigint").alias("dpi"), "image_format", F.col("max_side_px").cast("bigint").alias("max_side_px"))
    with_settings = pdfs.join(settings.select("assembly", "pdf", render.alias("settings")), ["assembly", "pdf"], "left")
    return with_settings.groupBy("assembly", "part").agg(
        F.sum("_n").alias("page_count"), F.sum("_bytes").alias("image_bytes"),
        F.array_sort(F.collect_list(F.struct("pdf", "settings", "images"))).alias("pdfs"),
    ).select("assembly", "part", "page_count", "image_bytes", "pdfs")


def pages_of(documents: DataFrame) -> DataFrame:
    """A row for each image of nested manifests, with its PDF's settings."""
    pdfs = documents.select("assembly", "part", F.explode("pdfs").alias("p"))
    images = pdfs.select("assembly", "part", F.col("p.pdf").alias("pdf"), "p.settings.*", F.explode("p.images").alias("i"))
    return images.select("assembly", "part", "pdf", *SETTINGS, "i.*")


def image_batches(pages: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Consecutive batches of image paths per assembly: PDFs by name, then pages."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    rows = pages.withColumn("_order", F.lower("pdf"))
    path = F.concat_ws("/", safe_name(stem(F.col("pdf"))), F.col("image_path"))
    batches = listed_in_parts(
        rows, ["assembly"], ["_order", "pdf", "page_number"], path, "images", batch_size
    )
    return batches.withColumnRenamed("part", "batch")


def first_pages(pages: DataFrame, keep: int = FAMILY_PAGE_CAP) -> DataFrame:
    """Pages sent to the model family that takes only the first ones of a PDF."""
    return pages.where(F.col("page_number") <= keep)


def current_manifests(sources: DataFrame, manifests: DataFrame, images: DataFrame) -> DataFrame:
    """Sources whose manifest has the same name, content hash and settings and whose page
    images all exist.

    ``sources(path, source_pdf_name, <settings>)``; ``manifests`` the same plus
    ``images array<string>``; ``images(image)`` lists the existing ones.
    """
    wanted = manifests.select("path", F.explode("images").alias("image"))
    broken = wanted.join(images.select("image").distinct(), "image", "left_anti").select("path").distinct()
    complete = manifests.join(broken, "path", "left_anti").drop("images")
    names = ["source_pdf_name", *SETTINGS]
    same = F.col("s.path") == F.col("m.path")
    for name in names:
        s, m = F.col(f"s.{name}"), F.col(f"m.{name}")
        # A missing hash says nothing about the content, so it equals no other.
        same = same & (s == m if name == "source_sha256" else s.eqNullSafe(m))
    return sources.alias("s").join(complete.alias("m"), same, "left_semi")


def stale_sources(sources: DataFrame, manifests: DataFrame, images: DataFrame) -> DataFrame:
    """Sources that must be converted again."""
    current = current_manifests(sources, manifests, images).select("path")
    return sources.join(current, "path", "left_anti")


def changed_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose size or time differs from the last run: only these need a new hash."""
    return listing.join(known.select("path", "length", "mtime"), ["path", "length", "mtime"], "left_anti")
