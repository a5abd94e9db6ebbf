import random
import re

from pyspark.sql import functions as F

from dossier.functions.views import BIT
from dossier.operators import inventory, manifests, resolve

FILES = "assembly string, rel_path string, length bigint"


def greedy(views):
    """Restated on plain sets: three aimed picks, then the widest uncovered."""
    left = [(frozenset(d), size, name.casefold(), name) for d, size, name in views]
    chosen = []

    def take(fits, score):
        options = [v for v in left if fits(v[0])]
        if options and len(chosen) < 3:
            best = min(options, key=lambda v: (-score(v[0]), -len(v[0]), -v[1], v[2], v[3]))
            left.remove(best)
            chosen.append(best)

    side = {"left", "right"}
    take(lambda d: {"top", "front"} <= d and d & side, lambda d: 0)
    first = chosen[0][0] if chosen else frozenset()
    take(lambda d: {"bottom", "back"} <= d and d & side,
         lambda d: int(("left" in first and "right" in d) or ("right" in first and "left" in d)))
    take(lambda d: d == {"front"}, lambda d: 0)
    while left and len(chosen) < 3:
        covered = set().union(*(v[0] for v in chosen))
        take(lambda d: True, lambda d: len(d - covered))
    return {v[3] for v in chosen}


def test_view_selection_equals_brute_force(spark):
    rng = random.Random(11)
    groups = {}
    for n in range(150):
        groups[f"g{n}"] = [
            (rng.sample(list(BIT), rng.choice([0, 1, 1, 2, 3, 3, 4])) if rng.random() < 0.5 else
             [rng.choice(["top", "bottom"]), rng.choice(["left", "right"]), rng.choice(["front", "back"])],
             rng.choice([0.1, 0.5, 2.0]), f"V{i}.png") for i in range(rng.randrange(1, 12))]
    groups["hot"] = [(["top", "left", "front"], 1.0 + i % 5, f"h{i}.png") for i in range(2000)] + [(["front"], 0.1, "f.png")]
    rows = [(g, name, name, size, sum(BIT[d] for d in set(ds))) for g, vs in groups.items() for ds, size, name in vs]
    df = spark.createDataFrame(rows, "assembly string, rel_path string, file_name string, file_size_mb double, mask int").repartition(5)
    got = {r.assembly: set(r.chosen) for r in inventory.select_views(df).collect()}
    assert got == {g: greedy(vs) for g, vs in groups.items()}
    assert all(len(got[g]) == min(3, len(vs)) for g, vs in groups.items())


def test_hand_made_views(spark):
    files = spark.createDataFrame([("a", n, 1000) for n in ("x_TLF.png", "x_BRB.png", "x_BLB.png", "front.png", "view.png")] +
                                  [("a", "plan.pdf", 10), ("a", "~$l.png", 5), ("b", "sub/x.xlsx", 10)], FILES)
    got = {r.file_name: r for r in inventory.inventory(files).collect()}
    assert set(got) == {"x_TLF.png", "x_BRB.png", "x_BLB.png", "front.png", "view.png", "plan.pdf", "x.xlsx"}
    assert {n for n, r in got.items() if r.cad_selected == "ja"} == {"x_TLF.png", "x_BRB.png", "front.png"}
    assert got["x_BLB.png"].priority == "nein" and got["x_TLF.png"].priority == "priority_1_candidate"
    assert got["plan.pdf"].cad_selected == "" and got["plan.pdf"].priority == "priority_1_candidate"
    assert got["x.xlsx"].relative_subfolder == "sub" and got["x.xlsx"].priority == "priority_2_candidate"
    folders = spark.createDataFrame([("a",), ("b",), ("empty",)], "assembly string")
    summary = {r.assembly: tuple(r)[1:] for r in inventory.priority_summary(inventory.inventory(files), folders).collect()}
    assert summary == {"a": (4, 0, 2), "b": (0, 1, 0), "empty": (0, 0, 0)}


def test_ignore_directory_moves_one_file(spark):
    before = spark.createDataFrame([("a", "x.pdf", 1), ("a", "y/z.png", 1), ("a", "t.txt", 1)], FILES)
    after = spark.createDataFrame([("a", "x.pdf", 1), ("a", "y/_LLM_IGNORE/z.png", 1), ("a", "t.txt", 1)], FILES)
    assert inventory.supported_counts(before).first()[1:] == (2, 0)
    assert inventory.supported_counts(after).first()[1:] == (1, 1)


def test_resolution(spark):
    rows = [("A", "", "b.pdf", "/old/b.pdf", " PRIORITY_1_candidate "), ("A", ".", "a.pdf", "nan", "priority_2_candidate"),
            ("A", "s", "c.pdf", "/old/c.pdf", "priority_2_candidate"), ("A", "", "B.pdf", "/old/b.pdf", "priority_1_candidate"),
            ("A", "", "n.pdf", "/old/n.pdf", "nein"), ("B", "", "q.pdf", None, "priority_1_candidate")]
    inv = spark.createDataFrame(rows, "assembly string, relative_subfolder string, file_name string, file_path string, priority string")
    listing = spark.createDataFrame([("/r/A/a.pdf",), ("/old/b.pdf",)], "path string")
    got = {r.resolved_path: r for r in resolve.resolve_files(inv, listing, "/r").collect()}
    assert {p: (r.path_source, r.exists_mark) for p, r in got.items()} == {
        "/r/A/a.pdf": ("current_folder", "ja"), "/old/b.pdf": ("inventory_full_path_fallback", "ja"),
        "/r/A/s/c.pdf": ("current_folder", "nein"), "/r/B/q.pdf": ("current_folder", "nein")}
    lists = {r.assembly: r for r in resolve.file_lists(resolve.resolve_files(inv, listing, "/r")).collect()}
    assert lists["A"].files == "a.pdf\nB.pdf\nc.pdf" and lists["A"].missing_files == "/r/A/s/c.pdf"


def test_type_is_found_once_before_a_filter(spark):
    files = spark.range(4).select(F.lit("A").alias("assembly"), F.concat(F.lit("plan"), "id", F.lit(".pdf")).alias("rel_path"), "id")
    typed = inventory.typed_files(files.withColumnRenamed("id", "length"))
    wanted = resolve.with_priority(typed)
    # A filter moved below the projection would hold the rules a second time.
    assert wanted._jdf.queryExecution().executedPlan().toString().count("teileliste") == 1
    assert {r.priority for r in wanted.collect()} == {"priority_1_candidate"}
    assert typed.columns == ["assembly", "rel_path", "length", "file_name", "relative_subfolder",
                             "file_extension", "file_size_mb", "guessed_type", "priority"]


def test_resolution_compares_hashes_before_paths(spark):
    """Repeated, missing and blank cells and repeated paths, against the rule on plain rows."""
    draw = random.Random(5)
    cells = [None, "", " ", "nan", "None ", ".", "s", " s ", "t/u"]
    rows = [(draw.choice(["A", "B"]), draw.choice(cells), draw.choice([" n.pdf", "N.pdf", "m.pdf", None]),
             draw.choice([None, " ", "nan", "/old/1", " /old/2", "/r/A/s/m.pdf"]), "priority_1_candidate") for _ in range(400)]
    there = ["/r/A/s/n.pdf", "/r/A/s/n.pdf", "/r/B/m.pdf", "/old/1", "/old/1", "/r/A/t/u/N.pdf", None]

    def cell(value):
        value = (value or "").strip()
        return "" if value.casefold() in ("nan", "none") else value

    best = {}
    for folder, sub, name, noted, priority in rows:
        parts = ["/r", folder, *([cell(sub)] if cell(sub) not in ("", ".") else []), cell(name)]
        current, old = "/".join(parts), cell(noted) or None
        use_old = current not in there and old in there and old is not None
        path = old if use_old else current
        order = ((name is not None, (name or "").casefold()), (name is not None, name or ""), (sub is not None, sub or ""))
        found = (order, name, sub, "inventory_full_path_fallback" if use_old else "current_folder", use_old or current in there)
        if (folder, path) not in best or found[0] < best[folder, path][0]:
            best[folder, path] = found
    inv = spark.createDataFrame(rows, "assembly string, relative_subfolder string, file_name string, file_path string, priority string")
    listing = spark.createDataFrame([(p,) for p in there], "path string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        resolved = resolve.resolve_files(inv, listing, "/r")
        plan = resolved._jdf.queryExecution().executedPlan().toString()
        got = {(r.assembly, r.resolved_path): (r.file_name, r.relative_subfolder, r.path_source, r.exists) for r in resolved.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {key: found[1:] for key, found in best.items()}
    assert len(re.findall(r"SortMergeJoin \[_hash#\d+L, ", plan)) == 2


def test_manifest_currency(spark):
    kinds = "path string, source_pdf_name string, source_sha256 string, dpi int, image_format string, max_side_px int"
    sources = [(p, p, "h", 200, "png", side) for p, side in
               (("same", 3000), ("null", None), ("hash", 3000), ("dpi", 3000), ("side", None), ("gone", 3000), ("new", 3000), ("empty", 3000))]
    stored = [("same", "same", "h", 200, "png", 3000, ["same1"]), ("null", "null", "h", 200, "png", None, ["null1", "null2"]),
              ("hash", "hash", "other", 200, "png", 3000, ["hash1"]), ("dpi", "dpi", "h", 150, "png", 3000, ["dpi1"]),
              ("side", "side", "h", 200, "png", 3000, ["side1"]), ("gone", "gone", "h", 200, "png", 3000, ["gone1", "gone2"]),
              ("empty", "empty", "h", 200, "png", 3000, [])]
    images = spark.createDataFrame([(i,) for s in stored for i in s[-1] if i != "gone2"], "image string")
    stale = manifests.stale_sources(spark.createDataFrame(sources, kinds), spark.createDataFrame(stored, kinds + ", images array<string>"), images)
    assert {r.path for r in stale.collect()} == {"hash", "dpi", "side", "gone", "new"}
    # Without a hash on either side nothing says that the content is the same.
    bare = [("none", "none", None, 200, "png", 3000)]
    unknown = manifests.stale_sources(spark.createDataFrame(bare, kinds), spark.createDataFrame([(*bare[0], ["same1"])], kinds + ", images array<string>"), images)
    assert [r.path for r in unknown.collect()] == ["none"]


def test_image_batches(spark):
    pages = [("a", pdf, n, f"page_{n:03d}.png", 10) for pdf, last in (("B x.pdf", 4), ("a.pdf", 7)) for n in range(1, last + 1)]
    df = spark.createDataFrame(pages, "assembly string, pdf string, page_number int, image_path string, file_size_bytes bigint")
    got = [r.images for r in manifests.image_batches(df).orderBy("batch").collect()]
    assert [len(b) for b in got] == [5, 5, 1]
    assert got[1] == ["a/page_006.png", "a/page_007.png", "B_x/page_001.png", "B_x/page_002.png", "B_x/page_003.png"]
    total = manifests.batch_manifest(manifests.assembly_manifest(manifests.pdf_manifest(df))).first()
    assert tuple(total) == (1, 2, 11) and manifests.first_pages(df).count() == 8
