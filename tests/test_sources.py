import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from dossier.operators import inventory, manifests
from dossier.sources import listing, sinks, tables


@pytest.fixture
def tree(tmp_path):
    for name, data in {
        "A1/x.pdf": b"12345", "A1/_x.pdf": b"1", "A1/.hid/h.pdf": b"1", "A1/_LLM_IGNORE/old.pdf": b"1", "A1/empty.pdf": b"",
        "A1/d/e/f/deep.PNG": b"123", "A1/~$l.xlsx": b"1", "B2/y.txt": b"1", "top.txt": b"1",
    }.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (tmp_path / "root" / "EMPTY").mkdir()
    os.symlink(tmp_path / "root", tmp_path / "root" / "A1" / "loop")
    return str(tmp_path / "root")


def test_listing_keeps_hidden_and_empty(spark, tree):
    files, folders, problems = listing.list_tree(spark, tree)
    got = {(r.assembly, r.rel_path): r.length for r in files.collect()}
    assert got == {("A1", "x.pdf"): 5, ("A1", "_x.pdf"): 1, ("A1", ".hid/h.pdf"): 1, ("A1", "_LLM_IGNORE/old.pdf"): 1,
                   ("A1", "empty.pdf"): 0, ("A1", "d/e/f/deep.PNG"): 3, ("A1", "~$l.xlsx"): 1, ("B2", "y.txt"): 1}
    assert {r.assembly for r in folders.collect()} == {"A1", "B2", "EMPTY"} and problems.count() == 0
    assert files.where("mtime is null").count() == 0
    rows = inventory.inventory(files)
    assert rows.where("file_name = 'deep.PNG'").first().cad_selected == "ja" and rows.count() == 7
    listing.require_folders(folders, tree)


def test_missing_root_is_reported(spark, tmp_path):
    _, folders, problems = listing.list_tree(spark, str(tmp_path / "none"))
    assert problems.count() == 1
    with pytest.raises(FileNotFoundError):
        listing.require_folders(folders, "none")


def test_hashes(spark, tree):
    got = {os.path.basename(r.path): r.sha256 for r in listing.file_hashes(spark, tree + "/A1/x.pdf").collect()}
    assert got == {"x.pdf": hashlib.sha256(b"12345").hexdigest()}
    in_pieces = listing.file_hashes(spark, tree + "/A1/x.pdf", whole_bytes=4).first()
    assert in_pieces.sha256 == got["x.pdf"]


def test_manifests_round_trip(spark, tmp_path):
    root = tmp_path / "m"
    for name, content in {"p1": json.dumps({"source_pdf": "a", "dpi": 200, "images": [{"page_number": 1, "image_path": "i.png"}]}, indent=2), "p2": "{broken"}.items():
        (root / name).mkdir(parents=True)
        (root / name / "manifest.json").write_text(content)
    rows = listing.read_manifests(spark, str(root)).collect()
    assert [(r.source_pdf, r.dpi, r.images[0].image_path) for r in rows] == [("a", 200, "i.png")]
    out = str(tmp_path / "out")
    sinks.write_manifests(spark.createDataFrame([("a", None)], "id string, side int"), out)
    assert json.loads(spark.read.text(out).first().value) == {"id": "a", "side": None}


def test_many_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("SAP-Nummer,Predicted_Label,Run_Model\nA,x,m1\n,,\nB,y,m1\n")
    (tmp_path / "b.csv").write_text("Prediction,Extra,TC-ID\nx,1,T1\ny,2,T2\n")
    (tmp_path / "c.csv").write_text("foo,ID\n1,Q\n")
    wanted = {"sap": tables.SAP_HEADERS, "teamcenter": tables.TC_HEADERS, "predicted": tables.PREDICTION_HEADERS}
    df = tables.read_many(spark, str(tmp_path / "*.csv"), wanted)
    got = sorted(tuple(r) for r in df.collect())
    assert got == [("a.csv", 2, "A", None, "x"), ("a.csv", 3, "B", None, "y"), ("b.csv", 2, None, "T1", "x"),
                   ("b.csv", 3, None, "T2", "y"), ("c.csv", 2, "Q", None, None)]
    with pytest.raises(Exception, match="No column for 'predicted' in c.csv"):
        tables.read_many(spark, str(tmp_path / "*.csv"), wanted, required=["predicted"]).collect()
    wide = ",".join(f"h{n}" for n in range(400))
    (tmp_path / "wide.txt").write_text(f"{wide},ID\n{wide},Z\n")
    assert [r.sap for r in tables.read_many(spark, str(tmp_path / "wide.txt"), wanted).collect()] == ["Z"]
    loose = tables.read_many(spark, str(tmp_path / "a.csv"), {"sap": ["sap nummer"]}, normalised=True)
    assert sorted(r.sap for r in loose.collect()) == ["A", "B"]


def test_models_and_participants_from_files(spark, tmp_path):
    (tmp_path / "classification_all_files_m-2_2026-01-01_00-00-00.csv").write_text("ID,Prediction\nA,x\n")
    (tmp_path / "other.csv").write_text("Run_Model,ID,Prediction\n,A,x\nm1,B,y\nzz,C,z\n")
    (tmp_path / "~$other.csv").write_text("ID,Prediction\nA,x\n")
    got = sorted((r.model, r.row_no, r.sap) for r in tables.read_predictions(spark, str(tmp_path / "*.csv")).collect())
    assert got == [("m-2", 2, "A"), ("m1", 2, "A"), ("m1", 3, "B"), ("m1", 4, "C")]
    (tmp_path / "Form_TN_A_1.csv").write_text("sap nummer,BAUGRUPPEN-KLASSE\nA,x\n")
    forms = tables.read_forms(spark, str(tmp_path / "*.csv"), "Form_").collect()
    assert [tuple(r) for r in forms] == [("TN_A_1", 2, "A", None, "x")]


def test_text_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text('ID,Name\n007,"a\nb"\n,\n')
    got = tables.read_text_table(spark, str(tmp_path / "t.csv"), line_breaks_in_cells=True)
    assert [tuple(r) for r in got.collect()] == [("007", "a\nb")]


def test_columns_by_candidates(spark):
    df = spark.createDataFrame([("1", "x")], "ID string, `Ground Truth` string")
    out = tables.resolve_columns(df, {"sap": tables.SAP_HEADERS, "teamcenter": tables.TC_HEADERS, "label": tables.TRUTH_HEADERS}, ["label"])
    assert tuple(out.first()) == ("1", None, "x")
    with pytest.raises(ValueError, match="predicted"):
        tables.resolve_columns(df, {"predicted": tables.PREDICTION_HEADERS}, ["predicted"])
    with pytest.raises(ValueError, match="lacks the columns"):
        tables.require_columns(df.columns, ["SAP-Nummer"], "list")
    assert tables.find_column(["sap  nummer"], ["SAP-Nummer"], "sap", normalised=True) == "sap  nummer"


def test_class_list_and_header_search(spark):
    df = spark.createDataFrame([(2, " b "), (3, "a"), (4, None), (5, "b"), (6, " ")], "row_no int, c string")
    assert tables.labels_for_prompt(tables.class_list(df, "c")) == ["b", "a"]
    with pytest.raises(ValueError):
        tables.labels_for_prompt(tables.class_list(df.where("row_no = 4"), "c"))
    cells = spark.createDataFrame([("s1", 0, 0, ["Titel", None]), ("s1", 0, 3, ["Nr", "funktionsklasse "]), ("s1", 0, 4, ["1", "b"]),
                                   ("s2", 1, 1, ["Funktionsklasse", "x"]), ("s2", 1, 2, ["c", "x"]), ("s2", 1, 3, ["nan", "x"])],
                                  "sheet string, sheet_no int, row_no int, cells array<string>")
    assert [tuple(r) for r in tables.rows_below_header(cells, "Funktionsklasse").collect()] == [("s1", 4, "b")]
    got = tables.rows_below_header(cells, "Funktionsklasse", "s2").orderBy("row_no").collect()
    assert [tuple(r) for r in got] == [("s2", 2, "c"), ("s2", 3, "")]


def test_reports_keep_columns_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "b string, a string, c string")
    sinks.write_report(empty, str(tmp_path / "r"), ["a", "b"])
    assert spark.read.parquet(str(tmp_path / "r")).columns == ["a", "b"]
    sinks.write_tables({"t": spark.range(2).withColumn("model", F.lit("m"))}, str(tmp_path), "run1", ["t"])
    assert spark.read.parquet(str(tmp_path / "t")).where("run_id = 'run1' and model = 'm'").count() == 2
    for _ in range(2):
        sinks.append_log(spark.range(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_line_breaks_in_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,Prediction,Note\nA,"Greifer\nweil ""so""",1\n\nB,y,"2\n3"\n')
    got = tables.read_predictions(spark, str(tmp_path / "a.csv"), multi_line=True).collect()
    assert sorted((r.row_no, r.sap, r.predicted) for r in got) == [(2, "A", 'Greifer\nweil "so"'), (3, "B", "y")]
    with pytest.raises(ValueError, match="multi_line"):
        tables.read_predictions(spark, str(tmp_path / "a.csv"))


def test_row_numbers_over_splits_without_a_shuffle(spark, tmp_path):
    lines = ["ID,Prediction"] + [f"k{n},p{n}" if n % 7 else "," for n in range(1, 4000)]
    (tmp_path / "big.csv").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = tables.read_many(spark, str(tmp_path / "big.csv"), {"sap": ["ID"], "predicted": ["Prediction"]})
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = {r.sap: r.row_no for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    kept = [n for n in range(1, 4000) if n % 7]
    assert got == {f"k{n}": place + 2 for place, n in enumerate(kept)}
    assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0]


def test_a_missing_header_is_an_error(spark):
    cells = spark.createDataFrame([("s", 1, 1, ["a", "b"])], "sheet string, sheet_no int, row_no int, cells array<string>")
    with pytest.raises(Exception, match="No sheet has the header 'Klasse'"):
        tables.rows_below_header(cells, "Klasse").collect()


def test_rows_of_plain_tables_are_numbered_over_splits(spark, tmp_path):
    lines = ["id,name"] + ["," if n % 10 == 0 else f'{n},"a ""quoted"" name, {n}"' for n in range(2, 4001)]
    for name in ("one", "two"):
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = tables.read_text_table(spark, str(tmp_path), row_no="no")
        assert rows.rdd.getNumPartitions() > 8
        got = sorted((r.no, r.id, r.name) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([(n, str(n), f'a "quoted" name, {n}') for n in range(2, 4001) if n % 10] * 2)


def test_only_changed_files_are_hashed_again(spark, tmp_path):
    root, table = tmp_path / "files", str(tmp_path / "hashes")
    root.mkdir()
    for n in range(5):
        (root / f"{n}.pdf").write_bytes(b"%d" % n * (n + 1))
    assert listing.hash_table(spark, str(root), table) == 1
    assert listing.hash_table(spark, str(root), table) == 1
    (root / "1.pdf").write_bytes(b"other")
    (root / "7 é.pdf").write_bytes(b"new")
    (root / "2.pdf").unlink()
    assert listing.hash_table(spark, str(root), table) == 2
    got = {os.path.basename(r.path): (r.sha256, r.version) for r in listing.known_hashes(spark, table, 2).collect()}
    want = {"0.pdf": (b"0", 1), "1.pdf": (b"other", 2), "3.pdf": (b"3333", 1), "4.pdf": (b"44444", 1)}
    assert {k: v for k, v in got.items() if k in want} == {k: (hashlib.sha256(d).hexdigest(), v) for k, (d, v) in want.items()}
    assert len(got) == 5 and {v for _, v in got.values()} == {1, 2}


def test_nested_documents_go_on_in_parts_and_spoilt_ones_are_set_apart(spark, tmp_path):
    pages = spark.createDataFrame(
        [("A", f"{d}.pdf", p, f"p{p}.png", 10, 20, p) for d in "ab" for p in range(1, 6)] + [("B", "c.pdf", 1, "p1.png", None, None, 7)],
        "assembly string, pdf string, page_number int, image_path string, width_px int, height_px int, file_size_bytes long",
    )
    settings = spark.createDataFrame([("A", "a.pdf", "h", 200, "png", None)], "assembly string, pdf string, source_sha256 string, dpi int, image_format string, max_side_px int")
    docs = manifests.nested_manifests(pages, settings, part_pages=4)
    assert {(r.assembly, r.part): (r.page_count, len(r.pdfs)) for r in docs.collect()} == {("A", 0): (4, 1), ("A", 1): (4, 2), ("A", 2): (2, 1), ("B", 0): (1, 1)}
    sinks.write_manifests(docs, f"{tmp_path}/docs")
    (tmp_path / "docs" / "bad.txt").write_text('{"assembly": "A", "pdfs": [\n\nno json\n')
    good, bad = listing.read_documents(spark, f"{tmp_path}/docs", manifests.NESTED_SCHEMA)
    back = manifests.pages_of(good).select(*pages.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, pages.select([F.col(c) for c in pages.columns]).collect()))
    assert {r.line for r in bad.collect()} == {'{"assembly": "A", "pdfs": [', "no json"}
    assert manifests.pages_of(good).where("source_sha256 = 'h'").count() == 5


def test_files_named_after_a_value(spark, tmp_path):
    rows = spark.createDataFrame([("A", "1", 'x "y"'), ("B", "2", None), (None, "3", "z"), ("A", "4", "")], "who string, id string, label string")
    root = str(tmp_path / "forms")
    assert sinks.write_named(rows.coalesce(1), root, "who", "Form_{}.csv", {"id": "SAP Nummer", "label": "Baugruppen-Klasse"}) == 2
    read = tables.read_forms(spark, f"{root}/*/*.csv", "Form_").collect()
    assert sorted((r.participant, r.row_no, r.sap, r.label or "") for r in read) == [("A", 2, "1", 'x "y"'), ("A", 3, "4", ""), ("B", 2, "2", "")]
    assert sinks.write_named(rows.limit(0), str(tmp_path / "none"), "who", "{}.csv", {"id": "id"}) == 0
