from pyspark.sql import functions as F

from dossier.functions import answers, paths, text
from dossier.functions.class_rules import CLASSES, feature_label
from dossier.functions.doctypes import doc_type, send_priority
from dossier.functions.ids import embedded_ids, fragments
from dossier.functions.views import view_code, view_mask, view_name, view_words


def apply(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_ids_keep_their_modes_apart(spark):
    values = ["123.0", " 0804xx0002 ", None, "AB-12", "nan", "None", "0804306221"]
    assert apply(spark, values, text.master_id) == ["123.0", "0804XX0002", "", "AB-12", "NAN", "NONE", "0804306221"]
    assert apply(spark, values, text.plain_id) == ["123", "0804xx0002", "", "ab12", "nan", "none", "804306221"]
    assert apply(spark, values, text.cell_id) == ["1230", "0804XX0002", "", "AB12", "", "", "0804306221"]
    assert apply(spark, values, text.search_id) == ["123", "0804XX0002", "", "AB12", "", "NONE", "0804306221"]
    assert apply(spark, values, text.sheet_key) == ["123.0", "0804xx0002", "", "AB-12", "nan", "None", "0804306221"]


def test_plain_id_reads_numbers_like_a_float(spark):
    values = ["1_000.0", "0804E00012", "1.5", "-7", "inf", "12d", ".5e1", "00000003", "9007199254740993", "1.", "", "000", "0.0", "00120.0", ".0", "123456789012345", "-0.0", "+7.0", "1e3", "7.00"]
    for value, got in zip(values, apply(spark, values, text.plain_id)):
        try:
            number = float(value)
            raw = str(int(number)) if number.is_integer() else value
        except (ValueError, OverflowError):
            raw = value
        assert got == "".join(ch for ch in raw if ch.isalnum()).lower(), value


def test_sheet_key_of_numbers(spark):
    assert apply(spark, [12.0, 1.5, None], lambda c: text.sheet_key(c, numeric=True), "double") == ["12", "1.5", ""]


def test_strip_takes_every_blank(spark):
    values = ["  a \n", "\x1cb\x85", "c"]
    assert apply(spark, values, text.strip) == [v.strip() for v in values]


def test_texts(spark):
    assert apply(spark, ["Straße_A--b  C "], text.search_text) == ["strasse a b c"]
    assert apply(spark, ["a/b:c  d._", "", "ä" * 100, "._ "], text.safe_name) == ["a_b_c_d", "unnamed", "ä" * 90, "unnamed"]
    assert apply(spark, ["SAP - Nummer", "Ground Truth", None], text.header_key) == ["sapnummer", "groundtruth", ""]
    names = ["classification_all_files_gem-1_2026-01-02_03-04-05.csv", "other.csv"]
    assert apply(spark, names, text.model_from_file) == ["gem-1", "other"]
    assert apply(spark, ["Form_ TN_A_1.csv", "Form_.csv"], lambda c: text.participant_from_file(c, "Form_")) == ["TN_A_1", "Form_"]


def test_embedded_ids_stand_alone(spark):
    values = ["BG_0804XX0002_REV A", "X0804XX0001Y", "0804xx0001-0804XX0001-AS00000003", "short"]
    got = apply(spark, values, embedded_ids)
    assert got == [["0804XX0002"], [], ["0804XX0001", "AS00000003"], []]


def test_fragments_longest_first(spark):
    got = apply(spark, ["abcdefgh", "abc", "aaaaaaaa", None], fragments)
    assert got[0] == ["abcdefgh", "abcdefg", "bcdefgh", "abcdef", "bcdefg", "cdefgh"]
    assert got[1] == [] and got[3] in ([], None)
    assert got[2] == ["aaaaaaaa", "aaaaaaa", "aaaaaa"]


def test_path_parts(spark):
    names = ["a.PDF", ".hid", "a.b.png", "x.", "..foo", "noext", "m.STEP"]
    assert apply(spark, names, paths.suffix) == [".pdf", "", ".png", "", "", "", ".step"]
    assert apply(spark, ["d/e/f.txt", "f.txt"], paths.parent_dir) == ["d/e", ""]
    assert apply(spark, [65536, 3 * 65536, 1048576, 524], paths.size_mb, "bigint") == [0.062, 0.188, 1.0, 0.0]
    ignored = apply(spark, ["_LLM_IGNORE/a.pdf", "x/_llm_ignore/y/a.pdf", "_LLM_IGNORE", "a_LLM_IGNORE/a.pdf"], paths.in_ignore_dir)
    assert ignored == [True, True, False, False]
    assert apply(spark, ["a/b/c", ""], paths.directory_prefixes) == [["a", "a/b", "a/b/c"], []]


def test_skip_reasons_first_wins(spark):
    cases = {
        ("~$list.xlsx", 5): "Temporaere Datei", (".hid/h.pdf", 5): "Versteckte Datei",
        ("d/.x.pdf", 5): "Versteckte Datei", ("a.xlsx", 0): "Excel uebersprungen",
        ("a.idw", 0): "Dateityp nicht unterstuetzt", ("empty.pdf", 0): "Leere Datei",
        ("big.pdf", 20971521): "Datei zu gross", ("edge.pdf", 20971520): None, ("a.txt", 3): None,
    }
    rows = spark.createDataFrame([(*k,) for k in cases], "p string, n bigint")
    got = {(r.p, r.n): r.o for r in rows.select("p", "n", paths.skip_reason(F.col("p"), F.col("n")).alias("o")).collect()}
    assert got == cases


def test_parent_dir_of_odd_paths(spark):
    odd = ["/f", "d/", "d\ne/f\n", "ü/ß/ñ.txt", "d//f", "", None]
    assert apply(spark, odd, paths.parent_dir) == ["", "d", "d\ne", "ü/ß", "d/", "", None]


def test_document_types(spark):
    def kind(older):
        return lambda c: doc_type(c, paths.suffix(paths.file_name(c)), older)

    expected = {
        "Stückliste.pdf": ("BOM", "BOM"), "BOM/Drawing.pdf": ("BOM", "BOM"),
        "plan.pdf": ("Technische_Zeichnung", "PDF_unknown"),
        "DFC_Struktur.png": ("DFC_structure_screenshot", "CAD_screenshot"),
        "DFC_Struktur.pdf": ("Technische_Zeichnung", "PDF_unknown"),
        "Struktur-baum.png": ("CAD_screenshot", "CAD_screenshot"),
        "Strukturbaum.png": ("DFC_structure_screenshot", "CAD_screenshot"),
        "a.idw": ("IDW_drawing", "unknown"), "m.STEP": ("CAD_raw", "CAD_raw_ignore_first"),
        "cad-zugriff/x.png": ("CAD_access_ignore", "CAD_access_ignore"),
        "review.docx": ("CAD_screenshot", "CAD_screenshot"), "bombardier/x.txt": ("BOM", "BOM"),
        "t.csv": ("Excel_unknown", "Excel_unknown"), "t.txt": ("unknown", "unknown"),
        "Data Sheet.xlsx": ("Datenblatt", "Datenblatt"),
    }
    assert apply(spark, list(expected), kind(False)) == [v[0] for v in expected.values()]
    assert apply(spark, list(expected), kind(True)) == [v[1] for v in expected.values()]
    kinds = ["Technische_Zeichnung", "BOM", "CAD_screenshot", "PDF_unknown"]
    assert apply(spark, kinds, send_priority) == ["priority_1_candidate", "priority_2_candidate", "nein", "nein"]
    assert apply(spark, kinds, lambda c: send_priority(c, True)) == ["maybe", "ja_candidate", "ja_candidate", "maybe"]


def test_views(spark):
    names = ["x_TLF.png", "x_BRB.png", "front.png", "oben_links.png", "TLFX.png", "view.png", "a-trf.jpg", "Rück.png"]
    got = apply(spark, names, lambda c: view_name(view_mask(view_code(c), view_words(c))))
    assert got == ["top_left_front", "bottom_right_back", "front", "top_left", "", "", "top_right_front", "back"]


def test_canonical_labels(spark):
    raws = ["Greifer", "`greifer`", '"Greifer"', "Die Klasse ist Greifer.", "Greifer oder Roboter",
            "Nicht klassifizierbar", "HTTP error 400: …", ""]
    fallback = "Nicht klassifizierbar"
    assert apply(spark, raws, lambda c: answers.tolerant_label(c, CLASSES)) == ["Greifer"] * 4 + [None, fallback, None, None]
    assert apply(spark, raws, lambda c: answers.strict_label(c, CLASSES)) == ["Greifer"] * 3 + [None] * 5
    assert apply(spark, raws, lambda c: answers.strict_label(c, CLASSES, True)) == ["Greifer"] * 3 + [None, None, fallback, None, None]
    # Exact spelling comes before the search without case, where the last spelling wins.
    assert apply(spark, ["GREIFER", *raws], lambda c: answers.checked_label(c, ["greifer", "Greifer"])) == [
        "Greifer", "Greifer", "greifer", "Greifer", None, None, fallback, None, None]


def test_nested_labels_are_rejected_with_a_reason(spark):
    labels = ["Achse", "Linearachse"]
    assert apply(spark, ["eine Linearachse", "Linearachse"], lambda c: answers.tolerant_label(c, labels)) == [None, "Linearachse"]
    assert apply(spark, ["eine Linearachse"], lambda c: answers.rejection_reason(c, labels)) == ["SEVERAL_LABELS"]


def test_feature_labels(spark):
    names = ["Drehteller links", "Greifer mit Schwenkeinheit", "Schraube"]
    assert apply(spark, names, feature_label) == ["Rotationseinheit", CLASSES[3], "Nicht klassifizierbar"]


def test_responses(spark):
    raws = ['{"candidates":[{"content":{"parts":[{"x":1},{"text":"A"},{"text":"B"}]}}],"usageMetadata":{"t":3}}',
            '{"candidates":[{"finishReason":"MAX"}]}', "{}", '{"content":[{"text":"C"}]}']
    assert apply(spark, raws, lambda c: answers.response_text(answers.parse_response(c))) == [
        "A", "(no text content, finishReason=MAX)", "(no text content, finishReason=unknown)", "(no text content, finishReason=unknown)"]
    assert apply(spark, raws, lambda c: answers.response_text_joined(answers.parse_response(c))) == ["AB", "", "", ""]
    assert apply(spark, raws, lambda c: answers.block_text(answers.parse_response(c)))[3] == "C"
    assert apply(spark, raws, lambda c: answers.usage_json(answers.token_usage(answers.parse_response(c))))[:2] == ['{"t":3}', "{}"]


def test_prompts(spark):
    got = apply(spark, ["Achse"], lambda c: answers.question_prioritised(c, F.array(F.lit("a.pdf"), F.lit("b.png")), ["X", "Y"]))[0]
    assert "Baugruppenname:\nAchse\n\nBeigefuegte Dateien:\n- a.pdf\n- b.png\n\nZulaessige Funktionsklassen:\n- X\n- Y\n" in got
    assert got.endswith("Antwort:") and got.startswith("Du bist")
    none = apply(spark, ["Achse"], lambda c: answers.question_described(c, c, c, c, F.array().cast("array<string>"), ["X"]))[0]
    assert "- Keine direkt lesbaren Dateien vorhanden" in none
