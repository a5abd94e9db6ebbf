import pytest
from pyspark.sql import functions as F

from dossier.functions.class_rules import CLASSES
from dossier.operators import labelling, questions
from dossier.operators.spread import settled
from dossier.plans import jobs
from dossier.streaming.arrivals import label_arrivals, stored_results


def fake_service():
    def make_client():
        calls = {}

        def answer(prompt, paths):
            calls[prompt] = calls.get(prompt, 0) + 1
            if "broken" in prompt:
                raise RuntimeError("no service")
            if "flaky" in prompt and calls[prompt] == 1:
                raise RuntimeError("try again")
            if "wordy" in prompt and "vorherige" not in prompt:
                return "no idea"
            return "`greifer`", {"totalTokenCount": len(paths)}

        return answer

    return make_client


client = fake_service()


def test_label_requests(spark):
    df = spark.createDataFrame([("1", 0, "ok", ["a"]), ("2", 0, "broken", []), ("3", 1, "ky", ["b", "c"]), ("3", 0, "fla", ["a"])],
                               "item string, part bigint, prompt string, paths array<string>")
    got = {r.item: r for r in labelling.label_requests(df, client, 3, wait_seconds=0).collect()}
    assert len(got) == 3 and got["3"].usage == {"totalTokenCount": 3} and got["3"].attempts == 2
    assert got["1"].response == "`greifer`" and got["1"].attempts == 1 and got["1"].usage == {"totalTokenCount": 1}
    assert got["2"].error == "RuntimeError: no service" and got["2"].attempts == 2 and got["2"].usage is None
    assert got["3"].response == "`greifer`" and got["3"].error is None
    again = labelling.label_requests(spark.createDataFrame([("4", 0, "wordy", [])], df.schema), client, 1, 2, 0, ["Greifer"], "\nDie vorherige Antwort war falsch.").first()
    assert again.response == "`greifer`" and again.attempts == 2


def counting_client(folder, broken_after=None):
    """A client that leaves a file for each call, and fails the whole task after some."""
    def make_client():
        def answer(prompt, paths, system=None):
            import os
            import uuid
            if broken_after is not None and len(os.listdir(folder)) >= broken_after:
                os._exit(1)
            open(f"{folder}/{prompt}-{uuid.uuid4().hex}", "w").close()
            return f"{prompt}!{system or ''}"
        return answer
    return make_client


def test_answers_are_stored_bucket_by_bucket(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [(str(n), 0, f"q{n}", []) for n in range(40)]
    df = spark.createDataFrame(rows, "item string, part bigint, prompt string, paths array<string>")
    path = str(tmp_path / "answers")
    first = labelling.stored_answers(df.where("item < '2'"), counting_client(str(calls)), 2, path, bucket_items=4)
    finished = first.count()
    assert finished == 12 == len(list(calls.iterdir()))
    with pytest.raises(Exception, match="(?i)crash|exited|lost|EOF|abort"):
        labelling.stored_answers(df, counting_client(str(calls), broken_after=25), 2, path, bucket_items=4)
    stored = {r.item for r in spark.read.parquet(path).collect()}
    assert 12 <= len(stored) < 40
    out = labelling.stored_answers(df, counting_client(str(calls)), 2, path, bucket_items=4, system="sys").collect()
    assert {r.item: r.response.split("!")[0] for r in out} == {str(n): f"q{n}" for n in range(40)} and len(out) == 40
    asked = [f.name.split("-")[0] for f in calls.iterdir()]
    assert all(asked.count(f"q{item}") == 1 for item in stored), "a stored item was asked again"
    assert all(r.response.endswith("!sys") for r in out if r.item not in stored)


@pytest.fixture
def run(spark):
    items = spark.createDataFrame([("1", 2, "S00001", None, "Greifer gross"), ("2", 3, "S00002", "", " "), ("3", 4, "S00003", None, "broken"),
                                   ("4", 5, None, None, "x"), ("5", 6, "S00005", None, "no files"), ("6", 7, "S99999", None, "lost")],
                                  "item string, row_no bigint, sap string, teamcenter string, name string")
    names = ["S00001", "S00002", "S00003", "S00005"]
    folders = spark.createDataFrame([(n, n) for n in names], "folder string, name string")
    files = spark.createDataFrame([("S00001", "a.pdf"), ("S00001", "_LLM_IGNORE/b.pdf"), ("S00001", "n.txt"), ("S00002", "a.pdf"), ("S00003", "a.pdf"), ("S00005", "a.xlsx")],
                                  "folder string, rel_path string").selectExpr("folder", "rel_path", "concat('/r/', folder, '/', rel_path) path", "3L length")
    return items, folders, files


def test_classify_all_files(spark, run):
    items, folders, files = run
    args = (folders, files, CLASSES, client, "m1", "2026-01-01T00:00:00", 2)
    out = jobs.classify_all_files(items, *args)
    got = {r.item: r for r in out["results"].collect()}
    assert {r.path for r in out["used_files"].collect()} == {"/r/S00001/a.pdf", "/r/S00003/a.pdf"}
    assert len(got) == 6
    assert got["1"].predicted_label == "Greifer" and got["1"].processing_status == "SUCCESS"
    assert got["1"].matched_folder == "S00001" and got["1"].file_count == 1 and got["1"].token_usage_json == '{"totalTokenCount":1}'
    assert got["2"].processing_status == got["4"].processing_status == "SKIPPED: missing ID or Benennung"
    assert got["3"].processing_status == "ERROR: RuntimeError: no service" and got["3"].predicted_label is None
    assert got["5"].processing_status == "SKIPPED: no supported documents found (EXACT_ASSEMBLY_ID)"
    assert got["6"].processing_status == "SKIPPED: no supported documents found (NOT_FOUND)"
    done = spark.createDataFrame([("1", "m1"), ("2", "other")], "item string, model string")
    assert {r.item for r in jobs.classify_all_files(items, *args, done=done)["results"].select("item").collect()} == {"2", "3", "4", "5", "6"}


def test_classify_prioritised(spark, run):
    items = run[0]
    inv = spark.createDataFrame([("S00001", "", "a.pdf", "", "priority_1_candidate"), ("S00001", "", "b.pdf", "", "nein"), ("S00003", "", "a.pdf", "", "priority_2_candidate"),
                                 ("S00003", "x", "gone.pdf", "", "priority_1_candidate"), ("S00005", "", "a.xlsx", "", "nein")],
                                "assembly string, relative_subfolder string, file_name string, file_path string, priority string")
    listing = spark.createDataFrame([("/r/S00001/a.pdf",), ("/r/S00003/a.pdf",)], "path string")
    out = jobs.classify_prioritised(items, inv, listing, "/r", CLASSES, client, 2, run={"model": "m1"})
    got = {r.item: r for r in out["results"].collect()}
    assert {i: r.status for i, r in got.items()} == {"1": "OK", "2": "NO_BAUGRUPPENNAME", "3": "FILE_NOT_FOUND", "4": "NO_IDENTIFIER", "5": "NO_PRIORITY_1_2_FILES", "6": "NOT_FOUND"}
    assert got["1"].label == "Greifer" and got["3"].file_count == 2 and got["3"].missing == 1
    lists = {r.assembly: r.missing_files for r in out["file_lists"].collect()}
    assert lists == {"S00001": "", "S00003": "/r/S00003/x/gone.pdf"}
    assert out["used_files"].count() == 3
    log = out["response_log"].collect()
    assert [(r.model, r.item, r.file_paths, r.canonical_label, r.status) for r in log] == [("m1", "1", ["/r/S00001/a.pdf"], "Greifer", "OK")]
    assert log[0].prompt.startswith("Du bist") and log[0].prompt.endswith("Antwort:") and "- a.pdf\n\nZulaessige" in log[0].prompt
    assert got["2"].error_message == "Benennung (EN) ist leer" and got["6"].error_message.startswith("Kein Ordner") and got["1"].error_message is None
    checked = jobs.classify_prioritised(items, inv, listing, "/r", CLASSES, client, 2, call=False)["results"]
    assert checked.where("item = '1'").first().status == "READY"


def test_collect_and_evaluate_jobs(spark):
    items = spark.createDataFrame([(2, "0804XX0001", ""), (3, "0804XX0002", "")], "row_no bigint, sap string, teamcenter string")
    found = spark.createDataFrame([("c", "0804XX0001", "c/1"), ("c", "misc", "c/2")], "category string, folder string, path string")
    out = jobs.collect(items, found, "/t", copy=True)
    assert {k: v.count() for k, v in out.items()} == {"matched": 1, "unmatched": 1, "ambiguous_folders": 0, "ambiguous_ids": 0, "duplicate_names": 0,
                                                      "several_folders": 0, "missing_items": 1, "conflict_counts": 1, "copy_plan": 1}
    preds = spark.createDataFrame([("m", 2, "1", "", "x"), ("n", 2, "1.0", "", "y")], "model string, row_no bigint, sap string, teamcenter string, predicted string")
    truth = spark.createDataFrame([(2, "01", "", "x")], "row_no bigint, sap string, teamcenter string, label string")
    ranked = jobs.evaluate(preds, truth)["model_comparison"].collect()
    assert [(r.model, r.accuracy) for r in ranked] == [("m", 1.0), ("n", 0.0)]


def test_question_sheet(spark):
    sheet = spark.createDataFrame([("1", None, "done"), ("2", " ", "kept"), (None, None, None), ("3", "broken", None)], "id string, `Was?` string, `broken?` string")
    files = spark.createDataFrame([("1", "a.pdf", 1), ("3", "b.pdf", 1), ("3", "c.txt", 1)], "item string, path string, length bigint")
    got = {(r.id, r.question): r.answer for r in jobs.answer_questions(sheet, "id", files, client, 2).collect()}
    assert got[("1", "Was?")] == "`greifer`" and got[("1", "broken?")] == "done"
    assert got[("2", "Was?")] == got[("2", "broken?")] == "ERROR: No documents found."
    assert got[(None, "Was?")] is None and got[("3", "Was?")] == "broken" and got[("3", "broken?")] == "ERROR: RuntimeError: no service"
    calls = {r.question: r.calls for r in questions.expected_calls(questions.to_long(sheet, ["id"]), "id").collect()}
    assert calls == {"Was?": 2, "broken?": 1}


def test_rows_of_one_id_share_answers_and_keep_filled_cells(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def counting():
        def answer(prompt, file_paths):
            asked.add(1)
            return f"{prompt} {len(file_paths)}"
        return answer

    sheet = spark.createDataFrame(
        [(1, "A", None), (2, "A", ""), (3, "A", "kept"), (4, None, "x"), (5, None, None)], "n int, id string, `Was?` string")
    files = spark.createDataFrame([("A", "a.pdf", 1), ("A", "b.png", 1)], "item string, path string, length bigint")
    for _ in range(2):
        long = jobs.answer_questions(sheet, "id", files, counting, 2, str(tmp_path / "answers"), ["n"])
        assert {r.n: r.answer for r in long.collect()} == {1: "Was? 2", 2: "Was? 2", 3: "kept", 4: "x", 5: None}
    assert asked.value == 1


def test_counts_of_the_writing_pass(spark):
    order = spark.createDataFrame([(1, "A", ""), (2, "B", "C"), (3, "Z", "")], "row_no bigint, sap string, teamcenter string")
    truth = spark.createDataFrame([(1, "B", "", "b"), (2, "", "C", "c"), (3, "A", "", "a")], "row_no bigint, sap string, teamcenter string, label string")
    forms = spark.createDataFrame([], "participant string, row_no bigint, sap string, teamcenter string, label string")
    made = jobs.annotation_lookups(order, truth, forms, ["P1", "P2"])
    assert made["ground truth"][1] == {"rows": 3, "found": 1, "contradicting": 1}
    assert made["participant forms"][1] == {"rows": 6, "found": 0, "contradicting": 0}
    empty = jobs.annotation_lookups(order.limit(0), truth, forms, ["P1"])
    assert [counts["rows"] for _, counts in empty.values()] == [0, 0]


def test_annotate_job(spark):
    order = spark.createDataFrame([(1, "A", ""), (2, "B", "")], "row_no bigint, sap string, teamcenter string")
    truth = spark.createDataFrame([(1, "B", "", "t2"), (2, "A", "", "t1")], "row_no bigint, sap string, teamcenter string, label string")
    forms = spark.createDataFrame([("P1", 1, "A", "", "x")], "participant string, row_no bigint, sap string, teamcenter string, label string")
    overview, facts = jobs.annotate(order, truth, forms, ["P1"])
    assert [(r.ground_truth, r.P1) for r in overview.collect()] == [("t1", "x"), ("t2", None)] and facts == {"rows": 2, "expected": 70}
    with pytest.raises(ValueError):
        jobs.annotate(order, truth.union(truth), forms, ["P1"])


def test_arrivals_are_labelled_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([("1", "ok"), ("2", "ok")], "item string, prompt string").selectExpr(
        "item", "prompt", "0L part", "array('a.pdf') paths", "1 n_files", "1L total_bytes")
    for batch in (rows, rows.where("item = '2'").union(rows.withColumn("item", F.lit("3")).limit(1))):
        batch.write.mode("append").parquet(src)
        label_arrivals(spark, src, out, state, client, 2)
    label_arrivals(spark, src, out, state, client, 2)
    assert sorted(r.item for r in stored_results(spark, out).collect()) == ["1", "2", "3"]


def test_written_answers_cost_one_call_each(spark, tmp_path):
    log = str(tmp_path / "calls")

    def make_client():
        def answer(prompt, _paths):
            with open(log, "a") as out:
                out.write(prompt + "\n")
            return "x"

        return answer

    requests = spark.range(20).selectExpr("cast(id as string) item", "0L part", "concat('p', id) prompt", "array('a') paths")
    replies = settled(labelling.label_requests(requests, make_client, 4))
    assert replies.count() == 20 and replies.where("response = 'x'").count() == 20
    with open(log) as calls:
        assert sorted(calls.read().split()) == sorted(f"p{n}" for n in range(20))


def test_zero_shot(spark):
    items = spark.createDataFrame([("1", "Greifer"), ("2", " "), ("3", "broken")], "item string, name string")
    known = spark.createDataFrame([("1", "Greifer"), ("2", "Roboter"), ("3", "Roboter")], "item string, ground_truth string")
    out = jobs.zero_shot(items, known, CLASSES, client, 2)
    got = {r.item: r.predicted_label for r in out["results"].collect()}
    assert got == {"1": "Greifer", "2": "FEHLER: Kein Baugruppenname", "3": "FEHLER: RuntimeError: no service"}
    assert sum(r.n for r in out["counts"].collect()) == 3


def test_classify_readable_files(spark):
    items = spark.createDataFrame([("1", "S00001", None, "wordy", None), ("2", "S00009", None, "x", "y"), ("3", None, "T00003", "plain", None)],
                                  "item string, sap string, teamcenter string, name_en string, name_de string")
    folders = spark.createDataFrame([("/r/a", "BG_S00001"), ("/r/b", "T00003"), ("/r/c", "other")], "folder string, name string")
    files = spark.createDataFrame([("/r/a", "a.pdf", 3), ("/r/a", "s/b.png", 3), ("/r/a", "c.xlsx", 3), ("/r/a", "d.pdf", 0), ("/r/b", ".h/e.pdf", 3)],
                                  "folder string, rel_path string, length bigint").withColumn("path", F.concat_ws("/", "folder", "rel_path"))
    out = jobs.classify_readable_files(items, folders, files, CLASSES, client, 2, wait_seconds=0)
    got = {r.item: r for r in out["results"].collect()}
    assert (got["1"].label, got["1"].file_count, got["1"].attempts) == ("Greifer", 2, 2), "asked once more"
    assert (got["2"].label, got["2"].matched_folder, got["2"].match_status) == (None, None, "Kein passender Ordner gefunden")
    assert (got["3"].label, got["3"].file_count, got["3"].attempts) == ("Greifer", 0, 1)
    assert sorted(r.path for r in out["skipped"].collect()) == ["/r/a/c.xlsx", "/r/a/d.pdf", "/r/b/.h/e.pdf"]


RETRY = """
import os, sys
from dossier.operators import labelling
from pyspark.sql import SparkSession

folder, path = sys.argv[1:]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
df = spark.createDataFrame([(str(n), 0, f"q{n}", []) for n in range(40)], "item string, part bigint, prompt string, paths array<string>")

def make_client():
    def answer(prompt, paths):
        import uuid
        if len(os.listdir(folder)) == 13:
            open(f"{folder}/broken-{uuid.uuid4().hex}", "w").close()
            os._exit(1)
        open(f"{folder}/{prompt}-{uuid.uuid4().hex}", "w").close()
        return prompt
    return answer

out = labelling.stored_answers(df, make_client, 2, path, bucket_items=4).collect()
assert sorted(r.response for r in out) == sorted(f"q{n}" for n in range(40)), out
"""


def test_a_lost_task_repeats_one_bucket(tmp_path):
    """A worker dies in the middle; the task's next attempt skips the buckets that are stored."""
    import subprocess
    import sys

    calls = tmp_path / "calls"
    calls.mkdir()
    run = subprocess.run([sys.executable, "-c", RETRY, str(calls), str(tmp_path / "answers")], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    made = [f.name for f in calls.iterdir()]
    assert any(n.startswith("broken") for n in made)
    # Each of the two tasks may lose the calls of one bucket at most.
    assert 40 <= len([n for n in made if n.startswith("q")]) <= 40 + 2 * 4
