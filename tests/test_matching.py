import random
import re

import pytest
from pyspark.sql import functions as F

from dossier.operators import cascade, folders, keypair


def rows_of(df, key):
    return {r[key]: r for r in df.collect()}


ITEMS = [
    (2, "0804XX0001", "AS00000001"), (3, " 0804xx0002 ", None), (4, None, "AS00000003"), (5, None, " "),
    (6, "123.0", None), (9, "0804XX0099", "AS00000008"), (10, "0804XX0099", "AS00000009"),
]
FOLDERS = [
    ("A", "0804XX0001"), ("A", "BG_0804XX0002_REV_A"), ("A", "AS00000003"), ("B", "AS00000003"),
    ("B", "0804XX0001_0804XX0002"), ("B", "X0804XX0001Y"), ("C", "REF_00000003"), ("C", "misc"),
    ("C", "0804XX0099"), ("C", "0804XX0099 AS00000008"), ("C", "0804XX0001 AS00000001"),
]


@pytest.fixture(scope="module")
def collected(spark):
    items = spark.createDataFrame(ITEMS, "row_no bigint, sap string, teamcenter string")
    found = spark.createDataFrame([(c, f, f"{c}/{f}") for c, f in FOLDERS], "category string, folder string, path string")
    return items, found, folders.folder_matches(items, found)


def test_folder_matches(collected):
    got = rows_of(collected[2], "path")
    assert len(got) == len(FOLDERS)
    status = {p: r.status for p, r in got.items()}
    assert status["A/0804XX0001"] == status["A/BG_0804XX0002_REV_A"] == "MATCHED"
    assert status["B/0804XX0001_0804XX0002"] == status["C/0804XX0099"] == "AMBIGUOUS"
    assert status["B/X0804XX0001Y"] == status["C/misc"] == status["C/REF_00000003"] == "UNMATCHED"
    assert got["A/0804XX0001"].match_kind == "exact folder name" and got["A/0804XX0001"].matched_by == "SAP-Nummer"
    assert got["C/0804XX0001 AS00000001"].matched_by == "SAP-Nummer + Teamcenter ID"
    assert got["C/0804XX0001 AS00000001"].n_rows == 1
    # Both ids name rows 9 and 10; row 9 carries both and counts once.
    assert got["C/0804XX0099 AS00000008"].n_rows == 2


def test_conflict_reports(collected):
    items, _, matches = collected
    matched = matches.where("status = 'MATCHED'")
    ambiguous = folders.ambiguous_ids(items).collect()
    assert [(r.id, r.n_rows, r.rows) for r in ambiguous] == [("0804XX0099", 2, "9, 10")]
    names = rows_of(folders.duplicate_names(matched), "name")
    assert names["AS00000003"].categories == "A | B" and names["AS00000003"].n_folders == 2
    assert set(rows_of(folders.several_folders(matched), "row_no")) == {2, 4}
    assert {r.row_no for r in folders.missing_items(items, matched).collect()} == {6, 9, 10}
    counts = folders.conflict_counts(items, matches).first()
    assert (counts.ambiguous_folders, counts.ambiguous_ids, counts.duplicate_names, counts.several_folders) == (3, 1, 1, 2)
    with pytest.raises(RuntimeError, match="conflicts"):
        folders.require_no_conflicts(items, matches)
    plan = folders.copy_plan(matched, "/t/", "conflicts").orderBy("n").collect()
    assert [r.n for r in plan] == list(range(1, 6)) and plan[0].destination == "/t/0804XX0001"


def _plain(value):
    raw = (value or "").strip()
    if re.fullmatch(r"\d+(\.0+)?", raw):
        raw = str(int(float(raw)))
    return re.sub("[^a-z0-9]", "", raw.lower())


def brute_cascade(sap, tc, names):
    sap, tc = _plain(sap), _plain(tc)
    keys = [(name, _plain(name)) for name in names]
    tests = []
    for step, both in (("EXACT", lambda i, k: i == k), ("CONTAINS", lambda i, k: i in k)):
        for label, value in ((f"{step}_ASSEMBLY_ID", sap), (f"{step}_TEAMCENTER_ID", tc)):
            if value:
                tests.append((label, value, both))
    for size in range(len(tc), 5, -1):
        tests += [("TEAMCENTER_FRAGMENT", tc[i:i + size], lambda i, k: i in k) for i in range(len(tc) - size + 1)]
    for label, value, test in tests:
        hits = [name for name, key in keys if test(value, key)]
        if hits:
            return (hits[0], label) if len(hits) == 1 else (None, f"AMBIGUOUS_{label}")
    return None, "NOT_FOUND" if sap or tc else "NO_IDENTIFIER"


def brute_two_tier(sap, tc, names):
    def key(v):
        v = (v or "").strip()
        return re.sub("[^A-Z0-9]", "", "" if v.lower() in ("nan", "none") else v.upper())

    ids = {k: key(v) for k, v in (("SAP", sap), ("TEAMCENTER", tc)) if key(v)}
    if not ids:
        return None, "NO_IDENTIFIER"
    exact = {n: [k for k, v in ids.items() if key(n) == v] for n in names}
    exact = {n: m for n, m in exact.items() if m}
    inside = {n: [k for k, v in ids.items() if v in key(n)] for n in names if n not in exact}
    inside = {n: m for n, m in inside.items() if m}
    for found, tier in ((exact, "EXACT"), (inside, "CONTAINS")):
        if len(found) == 1:
            (name, methods), = found.items()
            return name, f"{tier}_" + "+".join(methods)
        if len(found) > 1:
            full = [n for n, m in found.items() if len(m) == len(ids)]
            if tier == "CONTAINS" and len(ids) > 1 and len(full) == 1:
                return full[0], "CONTAINS_SAP+TEAMCENTER"
            return None, f"AMBIGUOUS_{tier}"
    return None, "NOT_FOUND"


def brute_either(sap, tc, names):
    def key(v):
        return re.sub("[^A-Z0-9]", "", (v or "").strip().upper())

    ids = {key(v) for v in (sap, tc) if len(key(v)) >= 4}
    hits = [n for n in names if any(i in key(n) for i in ids)]
    return (hits[0] if len(hits) == 1 else None), len(hits)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_equal_brute_force(spark, seed):
    rng = random.Random(seed)

    def some_id(prefix):
        return prefix + "".join(rng.choice("01A") for _ in range(rng.randrange(5, 8)))

    ids = [some_id("S") for _ in range(25)] + [some_id("T") for _ in range(25)]
    names = set()
    while len(names) < 60:
        a, b = rng.choice(ids), rng.choice(ids)
        names.add(rng.choice([a, a.lower(), f"BG_{a}", f"{a}-{b}", a[1:], f"x {a[2:]} y", f"{a[:3]}-{a[3:]}"]))
    names = sorted(names)
    items = [(f"i{n}", rng.choice([rng.choice(ids), "", None]), rng.choice([rng.choice(ids), "", "none"])) for n in range(80)]
    items.append(("same", ids[0], ids[0]))
    df = spark.createDataFrame(items, "item string, sap string, teamcenter string")
    tree = spark.createDataFrame([(n, n) for n in names], "folder string, name string")
    a, b, c = (rows_of(fn(df, tree), "item") for fn in (cascade.match_cascade, cascade.match_two_tier, cascade.match_either))
    for item, sap, tc in items:
        assert (a[item].folder, a[item].status) == brute_cascade(sap, tc, names), (item, sap, tc)
        assert (b[item].folder, b[item].status) == brute_two_tier(sap, tc, names), (item, sap, tc)
        assert (c[item].folder, c[item].n_candidates) == brute_either(sap, "" if tc == "none" else tc, names) or tc == "none"


def test_cascade_on_hand_made_rows(spark):
    items = spark.createDataFrame([
        ("plain", "0804XX0001", None), ("fragment", None, "AS00000003"), ("none", None, None), ("far", "ZZZZ", None),
    ], "item string, sap string, teamcenter string")
    tree = spark.createDataFrame([(f, f) for f in ("0804XX0001", "X0804XX0001Y", "REF_S00000003", "00000003")], "folder string, name string")
    got = rows_of(cascade.match_cascade(items, tree), "item")
    assert got["plain"].status == "EXACT_ASSEMBLY_ID"
    # An all-digit folder name loses its zeros and is no fragment match.
    assert (got["fragment"].status, got["fragment"].folder, got["fragment"].fragment) == ("TEAMCENTER_FRAGMENT", "REF_S00000003", "s00000003")
    assert got["none"].status == "NO_IDENTIFIER" and got["far"].status == "NOT_FOUND"


def test_hot_id_does_not_multiply(spark):
    """2,000 items and 2,000 folders share one id: the result has one row per item."""
    items = spark.range(2000).selectExpr("cast(id as string) item", "'HOTID0001' sap", "concat('T', id + 100000) teamcenter")
    tree = spark.range(2000).selectExpr("concat('HOTID0001 ', id) folder", "concat('HOTID0001 ', id) name")
    got = cascade.match_two_tier(items, tree)
    assert got.groupBy("status", "n_candidates").count().collect()[0][:] == ("AMBIGUOUS_CONTAINS", 2000, 2000)


def test_two_keys(spark):
    target = spark.createDataFrame([(1, "A", "X"), (2, "A", "Y"), (3, "B", ""), (4, "", "Z"), (5, "C", "X"), (6, "D", "D"),
                                    (7, "E", "Q"), (8, "A", "")], "row_no bigint, sap string, teamcenter string")
    source = spark.createDataFrame([(1, "A", "X", "l1"), (2, "A", "Y", "l2"), (3, "B", "V", "l3"), (4, "W", "Z", "l4"),
                                    (5, "C", "U", "l5"), (6, "E", "Q", "l6"), (7, "E", "Q", "l7")],
                                   "row_no bigint, sap string, teamcenter string, label string")
    got = rows_of(keypair.find_rows(target, source, ["label"]), "row_no")
    assert {n: (r.outcome, r.found_label) for n, r in got.items()} == {
        1: ("BOTH", "l1"), 2: ("BOTH", "l2"), 3: ("SAP", "l3"), 4: ("TEAMCENTER", "l4"), 5: ("DIFFERENT_ROWS", None),
        6: ("NONE", None), 7: ("AMBIGUOUS", None), 8: ("AMBIGUOUS", None)}
    with pytest.raises(ValueError, match="different rows"):
        keypair.require_clean(keypair.find_rows(target, source, ["label"]), "form")


def test_annotation_overview(spark):
    order = spark.createDataFrame([(1, "A", ""), (2, "B", "Y"), (3, "", "Z"), (4, "", "")], "row_no bigint, sap string, teamcenter string")
    truth = spark.createDataFrame([(1, "B", "Y", "t2", "nb"), (2, "A", "", "t1", "na"), (3, "", "Z", "t3", "nz")],
                                  "row_no bigint, sap string, teamcenter string, label string, name string")
    forms = spark.createDataFrame([("P1", 1, "A", "", "x"), ("P1", 2, "B", "Y", "y"), ("P2", 1, "", "Z", "z"), ("P2", 2, "B", "", "w")],
                                  "participant string, row_no bigint, sap string, teamcenter string, label string")
    got = rows_of(keypair.annotation_overview(order, truth, forms, ["P1", "P2"], ["name"]), "row_no")
    assert (got[1].ground_truth, got[1].P1, got[1].P2, got[1].name) == ("t1", "x", None, "na")
    assert (got[2].ground_truth, got[2].P1, got[2].P2) == ("t2", "y", "w")
    assert (got[3].ground_truth, got[3].P1, got[3].P2) == ("t3", None, "z")


def test_candidates_of_ambiguous_items(spark):
    items = spark.createDataFrame([("1", "A1", None), ("2", "B2", "C3"), ("3", "D4", None)], "item string, sap string, teamcenter string")
    names = spark.createDataFrame([("f1", "A1"), ("f2", "A1"), ("f3", "xA1x"), ("f4", "B2 old"), ("f5", "B2 new"), ("f6", "D4")], "folder string, name string")
    got = sorted(tuple(r) for r in cascade.two_tier_candidates(items, names).collect())
    assert got == [("1", "EXACT", "f1"), ("1", "EXACT", "f2"), ("2", "CONTAINS", "f4"), ("2", "CONTAINS", "f5")]


def test_a_used_target_is_refused(spark):
    with pytest.raises(FileExistsError):
        folders.require_empty_target(spark.createDataFrame([("/t/x",)], "path string"))
    folders.require_empty_target(spark.createDataFrame([], "path string"))


def test_cascade_broadcasts_no_parts_of_names(spark):
    """Names are cut into many parts, which the estimates of sizes leave out."""
    items = spark.createDataFrame([("i1", "PX1", "AS12345678"), ("i2", None, "AS92345678")], "item string, sap string, teamcenter string")
    found = spark.createDataFrame([("f1", "DOC-PX1-B"), ("f2", "REF_2345678")], "folder string, name string")
    for df in (cascade.containment(items.select(F.explode(F.array("sap", "teamcenter")).alias("id")).where("id is not null"),
                                   found.withColumnRenamed("name", "key")), cascade.match_cascade(items, found)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    got = {r.item: (r.folder, r.status, r.fragment) for r in df.collect()}
    assert got == {"i1": ("f1", "CONTAINS_ASSEMBLY_ID", None), "i2": ("f2", "TEAMCENTER_FRAGMENT", "2345678")}
