"""The same queries in plain SQL, written independently of the operators.

The text runs in another engine over the same tables and is compared with the results.
"""

from __future__ import annotations

SQL: dict[str, str] = {}


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select  # a select may go on with ", name AS (...)"


# --- evaluation -----------------------------------------------------------------------

TRUTH = """truth AS (
  SELECT o_orderkey AS row_no, CAST(o_orderkey AS VARCHAR) AS sap, 't' || CAST(o_orderkey AS VARCHAR) AS tc,
         o_orderpriority AS label
  FROM orders WHERE o_orderstatus <> 'P')"""

MATCHED = """preds AS (
  SELECT 'model_' || l_returnflag AS model,
         (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS prediction_row,
         CASE WHEN l_linenumber = 7 THEN 'X' || CAST(l_orderkey AS VARCHAR)
              WHEN l_linestatus = 'F' THEN CAST(l_orderkey AS VARCHAR) END AS sap,
         CASE WHEN l_linenumber <> 7 THEN ' t' || CAST(l_orderkey AS VARCHAR) END AS teamcenter,
         CASE WHEN round(l_discount * 100) = 0 THEN NULL
              WHEN round(l_tax * 100) = 8 THEN 'UNRECOGNISED_RESPONSE'
              WHEN l_quantity <= 10 THEN '1-URGENT' WHEN l_quantity <= 20 THEN '2-HIGH'
              WHEN l_quantity <= 30 THEN '3-MEDIUM' WHEN l_quantity <= 40 THEN '4-NOT SPECIFIED'
              ELSE '5-LOW' END AS predicted_label
  FROM lineitem),
matched AS (
  SELECT p.model, p.prediction_row, coalesce(a.row_no, b.row_no) AS truth_row, p.sap, p.teamcenter,
         coalesce(a.label, b.label) AS ground_truth, p.predicted_label,
         CASE WHEN a.label IS NOT NULL THEN 'SAP' WHEN b.label IS NOT NULL THEN 'TEAMCENTER'
              ELSE 'NOT_MATCHED' END AS match_method,
         coalesce(coalesce(a.label, b.label) = p.predicted_label, false) AS correct
  FROM preds p LEFT JOIN truth a ON a.sap = p.sap LEFT JOIN truth b ON b.tc = trim(p.teamcenter))"""

AXIS = """matched AS (
  SELECT 'largest_axis' AS model, vec_id AS prediction_row, CAST(label AS VARCHAR) AS ground_truth,
         CAST((list_position(embedding, list_max(embedding)) - 1) % 10 AS VARCHAR) AS predicted_label
  FROM embeddings)"""

CLASSES_CTE = """ev AS (SELECT * FROM matched WHERE ground_truth IS NOT NULL AND predicted_label IS NOT NULL),
labels_of AS (SELECT DISTINCT model, ground_truth AS class FROM ev UNION SELECT DISTINCT model, predicted_label FROM ev),
counted AS (
  SELECT l.model, l.class,
         count(*) FILTER (WHERE e.ground_truth = l.class) AS support,
         count(*) FILTER (WHERE e.ground_truth = l.class AND e.predicted_label = l.class) AS tp,
         count(*) FILTER (WHERE e.ground_truth <> l.class AND e.predicted_label = l.class) AS fp,
         count(*) FILTER (WHERE e.ground_truth = l.class AND e.predicted_label <> l.class) AS fn,
         count(*) FILTER (WHERE e.ground_truth <> l.class AND e.predicted_label <> l.class) AS tn
  FROM labels_of l JOIN ev e ON e.model = l.model GROUP BY ALL),
rated AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall FROM counted),
classes AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE
                 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rated),
summary AS (
  SELECT model, sum(support)::BIGINT AS evaluated_rows, sum(tp)::BIGINT AS correct_rows,
         sum(tp)::DOUBLE / sum(support) AS accuracy,
         avg(precision) FILTER (WHERE support > 0) AS macro_precision,
         avg(recall) FILTER (WHERE support > 0) AS macro_recall,
         avg(f1) FILTER (WHERE support > 0) AS macro_f1,
         sum(precision * support) / sum(support) AS weighted_precision,
         sum(recall * support) / sum(support) AS weighted_recall,
         sum(f1 * support) / sum(support) AS weighted_f1
  FROM classes GROUP BY model),
coverage AS (
  SELECT model, count(*) AS prediction_rows,
         count(*) FILTER (WHERE match_method <> 'NOT_MATCHED') AS matched_rows,
         count(*) FILTER (WHERE match_method = 'NOT_MATCHED') AS unmatched_rows,
         count(*) FILTER (WHERE predicted_label IS NULL) AS missing_prediction_rows,
         count(*) FILTER (WHERE predicted_label IN ('UNRECOGNISED_RESPONSE', 'ERROR', 'API_ERROR'))
           AS unrecognised_or_error_rows
  FROM matched GROUP BY model)"""

RATES = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision",
         "weighted_recall", "weighted_f1"]
ROUNDED_RATES = ", ".join(f"round({r}, 6) AS {r}" for r in RATES)
PER_CLASS = ("SELECT model, class, support, tp, fp, fn, tn, round(precision, 6) AS precision, "
             "round(recall, 6) AS recall, round(f1, 6) AS f1 FROM classes")

SQL["eval_matched_rows"] = with_ctes(TRUTH, MATCHED, select="SELECT * FROM matched")
SQL["eval_confusion"] = with_ctes(TRUTH, MATCHED, select="""
SELECT model, ground_truth, predicted_label, count(*) AS n FROM matched
WHERE ground_truth IS NOT NULL AND predicted_label IS NOT NULL GROUP BY ALL""")
SQL["eval_confusion_wide"] = with_ctes(TRUTH, MATCHED, """names AS (
  SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', 'UNRECOGNISED_RESPONSE']) AS ground_truth),
rows_of AS (SELECT DISTINCT m.model, n.ground_truth FROM matched m, names n)""", select="""
SELECT r.model, r.ground_truth,
  count(*) FILTER (WHERE predicted_label = '1-URGENT') AS urgent,
  count(*) FILTER (WHERE predicted_label = '2-HIGH') AS high,
  count(*) FILTER (WHERE predicted_label = '3-MEDIUM') AS medium,
  count(*) FILTER (WHERE predicted_label = '4-NOT SPECIFIED') AS unspecified,
  count(*) FILTER (WHERE predicted_label = '5-LOW') AS low,
  count(*) FILTER (WHERE predicted_label = 'UNRECOGNISED_RESPONSE') AS unrecognised
FROM rows_of r LEFT JOIN matched m USING (model, ground_truth) GROUP BY ALL""")
SQL["eval_per_class"] = with_ctes(TRUTH, MATCHED, CLASSES_CTE, select=PER_CLASS)
SQL["eval_summary"] = with_ctes(TRUTH, MATCHED, CLASSES_CTE, select=f"""
SELECT c.*, s.evaluated_rows, s.correct_rows, {ROUNDED_RATES} FROM coverage c JOIN summary s USING (model)""")
SQL["eval_run_counts"] = with_ctes(TRUTH, MATCHED, CLASSES_CTE, select="SELECT * FROM coverage")
SQL["model_ranking"] = with_ctes(TRUTH, MATCHED, CLASSES_CTE, select="""
SELECT model, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy FROM summary
ORDER BY 2 DESC, 3 DESC, 1""")
ORDER_CTES = """ev AS (
  SELECT * FROM matched WHERE ground_truth IS NOT NULL AND predicted_label IS NOT NULL),
firsts AS (
  SELECT model, ground_truth AS label, false AS only_predicted, min(prediction_row) AS f FROM ev GROUP BY 1, 2
  UNION ALL
  SELECT model, predicted_label, true, min(prediction_row) FROM ev e
  WHERE NOT EXISTS (SELECT 1 FROM ev t WHERE t.model = e.model AND t.ground_truth = e.predicted_label) GROUP BY 1, 2),
ordered AS (SELECT model, label, only_predicted, row_number() OVER (PARTITION BY model ORDER BY only_predicted, f) AS ord FROM firsts)"""
SQL["label_order"] = with_ctes(TRUTH, MATCHED, ORDER_CTES, select="SELECT * FROM ordered")
SQUARE_CTE = """square AS (
  SELECT t.model, t.ord AS truth_ord, t.label AS ground_truth, p.ord AS predicted_ord, p.label AS predicted_label,
    (SELECT count(*) FROM ev e WHERE e.model = t.model AND e.ground_truth = t.label AND e.predicted_label = p.label) AS n
  FROM ordered t JOIN ordered p USING (model))"""
SQL["eval_confusion_square"] = with_ctes(TRUTH, MATCHED, ORDER_CTES, SQUARE_CTE, select="SELECT * FROM square")
SQL["eval_confusion_ranked"] = with_ctes(TRUTH, MATCHED, ORDER_CTES, SQUARE_CTE, select="""
SELECT model, truth_ord AS ord, ground_truth AS label, sum(n) FILTER (WHERE predicted_ord = 1)::BIGINT AS n_1,
  sum(n) FILTER (WHERE predicted_ord = 2)::BIGINT AS n_2, sum(n) FILTER (WHERE predicted_ord = 3)::BIGINT AS n_3,
  sum(n) FILTER (WHERE predicted_ord = 4)::BIGINT AS n_4, sum(n) FILTER (WHERE predicted_ord = 5)::BIGINT AS n_5,
  sum(n) FILTER (WHERE predicted_ord = 6)::BIGINT AS n_6 FROM square GROUP BY ALL""")
SQL["eval_largest_axis"] = with_ctes(AXIS, CLASSES_CTE.split(",\nsummary AS")[0], select=PER_CLASS)
SQL["truth_lookup"] = """SELECT 'SAP' AS id_type, CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS label, o_orderkey AS row_no
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'Teamcenter', 't' || CAST(o_orderkey AS VARCHAR), o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus <> 'P'"""
SQL["truth_conflicts"] = """WITH t AS (
  SELECT 'SAP' AS id_type, CAST(user_id AS VARCHAR) AS key, event_type AS label, event_id AS row_no FROM events
  UNION ALL
  SELECT 'Teamcenter', 'k' || json_extract_string(props, '$.k'), event_type, event_id FROM events),
f AS (SELECT id_type, key, label, min(row_no) AS first_row FROM t GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY id_type, key) AS n_labels FROM f)
SELECT id_type, key, n_labels, label, first_row FROM r WHERE n_labels > 1"""

# --- ids and names --------------------------------------------------------------------

SQL["id_normalise"] = """WITH r AS (
  SELECT 'supplier' AS source, s_suppkey AS k, s_name AS s, s_name AS shown FROM supplier
  UNION ALL SELECT 'part', p_partkey, p_brand, p_brand FROM part
  UNION ALL SELECT 'orders', o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '.0', NULL FROM orders
  UNION ALL SELECT 'events', event_id, CASE WHEN event_type = 'error' THEN 'NaN' ELSE event_type || '_1' END, NULL FROM events)
SELECT source, k, upper(s) AS master,
  CASE WHEN source = 'orders' THEN CAST(k AS VARCHAR) ELSE lower(regexp_replace(s, '[^A-Za-z0-9]', '', 'g')) END AS plain,
  CASE WHEN s = 'NaN' THEN '' ELSE s END AS cell,
  CASE WHEN s = 'NaN' THEN '' ELSE regexp_replace(upper(s), '[^A-Z0-9]', '', 'g') END AS cell_key,
  CASE WHEN s = 'NaN' THEN '' WHEN source = 'orders' THEN lpad(CAST(k AS VARCHAR), 10, '0')
       ELSE regexp_replace(upper(s), '[^A-Z0-9]', '', 'g') END AS search,
  s AS sheet, s AS label, regexp_replace(lower(s), '[^a-z0-9]', '', 'g') AS header
FROM r"""

FOLDERS = """named AS (
  SELECT 'status_' || o_orderstatus AS category, o_orderkey,
    CASE o_orderpriority
      WHEN '1-URGENT' THEN 'C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
      WHEN '2-HIGH' THEN 'bg_c' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '_rev a'
      WHEN '3-MEDIUM' THEN 'C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '-C' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')
      WHEN '4-NOT SPECIFIED' THEN 'XC' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || 'Y'
      ELSE 'N' || lpad(CAST(month(o_orderdate) AS VARCHAR), 9, '0') || ' C' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
    END AS folder FROM orders),
folders AS (SELECT category, folder, 'raw/' || CAST(o_orderkey AS VARCHAR) || '/' || category || '/' || folder AS path FROM named),
tokens AS (
  SELECT path, token, min(place) AS place FROM (
    SELECT path, unnest(parts) AS token, generate_subscripts(parts, 1) AS place
    FROM (SELECT path, string_split_regex(upper(folder), '[^A-Z0-9]+') AS parts FROM folders))
  WHERE length(token) = 10 GROUP BY path, token)"""

SQL["embedded_id_list"] = with_ctes(FOLDERS, select="""
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY place) - 1 AS INTEGER) AS pos, token AS id FROM tokens""")

PART_ITEMS = """items AS (
  SELECT 'item' || CAST(p_partkey AS VARCHAR) AS item,
    CASE WHEN p_type = 'SMALL' OR (p_type = 'MEDIUM' AND p_size <= 5) THEN NULL
         ELSE 'PX' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') END AS sap,
    CASE WHEN p_type = 'PROMO' OR (p_type = 'MEDIUM' AND p_size <= 5) THEN NULL
         ELSE 'AS' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') END AS tc
  FROM part)"""
CUSTOMER_FOLDERS = """cust AS (
  SELECT *, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS d FROM customer),
fold AS (
  SELECT name || '#' || CAST(c_custkey AS VARCHAR) AS folder, regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS k
  FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'PX' || d || '_AS' || d
      WHEN c_mktsegment = 'BUILDING' THEN 'PX' || d
      WHEN c_mktsegment = 'AUTOMOBILE' THEN 'BG_PX' || d || '_REV_A'
      WHEN c_mktsegment = 'MACHINERY' THEN 'as' || d
      WHEN c_mktsegment = 'HOUSEHOLD' THEN 'DOC-AS' || d || '-B'
      ELSE 'REF_S' || d END AS name FROM cust))"""
PIECES = """pieces AS (
  SELECT item, piece, min(rank) AS rank FROM (
    SELECT item, substr(tc, CAST(s AS BIGINT), CAST(n AS BIGINT)) AS piece, (10 - n) * 100 + s AS rank
    FROM items, range(6, 11) t(n), range(1, 6) u(s) WHERE tc IS NOT NULL AND s <= 10 - n + 1)
  GROUP BY item, piece)"""

SQL["id_fragments"] = with_ctes(PART_ITEMS, PIECES, select="""
SELECT item, CAST(row_number() OVER (PARTITION BY item ORDER BY rank) - 1 AS INTEGER) AS pos, lower(piece) AS fragment FROM pieces""")
SQL["safe_names"] = """WITH p AS (
  SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '._ ') AS s,
         trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS m FROM pages)
SELECT page_id, substr(s, 1, 90) AS safe, m AS model, CAST(page_id AS VARCHAR) AS participant FROM p"""
SQL["search_texts"] = r"""WITH d AS (
  SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[_\-\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, length(t) AS n, sha256(t) AS digest,
  contains(t, 'license') OR contains(t, 'copyright') OR contains(t, 'ansicht') AS hit FROM d"""

# --- folders and conflicts ------------------------------------------------------------

ITEMS = """items AS (
  SELECT c_custkey + 2 AS row_no, 'C' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS sap,
    CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'N' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0') END AS tc
  FROM customer),
idx AS (SELECT sap AS id, row_no FROM items UNION SELECT tc, row_no FROM items WHERE tc <> '')"""
HITS = """hit AS (
  SELECT t.path, t.token, t.place, x.row_no FROM tokens t JOIN idx x ON x.id = t.token),
ids_of AS (SELECT path, string_agg(token, ', ' ORDER BY place) AS found_ids, list(token) AS found
           FROM (SELECT DISTINCT path, token, place FROM hit) GROUP BY path),
rows_of AS (SELECT path, count(DISTINCT row_no) AS n_rows, min(row_no) AS row_no FROM hit GROUP BY path),
matches AS (
  SELECT f.category, f.folder, f.path,
    CASE WHEN r.n_rows = 1 THEN 'MATCHED' WHEN r.n_rows IS NULL THEN 'UNMATCHED' ELSE 'AMBIGUOUS' END AS status,
    coalesce(r.n_rows, 0) AS n_rows, i.found_ids,
    CASE WHEN r.n_rows = 1 THEN m.row_no END AS row_no, CASE WHEN r.n_rows = 1 THEN m.sap END AS sap,
    CASE WHEN r.n_rows = 1 THEN m.tc END AS teamcenter,
    CASE WHEN r.n_rows = 1 THEN
      CASE WHEN list_contains(i.found, m.sap) AND list_contains(i.found, m.tc) THEN 'SAP-Nummer + Teamcenter ID'
           WHEN list_contains(i.found, m.sap) THEN 'SAP-Nummer' ELSE 'Teamcenter ID' END END AS matched_by,
    CASE WHEN r.n_rows = 1 THEN CASE WHEN list_contains(i.found, upper(f.folder)) THEN 'exact folder name'
      ELSE 'ID contained in folder name' END END AS match_kind
  FROM folders f LEFT JOIN rows_of r USING (path) LEFT JOIN ids_of i USING (path)
  LEFT JOIN items m ON m.row_no = r.row_no),
good AS (SELECT * FROM matches WHERE status = 'MATCHED')"""

SQL["folder_match"] = with_ctes(FOLDERS, ITEMS, HITS, select="SELECT * FROM matches")
SQL["unmatched_folders"] = with_ctes(FOLDERS, ITEMS, HITS, select="SELECT category, folder, path FROM matches WHERE status = 'UNMATCHED'")
SQL["ambiguous_ids"] = with_ctes(ITEMS, select="""
, c AS (SELECT id, row_no, count(*) OVER (PARTITION BY id) AS n_rows,
        row_number() OVER (PARTITION BY id ORDER BY row_no) AS rn FROM idx)
SELECT id, n_rows, (rn - 1) // 1000 AS part, string_agg(CAST(row_no AS VARCHAR), ', ' ORDER BY row_no) AS rows
FROM c WHERE n_rows > 1 GROUP BY ALL""".lstrip())
SQL["duplicate_names"] = with_ctes(FOLDERS, ITEMS, HITS, select="""
, c AS (SELECT upper(folder) AS name, *, count(*) OVER (PARTITION BY upper(folder)) AS n_folders,
        row_number() OVER (PARTITION BY upper(folder) ORDER BY lower(category), lower(folder), path) AS rn FROM good)
SELECT name, n_folders, (rn - 1) // 1000 AS part, string_agg(category, ' | ' ORDER BY rn) AS categories,
  string_agg(path, ' | ' ORDER BY rn) AS paths FROM c WHERE n_folders > 1 GROUP BY ALL""".lstrip())
SQL["several_folders"] = with_ctes(FOLDERS, ITEMS, HITS, select="""
, c AS (SELECT *, count(*) OVER (PARTITION BY row_no) AS n_folders,
        row_number() OVER (PARTITION BY row_no ORDER BY lower(category), lower(folder), path) AS rn FROM good)
SELECT row_no, sap, teamcenter, n_folders, (rn - 1) // 1000 AS part, string_agg(folder, ' | ' ORDER BY rn) AS folders,
  string_agg(path, ' | ' ORDER BY rn) AS paths FROM c WHERE n_folders > 1 GROUP BY ALL""".lstrip())
SQL["ambiguous_id_rows"] = with_ctes(ITEMS, select="""
, c AS (SELECT id, row_no, count(*) OVER (PARTITION BY id) AS n_rows FROM idx)
SELECT id, row_no, n_rows FROM c WHERE n_rows > 1""".lstrip())
SQL["duplicate_name_rows"] = with_ctes(FOLDERS, ITEMS, HITS, select="""
, c AS (SELECT upper(folder) AS name, category, folder, path, count(*) OVER (PARTITION BY upper(folder)) AS n_folders FROM good)
SELECT * FROM c WHERE n_folders > 1""".lstrip())
SQL["several_folder_rows"] = with_ctes(FOLDERS, ITEMS, HITS, select="""
, c AS (SELECT row_no, sap, teamcenter, category, folder, path, count(*) OVER (PARTITION BY row_no) AS n_folders FROM good)
SELECT * FROM c WHERE n_folders > 1""".lstrip())
SQL["missing_items"] = with_ctes(FOLDERS, ITEMS, HITS, select="""
SELECT row_no, sap, tc AS teamcenter FROM items i WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.row_no = i.row_no)""")
SQL["collect_gate"] = with_ctes(FOLDERS, ITEMS, HITS, select="""
, k AS (SELECT (SELECT count(*) FROM matches WHERE status = 'AMBIGUOUS') AS ambiguous_folders,
  (SELECT count(*) FROM (SELECT id FROM idx GROUP BY id HAVING count(*) > 1)) AS ambiguous_ids,
  (SELECT count(*) FROM (SELECT 1 FROM good GROUP BY upper(folder) HAVING count(*) > 1)) AS duplicate_names,
  (SELECT count(*) FROM (SELECT 1 FROM good GROUP BY row_no HAVING count(*) > 1)) AS several_folders)
SELECT *, ambiguous_folders + ambiguous_ids + duplicate_names + several_folders AS conflicts,
  ambiguous_folders + ambiguous_ids + duplicate_names + several_folders > 0 AS blocked FROM k""".lstrip())
SQL["copy_plan"] = with_ctes(FOLDERS, ITEMS, HITS, select="""
SELECT row_number() OVER (ORDER BY lower(category), lower(folder), path) AS n, folder, path AS source,
  '/data/processed/' || folder AS destination, 'conflicts' AS blocked_reason FROM good""")

STEP_COUNTS = """ids AS (SELECT sap AS id FROM items WHERE sap IS NOT NULL UNION SELECT tc FROM items WHERE tc IS NOT NULL),
inside AS (SELECT i.id, f.folder, f.k = i.id AS exact FROM ids i JOIN fold f ON contains(f.k, i.id)),
per_id AS (SELECT id, count(*) FILTER (WHERE exact) AS ne, min(folder) FILTER (WHERE exact) AS fe,
           count(*) AS nc, min(folder) AS fc FROM inside GROUP BY id)"""
SQL["match_cascade"] = with_ctes(PART_ITEMS, CUSTOMER_FOLDERS, STEP_COUNTS, """steps AS (
  SELECT item, 1 AS step, 'EXACT_ASSEMBLY_ID' AS label, ne AS n, fe AS f, NULL AS piece FROM items JOIN per_id ON id = sap WHERE ne > 0
  UNION ALL SELECT item, 2, 'EXACT_TEAMCENTER_ID', ne, fe, NULL FROM items JOIN per_id ON id = tc WHERE ne > 0
  UNION ALL SELECT item, 3, 'CONTAINS_ASSEMBLY_ID', nc, fc, NULL FROM items JOIN per_id ON id = sap
  UNION ALL SELECT item, 4, 'CONTAINS_TEAMCENTER_ID', nc, fc, NULL FROM items JOIN per_id ON id = tc)""",
  PIECES, """folder_pieces AS (
  SELECT DISTINCT folder, substr(k, CAST(s AS BIGINT), CAST(n AS BIGINT)) AS piece
  FROM fold, range(6, 11) t(n), range(1, 40) u(s) WHERE s <= length(k) - n + 1),
per_piece AS (SELECT piece, count(*) AS n, min(folder) AS f FROM folder_pieces GROUP BY piece),
tries AS (
  SELECT * FROM steps UNION ALL
  SELECT p.item, 100 + p.rank, 'TEAMCENTER_FRAGMENT', q.n, q.f, lower(p.piece) FROM pieces p JOIN per_piece q USING (piece)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY step) AS rn FROM tries) WHERE rn = 1)""",
  select="""SELECT i.item, CASE WHEN b.n = 1 THEN b.f END AS folder,
  CASE WHEN b.n = 1 THEN b.label WHEN b.n > 1 THEN 'AMBIGUOUS_' || b.label
       WHEN i.sap IS NULL AND i.tc IS NULL THEN 'NO_IDENTIFIER' ELSE 'NOT_FOUND' END AS status,
  coalesce(b.n, 0) AS n_candidates, b.piece AS fragment FROM items i LEFT JOIN best b USING (item)""")
PER_ITEM = """either AS (
  SELECT i.item, i.sap, i.tc, x.folder, bool_or(x.id = i.sap) AS by_sap, bool_or(x.id = i.tc) AS by_tc, bool_or(x.exact) AS exact
  FROM items i JOIN inside x ON x.id = i.sap OR x.id = i.tc GROUP BY ALL),
agg AS (
  SELECT item, count(*) FILTER (WHERE exact) AS ne, min(folder) FILTER (WHERE exact) AS fe,
    bool_or(by_sap) FILTER (WHERE exact) AS es, bool_or(by_tc) FILTER (WHERE exact) AS et,
    count(*) AS nc, min(folder) AS fc, bool_or(by_sap) AS cs, bool_or(by_tc) AS ct,
    count(*) FILTER (WHERE by_sap AND by_tc) AS nb, min(folder) FILTER (WHERE by_sap AND by_tc) AS fb
  FROM either GROUP BY item)"""
SQL["match_two_tier"] = with_ctes(PART_ITEMS, CUSTOMER_FOLDERS, STEP_COUNTS, PER_ITEM, select="""
, s AS (SELECT i.item, CASE WHEN i.sap IS NULL AND i.tc IS NULL THEN 'NO_IDENTIFIER'
    WHEN a.ne = 1 THEN 'EXACT_' || CASE WHEN es AND et THEN 'SAP+TEAMCENTER' WHEN es THEN 'SAP' ELSE 'TEAMCENTER' END
    WHEN a.ne > 1 THEN 'AMBIGUOUS_EXACT'
    WHEN a.nc = 1 THEN 'CONTAINS_' || CASE WHEN cs AND ct THEN 'SAP+TEAMCENTER' WHEN cs THEN 'SAP' ELSE 'TEAMCENTER' END
    WHEN a.nc > 1 AND i.sap IS NOT NULL AND i.tc IS NOT NULL AND a.nb = 1 THEN 'CONTAINS_SAP+TEAMCENTER'
    WHEN a.nc > 1 THEN 'AMBIGUOUS_CONTAINS' ELSE 'NOT_FOUND' END AS status,
    CASE WHEN a.ne = 1 THEN fe WHEN a.ne > 1 THEN NULL WHEN a.nc = 1 THEN fc WHEN a.nc > 1 AND a.nb = 1 THEN fb END AS folder,
    coalesce(CASE WHEN a.ne > 0 THEN a.ne ELSE a.nc END, 0) AS n_candidates
  FROM items i LEFT JOIN agg a USING (item))
SELECT item, folder, status, n_candidates, CASE status WHEN 'NO_IDENTIFIER' THEN 'SAP-Nummer und Teamcenter ID fehlen'
  WHEN 'AMBIGUOUS_EXACT' THEN 'Mehrere exakte Treffer' WHEN 'AMBIGUOUS_CONTAINS' THEN 'Mehrere Teiltreffer'
  WHEN 'NOT_FOUND' THEN 'Kein Ordner enthaelt SAP- oder Teamcenter-ID' ELSE '' END AS message FROM s""".lstrip())
SQL["match_either"] = with_ctes(PART_ITEMS, CUSTOMER_FOLDERS, STEP_COUNTS, PER_ITEM, select="""
SELECT i.item, CASE WHEN a.nc = 1 THEN a.fc END AS folder,
  CASE WHEN i.sap IS NULL AND i.tc IS NULL THEN 'Keine gueltige SAP- oder Teamcenter-Nummer'
       WHEN a.nc = 1 THEN 'OK' WHEN a.nc IS NULL THEN 'Kein passender Ordner gefunden'
       ELSE 'Mehrere passende Ordner gefunden (' || CAST(a.nc AS VARCHAR) || ')' END AS status,
  coalesce(a.nc, 0) AS n_candidates FROM items i LEFT JOIN agg a USING (item)""")
TWICE = CUSTOMER_FOLDERS.replace("fold AS (", "once AS (") + """,
fold AS (SELECT * FROM once UNION ALL SELECT folder || '-2', k FROM once)"""
SQL["two_tier_candidates"] = with_ctes(PART_ITEMS, TWICE, STEP_COUNTS, PER_ITEM, select="""
SELECT e.item, CASE WHEN a.ne > 1 THEN 'EXACT' ELSE 'CONTAINS' END AS tier, e.folder FROM either e JOIN agg a USING (item)
WHERE (a.ne > 1 AND e.exact) OR (a.ne = 0 AND a.nc > 1 AND NOT (e.sap IS NOT NULL AND e.tc IS NOT NULL AND a.nb = 1))""")
SQL["match_candidates"] = with_ctes(PART_ITEMS, CUSTOMER_FOLDERS, STEP_COUNTS, select="SELECT id, folder, exact FROM inside")
SQL["match_by_name"] = """SELECT o_orderkey AS item, o_custkey AS sap, s_name AS folder
FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey"""

# --- inventory ------------------------------------------------------------------------

FILES = """raw_files AS (
  SELECT 'A' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS assembly,
    ['', 'BOM/', 'cad-zugriff/', 'Datenblatt/', 'Ansichten/', 'alt/_LLM_IGNORE/', '.alt/'][l_linenumber] AS dir,
    (CASE l_returnflag || l_linestatus
      WHEN 'AF' THEN ['x_TLF', 'x_TRF', 'front', 'oben_links', 'DFC_Struktur']
      WHEN 'AO' THEN ['x_BRB', 'x_BLB', 'hinten', 'unten-rechts', 'front']
      WHEN 'NF' THEN ['Zeichnung', 'plan', 'x_TLB', 'top', 'rear_left']
      WHEN 'NO' THEN ['plan', 'rechts', 'TLFX', 'Strukturbaum', 'vorne_oben']
      WHEN 'RF' THEN ['x_BLF', 'x_BRF', 'links', 'view', 'Datasheet']
      ELSE ['~$lock', 'front', 'x_TRB', 'bottom', 'Stückliste'] END)[CAST(floor((l_quantity - 1) / 10) AS INTEGER) + 1]
      || '_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_partkey AS VARCHAR) || '_' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS stem,
    ['.pdf', '.PNG', '.jpg', '.xlsx', '.step', '.idw', '.docx', '.png', '.jpeg', '.csv', ''][CAST(round(l_discount * 100) AS INTEGER) + 1] AS raw_ext,
    CASE WHEN round(l_tax * 100) = 0 THEN 0 ELSE CAST(floor(l_extendedprice * 300) AS BIGINT) END AS length,
    l_returnflag AS flag, l_linestatus AS line_status
  FROM lineitem),
files AS (
  SELECT *, dir || stem || raw_ext AS rel_path, stem || raw_ext AS file_name, rtrim(dir, '/') AS sub,
    lower(raw_ext) AS ext, lower(dir || stem || raw_ext) AS p,
    replace(replace(lower(dir || stem || raw_ext), '_', ' '), '-', ' ') AS q FROM raw_files)"""

TYPED = """typed AS (
  SELECT *, round_even(length / 1048576.0::DOUBLE, 3) AS size_mb,
    CASE WHEN contains(p, 'cad-zugriff') OR contains(p, 'cad_zugriff') OR contains(p, 'cad zugriff') THEN 'CAD_access_ignore'
      WHEN ext IN ('.png', '.jpg', '.jpeg') AND ((contains(q, 'dfc') AND (contains(q, 'struktur') OR contains(q, 'strucktur') OR contains(q, 'structure')))
        OR contains(q, 'strukturbaum') OR contains(q, 'baugruppenstruktur')) THEN 'DFC_structure_screenshot'
      WHEN ext = '.idw' THEN 'IDW_drawing'
      WHEN contains(p, 'stückliste') OR contains(p, 'stueckliste') OR contains(p, 'bom') OR contains(p, 'teileliste')
        OR contains(p, 'part list') OR contains(p, 'parts list') THEN 'BOM'
      WHEN contains(p, 'datenblatt') OR contains(p, 'datasheet') OR contains(p, 'data sheet') THEN 'Datenblatt'
      WHEN contains(p, 'zeichnung') OR contains(p, 'drawing') THEN 'Technische_Zeichnung'
      WHEN ext IN ('.iam', '.ipt', '.stp', '.step') THEN 'CAD_raw'
      WHEN ext IN ('.png', '.jpg', '.jpeg') OR contains(p, 'screenshot') OR contains(p, 'view') OR contains(p, 'ansicht')
        OR contains(p, 'cad') THEN 'CAD_screenshot'
      WHEN ext IN ('.xlsx', '.xls', '.csv') THEN 'Excel_unknown'
      WHEN ext = '.pdf' THEN 'Technische_Zeichnung' ELSE 'unknown' END AS kind
  FROM files WHERE file_name NOT LIKE '~$%'),
ranked AS (
  SELECT *, CASE WHEN kind = 'Technische_Zeichnung' THEN 'priority_1_candidate'
    WHEN kind IN ('DFC_structure_screenshot', 'BOM', 'Datenblatt', 'Excel_unknown') THEN 'priority_2_candidate'
    ELSE 'nein' END AS prio FROM typed)"""

DIRECTIONS = {
    "top": ("T", 1, ["top", "oben"], 1), "bottom": ("B", 1, ["bottom", "unten"], 2),
    "left": ("L", 2, ["left", "links", "linke", "linker"], 4),
    "right": ("R", 2, ["right", "rechts", "rechte", "rechter"], 8),
    "front": ("F", 3, ["front", "vorne", "vorn", "vorder"], 16),
    "back": ("B", 3, ["back", "rear", "hinten", "rueck", "ruck", "rück"], 32),
}
BITS = " + ".join(
    f"CASE WHEN CASE WHEN code <> '' THEN substr(code, {place}, 1) = '{letter}' "
    f"ELSE list_has_any(words, {words}) END THEN {bit} ELSE 0 END"
    for letter, place, words, bit in DIRECTIONS.values()
)
VIEWS = f"""coded AS (
  SELECT *, regexp_extract(upper(stem), '(?:^|[^A-Z0-9])([TB][LR][FB])(?:$|[^A-Z0-9])', 1) AS code,
    regexp_extract_all(lower(stem), '[a-zäöüß]+') AS words FROM ranked WHERE kind = 'CAD_screenshot'),
v AS (SELECT assembly, rel_path, {BITS} AS m, size_mb AS sz, lower(file_name) AS nm, lower(rel_path) AS lp FROM coded)"""

ORDER = "bit_count(m) DESC, sz DESC, nm, lp, rel_path"


def _pick(name: str, earlier: list[str], where: str, score: str, free_only: bool) -> str:
    taken = " UNION ALL ".join(f"SELECT * FROM {e}" for e in earlier) or "SELECT NULL AS assembly, NULL AS rel_path, 0 AS m WHERE false"
    free = "AND coalesce(c.n, 0) < 3" if free_only else ""
    return f"""{name} AS (
  WITH taken AS ({taken}),
  c AS (SELECT assembly, bit_or(m) AS cov, count(*) AS n FROM taken GROUP BY assembly),
  o AS (SELECT v.*, row_number() OVER (PARTITION BY v.assembly ORDER BY {score}, {ORDER.replace('bit_count(m)', 'bit_count(v.m)')}) AS rn
        FROM v LEFT JOIN c USING (assembly) {"LEFT JOIN pick1 f USING (assembly)" if name == "pick2" else ""}
        WHERE ({where}) {free} AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.assembly = v.assembly AND t.rel_path = v.rel_path))
  SELECT assembly, rel_path, m FROM o WHERE rn = 1)""".replace("sz DESC, nm, lp, rel_path)", "v.sz DESC, v.nm, v.lp, v.rel_path)")


UNCOVERED = "bit_count(v.m & ~coalesce(c.cov, 0)) DESC"
PICKS = [
    _pick("pick1", [], "v.m & 17 = 17 AND v.m & 12 <> 0", "0", False),
    _pick("pick2", ["pick1"], "v.m & 34 = 34 AND v.m & 12 <> 0",
          "CASE WHEN (f.m & 4 <> 0 AND v.m & 8 <> 0) OR (f.m & 8 <> 0 AND v.m & 4 <> 0) THEN 0 ELSE 1 END", False),
    _pick("pick3", ["pick1", "pick2"], "v.m = 16", "0", False),
    _pick("pick4", ["pick1", "pick2", "pick3"], "true", UNCOVERED, True),
    _pick("pick5", ["pick1", "pick2", "pick3", "pick4"], "true", UNCOVERED, True),
    _pick("pick6", ["pick1", "pick2", "pick3", "pick4", "pick5"], "true", UNCOVERED, True),
    "picked AS (" + " UNION ALL ".join(f"SELECT * FROM pick{n}" for n in range(1, 7)) + ")",
]
VIEW_NAME = "concat_ws('_', " + ", ".join(
    f"CASE WHEN v.m & {bit} <> 0 THEN '{name}' END" for name, (_, _, _, bit) in DIRECTIONS.items()) + ")"
INVENTORY = """inv AS (
  SELECT r.assembly, r.rel_path, r.sub AS relative_subfolder, r.file_name, r.ext AS file_extension, r.size_mb AS file_size_mb,
    r.kind AS guessed_type, CASE WHEN kind = 'CAD_screenshot' THEN """ + VIEW_NAME + """ ELSE '' END AS cad_view,
    CASE WHEN kind <> 'CAD_screenshot' THEN '' WHEN k.rel_path IS NOT NULL THEN 'ja' ELSE 'nein' END AS cad_selected,
    CASE WHEN kind <> 'CAD_screenshot' THEN prio WHEN k.rel_path IS NOT NULL THEN 'priority_1_candidate' ELSE 'nein' END AS priority,
    '' AS note
  FROM ranked r LEFT JOIN v ON v.assembly = r.assembly AND v.rel_path = r.rel_path
  LEFT JOIN picked k ON k.assembly = r.assembly AND k.rel_path = r.rel_path)"""

SQL["file_inventory"] = with_ctes(FILES, TYPED, VIEWS, *PICKS, INVENTORY, select="SELECT * FROM inv")
SQL["priority_summary"] = with_ctes(FILES, TYPED, VIEWS, *PICKS, INVENTORY, select="""
SELECT s.assembly, count(*) FILTER (WHERE priority = 'priority_1_candidate') AS priority_1_candidate,
  count(*) FILTER (WHERE priority = 'priority_2_candidate') AS priority_2_candidate,
  count(*) FILTER (WHERE priority = 'nein') AS nein
FROM (SELECT 'A' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS assembly FROM supplier) s LEFT JOIN inv USING (assembly) GROUP BY ALL""")
SQL["type_counts"] = with_ctes(FILES, TYPED, select="SELECT kind AS guessed_type, count(*) AS n FROM typed GROUP BY ALL ORDER BY 1")
SQL["file_inventory_older"] = with_ctes(FILES, """old AS (
  SELECT *, CASE WHEN contains(p, 'cad-zugriff') OR contains(p, 'cad_zugriff') OR contains(p, 'cad zugriff') THEN 'CAD_access_ignore'
    WHEN regexp_matches(p, 'stückliste|stueckliste|bom|teileliste|parts? list') THEN 'BOM'
    WHEN regexp_matches(p, 'datenblatt|data ?sheet') THEN 'Datenblatt'
    WHEN regexp_matches(p, 'zeichnung|drawing') THEN 'Technische_Zeichnung'
    WHEN ext IN ('.iam', '.ipt', '.stp', '.step') THEN 'CAD_raw_ignore_first'
    WHEN ext IN ('.png', '.jpg', '.jpeg') OR regexp_matches(p, 'screenshot|view|ansicht|cad') THEN 'CAD_screenshot'
    WHEN ext IN ('.xlsx', '.xls', '.csv') THEN 'Excel_unknown' WHEN ext = '.pdf' THEN 'PDF_unknown' ELSE 'unknown' END AS kind
  FROM files WHERE file_name NOT LIKE '~$%')""", select="""
SELECT assembly, rel_path, sub AS relative_subfolder, file_name, ext AS file_extension,
  round_even(length / 1048576.0::DOUBLE, 3) AS file_size_mb, kind AS guessed_type,
  CASE WHEN kind IN ('CAD_screenshot', 'BOM') THEN 'ja_candidate'
       WHEN kind IN ('Datenblatt', 'Technische_Zeichnung', 'Excel_unknown', 'PDF_unknown') THEN 'maybe' ELSE 'nein' END AS priority,
  '' AS note FROM old""")
SKIP = """skip AS (
  SELECT assembly, rel_path, CASE WHEN file_name LIKE '~$%' THEN 'Temporaere Datei'
    WHEN dir LIKE '.%' OR file_name LIKE '.%' THEN 'Versteckte Datei'
    WHEN ext IN ('.xlsx', '.xls', '.xlsm', '.xlsb') THEN 'Excel uebersprungen'
    WHEN ext NOT IN ('.pdf', '.txt', '.md', '.csv', '.json', '.xml', '.jpg', '.jpeg', '.png', '.webp') THEN 'Dateityp nicht unterstuetzt'
    WHEN length = 0 THEN 'Leere Datei' WHEN length > 20971520 THEN 'Datei zu gross' END AS skip_reason FROM files)"""
SQL["skip_reasons"] = with_ctes(FILES, SKIP, select="SELECT * FROM skip")
SQL["skip_counts"] = with_ctes(FILES, SKIP, select="SELECT assembly, skip_reason, count(*) AS n FROM skip WHERE skip_reason IS NOT NULL GROUP BY ALL")
SQL["supported_counts"] = with_ctes(FILES, select="""
SELECT assembly, count(*) FILTER (WHERE dir NOT LIKE '%_LLM_IGNORE/') AS selected, count(*) FILTER (WHERE dir LIKE '%_LLM_IGNORE/') AS ignored
FROM files WHERE ext IN ('.pdf', '.png', '.jpg', '.jpeg') GROUP BY ALL""")
PATHS = "paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)"
SQL["category_folders"] = with_ctes(PATHS, select="""
SELECT DISTINCT split_part(path, '/', 1) AS category, split_part(path, '/', 2) AS folder FROM paths WHERE split_part(path, '/', 2) <> ''""")
SQL["directory_index"] = with_ctes(PATHS, """parts AS (
  SELECT string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS a FROM paths WHERE contains(path, '/')),
prefixes AS (SELECT DISTINCT array_to_string(a[1:CAST(n AS BIGINT)], '/') AS folder, a[CAST(n AS BIGINT)] AS name
             FROM parts, range(1, 10) t(n) WHERE n <= len(a))""", select="SELECT folder, name FROM prefixes")
RESOLVED = """sel AS (SELECT *, '/data/' || assembly || '/' || rel_path AS cur, '/old/' || assembly || '/' || rel_path AS old
                FROM ranked WHERE prio <> 'nein'),
res AS (SELECT assembly, file_name, sub AS relative_subfolder, prio AS priority,
  CASE WHEN line_status <> 'F' AND flag = 'A' THEN old ELSE cur END AS resolved_path,
  CASE WHEN line_status <> 'F' AND flag = 'A' THEN 'inventory_full_path_fallback' ELSE 'current_folder' END AS path_source,
  line_status = 'F' OR flag = 'A' AS exists,
  CASE WHEN line_status = 'F' OR flag = 'A' THEN 'ja' ELSE 'nein' END AS exists_mark FROM sel)"""
SQL["resolved_files"] = with_ctes(FILES, TYPED, RESOLVED, select="SELECT * FROM res")
SQL["resolved_file_lists"] = with_ctes(FILES, TYPED, RESOLVED, select="""
, o AS (SELECT *, row_number() OVER (PARTITION BY assembly ORDER BY NOT exists, lower(file_name), file_name, resolved_path) AS rn FROM res)
SELECT assembly, (rn - 1) // 1000 AS part, string_agg(file_name, chr(10) ORDER BY rn) AS files,
  coalesce(string_agg(resolved_path, chr(10) ORDER BY rn) FILTER (WHERE NOT exists), '') AS missing_files FROM o GROUP BY ALL""".lstrip())
SQL["precheck"] = with_ctes(FILES, TYPED, RESOLVED, """c AS (
  SELECT 'A' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS assembly, s_acctbal, count(*) FILTER (WHERE exists) AS existing,
    count(*) FILTER (WHERE NOT exists) AS missing
  FROM supplier LEFT JOIN res ON res.assembly = 'A' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') GROUP BY ALL)""", select="""
SELECT assembly, existing, missing, CASE WHEN s_acctbal < 0 THEN 'NO_BAUGRUPPENNAME'
  WHEN existing + missing = 0 THEN 'NO_PRIORITY_1_2_FILES' WHEN missing > 0 THEN 'FILE_NOT_FOUND' ELSE 'READY' END AS status FROM c""")

LABEL_LINES = ("- Lineareinheit\n- Gantry\n- Greifer\n- Handhabungsbaugruppe / kombinierte Einheit\n- Roboter\n- Rotationseinheit\n"
               "- Nicht klassifizierbar\n")


def _all_files_prompt(name: str) -> str:
    return (f"'Baugruppenbenennung: ' || {name} || '\n\nBeurteile die Baugruppenbenennung und alle beigefügten technischen Dateien.\n"
            f"Wähle genau eine der folgenden Funktionsklassen:\n{LABEL_LINES}'")


SQL["request_table"] = with_ctes(FILES, """o AS (
  SELECT *, row_number() OVER (PARTITION BY assembly ORDER BY rel_path) AS rn FROM files WHERE ext IN ('.pdf', '.png', '.jpg', '.jpeg')),
g AS (SELECT assembly AS item, (rn - 1) // 1000 AS part, string_agg(rel_path, chr(10) ORDER BY rn) AS paths, count(*) AS n_files,
      sum(length)::BIGINT AS total_bytes FROM o GROUP BY ALL),
s AS (SELECT 'A' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS item, """ + _all_files_prompt("s_name") + """ AS prompt FROM supplier)""", select="""
SELECT s.item, CASE WHEN coalesce(part, 0) = 0 THEN s.prompt ELSE '' END AS prompt, coalesce(part, 0) AS part, coalesce(paths, '') AS paths, CAST(coalesce(n_files, 0) AS INTEGER) AS n_files,
  coalesce(total_bytes, 0) AS total_bytes FROM s LEFT JOIN g USING (item)""")
SQL["path_parts"] = with_ctes(FILES, select="""
SELECT assembly, rel_path, ext, stem, CASE ext WHEN '.pdf' THEN 'application/pdf' WHEN '.png' THEN 'image/png'
  WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' END AS media, '/data/' || assembly || '/' || rel_path AS current FROM files""")

# --- manifests ------------------------------------------------------------------------

PAGES = """docs AS (SELECT *, greatest(1, CAST(ceil(length(text) / 1000.0) AS INTEGER)) AS n FROM documents),
pages_of AS (
  SELECT source AS assembly, 'Doc ' || CAST(doc_id AS VARCHAR) || '.pdf' AS pdf, CAST(p AS INTEGER) AS page_number, doc_id,
    CAST(length(substr(text, CAST((p - 1) * 1000 + 1 AS BIGINT), 1000)) AS BIGINT) AS bytes
  FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM docs)),
per_pdf AS (SELECT assembly, pdf, count(*) AS page_count, sum(bytes)::BIGINT AS image_bytes FROM pages_of GROUP BY ALL),
per_assembly AS (SELECT assembly, count(*) AS pdf_count, sum(page_count)::BIGINT AS total_pages, sum(image_bytes)::BIGINT AS image_bytes,
  assembly || '/baugruppe_manifest.json' AS manifest FROM per_pdf GROUP BY ALL)"""
SQL["pdf_manifest"] = with_ctes(PAGES, select="SELECT * FROM per_pdf")
SQL["assembly_manifest"] = with_ctes(PAGES, select="SELECT * FROM per_assembly")
SQL["batch_manifest"] = with_ctes(PAGES, select="""
SELECT count(*) AS assembly_count, sum(pdf_count)::BIGINT AS total_pdfs, sum(total_pages)::BIGINT AS total_pages FROM per_assembly""")
SQL["image_batches"] = with_ctes(PAGES, select="""
, o AS (SELECT *, row_number() OVER (PARTITION BY assembly ORDER BY lower(pdf), pdf, page_number) AS rn FROM pages_of)
SELECT assembly, (rn - 1) // 5 AS batch, string_agg('Doc_' || CAST(doc_id AS VARCHAR) || '/page_' || lpad(CAST(page_number AS VARCHAR), 3, '0') || '.png', chr(10) ORDER BY rn) AS images
FROM o GROUP BY ALL""".lstrip())
SQL["first_pages"] = with_ctes(PAGES, select="SELECT assembly, pdf, page_number FROM pages_of WHERE page_number <= 4")
SQL["stale_sources"] = """SELECT doc_id AS path, 'Doc ' || CAST(doc_id AS VARCHAR) AS source_pdf_name, sha256(text) AS source_sha256,
  200 AS dpi, 'png' AS image_format, CASE WHEN lang <> 'es' THEN 3000 END AS max_side_px
FROM documents WHERE lang IN ('fr', 'de') OR source = 'src3' OR (source = 'src5' AND length(text) > 1000)"""
SQL["manifest_round_trip"] = with_ctes(PAGES, select="""
SELECT assembly, (row_number() OVER (PARTITION BY assembly ORDER BY pdf, page_number) - 1) // 1000 AS part, pdf,
  sha256(d.text) AS source_sha256, 200::BIGINT AS dpi, page_number::BIGINT AS page_number,
  'page_' || lpad(CAST(page_number AS VARCHAR), 3, '0') || '.png' AS image_path, bytes AS file_size_bytes, true AS readable
FROM pages_of p JOIN documents d USING (doc_id)
UNION ALL
SELECT '{"assembly": "' || r_name || '", "pdfs": [{', NULL, NULL, NULL, NULL, NULL, NULL, NULL, false FROM region""".lstrip())
SQL["hash_versions"] = """WITH b AS (
  SELECT doc_id % 20 AS box, string_agg(sha256(coalesce(text, '')), chr(10) ORDER BY doc_id) || chr(10) AS content FROM documents GROUP BY ALL)
SELECT box, strlen(content) AS length, sha256(content) AS sha256, box % 2 + 1 AS version FROM b"""
SQL["changed_files"] = "SELECT doc_id AS path, length(text) AS length, n_chars AS mtime FROM documents WHERE lang = 'fr'"
SQL["turn_batches"] = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
SELECT conv_id, (rn - 1) // 5 AS part, string_agg(CAST(turn AS VARCHAR) || ':' || role, ',' ORDER BY rn) AS turns FROM o GROUP BY ALL"""
SQL["running_position"] = """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position,
  count(*) OVER (PARTITION BY user_id) AS total FROM events"""

# --- labelling ------------------------------------------------------------------------

SQL["canonical_labels"] = """WITH a AS (
  SELECT o_orderkey AS item, ['Lineareinheit', 'Gantry', 'Greifer', 'Handhabungsbaugruppe / kombinierte Einheit', 'Roboter'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS label,
    CASE WHEN o_totalprice > 450000 THEN 'double' WHEN o_totalprice < 10000 THEN 'failed' WHEN o_totalprice < 20000 THEN 'none'
         WHEN o_orderstatus = 'F' THEN 'exact' WHEN o_orderstatus = 'O' THEN 'ticks' WHEN o_totalprice > 250000 THEN 'quotes' ELSE 'wordy' END AS form
  FROM orders)
SELECT item,
  CASE WHEN form IN ('exact', 'ticks', 'quotes', 'wordy') THEN label WHEN form = 'none' THEN 'Nicht klassifizierbar'
       WHEN form = 'double' AND label = 'Roboter' THEN 'Roboter' END AS tolerant,
  CASE WHEN form IN ('exact', 'ticks', 'quotes') THEN label END AS strict,
  CASE WHEN form IN ('exact', 'ticks', 'quotes') THEN label WHEN form = 'none' THEN 'Nicht klassifizierbar' END AS strict_fallback,
  CASE WHEN form IN ('exact', 'ticks', 'quotes') THEN label WHEN form = 'none' THEN 'Nicht klassifizierbar' END AS checked,
  CASE WHEN form = 'failed' THEN 'NO_LABEL' WHEN form = 'double' AND label <> 'Roboter' THEN 'SEVERAL_LABELS' END AS reason
FROM a"""
NAMED = """named AS (
  SELECT 'item' || CAST(p_partkey AS VARCHAR) AS item, p_type, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun, p_size,
    CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'Greifbacke' WHEN 'bolt' THEN 'Spindel' WHEN 'plate' THEN 'Portal'
      WHEN 'rod' THEN 'Hubachse' WHEN 'gear' THEN 'Drehteller' WHEN 'gizmo' THEN 'Roboterarm'
      WHEN 'anvil' THEN 'Klemmhalter mit Schwenkeinheit' ELSE split_part(p_name, ' ', 2) END AS word,
    CASE WHEN p_size = 50 THEN 'Nicht klassifizierbar' ELSE CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'Greifer' WHEN 'bolt' THEN 'Lineareinheit' WHEN 'plate' THEN 'Gantry'
      WHEN 'rod' THEN 'Lineareinheit' WHEN 'gear' THEN 'Rotationseinheit' WHEN 'gizmo' THEN 'Roboter'
      WHEN 'anvil' THEN 'Handhabungsbaugruppe / kombinierte Einheit' ELSE 'Nicht klassifizierbar' END END AS label
  FROM part),
full_named AS (SELECT *, CASE WHEN p_size = 50 THEN '  ' ELSE adj || ' ' || word END AS name FROM named)"""
SQL["feature_labels"] = with_ctes(NAMED, select="SELECT item, label FROM full_named")
SQL["prompts"] = with_ctes(NAMED, select=f"""
SELECT item, {_all_files_prompt('name')} AS all_files,
'\nDu bist ein technischer Experte für Baugruppenklassifikation im Maschinen- und Anlagenbau.\n\nKlassifiziere den folgenden Baugruppennamen in genau eine der vorgegebenen Funktionsklassen.\n\nBaugruppenname:\n' || name || '

Zulässige Funktionsklassen:
- Lineareinheit
- Gantry
- Greifer
- Handhabungsbaugruppe / kombinierte Einheit
- Roboter
- Rotationseinheit

Regeln:
- Wähle genau eine Funktionsklasse aus der Liste.
- Antworte ausschließlich mit dem exakten Namen der Funktionsklasse, nie mit einer Abkürzung.
- Keine Erklärung, keine zusätzlichen Wörter.
- Wenn keine Klasse eindeutig passt, wähle "Nicht klassifizierbar".

Antwort:
' AS name_only FROM full_named""")
SQL["label_batch"] = with_ctes(NAMED, select=f"""
SELECT item, CASE WHEN p_size <> 50 THEN label END AS predicted_label,
  CASE WHEN p_size = 50 THEN 'SKIPPED: missing ID or Benennung' ELSE 'SUCCESS' END AS status,
  CASE WHEN p_size <> 50 THEN 1 END AS attempts,
  CASE WHEN p_size <> 50 THEN length({_all_files_prompt('name')}) END AS tokens FROM full_named""")
SQL["zero_shot_score"] = with_ctes(NAMED, select="""
SELECT CASE p_type WHEN 'SMALL' THEN 'Greifer' WHEN 'LARGE' THEN 'Roboter' ELSE 'Lineareinheit' END AS ground_truth,
  CASE WHEN p_size = 50 THEN 'FEHLER: Kein Baugruppenname' ELSE label END AS predicted_label, count(*) AS n FROM full_named GROUP BY ALL""")
SQL["numbered_lists"] = """SELECT c_nationkey::INTEGER AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS row_no,
  CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 7 > 0 THEN '"' || c_name || '", c' END AS c_name FROM customer"""
SQL["report_round_trip"] = """SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, 'said "' || s_name || '"' AS note, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier"""
SQL["tables_round_trip"] = with_ctes(TRUTH, MATCHED, select="""
SELECT model, ground_truth, predicted_label, count(*) AS n FROM matched
WHERE ground_truth IS NOT NULL AND predicted_label IS NOT NULL GROUP BY ALL
UNION ALL SELECT model, NULL, NULL, count(*) FROM matched GROUP BY ALL""")
SQL["log_round_trip"] = "SELECT event_id, event_type, user_id, (event_id % 2)::INTEGER AS run FROM events"
SQL["response_log"] = with_ctes(NAMED, """placed AS (
  SELECT 'item' || l_partkey AS item, path, (row_number() OVER (PARTITION BY l_partkey ORDER BY path) - 1) // 2 AS part FROM (
    SELECT l_partkey, l_orderkey || '-' || l_linenumber || CASE l_quantity WHEN 1 THEN '.pdf' ELSE '.PNG' END AS path
    FROM lineitem WHERE l_quantity <= 2)),
parts AS (SELECT item, part, string_agg(path, chr(10) ORDER BY path) AS file_paths FROM placed GROUP BY ALL)""", select=f"""
SELECT 'r' || n.run AS run, n.item, coalesce(part, 0)::BIGINT AS part, CASE WHEN coalesce(part, 0) = 0 THEN prompt ELSE '' END AS prompt,
  coalesce(file_paths, '') AS file_paths, name, '`' || lower(label) || '`' AS raw_response, label AS canonical_label,
  'SUCCESS' AS status, CAST(NULL AS VARCHAR) AS error
FROM (SELECT *, {_all_files_prompt('name')} AS prompt, (right(item, 1)::INTEGER % 2) AS run FROM full_named WHERE p_size <> 50) n LEFT JOIN parts p ON p.item = n.item""")
SQL["response_texts"] = """SELECT event_id,
  CASE WHEN event_type = 'error' THEN '(no text content, finishReason=SAFETY)' ELSE event_type END AS first_text,
  CASE WHEN event_type = 'error' THEN '' ELSE event_type || '!' END AS joined_text,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_tokens FROM events"""
SQL["block_texts"] = "SELECT event_id, CASE WHEN event_type = 'error' THEN '(no text content)' ELSE event_type END AS block_text FROM events"
SQL["token_usage"] = """SELECT 'm_' || event_type AS model, kind, sum(tokens)::BIGINT AS tokens, count(*) AS calls FROM (
  SELECT event_type, 'totalTokenCount' AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events
  UNION ALL SELECT event_type, 'promptTokenCount', user_id FROM events) GROUP BY ALL"""
SQL["resume"] = """SELECT event_id, event_type, user_id FROM events e
WHERE NOT (event_type IN ('purchase', 'signup') AND coalesce(value > 5, false))"""
SQL["first_rows"] = """SELECT c_custkey + 2 AS row_no, ' c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS sap,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'N' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0') END AS teamcenter
FROM customer ORDER BY c_custkey LIMIT 20"""

# --- forms and sheets -----------------------------------------------------------------

FORMS = """forms AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'TN_B_' ELSE 'TN_A_' END || o_orderstatus AS participant, o_orderkey AS row_no,
    'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS sap, 'D' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS tc,
    o_orderpriority AS label FROM orders),
ordered AS (
  SELECT c_custkey AS row_no, CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE c_name END AS sap,
    'D' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS tc, c_mktsegment AS label FROM customer),
who AS (SELECT unnest(['TN_A_F', 'TN_A_O', 'TN_B_P']) AS participant),
by_s AS (SELECT participant, sap, count(*) AS n, min(row_no) AS r FROM forms GROUP BY ALL),
by_t AS (SELECT participant, tc, count(*) AS n, min(row_no) AS r FROM forms GROUP BY ALL),
by_b AS (SELECT participant, sap, tc, count(*) AS n, min(row_no) AS r FROM forms GROUP BY ALL),
decided AS (
  SELECT o.row_no, w.participant,
    CASE WHEN s.n > 0 AND t.n > 0 AND b.n = 1 THEN 'BOTH' WHEN s.n > 0 AND t.n > 0 AND b.n IS NULL THEN 'DIFFERENT_ROWS'
         WHEN s.n = 1 THEN 'SAP' WHEN t.n = 1 THEN 'TEAMCENTER' WHEN s.n IS NULL AND t.n IS NULL THEN 'NONE' ELSE 'AMBIGUOUS' END AS outcome,
    s.r AS rs, t.r AS rt, b.r AS rb
  FROM ordered o CROSS JOIN who w
  LEFT JOIN by_s s ON s.participant = w.participant AND s.sap = o.sap
  LEFT JOIN by_t t ON t.participant = w.participant AND t.tc = o.tc
  LEFT JOIN by_b b ON b.participant = w.participant AND b.sap = o.sap AND b.tc = o.tc),
found AS (
  SELECT d.row_no, d.participant, d.outcome, f.row_no AS found_row, f.label AS found_label
  FROM decided d LEFT JOIN forms f ON f.row_no = CASE d.outcome WHEN 'BOTH' THEN rb WHEN 'SAP' THEN rs WHEN 'TEAMCENTER' THEN rt END)"""
SQL["intersection_match"] = with_ctes(FORMS, select="SELECT * FROM found")
SQL["annotation_overview"] = with_ctes(FORMS, select="""
SELECT o.row_no, coalesce(o.sap, ' ') AS sap, o.tc AS teamcenter, CASE WHEN o.sap IS NULL THEN 'NONE' ELSE 'SAP' END AS truth_outcome,
  CASE WHEN o.sap IS NOT NULL THEN o.label END AS ground_truth,
  max(found_label) FILTER (WHERE participant = 'TN_A_F') AS tn_a_f, max(found_label) FILTER (WHERE participant = 'TN_A_O') AS tn_a_o,
  max(found_label) FILTER (WHERE participant = 'TN_B_P') AS tn_b_p
FROM ordered o LEFT JOIN found f ON f.row_no = o.row_no GROUP BY ALL""")
SHEET = """sheet AS (
  SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN 'AS' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') END AS id,
    CASE WHEN p_size > 20 THEN p_brand END AS brand, CASE WHEN p_type = 'SMALL' THEN '  ' ELSE p_type END AS kind,
    CASE WHEN p_retailprice > 950 THEN CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) END AS price FROM part),
cells AS (SELECT p_partkey, id, 'Welche Marke?' AS question, brand AS answer FROM sheet
  UNION ALL SELECT p_partkey, id, 'Welche Art?', kind FROM sheet UNION ALL SELECT p_partkey, id, 'Welcher Preis?', price FROM sheet)"""
SQL["annotation_counts"] = with_ctes(FORMS, select="""
SELECT 'ground truth' AS source, count(*) AS rows_seen, count(sap) AS rows_found, 0::BIGINT AS rows_contradicting FROM ordered
UNION ALL SELECT 'participant forms', count(*), count(found_row), count(*) FILTER (WHERE outcome IN ('DIFFERENT_ROWS', 'AMBIGUOUS'))
FROM found""")
SQL["question_cells"] = with_ctes(SHEET, select="SELECT * FROM cells")
SQL["open_questions"] = with_ctes(SHEET, select="SELECT p_partkey, question FROM cells WHERE id IS NOT NULL AND (answer IS NULL OR trim(answer) = '')")
SQL["expected_calls"] = with_ctes(SHEET, select="""
SELECT question, count(*) FILTER (WHERE answer IS NULL OR trim(answer) = '') AS calls, count(*) AS cells FROM cells WHERE id IS NOT NULL GROUP BY ALL""")


def _filled(column: str, question: str) -> str:
    return f"CASE WHEN id IS NOT NULL AND ({column} IS NULL OR trim({column}) = '') THEN '? {question}' ELSE {column} END AS {column}"


SQL["questions_answered"] = with_ctes(SHEET, select=f"""
SELECT p_partkey, id, {_filled('brand', 'Welche Marke?')}, {_filled('kind', 'Welche Art?')}, {_filled('price', 'Welcher Preis?')} FROM sheet""")


def _asked(question: str) -> str:
    return f"""max(CASE WHEN question <> '{question}' THEN NULL WHEN id IS NULL THEN answer WHEN n IS NULL THEN 'ERROR: No documents found.'
  WHEN trim(answer) <> '' THEN answer WHEN n > 2 THEN 'ERROR: RuntimeError: too many files'
  ELSE CASE p_partkey % 2 WHEN 0 THEN 'first' ELSE 'second' END || ': ' || question || ' ' || n || ' ' || first_path END)"""


PART_FILES = """part_files AS (
  SELECT l_partkey AS k, l_orderkey || '-' || l_linenumber || CASE l_quantity WHEN 1 THEN '.pdf' ELSE '.PNG' END AS path
  FROM lineitem WHERE l_quantity <= 2)"""
SQL["questions_asked"] = with_ctes(SHEET, PART_FILES, select=f"""
SELECT p_partkey, id, {_asked('Welche Marke?')} AS brand, {_asked('Welche Art?')} AS kind, {_asked('Welcher Preis?')} AS price
FROM cells LEFT JOIN (SELECT k, count(*) AS n, min(path) AS first_path FROM part_files GROUP BY k) ON k = p_partkey GROUP BY p_partkey, id""")
SQL["unified_headers"] = """SELECT c_name AS sap, CAST(NULL AS VARCHAR) AS teamcenter, c_mktsegment AS label FROM customer
UNION ALL SELECT s_name, CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR) FROM supplier
UNION ALL SELECT p_brand, NULL, p_name FROM part"""
SQL["predictions_from_files"] = with_ctes(TRUTH, MATCHED, select="""
SELECT model, sap, trim(teamcenter) AS teamcenter,
  predicted_label || CASE WHEN prediction_row % 5 = 0 THEN ' "weil"' || chr(10) || 'so' ELSE '' END AS predicted FROM preds""")
SQL["forms_from_files"] = """SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS sap,
  'D' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS teamcenter, o_orderpriority AS label FROM orders"""
SQL["participant_forms"] = with_ctes(FORMS, select="SELECT participant, sap, tc AS teamcenter, label FROM forms")
SQL["run_stamps"] = """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS local,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS utc FROM events"""
SQL["class_list"] = "SELECT p_name AS label, min(p_partkey) AS ord FROM part WHERE p_size > 5 GROUP BY ALL"
SQL["rows_below_header"] = """WITH h AS (SELECT min(c_custkey) AS r FROM customer WHERE c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 9000)
SELECT c_mktsegment AS sheet, c_custkey AS row_no, CASE WHEN c_acctbal > 9000 THEN 'funktionsklasse' ELSE c_name END AS value
FROM customer, h WHERE c_mktsegment = 'HOUSEHOLD' AND c_custkey > h.r"""
