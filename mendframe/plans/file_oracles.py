"""DuckDB SQL of the queries over files, sinks, the catalogue and the feedback loop. What files hold is spelt out anew here; small fixtures are given by their expected values."""

from __future__ import annotations

from . import oracles as O
from . import tables as D


def _values(columns: str, *rows: tuple) -> str:
    said = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(said, r)) + ')' for r in rows)}) v({columns})"


_MARK = "'{\"s\":\"Jos' || chr(195) || chr(169) || '\",\"n\":'"


def oracle_sql() -> dict[str, str]:
    all_ = O.base_sql()
    mined = " UNION ALL ".join(f"SELECT * FROM ({all_[k]})" for k in ("mine_char_classes", "mine_token_shapes", "mine_markers"))
    modes = "coalesce(string_agg(mode, ',' ORDER BY mode), '')"
    return {
        "source_delimited": "SELECT CAST(c_custkey AS VARCHAR) AS k, 'Zo' || chr(235) || '; ' || c_name AS name, c_mktsegment AS segment, 'k,name,segment' AS header, 'cp1252' AS encoding, ';' AS delimiter, 'csv' AS kind FROM customer",
        "source_line_breaks": "SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 50 = 49 AND c_custkey > 300 THEN c_name || chr(10) || 'second line' ELSE c_name END AS name, c_mktsegment AS segment, 'k,name,segment' AS header FROM customer",
        "source_json_lines": f"SELECT CAST(c_custkey AS VARCHAR) AS k, {_MARK} || c_nationkey || '}}' AS tag, 'k,tag' AS header, 'jsonl' AS kind FROM customer WHERE c_custkey % 100 <> 99",
        "source_json_document": "SELECT CAST(s_suppkey AS VARCHAR) AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS name, 'k,name' AS header, 'json' AS kind FROM supplier",
        "source_workbook": "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, 'nations.xlsx#sheet1' AS source FROM nation",
        "source_text": "SELECT string_agg(chr(8220) || n_name || chr(8221) || ' ' || chr(8211) || ' a nation', chr(10) ORDER BY n_nationkey) AS text, 'cp1252' AS encoding, 'text' AS kind FROM nation",
        "sniffed_kinds": "SELECT name, kind, delimiter, name IN ('parquet misnamed', 'two lines') AS noted FROM (" + _values("name, kind, delimiter", ("zip", "xlsx", "-"), ("parquet misnamed", "parquet", "-"), ("orc", "orc", "-"), ("pdf", "pdf", "-"), ("lines", "jsonl", "-"), ("document", "json", "-"), ("tabs", "tsv", "\t"), ("semicolons", "csv", ";"), ("two lines", "text", "-"), ("prose", "text", "-")) + ")",
        "detected_encodings": "SELECT name, encoding, CAST(damage AS BIGINT) AS damage, encoding LIKE 'utf-16%' AS utf16 FROM (" + _values("name, encoding, damage", ("ascii", "utf-8", 0), ("utf-8", "utf-8", 0), ("marked", "utf-8-sig", 0), ("windows", "cp1252", 0), ("latin", "latin-1", 0), ("utf-16", "utf-16", 0), ("little", "utf-16-le", 0), ("big", "utf-16-be", 0), ("twice", "utf-8", 1)) + ")",
        "detected_dialects": _values("name, delimiter", ("semicolons", ";"), ("pipes", "|"), ("one column", ","), ("commas", ",")),
        "resolved_targets": _values("name, kind", ("a.csv", "csv"), ("b.json", "json"), ("c.json", "unreadable"), ("d.txt", "text"), ("e.dat", "csv"), ("run.log", "text"), ("missing.csv", "unreadable"), ("e.dat", "csv")),
        "inventory_kinds": _values("line", ("b.json [json]",), ("t0.csv [csv]",), ("t1.csv [csv]",), ("t2.csv [csv]",), ("3 csv, 1 json",)),
        "catalog_rows": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority FROM orders WHERE o_custkey >= 40",
        "catalog_names": _values("name, quoted", ("mf_list_nation", "`mf_list_nation`"), ("mf_list_region", "`mf_list_region`"), ("a; DROP TABLE b", "refused"), ("a b", "refused"), ("x`y", "refused")),
        "solved_files": f"WITH {O.SOLVED} SELECT {', '.join(f'{c}_2 AS {c}' for c in D.VENDOR)} FROM r WHERE kind IS NULL",
        "solved_quarantine_file": f"WITH {O.SOLVED} SELECT name_0 AS name, CASE kind WHEN 'ragged_rows' THEN '9 fields where the header has 8' ELSE 'value in ''notes'' was cut at 255 characters; the rest is not in this file' END AS reason FROM r WHERE kind IS NOT NULL",
        "solved_tables": f"WITH {O.SOLVED} SELECT count(*) FILTER (kind IS NULL) AS clean, count(*) FILTER (kind IS NOT NULL) AS quarantined, count(*) FILTER (kind IS NOT NULL) AS timed FROM r",
        "written_notes": all_["provenance_notes"],
        "written_records": f"WITH {O.NOTES}, m AS (SELECT row_key, {modes} AS modes FROM no GROUP BY row_key), f AS ({all_['repair_table']}) SELECT f.row_key, name, status, revenue, coalesce(modes, '') AS modes FROM f LEFT JOIN m USING (row_key)",
        "note_filters": f"WITH {O.NOTES}, x AS (SELECT count(*) FILTER (action <> 'unrepairable') AS changed, count(*) FILTER (action IN ('unrepairable', 'flagged')) AS to_review FROM no) SELECT mode, action, count(*) AS cells, any_value(changed) AS changed, any_value(to_review) AS to_review FROM no CROSS JOIN x GROUP BY mode, action",
        "duplicate_columns": _values("subject, units, mode, severity, samples", ("table header", 6, "duplicate_columns", "suspect", "id,name")),
        "row_audit": "SELECT 'table structure' AS subject, 'ragged_rows' AS mode, CASE WHEN (SELECT count(*) FILTER (p_partkey % 100 = 0) / count(*) FROM part) >= 0.01 THEN 'corrupt' ELSE 'suspect' END AS severity, string_agg('row ' || p_partkey || ': 4 fields', '|' ORDER BY p_partkey) AS samples FROM (SELECT p_partkey FROM part WHERE p_partkey % 100 = 0 ORDER BY 1 LIMIT 5)",
        "described_conventions": f"""WITH l AS ({O.long(["o_orderpriority", "o_orderdate"], "SELECT 0 AS row_key, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders")}), {O.CONVENTIONS}
SELECT CASE WHEN m < 40 THEN col || ': too few values to tell (' || m || ')' WHEN top_n / m >= 0.9 THEN col || ': ' || printf('%.1f%%', 100.0 * top_n / m) || ' follow ''' || top_shape || '''' || CASE others WHEN 0 THEN '' WHEN 1 THEN ', 1 other shape' ELSE ', ' || others || ' other shapes' END
  ELSE col || ': no dominant pattern (commonest ''' || top_shape || ''' at ' || printf('%.1f%%', 100.0 * top_n / m) || ')' END AS line FROM cv UNION ALL SELECT 'empty: too few values to tell (0)'""",
        "scanned_folder": _values("source, subject, mode, severity", *((f"{n}.csv", "column amount", "numeric_as_text", "suspect") for n in "abc"), ("across files", "across files", "inconsistent_headers", "suspect"), ("across files", "across files", "odd_file_out", "suspect")),
        "scanned_for_use": "SELECT source, severity, CAST(findings AS BIGINT) AS findings FROM (" + _values("source, severity, findings", ("a.csv", "corrupt", 1), ("b.csv", "corrupt", 1), ("c.csv", "corrupt", 1), ("across files", "suspect", 2)) + ")",
        "custom_profile": f"{O.AUDITED}, pw(mode, w) AS (VALUES ('mojibake', 0.5), ('null_as_string', 0.0), ('truncation', 2.0)), q AS (SELECT col, coalesce(w, 1.0) AS w, greatest(0, least(2, {O.RANK} + CASE WHEN coalesce(w, 1.0) >= 2 THEN 1 WHEN coalesce(w, 1.0) <= 0.5 THEN -1 ELSE 0 END)) AS now FROM cf LEFT JOIN pw USING (mode)), y AS (SELECT col, max(now) FILTER (w <> 0) AS r, count(*) FILTER (w <> 0) AS reported, count(*) FILTER (w = 0) AS suppressed FROM q GROUP BY col) SELECT a.col AS \"column\", {O.NAMED('coalesce(r, 0)')} AS severity, CAST(coalesce(reported, 0) AS BIGINT) AS reported, CAST(coalesce(suppressed, 0) AS BIGINT) AS suppressed FROM a LEFT JOIN y USING (col)",
        "recoverability": f"WITH x AS (SELECT mode, action, count(*) AS n FROM (WITH {O.NOTES} SELECT * FROM no) GROUP BY mode, action), z AS (SELECT affected AS n FROM ({all_['repair_refusals']}) WHERE mode = 'leading_zero_loss') SELECT CASE action WHEN 'repaired' THEN 'repaired ' ELSE 'refused ' END || mode || ': ' || {O.thousands('n')} || CASE n WHEN 1 THEN ' cell' ELSE ' cells' END AS line FROM x UNION ALL SELECT 'refused leading_zero_loss: ' || {O.thousands('n')} || ' cells' FROM z",
        "plurals": _values("said", ("0 rows",), ("1 row",), ("2 rows",), ("1,234,567 rows",)),
        "feedback_log": "SELECT CAST(doc_id AS VARCHAR) AS record_id, CASE WHEN quality = 0 THEN 'discard' ELSE 'keep' END AS label, 'suspect' AS severity, CAST(doc_id AS DOUBLE) AS ts FROM documents JOIN labels USING (doc_id)",
        "thresholds_in_force": f"SELECT feature, CASE WHEN adopted THEN threshold ELSE dv END AS threshold FROM ({all_['learned_thresholds']}) JOIN ({O.DEFAULTS}) df(feature, dv) USING (feature)",
        "pipeline_audit": f"SELECT subject, 'text' AS detector, n_findings, severity FROM ({all_['text_audit']})",
        "pipeline_quarantine": f"SELECT subject AS record_id, severity, CAST(subject AS DOUBLE) AS ts FROM ({all_['text_audit']}) WHERE severity <> 'clean' ORDER BY CASE severity WHEN 'corrupt' THEN 0 ELSE 1 END, CAST(subject AS DOUBLE) DESC LIMIT 50",
        "proposed_rules": f"SELECT kind, signature, support, precision, lift, round(precision * least(lift, 20.0) * sqrt(support), 3) AS strength FROM ({mined})",
    }
