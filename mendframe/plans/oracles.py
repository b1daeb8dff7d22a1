"""DuckDB SQL of the registered queries, written from the rules and not from the plans."""

from __future__ import annotations

from ..functions import values as V
from . import tables as D


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _esc(p: str) -> str:
    return p.replace("'", "''")


SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
TOKEN = f"[^{V.SPACE_CLASS}]+"
DIGIT_TOKEN = rf"[^{V.SPACE_CLASS}\p{{Nd}}]*\p{{Nd}}[^{V.SPACE_CLASS}]*"
T = V.THRESHOLDS


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{_esc(pattern)}'))"


def strip(v: str) -> str:
    return f"trim({v}, {SPACES})"


# --- texts -------------------------------------------------------------------------

MASK = f"array_to_string(list_transform(regexp_extract_all(x, '{_esc(V.WORD)}'), lambda w: CASE WHEN length(w) <= 4 AND lower(w) NOT IN {_in(V.SHORT_WORDS)} THEN 'F' ELSE '.' END), '')"


def features(source: str, keys: str) -> str:
    """keys, tokens, judged, glyph_rate, fragment_ratio, digit_rate of source(keys, x)."""
    return f"""
f0 AS (SELECT {keys}, x, CAST({count("x", TOKEN)} AS BIGINT) AS tokens, {count("x", DIGIT_TOKEN)} AS with_digit, {MASK} AS mask,
  {count("x", V.UNDECODED)} + {count("x", V.CID)} AS bad FROM ({source})),
f AS (SELECT {keys}, tokens, tokens >= 200 AS judged, coalesce(CAST(bad AS DOUBLE) / nullif(CAST(length(x) AS DOUBLE), 0) * 1000, 0.0) AS glyph_rate,
  CASE WHEN length(mask) >= 200 THEN CAST(length(mask) - length(regexp_replace(mask, 'F{{3,}}', '', 'g')) AS DOUBLE) / length(mask) ELSE 0.0 END AS fragment_ratio,
  CASE WHEN tokens >= 200 THEN CAST(with_digit AS DOUBLE) / tokens ELSE -1.0 END AS digit_rate FROM f0)"""


def found(keys: str) -> str:
    """Findings over f."""
    above = lambda m, c, s, k: f"SELECT {keys}, '{m}' AS mode, CASE WHEN {c} >= {k} THEN 'corrupt' ELSE 'suspect' END AS severity, {c} AS metric, CASE WHEN {c} >= {k} THEN {k} ELSE {s} END::DOUBLE AS threshold FROM f WHERE {c} >= {s}"
    return f"""g AS ({above("missing_glyph", "glyph_rate", 0.5, 3.0)} UNION ALL {above("shattered_words", "fragment_ratio", 0.05, 0.25)}
UNION ALL SELECT {keys}, 'numeric_loss', CASE WHEN digit_rate <= 0.0005 THEN 'corrupt' ELSE 'suspect' END, digit_rate, CASE WHEN digit_rate <= 0.0005 THEN 0.0005 ELSE 0.004 END::DOUBLE
FROM f WHERE digit_rate >= 0 AND digit_rate <= 0.004)"""


PENALTY = "sum((CASE WHEN severity = 'corrupt' THEN 0.45 ELSE 0.15 END) * CASE WHEN metric IS NOT NULL AND coalesce(threshold, 0) <> 0 THEN least(3.0, greatest(1.0, abs(metric / threshold))) ELSE 1.0 END)"
RANK = "CASE severity WHEN 'corrupt' THEN 2 WHEN 'suspect' THEN 1 ELSE 0 END"
NAMED = lambda r: f"CASE {r} WHEN 2 THEN 'corrupt' WHEN 1 THEN 'suspect' ELSE 'clean' END"
DOCS = "SELECT CAST(doc_id AS VARCHAR) AS subject, coalesce(text, '') AS x FROM documents"
SCORED = f"s AS (SELECT subject, count(*) AS k, max({RANK}) AS r, {PENALTY} AS p FROM g GROUP BY subject), a AS (SELECT f.subject, tokens AS units, judged, CAST(coalesce(k, 0) AS BIGINT) AS n_findings, {NAMED('coalesce(r, 0)')} AS severity, round(greatest(0.0, least(1.0, 1.0 - coalesce(p, 0))), 6) AS confidence FROM f LEFT JOIN s USING (subject))"

# --- columns -----------------------------------------------------------------------


def long(columns: list[str], source: str) -> str:
    """(k, column_, v) of a table with row_key."""
    return " UNION ALL ".join(f"SELECT row_key, {i} AS k, '{c}' AS col, coalesce(CAST({c} AS VARCHAR), '') AS v FROM ({source})" for i, c in enumerate(columns))


MOJIBAKE = f"regexp_matches(v, '{_esc('|'.join(V.MOJIBAKE_MARKERS))}')"
FORMATTED = f"regexp_matches(v, '{_esc(V.FORMATTED_NUMBER)}')"
PLAIN = f"regexp_matches({strip('v')}, '{_esc(V.PLAIN_NUMBER)}')"
EXCEL = f"regexp_matches({strip('v')}, '{_esc(V.EXCEL_DATE)}')"
FULL, DIGITS = f"{strip('v')} <> ''", r"regexp_matches(v, '^\p{Nd}+$')"
METRICS = f"""m AS (SELECT k, col, count(*) AS n, count(*) FILTER ({FULL}) AS m, count(*) FILTER ({MOJIBAKE}) AS mojibake, count(*) FILTER ({FULL} AND {FORMATTED}) AS formatted,
  count(*) FILTER ({FULL} AND {PLAIN}) AS plain, count(*) FILTER (v IN {_in(V.NULL_LIKE_AUDIT)}) AS nullish, count(*) FILTER ({FULL} AND {EXCEL}) AS excel,
  max(length(v)) FILTER ({FULL}) AS longest, count(*) FILTER ({DIGITS}) AS digits, min(length(v)) FILTER ({DIGITS}) AS digit_min, max(length(v)) FILTER ({DIGITS}) AS digit_max,
  coalesce(bool_or(v LIKE '0%') FILTER ({DIGITS}), false) AS padded FROM l GROUP BY k, col)"""
COLUMN_FINDINGS = f"""cut AS (SELECT l.k, count(*) AS hits, count(DISTINCT v) AS different FROM l JOIN m ON l.k = m.k AND length(v) = longest WHERE {FULL} AND longest IN (50, 100, 128, 200, 255, 256, 500, 512, 1000, 1024) GROUP BY l.k),
w AS (SELECT m.*, hits, different FROM m LEFT JOIN cut USING (k)),
cf AS (
  SELECT k, col, 'mojibake' AS mode, CASE WHEN mojibake / n >= 0.02 THEN 'corrupt' ELSE 'suspect' END AS severity, mojibake / n AS metric, CASE WHEN mojibake / n >= 0.02 THEN 0.02 ELSE 0.002 END::DOUBLE AS threshold FROM w WHERE mojibake > 0 AND mojibake / n >= 0.002
  UNION ALL SELECT k, col, 'numeric_as_text', 'suspect', formatted / m, 0.95 FROM w WHERE n >= 30 AND m > 0 AND formatted / m >= 0.95 AND formatted >= 30
  UNION ALL SELECT k, col, 'truncation', 'suspect', hits / m, 0.03 FROM w WHERE n >= 30 AND hits >= 3 AND different / hits >= 0.3 AND hits / m >= 0.03
  UNION ALL SELECT k, col, 'null_as_string', 'suspect', nullish / n, 0.01 FROM w WHERE n >= 30 AND nullish > 0 AND nullish / n >= 0.01
  UNION ALL SELECT k, col, 'excel_date_corruption', 'corrupt', excel, 2.0 FROM w WHERE excel >= 2 AND excel < 0.5 * m
  UNION ALL SELECT k, col, 'leading_zero_loss', 'suspect', digits / m, 0.5 FROM w WHERE n >= 30 AND regexp_matches(col, '{V.ID_NAME}') AND digit_min < digit_max AND NOT padded AND digits / m >= 0.5)"""
L = f"l AS ({long(D.VENDOR, D.vendor_sql())})"
AUDIT = f"WITH {L}, {METRICS}, {COLUMN_FINDINGS}"
AUDITED = f"{AUDIT}, s AS (SELECT k, max({RANK}) AS r, {PENALTY} AS p, count(*) AS c FROM cf GROUP BY k), a AS (SELECT w.k, col, n AS units, n >= 30 AS judged, coalesce(c, 0) AS c, {NAMED('coalesce(r, 0)')} AS severity, greatest(0.0, least(1.0, 1.0 - coalesce(p, 0))) AS confidence FROM w LEFT JOIN s USING (k))"
MONTHS = _in([m.lower() for m in V.MONTHS])
SHAPE = rf"""array_to_string(list_transform(regexp_extract_all({strip("v")}, '(?s)(\p{{Nd}}+|\p{{L}}+|[{V.SPACE_CLASS}]+|.)'), lambda p: CASE
  WHEN regexp_matches(p, '^\p{{Nd}}') THEN repeat('d', least(length(p), 4)) WHEN NOT regexp_matches(p, '^\p{{L}}') THEN CASE WHEN regexp_matches(p, '^[{V.SPACE_CLASS}]') THEN ' ' ELSE p END
  WHEN length(p) = 3 AND lower(p) IN {MONTHS} THEN 'Mmm' WHEN p = upper(p) AND p <> lower(p) THEN repeat('A', least(length(p), 4))
  WHEN p[1] = upper(p[1]) AND p[1] <> lower(p[1]) THEN 'A' || repeat('a', least(length(p) - 1, 3)) ELSE repeat('a', least(length(p), 4)) END), '')"""
SHAPES = f"sh AS (SELECT k, col, {SHAPE} AS shape, count(*) AS n, min(row_key) AS first FROM l WHERE {FULL} GROUP BY ALL)"
CONVENTIONS = f"{SHAPES}, cv AS (SELECT k, col, CAST(sum(n) AS BIGINT) AS m, max(n) AS top_n, arg_min(shape, (-n, first, shape)) AS top_shape, count(*) - 1 AS others FROM sh GROUP BY k, col)"

# --- repairs -----------------------------------------------------------------------

MARKED = " OR ".join(f"contains({{0}}, '{m}')" for m in V.REPAIR_MARKERS)


def mojibake_fixed(v: str) -> str:
    raw = f"try(decode(unhex(array_to_string(list_transform(string_split({v}, ''), lambda c: printf('%02X', unicode(c))), ''))))"
    return f"CASE WHEN ({MARKED.format(v)}) AND len(list_filter(string_split({v}, ''), lambda c: unicode(c) > 255)) = 0 AND {raw} <> {v} AND NOT ({MARKED.format(raw)}) THEN {raw} END"


def numeric_fixed(v: str) -> str:
    return f"CASE WHEN contains({strip(v)}, ',') AND regexp_matches({strip(v)}, '{_esc(V.PLAIN_NUMBER)}') THEN replace({strip(v)}, ',', '') END"


def null_fixed(v: str) -> str:
    return f"CASE WHEN {strip(v)} IN {_in(V.NULL_LIKE)} THEN '' END"


GENES = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in V.GENES.items()) + ") gene_map(was, symbol)"


def gene_fixed(v: str) -> str:
    return f"(SELECT symbol FROM ({GENES}) WHERE was = {strip(v)})"


def _repair(column: str, fixed: str) -> str:
    return f"WITH t AS ({D.vendor_sql()}) SELECT row_key, {fixed} AS fixed, coalesce({fixed}, {column}) <> {column} AS changed FROM t"


def once(v: str) -> str:
    return f"coalesce({mojibake_fixed(v)}, {numeric_fixed(v)}, {null_fixed(v)}, {v})"


SOLVED = (
    f"t AS ({D.vendor_sql()}), o AS (SELECT row_key, row_key % 50 = 0 AS ragged, "
    + ", ".join(f"{c} AS {c}_0, {once(c)} AS {c}_1" for c in D.VENDOR)
    + " FROM t), z AS (SELECT *, "
    + ", ".join(f"coalesce({gene_fixed(c + '_1')}, {c}_1) AS {c}_2" for c in D.VENDOR)
    + " FROM o), r AS (SELECT *, CASE WHEN ragged THEN 'ragged_rows' WHEN length(notes_2) = 255 THEN 'truncation' END AS kind FROM z)"
)
WEIGHTS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{u}', '{m}', {float(w[i])})" for m, w in V.WEIGHTS.items() for i, u in enumerate(V.USES)) + ") weights(p, profile, mode, w)"
PROFILES = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{u}')" for i, u in enumerate((*V.USES, "raw"))) + ") profiles(p, profile)"
RESCORED = f"""pf AS ({PROFILES}), wt AS ({WEIGHTS}), rs AS (SELECT pf.p, pf.profile, cf.col, cf.mode, coalesce(wt.w, 1.0) AS w,
  greatest(0, least(2, {RANK} + CASE WHEN coalesce(wt.w, 1.0) >= 2 THEN 1 WHEN coalesce(wt.w, 1.0) <= 0.5 THEN -1 ELSE 0 END)) AS now
  FROM pf CROSS JOIN cf LEFT JOIN wt ON wt.p = pf.p AND wt.mode = cf.mode)"""
NOTES = f"""t AS ({D.vendor_sql()}), no AS (
  SELECT row_key, 'name' AS col, name AS original, {mojibake_fixed("name")} AS value, 'mojibake' AS mode, 'repaired' AS action FROM t WHERE {mojibake_fixed("name")} IS NOT NULL
  UNION ALL SELECT row_key, 'revenue', revenue, {numeric_fixed("revenue")}, 'numeric_as_text', 'repaired' FROM t WHERE {numeric_fixed("revenue")} IS NOT NULL
  UNION ALL SELECT row_key, 'status', status, '', 'null_as_string', 'repaired' FROM t WHERE {null_fixed("status")} IS NOT NULL
  UNION ALL SELECT row_key, 'gene', gene, gene, 'excel_date_corruption', 'unrepairable' FROM t WHERE regexp_matches(gene, '{V.EXCEL_DATE}')
  UNION ALL SELECT row_key, 'notes', notes, notes, 'truncation', 'unrepairable' FROM t WHERE length(notes) = 255)"""

# --- learning and mining -----------------------------------------------------------

LABELLED = f"""{features("SELECT doc_id, coalesce(text, '') AS x, quality FROM documents JOIN labels USING (doc_id)", "doc_id, quality")},
lb AS (SELECT quality = 0 AS bad, 'glyph_rate' AS feature, round(glyph_rate, 9) AS value, false AS below FROM f UNION ALL SELECT quality = 0, 'fragment_ratio', round(fragment_ratio, 9), false FROM f UNION ALL SELECT quality = 0, 'digit_rate', round(digit_rate, 9), true FROM f),
vals AS (SELECT DISTINCT feature, below, value FROM lb), nxt AS (SELECT *, lead(value) OVER (PARTITION BY feature ORDER BY value) AS nx FROM vals),
cand AS (SELECT feature, below, value AS candidate, false AS midpoint FROM nxt UNION ALL SELECT feature, below, (value + nx) / 2, true FROM nxt WHERE nx IS NOT NULL),
sweep AS (SELECT c.feature, c.candidate, c.midpoint,
  (coalesce(count(*) FILTER (bad AND hit) / nullif(count(*) FILTER (bad), 0), 0) + coalesce(count(*) FILTER (NOT bad AND NOT hit) / nullif(count(*) FILTER (NOT bad), 0), 0)) / 2 AS balanced
  FROM (SELECT c.*, lb.bad, CASE WHEN c.below THEN lb.value <= c.candidate ELSE lb.value >= c.candidate END AS hit FROM cand c JOIN lb USING (feature)) c GROUP BY ALL)"""
DEFAULTS = "VALUES ('glyph_rate', 0.5), ('fragment_ratio', 0.05), ('digit_rate', 0.004)"
GATE = "r >= 8 AND r / (r + k) >= 0.85 AND CASE WHEN k_rate > 0 THEN r_rate / k_rate ELSE 999 END >= 4"
MINED = "round(r / (r + k), 6) AS precision, round(least(CASE WHEN k_rate > 0 THEN r_rate / k_rate ELSE 999 END, 999.0), 4) AS lift"
TOTAL = "tot AS (SELECT greatest(count(*) FILTER (rejected), 1) AS n_r, greatest(count(*) FILTER (NOT rejected), 1) AS n_k FROM d)"


def _sets(kind: str, features_: str) -> str:
    return f"""WITH d AS ({D.MINED_SQL}), {TOTAL}, e AS (SELECT rejected, unnest({features_}) AS signature FROM d),
c AS (SELECT signature, count(*) FILTER (rejected) AS r, count(*) FILTER (NOT rejected) AS k FROM e GROUP BY signature), q AS (SELECT *, r / n_r AS r_rate, k / n_k AS k_rate FROM c CROSS JOIN tot)
SELECT '{kind}' AS kind, signature, r AS support, {MINED} FROM q WHERE {GATE}"""


_CAPS = f"array_to_string(list_transform(regexp_extract_all(text, '{TOKEN}'), lambda t: CASE WHEN t = upper(t) AND t <> lower(t) AND length(t) > 2 THEN 'C' ELSE '.' END), '')"
_SCRIPTS = " + ".join(rf"CAST(regexp_matches(t, '\p{{{s}}}') AS INT)" for s in ("Latin", "Cyrillic", "Greek"))
_REPEATED = "len(list_filter(range(1, length(text) - 2), lambda i: substr(text, i, 4) = repeat(substr(text, i, 1), 4) AND trim(substr(text, i, 1), " + SPACES + ") <> '')) > 0"
TOKEN_SHAPES = rf"""list_filter([CASE WHEN regexp_matches(text, '(^|[{V.SPACE_CLASS}])\p{{L}}($|[{V.SPACE_CLASS}])') THEN 'ISOLATED_LETTER' END, CASE WHEN contains({_CAPS}, 'CCCC') THEN 'ALLCAPS_RUN' END, CASE WHEN {_REPEATED} THEN 'REPEATED_CHAR' END,
  CASE WHEN regexp_matches(text, '[.,;:]{{2,}}') THEN 'REPEATED_PUNCT' END, CASE WHEN len(list_filter(regexp_extract_all(text, '{TOKEN}'), lambda t: {_SCRIPTS} > 1)) > 0 THEN 'MIXED_SCRIPT' END], lambda s: s IS NOT NULL)"""
MARKERS = rf"""list_distinct(list_concat(regexp_extract_all(text, '[^\p{{L}}\p{{N}}_{V.SPACE_CLASS}]{{2,6}}'), CASE WHEN regexp_matches(text, '{V.CID}') THEN ['(cid:'] ELSE [] END,
  list_transform(list_distinct(regexp_extract_all(text, '{V.CONTROLS}')), lambda c: 'U+' || CASE WHEN length(hex(unicode(c))) < 4 THEN lpad(hex(unicode(c)), 4, '0') ELSE hex(unicode(c)) END)))"""
CLASSES = "[" + ", ".join(rf"struct_pack(signature := '{c}', rate := CAST({count('text', chr(92) + 'p{' + c + '}')} AS DOUBLE) / nullif(length(text), 0) * 1000)" for c in V.CATEGORIES) + "]"

EVENTS = "SELECT event_id, CAST(event_id AS VARCHAR) AS a, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS b, concat(event_id % 900 + 1, lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0')) AS c, event_id % 7 = 0 AS missing FROM events"


def thousands(n: str) -> str:
    """A count with commas, as text."""
    return f"format('{{{{:,}}}}', CAST({n} AS BIGINT))".replace("{{", "{").replace("}}", "}")


def base_sql() -> dict[str, str]:
    docs = features(DOCS, "subject")
    damaged = features(f"SELECT CAST(doc_id AS VARCHAR) AS subject, coalesce(text, '') AS x FROM ({D.DAMAGED_SQL})", "subject")
    turns = features("SELECT conv_id AS doc, turn AS page_no, coalesce(text, '') AS x FROM conversations", "doc, page_no")
    flat = "mode, severity, metric, threshold"
    return {
        "text_features": f"WITH {features('SELECT doc_id, coalesce(text, $$$$) AS x FROM documents', 'doc_id')} SELECT doc_id, tokens, judged, round(glyph_rate, 9) AS glyph_rate, round(fragment_ratio, 9) AS fragment_ratio, round(digit_rate, 9) AS digit_rate FROM f",
        "text_findings": f"WITH {docs}, {found('subject')} SELECT * FROM g",
        "text_audit": f"WITH {docs}, {found('subject')}, {SCORED} SELECT * FROM a",
        "text_severity_summary": f"WITH {docs}, {found('subject')}, {SCORED} SELECT source, count(*) AS n, count(*) FILTER (judged) AS n_judged, count(*) FILTER (severity = 'corrupt') AS n_corrupt, count(*) FILTER (severity = 'suspect') AS n_suspect FROM a JOIN documents d ON CAST(d.doc_id AS VARCHAR) = a.subject GROUP BY source",
        "text_glyphs": f"WITH {damaged}, {found('subject')} SELECT * FROM g WHERE mode = 'missing_glyph'",
        "shatter_runs": f"WITH m AS (SELECT doc_id, {MASK} AS mask FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)), r AS (SELECT *, regexp_extract_all(mask, 'F{{3,}}') AS runs FROM m) SELECT doc_id, CAST(length(mask) AS BIGINT) AS n_words, CAST(len(runs) AS BIGINT) AS n_runs, CAST(coalesce(list_max(list_transform(runs, lambda s: length(s))), 0) AS BIGINT) AS longest FROM r",
        "conversation_audit": f"WITH {turns}, {found('doc, page_no')} SELECT * FROM g",
        "page_glyphs": f"SELECT page_id, CAST({count('x', TOKEN)} AS BIGINT) AS tokens, round(coalesce(CAST({count('x', V.UNDECODED)} + {count('x', V.CID)} AS DOUBLE) / nullif(length(x), 0) * 1000, 0.0), 9) AS glyph_rate FROM (SELECT page_id, coalesce(html, '') AS x FROM pages)",
        "column_metrics": f"WITH {L}, {METRICS} SELECT col AS \"column\", n, m, mojibake, formatted, plain, nullish, excel, longest, digits, digit_min, digit_max, padded FROM m",
        "tabular_audit": f'{AUDIT} SELECT col AS "column", {flat} FROM cf',
        "tabular_samples": f"""{AUDIT}, ev AS (
  SELECT 'name' AS col, 'mojibake' AS mode, '\xc3\xa9' AS samples
  UNION ALL SELECT 'revenue', 'numeric_as_text', string_agg(v, '|' ORDER BY row_key) FROM (SELECT * FROM l WHERE col = 'revenue' ORDER BY row_key LIMIT 5)
  UNION ALL SELECT 'gene', 'excel_date_corruption', string_agg(v, '|' ORDER BY row_key) FROM (SELECT * FROM l WHERE col = 'gene' AND {EXCEL} ORDER BY row_key LIMIT 5)
  UNION ALL SELECT 'status', 'null_as_string', string_agg(v, '|' ORDER BY n DESC, f) FROM (SELECT v, count(*) AS n, min(row_key) AS f FROM l WHERE col = 'status' AND v <> 'active' GROUP BY v)
  UNION ALL SELECT 'zip_code', 'leading_zero_loss', string_agg(v, '|' ORDER BY row_key) FROM (SELECT * FROM l WHERE col = 'zip_code' ORDER BY row_key LIMIT 5)
  UNION ALL SELECT 'notes', 'truncation', string_agg(substr(v, 1, 40) || '...', '|' ORDER BY row_key) FROM (SELECT * FROM l WHERE col = 'notes' AND length(v) = 255 ORDER BY row_key LIMIT 3))
SELECT col AS "column", mode, samples FROM ev JOIN cf USING (col, mode)""",
        "tabular_severity": f'{AUDITED} SELECT col AS "column", units, judged, severity, round(confidence, 6) AS confidence FROM a',
        "audit_summary": f"{AUDITED} SELECT {NAMED(f'max({RANK})')} AS severity, count(*) AS artifacts, count(*) FILTER (judged) AS artifacts_judged, round(avg(confidence) FILTER (judged), 3) AS confidence, string_agg('column ' || col, ',' ORDER BY 'column ' || col) FILTER (c > 0) AS flagged FROM a",
        "lineitem_audit": f"WITH l AS (SELECT 0 AS row_key, i AS k, c AS col, v FROM (SELECT unnest({list(range(len(D.LINEITEM)))}) AS i, unnest({D.LINEITEM}) AS c, unnest([{', '.join(f'CAST({c} AS VARCHAR)' for c in D.LINEITEM)}]) AS v FROM lineitem)), {METRICS} SELECT col AS \"column\", n, m, mojibake, formatted, nullish, excel, digits, padded FROM m",
        "ragged_audit": f"WITH r AS ({D.RAGGED_SQL}), c AS (SELECT count(*) FILTER (len(fields) <> 3) / count(*) AS rate FROM r) SELECT 'table structure' AS subject, 'ragged_rows' AS mode, CASE WHEN rate >= 0.01 THEN 'corrupt' ELSE 'suspect' END AS severity, rate AS metric, CASE WHEN rate >= 0.01 THEN 0.01 ELSE 0.001 END::DOUBLE AS threshold FROM c WHERE rate >= 0.001",
        "table_features": f"WITH r AS ({D.RAGGED_SQL}), l AS (SELECT unnest(fields) AS v FROM r), c AS (SELECT count(*) FILTER ({MOJIBAKE}) / count(*) AS mojibake_rate, count(*) FILTER (v IN {_in(V.NULL_LIKE_AUDIT)}) / count(*) AS null_string, CAST(count(*) FILTER ({EXCEL}) AS DOUBLE) AS excel_date FROM l) SELECT count(*) AS units, count(*) >= 30 AS judged, any_value(mojibake_rate) AS mojibake_rate, any_value(null_string) AS null_string, count(*) FILTER (len(fields) <> 3) / count(*) AS ragged, any_value(excel_date) AS excel_date FROM r CROSS JOIN c",
        "duplicate_headers": "WITH h AS (SELECT unnest(range(5)) AS pos, unnest(['id', 'name', 'id', 'amount', 'name']) AS name) SELECT pos, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '__' || row_number() OVER (PARTITION BY name ORDER BY pos) ELSE name END AS name FROM h",
        "column_shapes": f"WITH l AS ({long(['p_brand', 'p_type', 'p_name'], 'SELECT 0 AS row_key, * FROM part')}), {SHAPES} SELECT col AS \"column\", shape, n FROM sh",
        "column_conventions": f'WITH {L}, {CONVENTIONS} SELECT col AS "column", m, top_n, top_shape, others, m - top_n AS breaks FROM cv',
        "convention_breaks": f"WITH {L}, {CONVENTIONS} SELECT col AS \"column\", 'convention_break' AS mode, CASE WHEN (m - top_n) / m < 0.01 THEN 'suspect' ELSE 'corrupt' END AS severity, (m - top_n) / m AS metric, CAST(0.05 AS DOUBLE) AS threshold FROM cv WHERE m >= 40 AND top_n / m >= 0.9 AND m > top_n AND (m - top_n) <= 0.05 * m",
        "order_date_shapes": f"WITH l AS ({long(['o_orderdate', 'o_orderpriority'], chr(10) + 'SELECT 0 AS row_key, strftime(o_orderdate, $$%Y-%m-%d$$) AS o_orderdate, o_orderpriority FROM orders')}), {SHAPES} SELECT col AS \"column\", shape, n FROM sh",
        "mojibake_repair": _repair("name", mojibake_fixed("name")),
        "numeric_repair": _repair("revenue", numeric_fixed("revenue")),
        "null_repair": _repair("status", null_fixed("status")),
        "gene_restore": _repair("gene", gene_fixed("gene")),
        "leading_zero_pad": f"WITH t AS ({D.vendor_sql()}), w AS (SELECT arg_min(w, (-n, f)) AS w FROM (SELECT length(zip_code) AS w, count(*) AS n, min(row_key) AS f FROM t GROUP BY 1)) SELECT row_key, CASE WHEN length(zip_code) < w THEN lpad(zip_code, CAST(w AS INT), '0') ELSE zip_code END AS padded FROM t CROSS JOIN w",
        "repair_table": f"WITH t AS ({D.vendor_sql()}) SELECT row_key, coalesce({mojibake_fixed('name')}, name) AS name, coalesce({numeric_fixed('revenue')}, revenue) AS revenue, gene, coalesce({null_fixed('status')}, status) AS status, zip_code, notes, joined, segment FROM t",
        "repair_counts": f"""{AUDIT}, t AS ({D.vendor_sql()}), w2 AS (SELECT arg_min(w, (-n, f)) AS w FROM (SELECT length(zip_code) AS w, count(*) AS n, min(row_key) AS f FROM t GROUP BY 1)), x AS (
  SELECT 'name' AS col, 'mojibake' AS mode, 'reversible' AS recoverability, count({mojibake_fixed("name")}) AS changed, count(*) AS total FROM t
  UNION ALL SELECT 'revenue', 'numeric_as_text', 'reversible', count({numeric_fixed("revenue")}), count(*) FROM t
  UNION ALL SELECT 'status', 'null_as_string', 'reversible', count({null_fixed("status")}), count(*) FROM t
  UNION ALL SELECT 'zip_code', 'leading_zero_loss', 'lossy', count(*) FILTER (length(zip_code) < w), count(*) FROM t CROSS JOIN w2)
SELECT col AS "column", mode, recoverability, changed, total FROM x JOIN cf USING (col, mode) WHERE changed > 0""",
        "repair_refusals": f"""{AUDIT} SELECT col AS "column", mode, CAST(CASE WHEN mode = 'leading_zero_loss' THEN digits WHEN metric > 1 THEN floor(metric) ELSE round(metric * n) END AS BIGINT) AS affected
FROM cf JOIN w USING (k, col) WHERE mode IN ('excel_date_corruption', 'truncation', 'leading_zero_loss')""",
        "solve_clean": f"WITH {SOLVED} SELECT {', '.join(f'{c}_2 AS {c}' for c in D.VENDOR)} FROM r WHERE kind IS NULL",
        "solve_quarantine": f"WITH {SOLVED} SELECT row_key, kind FROM r WHERE kind IS NOT NULL",
        "solve_actions": f"WITH {SOLVED}, c AS (" + " UNION ALL ".join(f"SELECT CASE WHEN {mojibake_fixed(c + '_0')} IS NOT NULL THEN 'mojibake' WHEN {numeric_fixed(c + '_0')} IS NOT NULL THEN 'numeric_as_text' ELSE 'null_as_string' END AS mode FROM r WHERE NOT ragged AND {c}_0 <> {c}_1 UNION ALL SELECT 'excel_date_corruption' FROM r WHERE NOT ragged AND {c}_2 <> {c}_1" for c in D.VENDOR) + ") SELECT mode, count(*) AS affected FROM c GROUP BY mode UNION ALL SELECT kind, count(*) FROM r WHERE kind IS NOT NULL GROUP BY kind",
        "solve_counts": f"WITH {SOLVED} SELECT count(*) FILTER (kind IS NULL) AS kept, count(*) FILTER (kind IS NOT NULL) AS quarantined, round(count(*) FILTER (kind IS NULL) / count(*), 6) AS recovered_fraction FROM r",
        "profile_rescore": f"{AUDITED}, {RESCORED}, y AS (SELECT p, col, max(now) FILTER (w <> 0) AS r, count(*) FILTER (w <> 0) AS reported, count(*) FILTER (w = 0) AS suppressed FROM rs GROUP BY p, col) SELECT pf.profile, a.col AS \"column\", {NAMED('coalesce(r, 0)')} AS severity, coalesce(r, 0) < 2 AS usable, CAST(coalesce(reported, 0) AS BIGINT) AS reported, CAST(coalesce(suppressed, 0) AS BIGINT) AS suppressed FROM pf CROSS JOIN a LEFT JOIN y ON y.p = pf.p AND y.col = a.col",
        "profile_compare": f"{AUDIT}, {RESCORED} SELECT profile, {NAMED('coalesce(max(now) FILTER (w <> 0), 0)')} AS worst, count(*) FILTER (w <> 0) AS reported, coalesce(string_agg(DISTINCT mode, ', ' ORDER BY mode) FILTER (w <> 0 AND now = 2), '-') AS blockers FROM rs GROUP BY profile",
        "crossfile_headers": f"WITH h AS ({D.HEADERS_SQL}), n AS (SELECT DISTINCT unnest(header) AS name FROM h), k AS (SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, name FROM n) SELECT key, string_agg(name, ' / ' ORDER BY name) AS spellings FROM k GROUP BY key HAVING count(*) > 1",
        "crossfile_layouts": f"WITH h AS ({D.HEADERS_SQL}), s AS (SELECT source, list_sort(list_transform(header, lambda c: lower(c))) AS layout FROM h), c AS (SELECT layout, count(*) AS n, min(source) AS f FROM s GROUP BY layout), t AS (SELECT arg_min(layout, (-n, f)) AS common, max(n) AS most, count(*) AS kinds, sum(n) AS every FROM c) SELECT source FROM s CROSS JOIN t WHERE kinds > 1 AND most >= 2 AND most >= 0.6 * every AND layout <> common",
        "provenance_notes": f'WITH {NOTES} SELECT row_key, col AS "column", original, value, mode, action FROM no',
        "review_queue": f"WITH {NOTES} SELECT row_key, col AS \"column\", mode, action FROM no ORDER BY CASE action WHEN 'unrepairable' THEN 0 ELSE 2 END, col, row_key LIMIT 200",
        "threshold_sweep": f"WITH {LABELLED} SELECT feature, round(candidate, 6) AS candidate, midpoint, round(balanced, 6) AS balanced FROM sweep",
        "learned_thresholds": f"""WITH {LABELLED}, df(feature, dv) AS ({DEFAULTS}), base AS (SELECT feature, (coalesce(count(*) FILTER (bad AND hit) / nullif(count(*) FILTER (bad), 0), 0) + coalesce(count(*) FILTER (NOT bad AND NOT hit) / nullif(count(*) FILTER (NOT bad), 0), 0)) / 2 AS before, count(*) FILTER (bad) AS nb, count(*) FILTER (NOT bad) AS ng
  FROM (SELECT lb.*, CASE WHEN below THEN value <= dv ELSE value >= dv END AS hit FROM lb JOIN df USING (feature)) GROUP BY feature),
best AS (SELECT feature, max(balanced) AS after, arg_min(candidate, (-balanced, midpoint, candidate)) AS threshold FROM sweep GROUP BY feature)
SELECT feature, round(before, 9) AS before, round(threshold, 9) AS threshold, round(after, 9) AS after, nb + ng >= 40 AND least(nb, ng) >= 10 AND after >= before + 0.03 AS adopted FROM base JOIN best USING (feature)""",
        "mine_char_classes": f"""WITH d AS ({D.MINED_SQL}), {TOTAL}, e AS (SELECT rejected, unnest({CLASSES}) AS u FROM d), c AS (SELECT u.signature AS signature, count(*) FILTER (rejected) AS r, count(*) FILTER (NOT rejected) AS k, coalesce(sum(u.rate) FILTER (rejected), 0) AS rs, coalesce(sum(u.rate) FILTER (NOT rejected), 0) AS ks FROM e WHERE u.rate > 0 GROUP BY 1),
q AS (SELECT *, rs / n_r AS r_rate, ks / n_k AS k_rate FROM c CROSS JOIN tot) SELECT 'character_class' AS kind, signature, r AS support, {MINED} FROM q WHERE r_rate >= 0.1 AND {GATE}""",
        "mine_token_shapes": _sets("token_shape", TOKEN_SHAPES),
        "mine_markers": _sets("marker_string", MARKERS),
        "detector_utility": f"""WITH {features("SELECT doc_id, quality, coalesce(text, '') AS x FROM documents JOIN labels USING (doc_id)", "doc_id, quality")}, e AS (SELECT quality = 0 AS bad, 'missing_glyph' AS name, glyph_rate >= 0.5 AS hit FROM f UNION ALL SELECT quality = 0, 'shattered_words', fragment_ratio >= 0.05 FROM f UNION ALL SELECT quality = 0, 'numeric_loss', digit_rate >= 0 AND digit_rate <= 0.004 FROM f),
c AS (SELECT name, count(*) FILTER (hit) AS fired, count(*) FILTER (hit AND bad) AS agreed, count(*) FILTER (NOT hit AND bad) AS missed FROM e GROUP BY name)
SELECT *, CASE WHEN fired = 0 OR (fired >= 30 AND agreed = 0) THEN 'retire' WHEN agreed / fired < 0.3 THEN 'noisy' WHEN missed > agreed THEN 'misses more than it finds' ELSE 'keep' END AS verdict FROM c""",
        "stream_repair": f"SELECT a AS event_id, b AS event_type, c AS value FROM ({EVENTS}) WHERE event_id % 100 <> 0",
        "stream_quarantine": "SELECT CAST(event_id AS VARCHAR) AS event_id, 'field count mismatch' AS reason FROM events WHERE event_id % 100 = 0",
        "stream_column_stats": f"WITH e AS ({EVENTS}), k AS (SELECT * FROM e WHERE event_id % 100 <> 0), n AS (SELECT count(*) AS n, count(*) FILTER (missing) AS x FROM k) SELECT 'column event_id' AS subject, n AS units, 'numeric_as_text' AS mode, 'suspect' AS severity, CAST(1.0 AS DOUBLE) AS metric, CAST(0.95 AS DOUBLE) AS threshold FROM n UNION ALL SELECT 'column value', n, 'numeric_as_text', 'suspect', 1.0, 0.95 FROM n UNION ALL SELECT 'column event_type', n, 'null_as_string', 'suspect', x / n, 0.01 FROM n",
    }


def oracle_sql() -> dict[str, str]:
    from . import file_oracles

    return base_sql() | file_oracles.oracle_sql()
