"""Expected results as DuckDB SQL on the test tables.

What a file or ticket names is computed from the columns its text was made of, never
by reading the text, so these queries share nothing with the operators.
"""

from __future__ import annotations

from ripplemap.operators.issues import FAILED_REQUEST, MISSING_PARAMETER, UNUSED_NOTE
from ripplemap.operators.issues import REFERENCE_PATTERN
from ripplemap.plans import corpora as c

_MAIN = "https://git.example.com/r/blob/main/"

# Facts of the derived files ----------------------------------------------------------

_REPO = f"""
repo AS (
  SELECT o_orderkey AS ordinal, o_orderkey AS k, o_custkey AS c,
    CASE o_custkey % 3 WHEN 0 THEN 0 ELSE o_custkey END AS t,
    'job' || (o_orderkey - o_orderkey % 20) || CASE o_orderkey % 6 WHEN 0 THEN '.yml' WHEN 1 THEN '.b.sql'
      WHEN 2 THEN '.sql.yml' ELSE '.sql' END AS name,
    'etl/d' || (o_custkey % 13) || '/' AS folder,
    CASE WHEN o_orderkey % 6 >= 2 THEN 'sql' WHEN o_orderkey % 6 = 0 THEN 'yml' END AS kind,
    CASE WHEN o_orderkey % 6 IN (0, 2) THEN 'yml' ELSE 'sql' END AS last_kind
  FROM orders),
repo_files AS (
  SELECT *, folder || name AS path, '{_MAIN}' || folder || name AS url FROM repo)"""

_YML = f"""
yml AS (
  SELECT p_partkey AS ordinal, p_partkey AS k, p_size AS s,
    'pipelines/p' || p_partkey || '.yml' AS path,
    '{_MAIN}pipelines/p' || p_partkey || '.yml' AS url
  FROM part)"""

_LAST_SQL = """
last_sql AS (
  SELECT * FROM repo_files WHERE kind = 'sql'
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY ordinal DESC) = 1)"""

_SQL_PAIRS = """
sql_pairs AS (
  SELECT name AS file, url, 0 AS pos, CASE WHEN k % 4 = 0 THEN 'dw.fact' || (k - k % 20)
    ELSE 'ods.orders' || t END AS tab FROM last_sql
  UNION ALL SELECT name, url, 1, CASE WHEN k % 4 = 0 THEN 'ods.orders' || t
    ELSE 'src.cust' || (c - c % 40) END FROM last_sql
  UNION ALL SELECT name, url, 2, 'raw.pay' || (k - k % 30) FROM last_sql WHERE k % 4 <> 0)"""

_YML_PAIRS = """
yml_pairs AS (
  SELECT path AS file, url, 0 AS pos, 'ods.parts' || (k % 25) AS tab FROM yml WHERE k % 5 <> 0
  UNION ALL SELECT path, url, 1, 'src.part' || (s % 9) FROM yml WHERE k % 5 <> 0)"""

_STEP = f"""
step_files AS (
  SELECT s_suppkey AS ordinal, s_suppkey AS k, s_nationkey AS n,
    'flows/s' || s_suppkey || '.yml' AS path, '{_MAIN}flows/s' || s_suppkey || '.yml' AS url,
    CASE s_suppkey % 15 WHEN 4 THEN 'ScannerError' WHEN 9 THEN 'ParserError'
      WHEN 14 THEN 'NoStepsSection' END AS reason
  FROM supplier)"""

# Steps in name order: a_clean's last INSERT, then b_load's last definition.
_STEP_PAIRS = """
step_pairs AS (
  SELECT path AS file, url, row_number() OVER (PARTITION BY path ORDER BY min(spot)) - 1 AS pos, tab
  FROM (
    SELECT path, url, 0 AS spot, 'dw.n' || n AS tab FROM step_files WHERE reason IS NULL
    UNION ALL SELECT path, url, 1, 'ods.s' || (k % 7) FROM step_files WHERE reason IS NULL
    UNION ALL SELECT path, url, 2, 'new.t' || (k % 7) FROM step_files WHERE reason IS NULL)
  GROUP BY path, url, tab)"""

_CODE = ",".join([_REPO, _YML, _LAST_SQL, _SQL_PAIRS, _YML_PAIRS, _STEP, _STEP_PAIRS]) + """,
code AS (
  SELECT tab AS pk, file AS label, url FROM sql_pairs
  UNION ALL SELECT tab, file, url FROM yml_pairs
  UNION ALL SELECT tab, file, url FROM step_pairs)"""

_CODE_INTENDED = ",".join([_REPO, _YML, _YML_PAIRS, _STEP, _STEP_PAIRS]) + """,
every_file AS (
  SELECT * FROM (
    SELECT ordinal, k, c, t, path, url FROM repo_files WHERE last_kind = 'sql')
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY ordinal DESC) = 1),
code AS (
  SELECT 'ods.orders' || t AS pk, path AS label, url FROM every_file
  UNION ALL SELECT 'src.cust' || (c - c % 40), path, url FROM every_file
  UNION ALL SELECT 'raw.pay' || (k - k % 30), path, url FROM every_file
  UNION ALL SELECT 'dw.fact' || (k - k % 20), path, url FROM every_file WHERE k % 4 = 0
  UNION ALL SELECT tab, file, url FROM yml_pairs
  UNION ALL SELECT tab, file, url FROM step_pairs
  UNION ALL SELECT 'first.one', path, url FROM step_files WHERE reason IS NULL)"""

_EDGES = """
edges AS (
  SELECT l_partkey AS table_id, 'Dash ' || (l_suppkey % 20) AS name,
    'wb' || l_suppkey || '/v' AS path,
    row_number() OVER (PARTITION BY l_partkey
      ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS pos
  FROM lineitem),
nth AS (
  SELECT *, row_number() OVER (PARTITION BY table_id, name ORDER BY pos) AS n FROM edges),
kept AS (
  SELECT * EXCLUDE (cutoff) FROM (
    SELECT *, min(CASE WHEN n = 2 THEN pos END) OVER (PARTITION BY table_id) AS cutoff FROM nth)
  WHERE cutoff IS NULL OR pos < cutoff)"""

_DATABASE_TABLES = """
db_tables AS (
  SELECT p_partkey AS table_id, 'ods.orders' || (p_partkey - p_partkey % 4) AS pk,
    CASE p_size % 7 WHEN 2 THEN NULL ELSE 'redshift' END AS connection_type
  FROM part WHERE p_size % 7 NOT IN (0, 1, 3))"""

_BI = ",".join([_EDGES, _DATABASE_TABLES]) + f""",
winners AS (
  SELECT pk, max(table_id) AS table_id FROM db_tables
  WHERE table_id IN (SELECT table_id FROM edges) GROUP BY pk),
bi AS (
  SELECT pk, name AS label, '{c.SERVER_URL}/#/views/' || path AS url
  FROM winners JOIN kept USING (table_id))"""

_BI_INTENDED = ",".join([_EDGES, _DATABASE_TABLES]) + f""",
bi AS (
  SELECT pk, name AS label,
    '{c.SERVER_URL}/#/views/' || arg_min(path, (table_id, pos)) AS url
  FROM db_tables JOIN edges USING (table_id) GROUP BY pk, name)"""

_INDEX = _CODE + "," + _BI + """,
idx AS (
  SELECT 'github' AS source, pk, label, url FROM code
  UNION ALL SELECT 'tableau', pk, label, url FROM bi),
keys AS (
  SELECT pk, bool_or(source = 'tableau') AS has_dashboards, bool_or(source = 'github') AS has_files,
    count(*) FILTER (WHERE source = 'tableau') AS n_dashboards,
    count(*) FILTER (WHERE source = 'github') AS n_files
  FROM idx GROUP BY pk)"""

_OLD = f"""
old_code AS (
  SELECT DISTINCT 'ods.orders' || (o_custkey - o_custkey % 2) AS pk, 'job' || (o_orderkey - o_orderkey % 20) || '.sql' AS label,
    'https://git.example.com/r/blob/old/job' || (o_orderkey - o_orderkey % 20) || '.sql' AS url
  FROM orders)"""

_REFS = """
refs AS (
  SELECT 'IMP-' || c_custkey AS issue_key, pos, field FROM (
    SELECT c_custkey, 0 AS pos, CASE c_custkey % 6
      WHEN 0 THEN 'ods.orders' || (c_custkey + 1) WHEN 1 THEN 'src.cust' || (c_custkey - c_custkey % 40)
      WHEN 3 THEN 'dw.fact' || (c_custkey - c_custkey % 10) WHEN 4 THEN 'order_status' END AS field
    FROM customer
    UNION ALL
    SELECT c_custkey, 1, CASE c_custkey % 6 WHEN 1 THEN 'raw.pay' || (c_custkey - c_custkey % 15)
      WHEN 3 THEN 'dw.fact' || (c_custkey - c_custkey % 10) WHEN 4 THEN 'ods.orders_staging' END
    FROM customer)
  WHERE field IS NOT NULL)"""

_LOOKUP = """
looked AS (
  SELECT r.*, pk, CASE WHEN pk IS NULL THEN 'confirmation' ELSE 'error' END AS status,
    coalesce(n_dashboards, 0) AS n_dashboards, coalesce(n_files, 0) AS n_files
  FROM refs r LEFT JOIN keys ON field = pk)"""

_REQUEST_REFS = """
request_refs AS (
  SELECT c_custkey AS request_id, 0 AS pos, CASE c_custkey % 7 WHEN 0 THEN 'ods.orders' || (c_custkey + 1)
    WHEN 1 THEN 'raw.pay' || (c_custkey - c_custkey % 15) WHEN 2 THEN 'a+b.c' END AS field FROM customer
  WHERE c_custkey % 7 IN (0, 1, 2)
  UNION ALL SELECT c_custkey, 1, CASE c_custkey % 7 WHEN 0 THEN 'src.cust' || (c_custkey - c_custkey % 40)
    ELSE 'dw.fact' || (c_custkey - c_custkey % 10) END FROM customer WHERE c_custkey % 7 IN (0, 2))"""

_REPORT = f"""
SELECT l.issue_key, l.pos, l.field, l.status,
  CASE i.source WHEN 'tableau' THEN 'dashboards' WHEN 'github' THEN 'files' END AS section,
  i.label, i.url, CASE WHEN l.pk IS NULL THEN '{UNUSED_NOTE}' END AS note
FROM looked l LEFT JOIN idx i ON l.field = i.pk"""

_STATEMENTS = """
scripts AS (
  SELECT ordinal, k, 0 AS pos, 'INSERT INTO ods.orders' || t || '_tmp SELECT * FROM src.cust' ||
    (c - c % 40) || ' c JOIN Raw.Pay' || (k - k % 30) || ' p ON c.k = p.k' AS statement
  FROM repo_files WHERE kind = 'sql'
  UNION ALL SELECT ordinal, k, 1, 'SELECT * FROM sel.only' FROM repo_files WHERE kind = 'sql'
  UNION ALL SELECT ordinal, k, 2, 'insert into dw.fact' || (k - k % 20) ||
    '_staging select * from ods.orders' || t
  FROM repo_files WHERE kind = 'sql' AND k % 4 = 0)"""

_TABLE_NODES = """
nodes AS (
  SELECT p_partkey AS page, p_partkey AS k, p_size AS s, 'Orders' || (p_partkey - p_partkey % 4) AS name,
    '[ODS].[Orders' || (p_partkey - p_partkey % 4) || ']' AS full_name,
    CASE p_partkey % 4 WHEN 0 THEN 'ods' WHEN 1 THEN 'ODS' WHEN 2 THEN 'dbo' END AS "schema",
    CASE p_size % 7 WHEN 0 THEN 'hyper' WHEN 1 THEN 'textscan' WHEN 2 THEN NULL
      ELSE 'redshift' END AS connection_type,
    CASE WHEN p_size % 5 > 0 THEN 'Id,Amount' || p_size END AS column_names
  FROM part),
listed AS (
  SELECT page, 0 AS pos, 'Dash ' || (s % 6) AS name, 'wb' || k || '/a' AS path FROM nodes WHERE s % 4 >= 1
  UNION ALL SELECT page, 1, 'Dash ' || (s % 4), 'wb' || k || '/b' FROM nodes WHERE s % 4 >= 2
  UNION ALL SELECT page, 2, 'Dash ' || (s % 3), 'wb' || k || '/c' FROM nodes WHERE s % 4 >= 3)"""


def _with(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body.strip()


def _substituted(mode: str) -> str:
    """Expected text of the template files."""
    both = "r ods" if mode == "intended" else "r {{ schema.ods }}"
    # The open brace of the sixth line is unknown text, so a line in intended mode
    # loses its braces once its variables are gone.
    rooted = "rr no end " if mode == "intended" else "rr no end {{"
    return f"""
    SELECT c_custkey AS ordinal, 'from ods.t' || c_custkey || chr(10) || CASE c_custkey % 6
      WHEN 0 THEN '' WHEN 1 THEN 'from xy.t' || chr(10) WHEN 2 THEN '{both}' || chr(10)
      WHEN 3 THEN ' q' || chr(10) WHEN 4 THEN 'a  x ' || chr(10)
      ELSE '{rooted}' || chr(10) END || 'where open' AS content
    FROM customer"""


_ORACLE = {
    "q_repo_scan": _with(_REPO, _YML, _STEP, body=f"""
        SELECT ordinal, path, name, url, length(content) AS n_chars
        FROM repo_files JOIN (SELECT ordinal, content FROM {c.duck(c.REPO_FILES)}) USING (ordinal)
        UNION ALL
        SELECT ordinal, path, 'p' || k || '.yml', url, length(content)
        FROM yml JOIN (SELECT ordinal, content FROM {c.duck(c.YML_FILES)}) USING (ordinal)
        UNION ALL
        SELECT ordinal, path, 's' || k || '.yml', url, length(content)
        FROM step_files JOIN (SELECT ordinal, content FROM {c.duck(c.STEP_FILES)}) USING (ordinal)"""),
    "q_repo_folder": f"""
        SELECT folder || name AS path, name, '{_MAIN}' || folder || name AS url, length(content) AS n_chars
        FROM (SELECT content, 'pipelines/' || CASE ordinal % 3 WHEN 0 THEN '.d' ELSE 'd' END || (ordinal % 11) || '/'
            AS folder, CASE ordinal % 5 WHEN 0 THEN '.p' WHEN 1 THEN '_p' ELSE 'p' END || ordinal || '.yml' AS name
          FROM {c.duck(c.YML_FILES)})""",
    "q_classify_files": _with(_REPO, _YML, _STEP, body="""
        SELECT ordinal, path, kind, CASE kind WHEN 'sql' THEN name ELSE path END AS file_key
        FROM repo_files WHERE kind IS NOT NULL
        UNION ALL SELECT ordinal, path, 'yml', path FROM yml
        UNION ALL SELECT ordinal, path, 'yml', path FROM step_files"""),
    "q_classify_files_intended": _with(_REPO, _YML, _STEP, body="""
        SELECT ordinal, path, last_kind AS kind, path AS file_key FROM repo_files
        UNION ALL SELECT ordinal, path, 'yml', path FROM yml
        UNION ALL SELECT ordinal, path, 'yml', path FROM step_files"""),
    "q_file_urls": _with(_REPO, _YML, _STEP, _LAST_SQL, body="""
        SELECT kind, name AS file_key, url FROM last_sql
        UNION ALL SELECT DISTINCT kind, path, url FROM repo_files WHERE kind = 'yml'
        UNION ALL SELECT 'yml', path, url FROM yml
        UNION ALL SELECT 'yml', path, url FROM step_files"""),
    "q_sql_file_dedup": _with(_REPO, _LAST_SQL, body="""
        SELECT name AS file_key, ordinal, path FROM last_sql"""),
    "q_env_vars": """
        SELECT v.key, v.value FROM supplier, (VALUES ('bucket'), ('schema.ods'), ('schema.deep.x'),
          ('schema.deep.y'), ('shared'), ('raw')) keys(key),
        LATERAL (SELECT keys.key, CASE keys.key WHEN 'bucket' THEN 'b' || s_nationkey
          WHEN 'schema.ods' THEN 'ods' || s_suppkey WHEN 'schema.deep.x' THEN 'True'
          WHEN 'schema.deep.y' THEN 'None' WHEN 'shared' THEN 'from_defaults'
          ELSE 'raw' || (s_suppkey % 3) END AS value) v
        WHERE s_suppkey = 7""",
    "q_env_vars_missing": "SELECT 'env_vars' AS key, 'none' AS value",
    "q_flatten_vars": """
        SELECT 'pipelines/settings' || s_suppkey || '.yml' AS path, v.key, v.value
        FROM supplier, (VALUES ('bucket'), ('schema.ods'), ('schema.deep.x'),
          ('schema.deep.y'), ('shared'), ('raw')) keys(key),
        LATERAL (SELECT keys.key, CASE keys.key WHEN 'bucket' THEN 'b' || s_nationkey
          WHEN 'schema.ods' THEN 'ods' || s_suppkey WHEN 'schema.deep.x' THEN 'True'
          WHEN 'schema.deep.y' THEN 'None' WHEN 'shared' THEN 'from_defaults'
          ELSE 'raw' || (s_suppkey % 3) END AS value) v""",
    "q_env_substitute": _substituted("parity"),
    "q_env_substitute_intended": _substituted("intended"),
    "q_split_statements": _with(_REPO, _STATEMENTS, body="""
        SELECT ordinal, pos, statement FROM scripts"""),
    "q_insert_statements": _with(_REPO, _STATEMENTS, body="""
        SELECT ordinal, pos, statement FROM scripts WHERE pos <> 1"""),
    "q_table_refs": _with(_REPO, body="""
        SELECT ordinal, 0 AS pos, 0 AS ref_pos, 'ods.orders' || t || '_tmp' AS "table"
        FROM repo_files WHERE kind = 'sql'
        UNION ALL SELECT ordinal, 0, 1, 'src.cust' || (c - c % 40) FROM repo_files WHERE kind = 'sql'
        UNION ALL SELECT ordinal, 0, 2, 'Raw.Pay' || (k - k % 30) FROM repo_files WHERE kind = 'sql'
        UNION ALL SELECT ordinal, 2, 0, 'dw.fact' || (k - k % 20) || '_staging' FROM repo_files
          WHERE kind = 'sql' AND k % 4 = 0
        UNION ALL SELECT ordinal, 2, 1, 'ods.orders' || t FROM repo_files
          WHERE kind = 'sql' AND k % 4 = 0"""),
    "q_table_refs_dialects": """
        SELECT c_custkey AS ordinal, 0 AS pos, ref_pos, CASE ref_pos WHEN 0 THEN 'ods.t' || c_custkey
          WHEN 1 THEN 'src.n' || c_nationkey ELSE 'dw.s ' || (c_custkey % 9) END AS "table"
        FROM customer, (VALUES (0), (1), (2)) r(ref_pos)""",
    "q_last_insert": _with(_REPO, _STATEMENTS, body="""
        SELECT ordinal, statement FROM scripts WHERE pos = CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END"""),
    "q_normalise_tables": """
        SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'ods.a' || c_custkey || 'late'
          WHEN 1 THEN 'x.y' || c_custkey || '_tmp' WHEN 3 THEN 'dw.t' || c_custkey
          ELSE 'c.s.u' || c_custkey END AS "table"
        FROM customer WHERE c_custkey % 5 <> 2""",
    "q_normalise_tables_intended": """
        SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'ods.a' || c_custkey || '_tmp_template'
          WHEN 1 THEN 'x.y' || c_custkey WHEN 3 THEN 'dw.t' || c_custkey
          ELSE 'c.s_temp.u' || c_custkey END AS "table"
        FROM customer WHERE c_custkey % 5 <> 2""",
    "q_yml_gate": _with(_YML, _STEP, body="""
        SELECT path, true AS has_steps FROM yml WHERE k % 5 <> 0
        UNION ALL SELECT path, k % 15 <> 14 FROM step_files"""),
    "q_yml_lint": """
        SELECT p_partkey AS ordinal, 'frequency: daily' || chr(10) || 'steps:' || chr(10) ||
          '- step_type: ' || CASE WHEN p_partkey % 5 = 0 THEN 'extract-s3' ELSE 'sql-command' END ||
          chr(10) || '  name: load-' || p_size || chr(10) || '  command: INSERT INTO {{ schema.ods }}.parts'
          || (p_partkey % 25) || '_temp SELECT * FROM src.part' || (p_size % 9) || chr(10) AS content
        FROM part""",
    "q_yml_steps": _with(_STEP, body="""
        SELECT path, 'a_clean' AS name, 1 AS pos, 'INSERT INTO first.one SELECT 1; INSERT INTO dw.n' || n ||
          ' SELECT * FROM ods.s' || (k % 7) || '_tmp' AS command FROM step_files WHERE reason IS NULL
        UNION ALL SELECT path, 'b_load', 4, 'INSERT INTO new.t' || (k % 7) || ' SELECT * FROM dw.n' || n
        FROM step_files WHERE reason IS NULL"""),
    "q_yml_quarantine": _with(_STEP, body="""
        SELECT path, reason FROM step_files WHERE reason IS NOT NULL"""),
    "q_ingest_stats": _with(_REPO, _YML, _STEP, body="""
        SELECT kind, 'found' AS outcome, count(*) AS files FROM (
          SELECT kind FROM repo_files WHERE kind IS NOT NULL UNION ALL SELECT 'yml' FROM yml
          UNION ALL SELECT 'yml' FROM step_files) GROUP BY kind
        UNION ALL SELECT 'yml', outcome, count(*) FROM (
          SELECT 'parsed' AS outcome FROM yml WHERE k % 5 <> 0
          UNION ALL SELECT CASE WHEN reason IS NULL THEN 'parsed' ELSE 'failed' END FROM step_files)
        GROUP BY outcome"""),
    "q_tables_per_file": _with(
        _REPO, _YML, _LAST_SQL, _SQL_PAIRS, _YML_PAIRS, _STEP, _STEP_PAIRS, body="""
        SELECT file AS file_key, pos, tab AS "table" FROM sql_pairs
        UNION ALL SELECT file, pos, tab FROM yml_pairs
        UNION ALL SELECT file, pos, tab FROM step_pairs"""),
    "q_table_to_files": _with(_CODE, body="""
        SELECT pk AS "table", label AS file, url FROM code"""),
    "q_code_index": _with(_CODE, body="SELECT pk, label, url FROM code"),
    "q_code_index_intended": _with(_CODE_INTENDED, body="SELECT DISTINCT pk, label, url FROM code"),
    "q_bi_table_scan": _with(_TABLE_NODES, body="""
        SELECT page, name, full_name, "schema", connection_type, column_names, s % 4 AS n_dashboards
        FROM nodes"""),
    "q_custom_sql_lists": """
        SELECT s_suppkey AS ordinal, 'db' || s_nationkey AS database, 'redshift' AS connection_type,
          kind, "schema", name, path FROM supplier, LATERAL (
            SELECT 'table' AS kind, 'ods' AS "schema", 't' || (s_suppkey % 9) AS name, NULL AS path
            UNION ALL SELECT 'table', 'dw', 'u' || (s_suppkey % 4), NULL
            UNION ALL SELECT 'column', NULL, 'c' || (s_suppkey % 5), NULL
            UNION ALL SELECT 'dashboard', NULL, 'Dash ' || (s_suppkey % 20), 'wb' || s_suppkey || '/v'
              WHERE s_suppkey % 3 > 0)""",
    "q_custom_sql_dashboards": """
        SELECT s_suppkey AS ordinal, 'db' || s_nationkey AS database, 'redshift' AS connection_type,
          kind, "schema", name, path, page_number
        FROM (SELECT *, (row_number() OVER (ORDER BY 'db' || s_nationkey, s_suppkey) - 1) // 50 AS page_number
              FROM supplier), LATERAL (
            SELECT 'table' AS kind, 'ods' AS "schema", 't' || (s_suppkey % 9) AS name, NULL AS path
            UNION ALL SELECT 'table', 'dw', 'u' || (s_suppkey % 4), NULL
            UNION ALL SELECT 'column', NULL, 'c' || (s_suppkey % 5), NULL
            UNION ALL SELECT 'dashboard', NULL, 'Dash ' || (s_suppkey % 20), 'wb' || s_suppkey || '/v'
              WHERE s_suppkey % 3 > 0)""",
    "q_bi_table_catalogue": """
        SELECT 'l' || p_partkey AS luid, 'i' || p_partkey AS id, p_name AS name, p_type AS "schema",
          '[' || p_type || '].[' || p_name || ']' AS full_name,
          CASE WHEN p_size % 2 = 0 THEN 'redshift' END AS connection_type
        FROM part""",
    "q_bi_database_catalogue": """
        SELECT 'l' || s_suppkey AS luid, 'i' || s_suppkey AS id, s_name AS name,
          CASE WHEN s_suppkey % 2 = 0 THEN 'redshift' END AS connection_type
        FROM supplier""",
    "q_workbook_fields": """
        SELECT 'wb' || c_custkey AS workbook, CASE c_custkey % 4 WHEN 0 THEN 'Finance' ELSE 'Retail' END AS project,
          'sheet' || c_nationkey AS sheet, field, '[wb' || c_custkey || '].[' || field || ']' AS qualified_field,
          CASE field WHEN 'f1' THEN 'EmbeddedDatasource' ELSE 'PublishedDatasource' END AS datasource_type,
          CASE field WHEN 'f1' THEN 'e' || c_nationkey ELSE 'p' || c_nationkey END AS datasource,
          CASE up WHEN 1 THEN 'p' || c_nationkey WHEN 2 THEN 'q' || (c_custkey % 8) END AS upstream_datasource
        FROM customer, (VALUES ('f1', 1), ('f1', 2), ('f2', 0)) f(field, up)
        WHERE c_custkey % 4 IN (0, 1)""",
    "q_published_datasources": """
        SELECT p_partkey AS ordinal, p_name AS datasource, 'sites/1/datasources/' || p_partkey AS uri,
          p_size % 2 = 0 AS has_extracts, kind, name, qualified_name
        FROM part, LATERAL (
          SELECT 'table' AS kind, '[ODS].[T' || p_size || ']' AS name, NULL AS qualified_name
          UNION ALL SELECT 'table', '[dw].[U' || (p_partkey % 9) || ']', NULL
          UNION ALL SELECT 'dashboard', 'Dash ' || p_size, NULL WHERE p_size % 3 > 0
          UNION ALL SELECT 'field', 'F', '[' || p_name || '].[F]')""",
    "q_embedded_datasources": """
        SELECT p_name AS datasource, 'Dash ' || p_size AS dashboard FROM part WHERE p_size % 3 > 0
        UNION ALL SELECT p_name, 'Dash ' || (p_partkey % 20) FROM part WHERE p_size % 3 = 2
        UNION ALL SELECT p_name, NULL FROM part WHERE p_size % 3 = 0""",
    "q_workbook_lineage": """
        SELECT 'w' || c_custkey AS workbook_id, c_name AS workbook, 'sites/1/workbooks/' || c_custkey AS uri,
          kind, upstream_id, upstream_name
        FROM customer, LATERAL (
          SELECT 'datasource' AS kind, 'ds' || c_nationkey AS upstream_id, 'p' || c_nationkey AS upstream_name
          UNION ALL SELECT 'database', 'db' || (c_custkey % 7), c_mktsegment
          UNION ALL SELECT 'table', 't' || (c_custkey % 90), 'orders' || (c_custkey % 90) WHERE c_custkey % 3 > 0
          UNION ALL SELECT 'table', 't' || (c_custkey % 11), 'orders' || (c_custkey % 11)
            WHERE c_custkey % 3 > 0)""",
    "q_datasource_clean": """
        SELECT lower(p_name) || '.f' AS fields,
          'ods.t' || p_size || ',dw.u' || (p_partkey % 9) AS "tables"
        FROM part WHERE p_size % 3 > 0""",
    "q_bi_connection_filter": _with(_DATABASE_TABLES, body="""
        SELECT table_id, connection_type FROM db_tables"""),
    "q_bi_clean": _with(_TABLE_NODES, body="""
        SELECT page, name AS table_name, 'ods' AS schema_name, 'ods.orders' || (k - k % 4) AS full_name,
          lower(column_names) AS column_names
        FROM nodes WHERE s % 7 NOT IN (0, 1) AND "schema" IS NOT NULL"""),
    "q_bi_quarantine": _with(_TABLE_NODES, body="""
        SELECT page, 'MissingSchemaOrFullName' AS reason FROM nodes
        WHERE s % 7 NOT IN (0, 1) AND "schema" IS NULL"""),
    "q_dashboards_by_table": _with(_EDGES, body="SELECT table_id, name, path FROM kept"),
    "q_dashboards_by_table_intended": _with(_EDGES, body="""
        SELECT table_id, name, path FROM nth WHERE n = 1"""),
    "q_bi_index": _with(_BI, body="SELECT pk, label, url FROM bi"),
    "q_bi_index_intended": _with(_BI_INTENDED, body="SELECT pk, label, url FROM bi"),
    "q_bi_index_of_nodes": _with(_TABLE_NODES, body=f"""
        , real AS (
          SELECT page, 'ods.orders' || (k - k % 4) AS pk FROM nodes
          WHERE s % 7 NOT IN (0, 1) AND "schema" IS NOT NULL AND s % 4 > 0),
        winners AS (SELECT pk, max(page) AS page FROM real GROUP BY pk),
        nth AS (SELECT *, row_number() OVER (PARTITION BY page, name ORDER BY pos) AS n FROM listed),
        cut AS (SELECT page, min(pos) FILTER (WHERE n = 2) AS cutoff FROM nth GROUP BY page)
        SELECT pk, name AS label, '{c.SERVER_URL}/#/views/' || path AS url
        FROM winners JOIN listed USING (page) JOIN cut USING (page)
        WHERE cutoff IS NULL OR pos < cutoff"""),
    "q_reference_index": _with(_INDEX, body="SELECT source, pk, label, url FROM idx"),
    "q_reference_index_intended": _with(_CODE_INTENDED, _BI_INTENDED, body="""
        SELECT DISTINCT 'github' AS source, pk, label, url FROM code
        UNION ALL SELECT 'tableau', pk, label, url FROM bi"""),
    # The variable file of supplier 7 sets schema.ods to ods7; a fourth of the SQL files spell ods out.
    "q_code_index_of_repo": _with(_CODE, body="""
        SELECT CASE pos WHEN 0 THEN replace(tab, 'ods.', 'ods7.') ELSE tab END AS pk, file AS label, url
        FROM sql_pairs
        UNION ALL SELECT replace(tab, 'ods.', 'ods7.'), file, url FROM yml_pairs
        UNION ALL SELECT replace(tab, 'ods.', 'ods7.'), file, url FROM step_pairs"""),
    "q_index_merge": _with(_CODE, _OLD, _BI, body="""
        SELECT 'github' AS source, pk, label, url FROM code
        UNION ALL SELECT 'github', pk, label, url FROM old_code
          WHERE pk NOT IN (SELECT pk FROM code)
        UNION ALL SELECT 'tableau', pk, label, url FROM bi"""),
    "q_index_store": _with(_CODE, _OLD, _BI, body="""
        SELECT 'github' AS source, pk, label, url FROM code
        UNION ALL SELECT 'github', pk, label, url FROM old_code
          WHERE pk NOT IN (SELECT pk FROM code)
        UNION ALL SELECT 'tableau', pk, label, url FROM bi"""),
    "q_index_store_partial": _with(_CODE, _OLD, body=f"""
        SELECT 'github' AS source, pk, label, url FROM code WHERE pk IN {c.PARTIAL_KEYS}
        UNION ALL SELECT 'github', pk, label, url FROM old_code
          WHERE pk NOT IN (SELECT pk FROM code WHERE pk IN {c.PARTIAL_KEYS})"""),
    "q_index_rejects": """
        SELECT CAST(NULL AS VARCHAR) AS pk, 'plain' || c_custkey AS label, CAST(c_custkey AS VARCHAR) AS url,
          'MissingKey' AS reason
        FROM customer WHERE c_custkey % 5 = 2""",
    "q_index_replace": _with(_CODE, _BI, body="""
        SELECT 'github' AS source, pk, label, url FROM code
        UNION ALL SELECT 'tableau', pk, label, url FROM bi"""),
    "q_index_keys": _with(_INDEX, body="""
        SELECT pk, has_dashboards, has_files, n_dashboards, n_files FROM keys"""),
    "q_issue_scan": f"SELECT issue_key, summary FROM {c.duck(c.ISSUES)}",
    "q_issue_refs": _with(_REFS, body="SELECT issue_key, pos, field FROM refs"),
    "q_issue_refs_intended": _with(_REFS, body="""
        SELECT issue_key, pos, replace(field, '_staging', '') AS field FROM refs"""),
    "q_impact_report_intended": _with(_CODE_INTENDED, _BI_INTENDED, """
        idx AS (
          SELECT DISTINCT 'files' AS section, pk, label, url FROM code
          UNION ALL SELECT 'dashboards', pk, label, url FROM bi)""", _REFS, body=f"""
        SELECT r.issue_key, r.pos, replace(r.field, '_staging', '') AS field,
          CASE WHEN i.pk IS NULL THEN 'confirmation' ELSE 'error' END AS status,
          i.section, i.label, i.url, CASE WHEN i.pk IS NULL THEN '{UNUSED_NOTE}' END AS note
        FROM refs r LEFT JOIN idx i ON replace(r.field, '_staging', '') = i.pk"""),
    "q_text_refs": f"""
        SELECT issue_key, generate_subscripts(found, 1) - 1 AS pos, unnest(found) AS field FROM (
          SELECT issue_key, regexp_extract_all(lower(txt), '{REFERENCE_PATTERN}', 0) AS found FROM (
            SELECT 'page ' || page_id AS issue_key, url AS txt FROM pages
            UNION ALL SELECT 'html ' || page_id, html FROM pages
            UNION ALL SELECT 'document ' || doc_id, text FROM documents
            UNION ALL SELECT 'turn ' || conv_id || '.' || turn, text FROM conversations))""",
    "q_text_refs_whole": f"""
        SELECT issue_key, generate_subscripts(found, 1) - 1 AS pos, unnest(found) AS field FROM (
          SELECT issue_key, regexp_extract_all(lower(txt), '{REFERENCE_PATTERN}', 0) AS found FROM (
            SELECT 'page ' || page_id AS issue_key, url AS txt FROM pages
            UNION ALL SELECT 'html ' || page_id, html FROM pages
            UNION ALL SELECT 'document ' || doc_id, text FROM documents
            UNION ALL SELECT 'turn ' || conv_id || '.' || turn, text FROM conversations))""",
    "q_issue_lookup": _with(_INDEX, _REFS, _LOOKUP, body="""
        SELECT issue_key, pos, field, pk, status, n_dashboards, n_files FROM looked"""),
    "q_mentioned_entries": _with(_INDEX, _REFS, body="""
        SELECT pk AS field, CASE source WHEN 'tableau' THEN 'dashboards' ELSE 'files' END AS section,
          label, url
        FROM idx WHERE pk IN (SELECT field FROM refs)"""),
    "q_impact_report": _with(_INDEX, _REFS, _LOOKUP, body=_REPORT),
    "q_report_in_order": _with(_INDEX, _REFS, _LOOKUP, body=_REPORT),
    "q_point_lookup": _with(_INDEX, body=f"""
        SELECT a.pos, a.field, source, label, url
        FROM (VALUES {", ".join(f"({i}, '{f}')" for i, f in enumerate(c.POINT_FIELDS))}) a(pos, field)
        LEFT JOIN idx ON pk = a.field"""),
    "q_issue_status": _with(_INDEX, _REFS, _LOOKUP, body="""
        SELECT 'IMP-' || c_custkey AS issue_key, count(field) AS refs, count(pk) AS used,
          coalesce(max(status), 'none') AS status
        FROM customer LEFT JOIN looked ON issue_key = 'IMP-' || c_custkey GROUP BY c_custkey"""),
    "q_unreferenced": _with(_INDEX, _REFS, body="""
        SELECT issue_key, pos, field FROM refs WHERE field NOT IN (SELECT pk FROM keys)"""),
    "q_lookup_param": _with(_REQUEST_REFS, body="SELECT request_id, pos, field FROM request_refs"),
    "q_lookup_rejects": f"""
        SELECT c_custkey AS request_id, CASE WHEN c_custkey % 7 IN (3, 4) THEN 400 ELSE 500 END AS status_code,
          CASE WHEN c_custkey % 7 IN (3, 4) THEN '{MISSING_PARAMETER.replace("'", "''")}'
            ELSE '{FAILED_REQUEST}' END AS message
        FROM customer WHERE c_custkey % 7 >= 3""",
    "q_answer_requests": _with(_INDEX, _REQUEST_REFS, body="""
        SELECT request_id, pos, field, pk, CASE WHEN pk IS NULL THEN 'confirmation' ELSE 'error' END AS status,
          coalesce(n_dashboards, 0) AS n_dashboards, coalesce(n_files, 0) AS n_files
        FROM request_refs LEFT JOIN keys ON field = pk"""),
    "q_index_records": _with(_INDEX, body="""
        SELECT pk, 0 AS part,
          string_agg(label || '=' || url, '|' ORDER BY label) FILTER (WHERE source = 'github') AS files,
          string_agg(label || '=' || url, '|' ORDER BY label) FILTER (WHERE source = 'tableau') AS dashboards
        FROM idx GROUP BY pk"""),
    "q_index_records_split": _with(_INDEX, body=f"""
        SELECT source, pk, label, url,
          CAST(ceil(count(*) OVER (PARTITION BY pk) / {c.ENTRIES_PER_PART}.0) AS BIGINT) AS parts
        FROM idx"""),
    "q_impact_stream": _with(_INDEX, _REFS, _LOOKUP, body=_REPORT),
    "q_impact_stream_batches": _with(_INDEX, _REFS, _LOOKUP, body=_REPORT),
}


# Columns that are 64-bit integers in Spark, whatever DuckDB makes of small constants.
_BIG = {
    "pos": ["q_split_statements", "q_insert_statements", "q_table_refs", "q_table_refs_dialects", "q_yml_steps",
            "q_tables_per_file", "q_issue_refs", "q_issue_refs_intended",
            "q_impact_report_intended", "q_text_refs", "q_text_refs_whole", "q_issue_lookup",
            "q_impact_report", "q_report_in_order", "q_point_lookup", "q_impact_stream", "q_impact_stream_batches", "q_unreferenced",
            "q_lookup_param", "q_answer_requests"],
    "ref_pos": ["q_table_refs", "q_table_refs_dialects"], "n_dashboards": ["q_bi_table_scan"], "part": ["q_index_records"],
    "status_code": ["q_lookup_rejects"],
}


def oracle_sql() -> dict[str, str]:
    out = dict(_ORACLE)
    for column, names in _BIG.items():
        for name in names:
            out[name] = (
                f"SELECT * REPLACE (CAST({column} AS BIGINT) AS {column}) FROM ({out[name]})"
            )
    return out
