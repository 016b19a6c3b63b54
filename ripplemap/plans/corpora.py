"""Inputs that Spark derives from the test tables.

The shared texts are SQL that Spark and DuckDB both run; ``{{`` and ``}}`` in them are
escapes of single braces. Each input has one row per row of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES = {"schema.ods": "ods"}
TEMPLATE_VARIABLES = {"schema.ods": "ods", "root": "r"}
SERVER_URL = "https://bi.example.com"
MAIN = "https://git.example.com/r/blob/main/"
VARIABLE_PATH = "pipelines/settings7.yml"
POINT_FIELDS = ("ods.orders4", "src.cust40", "raw.pay30", "no.such", "raw.pay30")
POINT_PARAM = POINT_FIELDS[0] + "%2C" + ",".join(POINT_FIELDS[1:])
PROJECTS = ("Finance", "Retail")
#: So few entries to a record that hot keys have many parts at any size of the tables.
ENTRIES_PER_PART = 100
PARTIAL_KEYS = ("ods.orders4", "src.cust40")

# Names grow in number with the tables; a third of all scripts write ods.orders0.
REPO_FILES = """
SELECT o_orderkey AS ordinal, path, 'https://git.example.com/r/blob/main/' || path AS url, content
FROM (SELECT o_orderkey,
  'etl/d' || cast(o_custkey % 13 AS string) || '/job' || cast(o_orderkey - o_orderkey % 20 AS string) ||
    CASE o_orderkey % 6 WHEN 0 THEN '.yml' WHEN 1 THEN '.b.sql' WHEN 2 THEN '.sql.yml'
      ELSE '.sql' END AS path,
  'INSERT INTO {{{{ schema.ods }}}}.orders' || cast(CASE o_custkey % 3 WHEN 0 THEN 0 ELSE o_custkey END AS string) || '_tmp' || chr(10) ||
  'SELECT * FROM src.cust' || cast(o_custkey - o_custkey % 40 AS string) || ' c JOIN Raw.Pay' ||
    cast(o_orderkey - o_orderkey % 30 AS string) || ' p ON c.k = p.k -- FROM no.comment' || chr(10) ||
  '; SELECT * FROM sel.only;' ||
  CASE WHEN o_orderkey % 4 = 0 THEN chr(10) || 'insert into dw.fact' ||
    cast(o_orderkey - o_orderkey % 20 AS string) || '_staging select * from ods.orders' ||
    cast(CASE o_custkey % 3 WHEN 0 THEN 0 ELSE o_custkey END AS string) ELSE '' END AS content
  FROM {orders}) q
"""

YML_FILES = """
SELECT p_partkey AS ordinal, 'pipelines/p' || cast(p_partkey AS string) || '.yml' AS path,
  'https://git.example.com/r/blob/main/pipelines/p' || cast(p_partkey AS string) || '.yml' AS url,
  'frequency: daily' || chr(10) || 'load_time: %Y' || chr(10) || 'steps:' || chr(10) ||
  '- step_type: ' || CASE WHEN p_partkey % 5 = 0 THEN 'extract-s3' ELSE 'sql-command' END || chr(10) ||
  '  name: load-' || cast(p_size AS string) || chr(10) ||
  '  command: INSERT INTO {{{{ schema.ods }}}}.parts' || cast(p_partkey % 25 AS string) ||
    '_temp SELECT * FROM src.part' || cast(p_size % 9 AS string) || chr(10) ||
  'x: 1' || chr(10) || 'y: 2' || chr(10) || 'z: 3' || chr(10) AS content
FROM {part}
"""

# The same definitions in folders and under names that begin with a dot or an underscore, too.
HIDDEN_FILES = """
SELECT p_partkey AS ordinal, 'pipelines/' || CASE p_partkey % 3 WHEN 0 THEN '.d' ELSE 'd' END ||
  cast(p_partkey % 11 AS string) || '/' || CASE p_partkey % 5 WHEN 0 THEN '.p' WHEN 1 THEN '_p' ELSE 'p' END ||
  cast(p_partkey AS string) || '.yml' AS path FROM {part}
"""

# Names in brackets, with blanks around dots, and behind an unusual join word.
DIALECT_FILES = """
SELECT c_custkey AS ordinal, 'sql/q' || cast(c_custkey AS string) || '.sql' AS path,
  'https://git.example.com/r/blob/main/sql/q' || cast(c_custkey AS string) || '.sql' AS url,
  CASE c_custkey % 4
    WHEN 0 THEN 'INSERT INTO [ods].[t' || cast(c_custkey AS string) || '] SELECT a[1] FROM [src].[n' ||
      cast(c_nationkey AS string) || '] x'
    WHEN 1 THEN 'INSERT INTO ods . t' || cast(c_custkey AS string) || ' SELECT 1. FROM src .n' ||
      cast(c_nationkey AS string) || ' x'
    WHEN 2 THEN 'INSERT INTO ods.t' || cast(c_custkey AS string) || ' SELECT STRAIGHT_JOIN x.k FROM src.n' ||
      cast(c_nationkey AS string) || ' x'
    ELSE 'INSERT INTO `ods` . [t' || cast(c_custkey AS string) || '] SELECT x . k FROM [src].n' ||
      cast(c_nationkey AS string) || ' x' END ||
  ' STRAIGHT_JOIN dw . [s ' || cast(c_custkey % 9 AS string) || '] y ON x . k = [y].[k];' AS content
FROM {customer}
"""

# Several steps per file: a repeated name, an empty command, another type, two
# INSERTs in one command; one file in five is broken in one of three ways.
STEP_FILES = """
SELECT s_suppkey AS ordinal, 'flows/s' || cast(s_suppkey AS string) || '.yml' AS path,
  'https://git.example.com/r/blob/main/flows/s' || cast(s_suppkey AS string) || '.yml' AS url,
  CASE s_suppkey % 15 WHEN 4 THEN 'stage' WHEN 9 THEN 'key: [1, 2' WHEN 14 THEN 'note: x'
    ELSE 'note: y' END || chr(10) ||
  CASE WHEN s_suppkey % 15 = 14 THEN 'tasks:' ELSE 'steps:' END || chr(10) ||
  '- step_type: sql-command' || chr(10) || '  name: b-load' || chr(10) ||
  '  command: INSERT INTO old.t SELECT * FROM old.u' || chr(10) ||
  '- step_type: sql-command' || chr(10) || '  name: a-clean' || chr(10) ||
  '  command: "INSERT INTO first.one SELECT 1; INSERT INTO dw.n' ||
    cast(s_nationkey AS string) || ' SELECT * FROM {{{{schema.ods}}}}.s' ||
    cast(s_suppkey % 7 AS string) || '_tmp"' || chr(10) ||
  '- step_type: sql-command' || chr(10) || '  name: empty' || chr(10) || '  command: ""' || chr(10) ||
  '- step_type: shell' || chr(10) || '  name: c' || chr(10) ||
  '  command: INSERT INTO shell.t SELECT 1' || chr(10) ||
  '- step_type: sql-command' || chr(10) || '  name: b-load' || chr(10) ||
  '  command: INSERT INTO new.t' || cast(s_suppkey % 7 AS string) ||
    ' SELECT * FROM dw.n' || cast(s_nationkey AS string) || chr(10) ||
  'x: 1' || chr(10) || 'y: 2' || chr(10) || 'z: 3' || chr(10) AS content
FROM {supplier}
"""

VARIABLE_FILES = """
SELECT s_suppkey AS ordinal, 'pipelines/settings' || cast(s_suppkey AS string) || '.yml' AS path,
  'https://git.example.com/r/blob/main/pipelines/settings' || cast(s_suppkey AS string) || '.yml' AS url,
  'root:' || chr(10) || '  bucket: b' || cast(s_nationkey AS string) || chr(10) ||
  '  schema:' || chr(10) || '    ods: ods' || cast(s_suppkey AS string) || chr(10) ||
  '    deep:' || chr(10) || '      x: true' || chr(10) || '      y:' || chr(10) ||
  '  shared: from_root' || chr(10) ||
  'default_schema_names:' || chr(10) || '  shared: from_defaults' || chr(10) ||
  '  rate: 50%' || chr(10) || '  raw: raw' || cast(s_suppkey % 3 AS string) || chr(10) ||
  '  lost1: 1' || chr(10) || '  lost2: 2' || chr(10) || '  lost3: 3' || chr(10) AS content
FROM {supplier}
"""

TEMPLATE_FILES = """
SELECT c_custkey AS ordinal, 'sql/t' || cast(c_custkey AS string) || '.sql' AS path,
  'https://git.example.com/r/blob/main/sql/t' || cast(c_custkey AS string) || '.sql' AS url,
  'from {{{{ schema.ods }}}}.t' || cast(c_custkey AS string) || chr(10) ||
  CASE c_custkey % 6
    WHEN 0 THEN '{{{{ depends_on }}}} z'
    WHEN 1 THEN 'from {{{{ x y }}}}.t'
    WHEN 2 THEN '{{{{ root }}}} {{{{ schema.ods }}}}'
    WHEN 3 THEN '{{{{}}}} q'
    WHEN 4 THEN 'a }}}} {{{{ x }}}} }}}}'
    ELSE '{{{{root}}}}{{{{root}}}} no end {{{{' END || chr(10) || 'where {{{{ open' AS content
FROM {customer}
"""

BI_TABLES = """
SELECT p_partkey AS ordinal, p_partkey AS table_id,
  'Orders' || cast(p_partkey - p_partkey % 4 AS string) AS name,
  '[ODS].[Orders' || cast(p_partkey - p_partkey % 4 AS string) || ']' AS `fullName`,
  CASE WHEN p_partkey % 3 = 0 THEN 'ods' WHEN p_partkey % 3 = 1 THEN 'ODS' ELSE 'dbo' END AS `schema`,
  CASE p_size % 7 WHEN 0 THEN 'hyper' WHEN 1 THEN 'textscan' WHEN 2 THEN NULL
    WHEN 3 THEN 'google-sheets' ELSE 'redshift' END AS `connectionType`
FROM {part}
"""

ISSUES = """
SELECT 'IMP-' || cast(c_custkey AS string) AS issue_key,
  CASE c_custkey % 6
    WHEN 0 THEN 'Combine address1 and address2 fields in ODS.Orders' || cast(c_custkey + 1 AS string)
    WHEN 1 THEN 'Fix src.cust' || cast(c_custkey - c_custkey % 40 AS string) || ' and raw.pay' ||
      cast(c_custkey - c_custkey % 15 AS string)
    WHEN 2 THEN 'Refresh dashboard'
    WHEN 3 THEN 'Drop dw.fact' || cast(c_custkey - c_custkey % 10 AS string) || ', dw.fact' ||
      cast(c_custkey - c_custkey % 10 AS string)
    WHEN 4 THEN 'Check order_status of ods.orders_staging'
    ELSE '' END AS summary
FROM {customer}
"""

RAW_NAMES = """
SELECT c_custkey AS id, CASE c_custkey % 5
    WHEN 0 THEN 'ODS.a' || cast(c_custkey AS string) || '_tmp_template'
    WHEN 1 THEN 'x.y' || cast(c_custkey AS string) || '_TMP'
    WHEN 2 THEN 'plain' || cast(c_custkey AS string)
    WHEN 3 THEN 'Dw.T' || cast(c_custkey AS string) || '_staging'
    ELSE 'c.S_temp.u' || cast(c_custkey AS string) END AS raw
FROM {customer}
"""

REQUESTS = """
SELECT c_custkey AS request_id, CASE c_custkey % 7
    WHEN 0 THEN 'ods.orders' || cast(c_custkey + 1 AS string) || '%2Csrc.cust' ||
      cast(c_custkey - c_custkey % 40 AS string)
    WHEN 1 THEN 'raw.pay' || cast(c_custkey - c_custkey % 15 AS string)
    WHEN 2 THEN 'a+b.c,dw.fact' || cast(c_custkey - c_custkey % 10 AS string)
    WHEN 3 THEN ''
    WHEN 4 THEN NULL
    WHEN 5 THEN CASE c_custkey % 2 WHEN 0 THEN 'bad%zz.' ELSE 'bad%FF.' END || cast(c_custkey AS string)
    ELSE 'x.y,,z.w' END AS param
FROM {customer}
"""

# An earlier run's code attribute: other keys and addresses than today's, some shared.
OLD_CODE = """
SELECT DISTINCT 'ods.orders' || cast(o_custkey - o_custkey % 2 AS string) AS pk,
  'job' || cast(o_orderkey - o_orderkey % 20 AS string) || '.sql' AS label,
  'https://git.example.com/r/blob/old/job' || cast(o_orderkey - o_orderkey % 20 AS string) || '.sql' AS url
FROM {orders}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# What the text of a file is made of; spread while rows are still narrow.
_TEXT_KEYS = {"orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey",
              "customer": "c_custkey"}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A test table, one file each, dealt to as many tasks as there are slots."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run one of the texts above on the table it names."""
    name = text[text.rindex("FROM {") + 6:].split("}")[0]
    rows = spread(table(spark, sf_dir, name), _TEXT_KEYS[name])
    return spark.sql(text, **{name: rows})


def duck(text: str) -> str:
    """The same text for DuckDB, as a sub-select."""
    name = text[text.rindex("FROM {") + 6:].split("}")[0]
    return "(" + text.format(**{name: name}).replace("`", '"') + ")"


def bi_dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed dashboards; ``pos`` is the tuple that orders them within their table."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("table_id"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("pos"),
        F.concat(F.lit("Dash "), (F.col("l_suppkey") % 20).cast("string")).alias("name"),
        F.concat(F.lit("wb"), F.col("l_suppkey").cast("string"), F.lit("/v")).alias("path"),
    )


# BI responses as JSON text, one page per table row -----------------------------------

_TABLE_PAGES = """
SELECT p_partkey AS page, to_json(named_struct('data', named_struct('databaseTables', array(
  named_struct('name', 'Orders' || (p_partkey - p_partkey % 4),
    'fullName', '[ODS].[Orders' || (p_partkey - p_partkey % 4) || ']',
    'schema', CASE p_partkey % 4 WHEN 0 THEN 'ods' WHEN 1 THEN 'ODS' WHEN 2 THEN 'dbo' END,
    'connectionType', CASE p_size % 7 WHEN 0 THEN 'hyper' WHEN 1 THEN 'textscan' WHEN 2 THEN NULL
      ELSE 'redshift' END,
    'columns', CASE WHEN p_size % 5 > 0 THEN array(named_struct('name', 'Id'),
      named_struct('name', 'Amount' || p_size)) END,
    'downstreamDashboards', slice(array(
      named_struct('name', 'Dash ' || p_size % 6, 'path', 'wb' || p_partkey || '/a'),
      named_struct('name', 'Dash ' || p_size % 4, 'path', 'wb' || p_partkey || '/b'),
      named_struct('name', 'Dash ' || p_size % 3, 'path', 'wb' || p_partkey || '/c')),
      1, p_size % 4)))))) AS response
FROM {part}
"""

_CUSTOM_SQL_PAGES = """
SELECT s_suppkey AS page, to_json(named_struct('data', named_struct('customSQLTablesConnection',
  named_struct('nodes', array(named_struct(
    'database', named_struct('name', 'db' || s_nationkey, 'connectionType', 'redshift'),
    'tables', array(named_struct('name', 't' || s_suppkey % 9, 'schema', 'ods'),
      named_struct('name', 'u' || s_suppkey % 4, 'schema', 'dw')),
    'columns', array(named_struct('name', 'c' || s_suppkey % 5)),
    'downstreamDashboards', CASE WHEN s_suppkey % 3 > 0 THEN array(named_struct('__typename',
      'Dashboard', 'name', 'Dash ' || s_suppkey % 20, 'path', 'wb' || s_suppkey || '/v')) END
  )))))) AS response
FROM {supplier}
"""

_DATABASE_TABLE_PAGES = """
SELECT p_partkey AS page, to_json(named_struct('data', named_struct('databaseTables', array(
  named_struct('luid', 'l' || p_partkey, 'id', 'i' || p_partkey, 'name', p_name,
    'schema', p_type, 'fullName', '[' || p_type || '].[' || p_name || ']',
    'connectionType', CASE WHEN p_size % 2 = 0 THEN 'redshift' END))))) AS response
FROM {part}
"""

_DATABASE_PAGES = """
SELECT s_suppkey AS page, to_json(named_struct('data', named_struct('databases', array(
  named_struct('luid', 'l' || s_suppkey, 'id', 'i' || s_suppkey, 'name', s_name,
    'connectionType', CASE WHEN s_suppkey % 2 = 0 THEN 'redshift' END))))) AS response
FROM {supplier}
"""

_WORKBOOK_FIELD_PAGES = """
SELECT c_custkey AS page, to_json(named_struct('data', named_struct('workbooks', array(named_struct(
  '__typename', 'Workbook', 'name', 'wb' || c_custkey,
  'projectName', CASE c_custkey % 4 WHEN 0 THEN 'Finance' WHEN 1 THEN 'Retail' WHEN 2 THEN 'Archive' END,
  'sheets', array(named_struct('__typename', 'Sheet', 'name', 'sheet' || c_nationkey,
    'sheetFieldInstances', array(
      named_struct('__typename', 'Field', 'name', 'f1', 'fullyQualifiedName', '[wb' || c_custkey || '].[f1]',
        'datasource', named_struct('__typename', 'EmbeddedDatasource', 'name', 'e' || c_nationkey,
          'upstreamDatasources', array(
            named_struct('__typename', 'PublishedDatasource', 'name', 'p' || c_nationkey),
            named_struct('__typename', 'PublishedDatasource', 'name', 'q' || c_custkey % 8)))),
      named_struct('__typename', 'Field', 'name', 'f2', 'fullyQualifiedName', '[wb' || c_custkey || '].[f2]',
        'datasource', named_struct('__typename', 'PublishedDatasource', 'name', 'p' || c_nationkey,
          'upstreamDatasources', NULL)))))))))) AS response
FROM {customer}
"""

_PUBLISHED_PAGES = """
SELECT p_partkey AS page, to_json(named_struct('data', named_struct('publishedDatasources', array(
  named_struct('name', p_name, 'uri', 'sites/1/datasources/' || p_partkey, 'hasExtracts', p_size % 2 = 0,
    'upstreamTables', array(named_struct('fullName', '[ODS].[T' || p_size || ']'),
      named_struct('fullName', '[dw].[U' || p_partkey % 9 || ']')),
    'downstreamDashboards', CASE WHEN p_size % 3 > 0 THEN array(named_struct('name', 'Dash ' || p_size)) END,
    'fields', array(named_struct('name', 'F', 'fullyQualifiedName', '[' || p_name || '].[F]'))
  ))))) AS response
FROM {part}
"""

_EMBEDDED_PAGES = """
SELECT p_partkey AS page, to_json(named_struct('data', named_struct('embeddedDatasources', array(
  named_struct('name', p_name, 'downstreamDashboards', slice(array(
    named_struct('name', 'Dash ' || p_size), named_struct('name', 'Dash ' || p_partkey % 20)),
    1, p_size % 3)))))) AS response
FROM {part}
"""

_WORKBOOK_PAGES = """
SELECT c_custkey AS page, to_json(named_struct('data', named_struct('workbooks', array(named_struct(
  'id', 'w' || c_custkey, 'luid', 'l' || c_custkey, 'name', c_name, 'uri', 'sites/1/workbooks/' || c_custkey,
  'upstreamDatasources', array(named_struct('id', 'ds' || c_nationkey, 'luid', 'x', 'name', 'p' || c_nationkey)),
  'upstreamDatabases', array(named_struct('id', 'db' || c_custkey % 7, 'luid', 'x', 'name', c_mktsegment,
    'connectionType', 'redshift')),
  'upstreamTables', CASE WHEN c_custkey % 3 > 0 THEN array(
    named_struct('id', 't' || c_custkey % 90, 'luid', 'x', 'name', 'orders' || c_custkey % 90),
    named_struct('id', 't' || c_custkey % 11, 'luid', 'x', 'name', 'orders' || c_custkey % 11)) END
  ))))) AS response
FROM {customer}
"""

_TICKETS = """
SELECT to_json(named_struct('key', issue_key, 'fields', named_struct('summary', summary))) AS ticket
FROM {issues}
"""

PAGES = {
    "tables_to_dashboards": _TABLE_PAGES,
    "custom_sql": _CUSTOM_SQL_PAGES,
    "database_tables": _DATABASE_TABLE_PAGES,
    "databases": _DATABASE_PAGES,
    "workbook_fields": _WORKBOOK_FIELD_PAGES,
    "published_datasources": _PUBLISHED_PAGES,
    "embedded_datasources": _EMBEDDED_PAGES,
    "workbooks": _WORKBOOK_PAGES,
}


def bi_pages(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(page, response): metadata responses as JSON text."""
    return derive(spark, sf_dir, PAGES[kind])


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticket): ticket documents as JSON text."""
    return spark.sql(_TICKETS, issues=derive(spark, sf_dir, ISSUES))
