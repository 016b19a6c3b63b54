"""Line rules: linting and variable substitution."""

import pytest
from pyspark.sql import functions as F

from ripplemap.functions import names, text


def value(spark, given, make):
    df = spark.createDataFrame([(given,)], "x string").repartition(1)
    return df.select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize("given, lines", [
    ("a\nb\n", ["a\n", "b\n"]), ("a\nb", ["a\n", "b"]), ("", []), ("\n\n", ["\n", "\n"]),
    ("a\r\nb", ["a\r\n", "b"]),
])
def test_lines_keep_their_ends(spark, given, lines):
    assert value(spark, given, text.lines_of) == lines
    assert value(spark, given, text.line_count) == len(lines)


@pytest.mark.parametrize("given, expected", [
    ("1\n2\n3\n4\n", "1\n"), ("1\n2\n3\n4", "1\n"), ("1\n2\n3\n", ""), ("1", ""), ("", ""),
    ("a\nb % c\nd\n1\n2\n3\n", "a\nd\n"), ("%\n%\n1\n2\n3\n", ""),
])
def test_lint_drops_three_last_and_percent_lines(spark, given, expected):
    assert value(spark, given, text.lint_yml) == expected


def test_lint_intended_keeps_everything_but_quotes_breaking_values(spark):
    given = "%YAML 1.1\na: %Y it's\nb: x LIKE 'c%'\n- %d\nlast: 1\n"
    expected = "a: '%Y it''s'\nb: x LIKE 'c%'\n- '%d'\nlast: 1\n"
    assert value(spark, given, lambda c: text.lint_yml(c, "intended")) == expected


VARS = {"schema.ods": "ods", "root": "r"}


@pytest.mark.parametrize("given, expected", [
    ("from {{ schema.ods }}.t", "from ods.t"),
    ("from {{ x y }}.t", "from xy.t"),
    ("a\n{{ depends_on }} z\nb", "a\nb"),
    ("{{ root }} {{ schema.ods }}", "r {{ schema.ods }}"),
    ("{{root}}{{root}}", "rr"),
    ("{{root}} {{ root }}", "r {{ root }}"),
    ("{{}} q", " q"),
    ("a }} {{ x }} }}", "a  x "),
    ("{{\troot }}!", "r!"),
    ("open {{ root", "open {{ root"),
    ("open {{ other", "open other"),
    ("x {{ a {{ root }}", "x a root "),
    ("no variable\n", "no variable\n"),
    ("", ""),
])
def test_first_variable_of_a_line(spark, given, expected):
    assert value(spark, given, lambda c: text.substitute(c, VARS)) == expected


def test_substitution_of_null_and_of_special_values(spark):
    assert value(spark, None, lambda c: text.substitute(c, VARS)) is None
    odd = {"a.b": r"$1\x", "aXb": "no"}
    assert value(spark, "{{ a.b }}", lambda c: text.substitute(c, odd)) == r"$1\x"
    assert value(spark, "{{ a.b }}", lambda c: text.substitute(c, odd, "intended")) == r"$1\x"


def test_intended_mode_replaces_every_variable(spark):
    given = "{{ root }} {{ schema.ods }} {{root}}\n{{ depends }}\n"
    assert value(spark, given, lambda c: text.substitute(c, VARS, "intended")) == "r ods r\n"


@pytest.mark.parametrize("name, parity, intended", [
    ("a.sql", "sql", "sql"), (".sql", "sql", "sql"), ("a.sql.yml", "sql", "yml"),
    ("a.b.sql", None, "sql"), ("x.SQL", None, None), ("x", None, None), ("a.yml", "yml", "yml"),
    ("a.yml.sql", "yml", "sql"), ("a.sql.txt", None, None), ("sql", None, None),
])
def test_file_kind(spark, name, parity, intended):
    assert value(spark, name, names.file_kind) == parity
    assert value(spark, name, lambda c: names.file_kind(c, "intended")) == intended


@pytest.mark.parametrize("raw, parity, intended", [
    ("ODS.a_tmp_template", "ods.alate", "ods.a_tmp_template"),
    ("x.y_TMP", "x.y_tmp", "x.y"), ("x.y_staging", "x.y", "x.y"),
    ("x._t_tmpemp", "x._temp".replace("_temp", ""), "x._t_tmpemp"),
])
def test_normalised_names(spark, raw, parity, intended):
    assert value(spark, raw, names.normalise_table) == parity
    assert value(spark, raw, lambda c: names.normalise_table(c, "intended")) == intended


def test_qualified_tables_keep_first_appearance(spark):
    df = spark.createDataFrame([(["b.X_tmp", "plain", "a.y", "B.x"],)], "t array<string>")
    assert df.select(names.qualified_tables(F.col("t"))).first()[0] == ["b.x", "a.y"]


def test_small_names(spark):
    assert value(spark, "[Db].[T]", names.strip_brackets) == "Db.T"
    assert value(spark, "a-b-c", names.step_key) == "a_b_c"
    assert value(spark, "w/v", lambda c: names.dashboard_url("https://s", c)) == "https://s/#/views/w/v"
    assert value(spark, "a.sql.x", names.has_sql_extension) is True
    assert value(spark, "plain", names.has_sql_extension) is False
