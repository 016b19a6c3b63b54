"""Files, variable files and pipeline definitions."""

import pytest
from pyspark.sql import functions as F

from ripplemap.functions import yaml_udf
from ripplemap.operators import code, files
from ripplemap.plans import jobs
from ripplemap.sources import folder, repo
from tests.conftest import rows


def snapshot(spark, *entries):
    """Files from (path, content), in walk order."""
    table = spark.createDataFrame(
        [(i, path, f"u/{i}", content) for i, (path, content) in enumerate(entries)],
        "ordinal long, path string, url string, content string",
    )
    return repo.from_table(table)


def test_last_file_of_a_base_name_wins_even_without_tables(spark):
    corpus = snapshot(
        spark,
        ("a/x.sql", "insert into a.b select * from c.d"),
        ("b/x.sql", "select 1"),
        ("a/y.sql", "insert into a.b select 1"),
        ("b/y.sql", "insert into e.f_tmp select * from E.F"),
    )
    assert rows(jobs.code_index(corpus, {})) == [("e.f", "y.sql", "u/3")]
    intended = rows(jobs.code_index(corpus, {}, "intended"), "pk", "label")
    assert intended == [("a.b", "a/x.sql"), ("a.b", "a/y.sql"), ("c.d", "a/x.sql"), ("e.f", "b/y.sql")]


def test_file_without_url_keeps_a_null_address(spark):
    corpus = snapshot(spark, ("x.sql", "insert into a.b select 1")).withColumn(
        "url", F.lit(None).cast("string"))
    assert rows(jobs.code_index(corpus, {})) == [("a.b", "x.sql", None)]


ENV = """root:
  bucket: b
  empty:
  schema:
    ods: ods
    flags: {up: true, deep: {x: 1}}
  schema.ods: flat
default_schema_names:
  bucket: other
  part: 5%
  n: 7
  l1: 1
  l2: 2
  l3: 3
"""


def test_env_vars(spark):
    corpus = snapshot(spark, ("v.yml", ENV), ("v.yml", "root: {a: 1}\n"), ("w.yml", "x"))
    assert rows(files.env_vars(corpus, "v.yml"), "key", "value") == [
        ("bucket", "other"), ("empty", "None"), ("n", "7"),
        ("schema.flags.deep", "{'x': 1}"), ("schema.flags.up", "True"), ("schema.ods", "flat"),
    ]
    assert files.collect_vars(files.env_vars(corpus, "none.yml")) == {"env_vars": "none"}
    with pytest.raises(ValueError):
        files.collect_vars(files.env_vars(corpus, "w.yml"))


def plain_flatten(document):
    """Dictionaries only: the same rules without rows."""
    level = {**document["root"]}
    level.update(document["default_schema_names"])
    final = {}
    for depth in (1, 2, 3):
        deeper = {}
        for key, value in level.items():
            if isinstance(value, dict) and depth < 3:
                deeper.update((f"{key}.{k}", v) for k, v in value.items())
            elif isinstance(key, str):
                final[key] = str(value)
        level = {k: v for k, v in deeper.items() if k not in final}
    return final


CLASHES = [
    "root: {a: {b.c: 1, b: {c: 2}}, d: {}, e.f: 3, e: {f: {g: 4}, h: {i: {}}}, 5: x}\ndefault_schema_names: {}",
    "root: {a: {b: {c: 1}}, a.b: {c: 2, d: 3}, z: {y: 1}}\ndefault_schema_names: {z: plain, a: {b: {e: 5}}}",
    "root: {x.y: 1, x: {y: {z: 2}, w: null}}\ndefault_schema_names: {q: [1, 2], r: {s: true, t: 1.50, u: 2020-01-02}}",
    "root: {a.b.c: top, a: {b.c: middle, b: {c: deep}}}\ndefault_schema_names: {a.b: {c: two, d: {e: {f: 1}}}}",
    "root: {é: 'it''s \"q\"', 'sp ace': {'k.': v}}\ndefault_schema_names: {}",
]


def test_flattening_depths_and_clashes(spark):
    corpus = snapshot(spark, *((f"v{i}.yml", t + "\n1:\n2:\n3:\n") for i, t in enumerate(CLASHES)))
    found = {}
    for r in files.flatten_variables(corpus).collect():
        assert r["error"] is None
        found.setdefault(r["path"], {})[r["key"]] = r["value"]
    assert found == {f"v{i}.yml": plain_flatten(yaml_udf.yaml.safe_load(t)) for i, t in enumerate(CLASHES)}
    assert found["v0.yml"] == {"a.b.c": "1", "e.f": "3", "e.h.i": "{}"}


def test_unreadable_variable_files_are_one_row_each(spark):
    tail = "\n1:\n2:\n3:\n"
    corpus = snapshot(spark, ("a.yml", "root: [1" + tail), ("b.yml", "root: {a: 1}" + tail),
                      ("c.yml", "root: {a: {5: 1}}\ndefault_schema_names: {}" + tail), ("d.yml", "root: {}\ndefault_schema_names: {}" + tail),
                      ("e.yml", "root: {k: v}\ndefault_schema_names: {}" + tail))
    found = rows(files.flatten_variables(corpus), "path", "key", "value", "error")
    assert [(r[0], r[1]) for r in found] == [("a.yml", None), ("b.yml", None), ("c.yml", None), ("e.yml", "k")]
    assert [r[3] for r in found] == ["ParserError", "KeyError", "TypeError", None]


def test_a_variable_file_of_very_many_keys(spark):
    body = "".join(f"  k{i}: {{a: v{i}, b: {{c: w{i}}}}}\n" for i in range(50_000))
    corpus = snapshot(spark, ("big.yml", "root:\n" + body + "default_schema_names: {k7: flat}\n1:\n2:\n3:\n"))
    flat = files.flatten_variables(corpus)
    assert flat.count() == 2 * 49_999 + 1
    assert rows(flat.filter("key LIKE 'k7' OR key LIKE 'k8.%'"), "key", "value") == [
        ("k7", "flat"), ("k8.a", "v8"), ("k8.b.c", "w8")]


def test_repo_with_its_own_variables(spark):
    corpus = snapshot(
        spark,
        ("cfg.yml", "root:\n  s: ods\ndefault_schema_names: {}\n1:\n2:\n3:\n"),
        ("x.sql", "insert into {{ s }}.t select 1"),
        ("y.yml", "steps:\n- step_type: sql-command\n  name: n\n  command: insert into {{s}}.u select 1\n1:\n2:\n3:\n"),
    )
    assert rows(jobs.code_index_of_repo(corpus, "cfg.yml"), "pk", "label") == [
        ("ods.t", "x.sql"), ("ods.u", "y.yml")]


HEAD = "steps:\n- step_type: sql-command\n"
TAIL = "1:\n2:\n3:\n"


@pytest.mark.parametrize("content, reason", [
    (HEAD + "  name: a\n  command: insert into a.b select 1\n" + TAIL, None),
    (HEAD + "  name: [\n  command: x\n" + TAIL, "ParserError"),
    (HEAD + "  command: insert into a.b select 1\n" + TAIL, "UnusableStep"),
    (HEAD + "  name: a\n  command: [x]\n" + TAIL, "UnusableStep"),
    ("tasks:\n- step_type: sql-command\n" + TAIL, "NoStepsSection"),
    (HEAD, "TypeError"),
    ("a: 1\nsteps:\n" + TAIL + "- step_type: sql-command\n", "TypeError"),
])
def test_quarantine(spark, content, reason):
    corpus = files.classify_files(snapshot(spark, ("f.yml", content)))
    got = rows(code.yml_quarantine(corpus, {}), "path", "reason")
    assert got == ([("f.yml", reason)] if reason else [])


def test_gate_lets_only_marked_definitions_through(spark):
    corpus = files.classify_files(snapshot(
        spark, ("a.yml", HEAD), ("b.yml", "steps:\n- step_type: sql_command\n"), ("c.sql", HEAD)))
    assert rows(files.gate_yml(corpus), "path", "has_steps") == [("a.yml", True)]


def test_steps_order_names_and_duplicates(spark):
    content = (
        "steps:\n"
        "- step_type: sql-command\n  name: z-1\n  command: insert into z.z select 1\n"
        "- step_type: sql-command\n  name: a\n  command: insert into a.a select * from z.z\n"
        "- {step_type: sql-command, name: z_1, command: select 1}\n"
        "- {step_type: sql-command, name: '', command: insert into e.e select 1}\n"
        "- {step_type: sql-command, name: skip}\n" + TAIL
    )
    corpus = files.classify_files(snapshot(spark, ("f.yml", content)))
    assert rows(code.yml_steps(corpus, {}), "name", "pos") == [("", 3), ("a", 1), ("z_1", 2)]
    tables = code.tables_per_file(code.file_tables(corpus, {}))
    assert rows(tables, "pos", "table") == [(0, "e.e"), (1, "a.a"), (2, "z.z")]


def test_results_do_not_depend_on_partitions(spark):
    corpus = snapshot(spark, *[
        (f"d{i % 7}/f{i % 40}.sql", f"insert into a.t{i % 9} select * from b.u{i % 5}, c.hub")
        for i in range(400)
    ])
    results = {tuple(rows(jobs.code_index(corpus.repartition(n), {}))) for n in (1, 3, 16)}
    assert len(results) == 1


def test_read_repo(spark, tmp_path):
    for path, content in {"b.sql": b"insert into a.b select 1", "a/x.sql": b"insert into a.x select 1",
                          "a-b/x.sql": b"insert into a.z select '\xff'", "n.txt": b"no"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    corpus = repo.read_repo(spark, str(tmp_path), "https://h/")
    assert rows(corpus, "path", "name", "url") == [
        ("a-b/x.sql", "x.sql", "https://h/a-b/x.sql"), ("a/x.sql", "x.sql", "https://h/a/x.sql"),
        ("b.sql", "b.sql", "https://h/b.sql")]
    # Breadth-first: deeper folders come later; "a-b" follows "a" as a folder name.
    assert rows(jobs.code_index(corpus, {}), "pk", "label") == [("a.b", "b.sql"), ("a.z", "x.sql")]


def test_read_repo_keeps_hidden_names_and_walks_all_folders(spark, tmp_path):
    written = {f"{a}/{b}/{n}{i}.{e}": f"{a}{b}{n}{i}" for i, (a, b, n, e) in enumerate(
        (a, b, n, e) for a in ("x", ".h", "_u", "x/deep/er") for b in ("1", ".2") for n in (".f", "_f", "f")
        for e in ("sql", "yml", "txt"))}
    written |= {f"hot/f{i}.sql": "h" for i in range(500)}
    made = spark.createDataFrame(list(written.items()), "path string, content string").repartition(3)
    assert folder.write_tree(made, str(tmp_path / "r")) == len(written)
    (tmp_path / "r" / ".git").mkdir()
    (tmp_path / "r" / ".git" / "no.sql").write_text("no")
    (tmp_path / "r" / "loop").symlink_to(tmp_path / "r")
    (tmp_path / "r" / "empty").mkdir()
    every = repo.read_repo(spark, str(tmp_path / "r"), suffixes=())
    assert dict(rows(every, "path", "content")) == written
    chosen = repo.read_repo(spark, (tmp_path / "r").as_uri())
    assert dict(rows(chosen, "path", "content")) == {p: t for p, t in written.items() if not p.endswith("txt")}
    for tasks in (1, 2, 40):
        spark.dataSource.register(folder.FolderNames)
        listed = spark.read.format(folder.FORMAT).option("tasks", tasks).load(str(tmp_path / "r"))
        assert rows(listed) == sorted(((p, len(t)) for p, t in written.items()), key=repr)
    (tmp_path / "void").mkdir()
    assert rows(repo.read_repo(spark, str(tmp_path / "void"))) == []


def test_step_type_is_a_parameter(spark):
    content = HEAD.replace("sql-command", "sql_command") + "  name: a\n  command: insert into a.b select 1\n" + TAIL
    corpus = snapshot(spark, ("f.yml", content))
    assert rows(jobs.code_index(corpus, {})) == []
    assert rows(jobs.code_index(corpus, {}, step_type="sql_command"), "pk", "label") == [("a.b", "f.yml")]


def test_scripts_that_a_later_one_replaces_are_left_out_before_parsing(spark):
    corpus = snapshot(
        spark,
        ("a/x.sql", "insert into a.b select * from c.d"),
        ("b/x.sql", "select 1"),
        ("c/x.sql", None),
        ("n.sql", None),
        ("a/y.sql", "insert into e.f select 1"),
        ("p/z.yml", "steps:\n"),
        ("p/z.yml", "broken"),
        ("a/t.txt", "no kind"),
    )
    latest = files.latest_scripts(corpus)
    assert rows(latest, "ordinal", "path") == [
        (1, "b/x.sql"), (3, "n.sql"), (4, "a/y.sql"), (5, "p/z.yml"), (6, "p/z.yml"), (7, "a/t.txt")]
    tables = lambda given: rows(jobs.file_tables(given, {}))
    assert tables(latest) == tables(corpus) and len(tables(latest)) == 3
    assert rows(files.latest_scripts(corpus, "intended")) == rows(corpus)
