"""Statements and the tables they name."""

import pytest
from pyspark.sql import functions as F

from ripplemap.functions import sqltext


def value(spark, given, make):
    df = spark.createDataFrame([(given,)], "x string").repartition(1)
    return df.select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize("script, expected", [
    ("select 1; select 2 ;; ", ["select 1", "select 2"]),
    ("a -- x; y\nb", ["a b"]),
    ("a /* ; \n */b;c", ["a b", "c"]),
    ("insert into t values ('a;b', 'it''s -- no')", ["insert into t values ('' , '' '' )"]),
    ('select "a -- b" from t', ['select "a -- b" from t']),
    ("# note; x\nselect 1", ["select 1"]),
    ("", []),
    (r"select 'a\'; b' ; c", ["select ''", "c"]),
])
def test_statements(spark, script, expected):
    assert value(spark, script, sqltext.statements) == expected


CASES = [
    ("INSERT INTO m.t WITH w AS (SELECT * FROM k.l) SELECT * FROM w JOIN (SELECT * FROM n.o, n.p) s ON 1=1",
     ["m.t", "k.l", "n.o", "n.p"]),
    ("insert into a.b select extract(day FROM c.ts) d FROM db.s.u", ["a.b", "db.s.u"]),
    ("insert into a.b select trim(both 'x' from c.v), substring (c.w from 2) from d.e", ["a.b", "d.e"]),
    ("insert overwrite table a.b partition (dt) select * from c.d x, e.f y where x.k in (1, 2)",
     ["a.b", "c.d", "e.f"]),
    ("insert into a.b (c, d) values (1, 2), (3, 4)", ["a.b"]),
    ("insert into a.b select * from (c.d cross join e.f), g.h", ["a.b", "c.d", "e.f", "g.h"]),
    ("insert into a.b select * from c.d left outer join e.f using (k, l), g.h order by c.d, e.z",
     ["a.b", "c.d", "e.f", "g.h"]),
    ("insert into a.b select * from c.d join e.f on c.d.k = e.f.k, g.h group by x.y, z.w",
     ["a.b", "c.d", "e.f", "g.h"]),
    ("insert into a.b select * from only c.d, lateral (select * from e.f) q", ["a.b", "c.d", "e.f"]),
    ("insert into `a`.`b` select * from \"c d\".\"e\" f", ["a.b", "c d.e"]),
    ("insert into a.b select x from c.d where x is distinct from e.f", ["a.b", "c.d"]),
    ("insert into a.b values (1) on duplicate key update c.d = 1", ["a.b"]),
    ("insert into a.b select (select max(k) from c.d), f.g from h.i union all select * from c.d",
     ["a.b", "c.d", "h.i"]),
    ("insert into a.b with recursive x (i, j) as (select * from c.d), y as (select * from x) "
     "select * from y, x", ["a.b", "c.d"]),
    ("insert into a.b select*from(select*from c.d)z", ["a.b", "c.d"]),
    ("insert into a.b select x from c.d window w as (partition by y), v as (order by q.z)",
     ["a.b", "c.d"]),
    ("insert into a.b select from_x.y, tablex from c.d t where joiner = 1", ["a.b", "c.d"]),
    ("insert into a.b select * from c.d limit 5, 10", ["a.b", "c.d"]),
    ("insert into [a].[b] select * from [c d].e x, f.[g] where x.k[1] = [h].[i]", ["a.b", "c d.e", "f.g"]),
    ("insert into a . b select * from c. d join e .f on 1=1, \"g\" . `h` . i", ["a.b", "c.d", "e.f", "g.h.i"]),
    ("insert into a.b select 1. from c.d where x > 2. and y in (select .5 from e.f)", ["a.b", "c.d", "e.f"]),
    ("insert into a.b select * from c.d STRAIGHT_JOIN e.f on 1=1 straight_join g.h", ["a.b", "c.d", "e.f", "g.h"]),
    ("insert into a.b select straight_join x.y, z.w from c.d", ["a.b", "c.d"]),
    ("insert into a.b select distinct straight_join x.y from c.d", ["a.b", "c.d"]),
    ("insert into a.b select array[x.y, 2], [(select max(k) from e.f)] from c.d", ["a.b", "e.f", "c.d"]),
    ("insert into a.b select t.x .y, u. z from c.d t, [e] . [f] u order by t . x, g . h", ["a.b", "c.d", "e.f"]),
    ("insert into a.b select * from c.d t, lateral (select t . k) q", ["a.b", "c.d"]),
]


@pytest.mark.parametrize("statement, tables", CASES)
def test_named_tables(spark, statement, tables):
    assert value(spark, statement, lambda c: sqltext.named_tables(
        sqltext.statements(c)[0])) == tables


def test_last_insert_counts_and_intended_takes_all(spark):
    script = "INSERT INTO a.b SELECT * FROM c.d; update x.y set z = 1;\ninsert into e.f select * from g.h; select * from i.j"
    assert value(spark, script, sqltext.script_tables) == ["e.f", "g.h"]
    assert value(spark, script, lambda c: sqltext.script_tables(c, True)) == ["a.b", "c.d", "e.f", "g.h"]
    assert value(spark, "with x as (select 1) insert into a.b select 1", sqltext.script_tables) == []
    assert value(spark, "create table a.b as select 1", sqltext.script_tables) == []


def test_long_texts_do_not_overflow_the_matcher(spark):
    big = "insert into a.b values ('" + "x''y" * 50_000 + "'); insert into c.d select * from e.f where k in (" + \
        ", ".join(["'v'"] * 20_000) + ") /*" + "*" * 100_000 + "*/"
    assert value(spark, big, sqltext.script_tables) == ["c.d", "e.f"]
    deep = "insert into a.b select * from " + "(select * from " * 60 + "c.d" + ") t" * 60 + ", e.f"
    assert value(spark, deep, sqltext.script_tables) == ["a.b", "c.d", "e.f"]
