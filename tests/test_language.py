"""The truth table of the predicate language, on both kinds of columns, and the parsers."""

import pytest
from flowquery import compile as c
from flowquery.operators import projection
from flowquery.path import Item, PathError, parse_path, parse_template
from flowquery.predicate import PredicateError, parse_predicate
from pyspark.sql import functions as F

# value of x as JSON, then the answers to x=* x~* x=5 x~5 x=ab* x~ab* x>5 x<5
TABLE = {
    None: "FTFFFFFF", "null": "TFFTFTFF", "5": "TFTFFTFF", "7": "TFFTFTTF", '"abc"': "TFFTTFFF", "[]": "FFFFFFFF", "[5,7]": "TFTTFTTF", '["abc","x"]': "TFFTTTFF",
}
PREDICATES = ["{}=*", "{}~*", "{}=5", "{}~5", "{}=ab*", "{}~ab*", "{}>5", "{}<5"]


@pytest.mark.parametrize(("value", "answers"), TABLE.items())
def test_truth_table_of_variants(spark, value, answers):
    text = "{}" if value is None else f'{{"x":{value}}}'
    df = spark.range(1).select(F.parse_json(F.lit(text)).alias("v"))
    path = "x[]" if value and value[0] == "[" else "x"
    row = df.select(*(c.flag(c.where_variant(F.col("v"), p.format(path))) for p in PREDICATES)).first()
    assert "".join("T" if x else "F" for x in row) == answers


@pytest.mark.parametrize(("kind", "value", "answers"), [
    ("int", None, "FTFFFFFF"), ("int", 5, "TFTFFTFF"), ("int", 7, "TFFTFTTF"), ("string", "abc", "TFFTTFFF"), ("array<int>", [], "FFFFFFFF"),
    ("array<int>", [5, 7], "TFTTFTTF"), ("array<string>", ["abc", "x"], "TFFTTTFF"),
])
def test_truth_table_of_typed_columns(spark, kind, value, answers):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    row = df.select(*(c.flag(c.where(df.schema, p.format("x"))) for p in PREDICATES)).first()
    assert "".join("T" if x else "F" for x in row) == answers


def test_unknown_names_are_absent(spark):
    df = spark.createDataFrame([(1,)], "x int")
    row = df.select(*(c.flag(c.where(df.schema, p)) for p in ("y=*", "y~*", "y~5", "y{z}>0"))).first()
    assert list(row) == [False, True, False, False]


def test_or_binds_tighter_than_and():
    tree = parse_predicate("a=1,b=1|c=1")
    assert (tree.op, tree.parts[1].op) == (",", "|")


@pytest.mark.parametrize("text", ["a>=1", "a", "=1", "(a=1", "a=1)", "packets[{b,dir}]=5", "a=1,,b=2"])
def test_bad_predicates_are_refused(text):
    with pytest.raises((PredicateError, PathError)):
        parse_predicate(text)


def test_templates():
    assert parse_template("sa, tcp{out{flags}}, p[{b},{dir}], q[]") == (
        Item("sa"), Item("tcp", "object", ((Item("out", "object", ((Item("flags"),),)),),)), Item("p", "array", ((Item("b"),), (Item("dir"),))), Item("q", "whole"),
    )
    assert parse_path("a{b}").name == "a"
    for bad in ("a{", "a[{b}", "{a}", "a{}", ""):
        with pytest.raises(PathError):
            parse_template(bad)


@pytest.mark.parametrize(("pattern", "yes", "no"), [("a.b", ["a.b"], ["axb"]), ("a*b?", ["axxb1", "ab1"], ["ab"]), ("[ab]c*", ["acd", "bc"], ["cc"]), ("x+y", ["x+y"], ["xxy"])])
def test_globs(spark, pattern, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "x string")
    assert [r[0] for r in df.select(c.glob(F.col("x"), pattern)).collect()] == [True] * len(yes) + [False] * len(no)


def test_prefix_globs_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    plan = df.where(c.where(df.schema, "p_name=red*,p_size>5"))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(p_name,red)" in plan and "GreaterThan(p_size,5)" in plan


def test_select_drops_rows_and_array_elements_without_paths(spark):
    df = spark.createDataFrame([(1, [(1, None), (None, "x")]), (None, []), (None, None)], "a int, p array<struct<b:int,d:string>>")
    rows = projection.select(df, "a,p[{b}]").collect()
    assert [(r.a, [x.b for x in r.p]) for r in rows] == [(1, [1])]
    assert projection.select(df, "nothing").count() == 0


def test_normalize_keeps_structure(spark):
    df = spark.createDataFrame([(1, [(1, "x")], (2, 3))], "a int, p array<struct<b:int,d:string>>, s struct<m:int,n:int>")
    row = projection.normalize(df, "a,p[{b}],s{n}").first()
    assert (row.a, row.p[0].b, row.p[0].d, row.s.m, row.s.n) == (None, None, "x", 2, None)
