"""A user's predicates and processors, in the builder and on the command line."""

import json

import pytest
from flowquery import extend
from flowquery.__main__ import main
from flowquery.pipeline import FlowQuery
from pyspark.sql import functions as F

EXTENSION = """
from flowquery import extend
from pyspark.sql import functions as F

@extend.predicate("large")
def large(text="10"):
    return F.col("b") > int(text)

@extend.processor("halves", needs=["da", "b"], gives="da string, half long")
def halves(df):
    return df.select("da", F.explode(F.array(F.floor(F.col("b") / 2), F.col("b") - F.floor(F.col("b") / 2))).alias("half"))
"""


@pytest.fixture
def loaded(tmp_path):
    (tmp_path / "own.py").write_text(EXTENSION)
    extend.load(str(tmp_path / "own.py"))
    yield str(tmp_path / "own.py")
    extend.PREDICATES.clear()
    extend.PROCESSORS.clear()


def test_builder(spark, loaded, tmp_path):
    spark.createDataFrame([("x", 5), ("x", 25), ("y", 13), ("z", None)], "da string, b long").write.parquet(f"{tmp_path}/t")
    flows = spark.read.parquet(f"{tmp_path}/t")
    q = FlowQuery(flows).keep("large").process("halves")
    assert sorted(map(tuple, q.run().collect())) == [("x", 12), ("x", 13), ("y", 6), ("y", 7)]
    assert sorted((r.da, r.half) for r in q.groupby("da").sum("half").run().collect()) == [("x", 25), ("y", 13)]
    assert FlowQuery(flows).keep("large:20").run().count() == 1
    assert "PushedFilters: [IsNotNull(b), GreaterThan(b,10)]" in q.run()._jdf.queryExecution().toString()


def test_what_does_not_fit_is_told(spark, loaded):
    flows = spark.createDataFrame([("x", 5)], "da string, b long")
    for query, error in ((FlowQuery(flows).keep("none"), "no such predicate"), (FlowQuery(flows).process("none"), "no such processor"), (FlowQuery(flows.drop("da")).process("halves"), "needs da")):
        with pytest.raises(ValueError, match=error):
            query.run()
    extend.predicate("text")(lambda: F.col("da"))
    extend.processor("other", gives="n int")(lambda df: df)
    for query, error in ((FlowQuery(flows).keep("text"), "not a condition"), (FlowQuery(flows).process("other"), "not n int")):
        with pytest.raises(TypeError, match=error):
            query.run()


def test_command_line(spark, loaded, tmp_path, capsys):
    (tmp_path / "f.json").write_text('{"da": "x", "b": 5}\n{"da": "x", "b": 25}\n{"da": "y", "b": 13}\n')
    assert main([str(tmp_path / "f.json"), "--extension", loaded, "--keep", "large:12", "--process", "halves"], spark) == 0
    assert sorted((x["da"], x["half"]) for x in map(json.loads, capsys.readouterr().out.splitlines())) == [("x", 12), ("x", 13), ("y", 6), ("y", 7)]
