"""Names of codes: order, repeats, codes without names, nulls, empty tables."""

from flowquery.operators import lookups
from flowquery.sources import fingerprints
from pyspark.sql import functions as F


def test_names_are_read_and_found(spark, tmp_path):
    (tmp_path / "names").write_text("0\tHOPOPT\n6 \tTCP \t# the usual\n\n# nothing\n17  user  datagrams\n99\n6 ZZZ\n")
    names = lookups.read_names(spark, str(tmp_path / "names"))
    assert sorted(map(tuple, names.collect())) == [("0", "HOPOPT"), ("17", "user datagrams"), ("6", "TCP")]
    rows = spark.createDataFrame([(6, "x"), (99, "y"), (None, "z"), (6, "x")], "pr int, name string")
    found = lookups.named(rows, F.col("pr"), names, "protocol")
    assert found.columns == ["pr", "name", "protocol"]
    assert sorted(found.collect(), key=str) == sorted([(6, "x", "TCP"), (99, "y", "99"), (None, "z", None), (6, "x", "TCP")], key=str)


def test_lists_keep_order_repeats_nulls_and_unknown_codes(spark):
    names = spark.createDataFrame([("c02b", "A"), ("009c", "B"), ("009c", "C"), (None, "D")], "code string, name string")
    lists = [["c02b", "ffff", "009c", "c02b"], [], None, ["ffff"], [None, "009c"], ["c02b", "ffff", "009c", "c02b"]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, cs array<string>")
    found = {r.i: r.names for r in lookups.named_lists(rows, "cs", names).collect()}
    assert found == {0: ["A", "ffff", "B", "A"], 1: [], 2: None, 3: ["ffff"], 4: [None, "B"], 5: ["A", "ffff", "B", "A"]}
    assert {r.i: r.names for r in lookups.named_lists(rows, "cs", names.limit(0)).collect()} == dict(enumerate(lists))
    assert lookups.named_lists(rows.limit(0), "cs", names).collect() == []


def test_fingerprints_of_captures_have_a_row_for_the_side_that_sent_them(spark):
    schema = "sa string, da string, sp int, dp int, pr int, time_start long, fpx struct<out:string,`in`:string>"
    rows = [("a", "b", 1, 443, 6, 1_500_000, ("(0303)", None)), ("c", "d", 443, 2, 6, 0, (None, "(0304)")), ("e", "f", 1, 443, 6, 0, (None, None)), ("g", "h", 1, 443, 17, None, ("x", "y")), ("i", "j", 1, 2, 6, 0, None)]
    found = fingerprints.captured(spark.createDataFrame(rows, schema))
    assert found.columns == ["source_addr", "dest_addr", "source_port", "dest_port", "protocol", "timestamp", "fingerprint"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [
            ("a", "b", 1, 443, "TCP", "1970-01-01 00:00:01.500000", "(0303)"), ("d", "c", 2, 443, "TCP", "1970-01-01 00:00:00.000000", "(0304)"),
            ("g", "h", 1, 443, "UDP", None, "x"), ("h", "g", 443, 1, "UDP", None, "y"),
        ],
        key=str,
    )
