"""Anonymised records: all else byte for byte, addresses at any depth, and codes against published ciphertexts."""

import json

import pytest
from flowquery.__main__ import main
from flowquery.functions import scalar
from flowquery.sinks import anonymous
from flowquery.sources import subnets
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

LINES = [
    '{"sa":"10.0.0.1", "da" : "192.168.1.9","x":{"sa":"10.9.9.9","y":[{"da":"10.0.0.2"},"10.0.0.3"]},  "n":1.0e5}',
    '{"note":"\\"sa\\":\\"10.0.0.1\\"","sa":["10.0.0.4",{"k":"10.0.0.5"},"10.0.0.6"],"da":null,"é":"\\u00e9"}',
    '{"sa":"not an address","da":"10.0.0.256","sa":""}', '{"sa":"10.0.0.1","da":"10.0', "no json sa 10.0.0.1", "", None,
]


@pytest.fixture
def nets(spark, tmp_path):
    (tmp_path / "nets").write_text("10.0.0.0/8 # ours\n192.168.1.9\n")
    return subnets.read(spark, str(tmp_path / "nets"))


def test_rewriting_keeps_all_else(spark, nets):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    key = "0123456789abcdef"
    coded = [r.value for r in anonymous.rewrite(lines, ["sa", "da"], anonymous.address_code(nets, key)).collect()]
    plain = {f"10.0.0.{i}" for i in (1, 2, 4, 6)} | {"10.9.9.9", "192.168.1.9"}
    codes = {r.a: r.c for r in spark.createDataFrame([(a,) for a in sorted(plain)], "a string").select("a", scalar.anonymized(F.col("a"), F.encode(F.lit(key), "UTF-8")).alias("c")).collect()}
    expected = list(LINES)
    for n, some in ((0, ["10.0.0.1", "192.168.1.9", "10.9.9.9", "10.0.0.2"]), (1, ["10.0.0.4", "10.0.0.6"])):
        for a in some:
            expected[n] = expected[n].replace(f'"{a}"', f'"{codes[a]}"')
    expected[3] = expected[3].replace('"10.0.0.1"', f'"{codes["10.0.0.1"]}"')
    assert coded == expected
    left = anonymous.uncoded(lines, ["sa", "da"], nets)
    assert sorted((r.name, r.leaf) for r in left.collect()) == [("da", "10.0.0.2"), ("da", "192.168.1.9"), ("sa", "10.0.0.1"), ("sa", "10.0.0.1"), ("sa", "10.0.0.4"), ("sa", "10.0.0.6"), ("sa", "10.9.9.9")]
    assert anonymous.uncoded(spark.createDataFrame([(x,) for x in coded], "value string"), ["sa", "da"], nets).count() == 0


TREE = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=8)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["sa", "da", "x", '"', "\\"]), x, max_size=3)), max_leaves=12)


def plain_leaves(tree, key=None):
    """The string leaves below a named key, through arrays alone, in order."""
    if isinstance(tree, dict):
        return [leaf for k, v in tree.items() for leaf in plain_leaves(v, k)]
    if isinstance(tree, list):
        return [leaf for v in tree for leaf in plain_leaves(v, key)]
    return [tree] if isinstance(tree, str) and key in ("sa", "da") else []


@settings(max_examples=300, deadline=None)
@given(TREE, st.sampled_from([None, 2]), st.booleans())
def test_leaves_of_any_tree(tree, indent, ascii_only):
    line = json.dumps(tree, indent=indent, ensure_ascii=ascii_only)
    gaps, keys, leaves = anonymous.cut(line, frozenset(["sa", "da"]))
    assert [json.loads(f'"{x}"') for x in leaves] == plain_leaves(tree) and len(gaps) == len(leaves) + 1 == len(keys) + 1
    assert "".join(g + x for g, x in zip(gaps, [*leaves, ""], strict=True)) == line


def test_codes_are_published_ciphertexts(spark):
    """Blocks of one to four leading ones under a key of zeros, from the standard's known answers."""
    known = {
        "128.0.0.0": "3ad78e726c1ec02b7ebfe92b23d9ec34", "192.0.0.0": "aae5939c8efdf2f04e60b9fe7117b2c2", "224.0.0.0": "f031d4d74f5dcbf39daaf8ca3af6e527", "240.0.0.0": "96d9fd5cc4f07441727df0f33e401a36",
    }
    key = F.unhex(F.lit("00" * 16))
    rows = spark.createDataFrame([(a,) for a in known], "a string").select("a", scalar.anonymized(F.col("a"), key).alias("c"))
    assert {r.a: r.c for r in rows.collect()} == known
    assert {r.p for r in rows.select(scalar.deanonymized(F.col("c"), key).alias("p")).collect()} == set(known)


def test_bounds(spark, nets, monkeypatch):
    monkeypatch.setattr(anonymous, "MOST_NETWORKS", 1)
    with pytest.raises(ValueError, match="networks"):
        anonymous.inside(nets)
    with pytest.raises(ValueError, match="key"):
        anonymous.address_code(nets, "short")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "f.json").write_text('{"sa": "10.0.0.1", "in": {"da": "8.8.8.8", "sa": "10.0.0.1"}}\n')
    (tmp_path / "nets").write_text("10.0.0.0/8\n")
    words = [str(tmp_path / "f.json"), "--anon-nets", str(tmp_path / "nets"), "--anon-key", "0123456789abcdef"]
    assert main(words, spark) == 0
    shown = json.loads(capsys.readouterr().out)
    assert len(shown["sa"]) == 32 and shown["in"] == {"da": "8.8.8.8", "sa": shown["sa"]}
    main([*words, "--output", str(tmp_path / "out")], spark)
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [shown]
