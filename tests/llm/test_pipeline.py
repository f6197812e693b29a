"""Each stage of the pipeline against a plain version, on the smallest tables."""

import re

import corpus_pipeline
import pytest
from flowquery.llm import near_duplicates, packing, quality, secret_scan, token_files
from flowquery.llm.queries import QUERIES, table, tokenizer_path
from pyspark.sql import functions as F

from tests.llm.texts import documents


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """name: (rows in, rows out)"""
    docs, found = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        found[name] = docs, out
        docs = out
    return found


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(stages, spark, sf_dir):
    columns = table(spark, sf_dir, "documents").columns
    assert [out.columns == columns for _, out in stages.values()] == [True] * 4 + [False]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_rows(spark, sf_dir, stage):
    docs = documents(spark).withColumn("n_chars", F.char_length("text").cast("long"))
    out = stage(spark, docs, sf_dir)
    rows, after = docs.collect(), out.collect()
    if "doc_ids" in out.columns:
        assert sum(out.select(F.explode("pieces").alias("p")).where("p = 0").groupBy().count().first()) == len(rows)
    else:
        assert out.columns == docs.columns and {r.doc_id for r in after} <= {r.doc_id for r in rows}
        assert {(r.spans, r.fp, r.score) for r in after} <= {("s", 3, 2.0)}
    empty = stage(spark, docs.limit(0), sf_dir)
    assert empty.columns == out.columns and empty.collect() == []


def test_quality(stages, spark, sf_dir):
    before, after = stages["quality"]
    score = quality.scorer(before, table(spark, sf_dir, "labels"))
    assert ids(after) == ids(before.withColumn("s", score).where(f"s >= {corpus_pipeline.LEAST_QUALITY}"))
    good = table(spark, sf_dir, "labels").where("quality = 1").join(before, "doc_id")
    assert len(ids(good) & ids(after)) / len(ids(good)) > 0.9


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    groups = {}
    for r in near_duplicates.near_duplicates(before).collect():
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert ids(after) == {min(g) for g in groups.values()}


def test_decontaminate(stages, spark, sf_dir):
    before, after = stages["decontaminate"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({i: i + 32 for i in range(65, 91)}))
    windows = {tuple(w[k : k + 10]) for r in table(spark, sf_dir, "benchmark").collect() for w in [words(r.text)] for k in range(max(1, len(w) - 9))}
    clean = {r.doc_id for r in before.collect() if not any(tuple(w[k : k + n]) in windows for w in [words(r.text)] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))}
    assert ids(after) == clean


def test_secrets(stages):
    before, after = stages["secrets"]
    texts = dict(after.select("doc_id", "text").collect())
    for r in before.collect():
        spans = sorted((m.start(), m.end(), x.kind) for x in secret_scan.RULES for m in re.finditer(x.regex, r.text) if len(m.group(x.group)) >= x.least)
        out, at = "", 0
        for b, e, kind in spans:
            if b >= at:
                out += r.text[at:b] + f"[{kind}]"
            at = max(at, e)
        assert texts[r.doc_id] == out + r.text[at:]


def test_packing(stages):
    before, after = stages["packing"]
    tokenizer = token_files.encoder(tokenizer_path()).tokenizer
    expected = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0] for r in before.collect()}
    found: dict = {}
    for r in after.collect():
        assert r.n_tokens <= r.capacity <= max(packing.CAPACITIES)
        ids, at = token_files.unpack(r.payload, r.width, 0, r.n_tokens).tolist(), 0
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths, strict=True):
            found.setdefault(d, []).append((s, ids[at : at + n]))
            at += n
    assert {d: [i for _, x in sorted(parts) for i in x] for d, parts in found.items()} == expected


def test_run_is_registered(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages["packing"][1].count()
    assert "op1_token_files" in QUERIES
