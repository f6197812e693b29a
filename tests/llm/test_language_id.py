"""Language identification against a plain version of the rule, and on held-out labels."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from flowquery.llm import language_id
from flowquery.llm.queries import QUERIES
from pyspark.sql import functions as F

from tests.llm.texts import documents


def letters_of(text):
    out, word = [], ""
    import unicodedata

    for c in (text or "").lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and word):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_predictions(rows, learnt):
    """Word by word, with dictionaries; nothing is bounded. Rows: (doc_id, text, lang)."""
    counts = Counter(lang for _, _, lang in learnt)
    langs = sorted(counts)
    tables = []  # of words, then n-grams by length
    for n in range(language_id.GRAM + 1):
        table = {x: Counter() for x in langs}
        for lang, text in {(lang, text) for _, text, lang in learnt}:
            for w in letters_of(text):
                table[lang].update([w] if n == 0 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)])
        tables.append(table)

    def share(table, lang, term):
        totals = {x: sum(c.values()) for x, c in table.items()}
        return math.log(table[lang][term] / totals[lang]) if table[lang][term] else math.log(language_id.UNSEEN / max(totals.values()))

    def word_scores(w):
        for n in (0, *range(language_id.GRAM, 0, -1)):
            terms = [w] if n == 0 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
            known = [t for t in terms if any(tables[n][x][t] for x in langs)]
            if known:
                return {x: sum(share(tables[n], x, t) for t in known) / len(known) for x in langs}
        return dict.fromkeys(langs, 0.0)

    out = []
    for d, text, _ in rows:
        held = letters_of(text)
        if not held or not langs:
            out.append((d, "und", 0.0))
            continue
        sums = {x: math.log(counts[x] / len(learnt)) for x in langs}
        for w in held:
            for x, v in word_scores(w).items():
                sums[x] += v
        best = max(langs, key=lambda x: (sums[x], [-ord(c) for c in x]))
        out.append((d, best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())))
    return out


@pytest.fixture
def mixed(spark, tmp_path):
    random.seed(11)
    syllables = {"xa": "ka lo mi ra tu".split(), "xb": "schu ber ling ung öst".split(), "xc": "да не ка ще ру".split()}
    rows = []
    for i in range(160):
        lang = random.choice(list(syllables))
        text = " ".join("".join(random.choices(syllables[lang], k=random.randint(1, 3))) for _ in range(random.randint(1, 12)))
        rows.append((i, random.choice([text, text.upper(), text + " 1234 ***"]), lang))
    rows += [(rows[3][0], rows[3][1], rows[3][2])] * 3
    rows += [(200, None, "xa"), (201, "", "xb"), (202, "123 ²½ !", "xa"), (203, "ka lo", None), (None, "unheard", "xz"), (204, "中文字", None), (205, "éke réko", "xa"), (206, "ka " * 4000, "xb")]
    docs = spark.createDataFrame([(d, t, x, 1) for d, t, x in rows], "doc_id long, text string, lang string, found int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), rows


def test_query_against_plain_version(spark, mixed):
    path, rows = mixed
    found = QUERIES["op13_language_id"](spark, path)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    out = zlib.crc32
    learnt = [r for r in rows if r[0] is not None and r[2] is not None and out(str(r[0]).encode()) % 4 != 2]
    expected = [(d, d is not None and out(str(d).encode()) % 4 == 2, x, round(s, 9)) for d, x, s in plain_predictions(rows, learnt)]
    assert sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in found.collect()), key=repr) == sorted(expected, key=repr)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    found = QUERIES["op13_language_id"](spark, sf_dir.replace("sf0.001", "sf0.01")).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


def test_bounds_leave_frequent_terms(spark):
    counts = spark.createDataFrame([("a", f"t{i}", n) for i, n in enumerate([5, 5, 4, 3, 3, 3, 1])] + [("b", "x", 2), ("b", "y", 2), ("b", "z", 2)], "lang string, term string, n long")
    kept = {(r.lang, r.n) for r in language_id.most(counts, "lang", 4).collect()}
    assert kept == {("a", 5), ("a", 4), ("b", 2)}
    assert language_id.most(counts, "lang", 2).where("lang = 'b'").count() == 0


def test_bounded_model_still_predicts(spark, mixed, monkeypatch):
    path, rows = mixed
    monkeypatch.setattr(language_id, "WORDS", 9)
    monkeypatch.setattr(language_id, "GRAMS", 30)
    monkeypatch.setattr(language_id, "REMEMBERED", 3)
    found = {r.doc_id: r.lang_pred for r in language_id.identify(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    sure = [(d, x) for d, t, x in rows[:160] if len(t) > 20]
    assert np.mean([found[d] == x for d, x in sure]) > 0.95


def test_nothing_to_learn_from(spark):
    docs = documents(spark).select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "spans")
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs).collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0)).collect() == []
