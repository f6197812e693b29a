"""Runs against their definition, word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from flowquery.llm import periodic_runs
from flowquery.llm.queries import QUERIES
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.texts import documents, rows_of


def plain_runs(words, least=2, exponent=2):
    """Stretches of words equal to those ``q`` before them, for every ``q``; a multiple of a smaller period is none."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            if end > at and length >= max(least, exponent * q, 2 * q) and not any(s <= at and at + length <= s + m for s, m, p in out if p < q and q % p == 0):
                out.append((at, length, q))
            at = max(end, at) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


WORDS = st.one_of(
    st.lists(st.integers(0, 1), max_size=60),
    st.lists(st.integers(0, 3), max_size=60),
    st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9)), max_size=5).map(lambda parts: [x for block, k in parts for x in block * k]),
)


@settings(max_examples=600, deadline=None)
@given(WORDS)
def test_all_runs(words):
    assert periodic_runs.maximal_runs(words) == plain_runs(words)


@settings(max_examples=600, deadline=None)
@given(WORDS, st.sampled_from([(6, 4), (3, 3), (2, 2), (8, 2), (4, 9)]))
def test_long_runs_survive_the_cuts(words, wanted):
    assert periodic_runs.runs_of([str(w).encode() for w in words], *wanted) == plain_runs(words, *wanted)


def test_cuts_are_of_use():
    random.seed(3)
    words = [random.randrange(300) for _ in range(3000)]
    words[1000:1000] = [1, 2, 3, 4, 5] * 8
    [(begin, end)] = periodic_runs.stretches(np.array(words), 6, 4)
    assert 990 <= begin <= 1000 and 1040 <= end <= 1050


def test_long_unary_text_is_quick():
    assert periodic_runs.runs_of([b"a"] * 60_000) == [(0, 60_000, 1)]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 20_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    found = periodic_runs.maximal_runs([ord(c) for c in fibonacci[-1]])
    assert len(found) < len(fibonacci[-1]) and all(fibonacci[-1][s + p : s + m] == fibonacci[-1][s : s + m - p] for s, m, p in found)


def plain_row(doc_id, text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 6, 4)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{p}\n" for s, m, p in runs), " ".join(kept))]
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *digest)


@pytest.fixture
def whole(spark, tmp_path):
    docs = documents(spark, n=200)
    lines = "one two three " * 9 + "x " + "echo " * 12 + "end\n"
    extra = [(300 + i, lines * k + "tail word\u0085 x\x1cy") for i, k in enumerate((1, 2, 5))] + [(400, "a " * 3000), (401, " \t\n"), (402, "a a a a a")]
    docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_query_against_brute_force(spark, whole):
    found = QUERIES["op12_periodic_runs"](spark, whole)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = rows_of(spark.read.parquet(f"{whole}/documents.parquet"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain_row(*r) for r in rows), key=repr)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows if d is not None) > 5


def test_operator_keeps_texts(spark):
    docs = spark.createDataFrame([(1, "so so so so so so it goes"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: (r.runs, r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()}
    assert found == {1: ([(0, 6, 1)], "so it goes"), 2: ([], "")}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect() == []
