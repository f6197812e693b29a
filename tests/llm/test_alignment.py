"""Alignment against the libraries over whole texts, and token by token."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from flowquery.llm import alignment
from flowquery.llm.queries import QUERIES
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.texts import documents, rows_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.text(st.sampled_from("ab Z'sdtrem  \n\t\r!9²½éñß×÷Ⅷ中\x1c.,_-<|>日ا1  ▁\x00😀"), max_size=40)


def plain_tokens(text, tokenizer, model, letters):
    """(a, b) as lists of (id, bytes), each from one call of its library."""
    a = [(i, bytes(letters[c] for c in tokenizer.id_to_token(i))) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    shown = {}
    extra = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            shown[chr(b)] = b
        else:
            shown[chr(256 + extra)] = b
            extra += 1
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B), shown


def ranges(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain_rows(rows, libraries):
    """The contract's columns, pair by pair; links are looked for among all pairs of tokens."""
    texts = [(d, *map(ranges, plain_tokens(t or "", *libraries))) for d, t in rows]
    links = [[(x[0], y[0]) for x in a for y in b if x[2] == y[2]] for _, a, b in texts]
    counts = Counter(p for some in links for p in some)
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    out = []
    for (d, a, b), some in zip(texts, links, strict=True):
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = ["|".join(",".join(str(x[0]) for x in side if begin < x[2] <= end) for side in (a, b)) for begin, end in zip([0, *cuts], cuts, strict=False)]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best = sum(counts[p] == highest[p[1]] for p in some)
        out.append((d, len(a), len(b), len(groups), len(some), digest, best, sum(counts[p] for p in some)))
    return out


def found_rows(frame):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in frame.collect()]


def in_order(rows):
    return sorted(rows, key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(TEXT, st.none(), st.just("a <|endoftext|> b  <s> <0x41> c"), st.just(" ")), max_size=8))
def test_tokens_are_those_of_the_libraries(libraries, texts):
    own = alignment.aligner(A, B)
    found, at, ends = own.tokens(pa.array(texts, pa.string()))
    plain = [plain_tokens(t or "", *libraries) for t in texts]
    assert at.tolist() == [n for n, (a, _) in enumerate(plain) if a]
    for flat, upto, side in ((found.a, ends[0], 0), (found.b, ends[1], 1)):
        parts = np.split(flat, upto)[: len(at)]
        assert [x.tolist() for x in parts] == [[i for i, _ in plain[n][side]] for n in at]


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_products_are_those_of_the_definition(libraries, text):
    own = alignment.aligner(A, B)
    found, at, _ = own.tokens(pa.array([text]))
    a, b = map(ranges, plain_tokens(text, *libraries))
    shared = [(i, j, n) for i, x in enumerate(a) for j, y in enumerate(b) if (n := min(x[2], y[2]) - max(x[1], y[1])) > 0]
    assert list(zip(*(x.tolist() for x in found.overlaps), strict=True)) == shared
    cuts = sorted({x[2] for x in a} & {y[2] for y in b})
    same = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if sum(c < x[2] for c in cuts) == sum(c < y[2] for c in cuts)]
    assert [(i, j) for rows, columns in found.shared() for i, j in zip(rows.tolist(), columns.tolist(), strict=True)] == same


def test_product_of_any_two_matrices():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x, y = rng.random((5, 7)) < 0.4, rng.random((7, 6)) < 0.4
        of = [alignment.Incidence(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1].astype(np.int32), m.shape[1]) for m in (x, y)]
        rows, columns, sums = of[0].times(of[1])
        expected = x.astype(int) @ y.astype(int)
        assert [rows.tolist(), columns.tolist()] == [z.tolist() for z in np.nonzero(expected)] and sums.tolist() == expected[np.nonzero(expected)].tolist()
        turned = of[0].transposed()
        assert [turned.columns[turned.starts[c] : turned.starts[c + 1]].tolist() for c in range(7)] == [np.flatnonzero(x[:, c]).tolist() for c in range(7)]


def test_query_against_brute_force(spark, libraries, tmp_path, monkeypatch):
    docs = documents(spark)
    extra = spark.createDataFrame([(200, "a  b   c "), (201, "a▁b"), (202, "<|endoftext|> and <s>"), (203, " " * 300 + "x"), (204, "中文 字 😀"), (204, "中文 字 😀")], "doc_id long, text string")
    docs.unionByName(extra, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    rows = rows_of(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", 100)
    found = QUERIES["op11_alignment"](spark, str(tmp_path))
    assert in_order(found_rows(found)) == in_order(plain_rows(rows, libraries))


def test_small_slices_and_blocks_change_nothing(spark, libraries, monkeypatch):
    texts = pa.array(["a b  c" * k for k in range(1, 9)] + ["", None, "x▁"])
    own = alignment.Aligner(A, B)
    whole = alignment._figures(own, texts)
    assert pa.array(whole["groups"]).to_pylist()[-3:] == ["", "", ""]
    monkeypatch.setattr(alignment, "SLICE_BYTES", 10)
    monkeypatch.setattr(alignment, "BLOCK_ENTRIES", 3)
    parts = [alignment._figures(own, texts.slice(n, 1)) for n in range(len(texts))]
    assert all(whole[k].to_pylist() == [x for p in parts for x in p[k].to_pylist()] for k in whole)
    found, _, _ = own.tokens(texts)
    assert sum(len(i) for i, _ in found.shared()) == sum(whole["n_shared"].to_pylist())


def test_shared_group_links(spark, libraries):
    docs = spark.createDataFrame([(1, "unbelievable things"), (2, None), (3, "中文")], "doc_id long, text string")
    found = {(r.doc_id, r.a_at, r.b_at) for r in alignment.shared_group_links(docs, A, B).collect()}
    expected = set()
    for d, t in rows_of(docs):
        a, b = map(ranges, plain_tokens(t or "", *libraries))
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        expected |= {(d, i, j) for i, x in enumerate(a) for j, y in enumerate(b) if sum(c < x[2] for c in cuts) == sum(c < y[2] for c in cuts)}
    assert found == expected


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, n_a int").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op11_alignment"](spark, str(tmp_path)).collect() == []


def test_linked_pairs_are_suffixes(libraries):
    """What bounds the broadcast table."""
    own = alignment.aligner(A, B)
    assert sum(int(n.sum()) for n in own.sizes) < 700_000
