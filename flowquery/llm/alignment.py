"""Cross-tokenizer alignment by products of token-byte incidence matrices.

Each text, behind a space, is encoded by a byte-level BPE (A) and a piece BPE with byte fallback (B). Which bytes a token
covers is a 0/1 matrix in compressed sparse rows, built by hand for a slice of texts at once. The row-by-row product
of A's matrix with the transpose of B's gives the *overlap links*: each pair of tokens that share bytes, and how many.
Those whose ranges end together are the *links*; their ends cut both token sequences into *groups*. Which group a token is in is a second pair
of matrices; their product gives the *shared-group links*, row block by row block, so that a group without a common
end inside is never expanded whole.

Of two tokens that end together one is a suffix of the other. So there are no more linked id pairs, whatever the corpus, than
vocabulary entries have suffixes: some 500,000 for the contract's vocabularies. That bound is why the corpus-wide
counts of the pairs can be summed a task in numpy and broadcast.

Defined results: texts that are null or empty, or that either tokenizer does not give back byte for byte (those with U+2581, which B
reads as a space) have no tokens, and all figures are zero; special tokens' strings are plain text; tokens without
bytes overlap nothing; repeated rows and ids give a row each, null ids too; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from copy import copy
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquery.llm.common import new_table_path
from flowquery.llm.token_files import ENDS_BLANK, STARTS_BLANK, Encoder, picked

#: Bytes of text that are aligned at once; a longer text is alone.
SLICE_BYTES = 1_500_000
#: Pieces of text whose ids a worker remembers.
KNOWN_PIECES = 300_000
#: Pairs that are counted or looked up at once, unless one row has more.
PAIRS_AT_ONCE = 500_000
#: Entries that a block of a shared-group product expands to, unless one row has more.
BLOCK_ENTRIES = 1_000_000


@dataclass
class Incidence:
    """A 0/1 matrix in compressed sparse rows: row ``r`` has ones in ``columns[starts[r]:starts[r + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def transposed(self) -> Incidence:
        rows = np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), self.sizes)
        falls = (self.columns[1:] < self.columns[:-1]).any()
        order = np.argsort(self.columns, kind="stable") if falls else slice(None)
        return Incidence(np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))]), rows[order], len(self.starts) - 1)

    def times(self, other: Incidence, begin: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows ``begin`` to ``end`` of the product, Gustavson's way: each entry of a row adds the other's row of that number. (row, column, sum) of what is not zero, in order."""
        starts = self.starts[begin : len(self.starts) if end is None else end + 1]
        own = self.columns[starts[0] : starts[-1]]
        sizes = other.sizes[own]
        columns = picked(other.columns, other.starts[own], sizes)
        rows = np.repeat(np.repeat(np.arange(begin, begin + len(starts) - 1), np.diff(starts)), sizes)
        key = rows * max(other.width, 1) + columns
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, rows, columns = key[order], rows[order], columns[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        return rows[first], columns[first], np.diff(first, append=len(key))


def before(marks: np.ndarray, n: int) -> np.ndarray:
    """How many of ``marks`` (distinct places) are before each of ``n`` places."""
    marked = np.zeros(n, np.int32)
    marked[marks] = 1
    return np.cumsum(marked, dtype=np.int32) - marked


@dataclass
class Aligned:
    """The tokens of several texts that both tokenizers give back, one text after the other."""

    a: np.ndarray
    b: np.ndarray
    a_sizes: np.ndarray  # bytes
    b_sizes: np.ndarray

    @cached_property
    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.a_sizes), np.cumsum(self.b_sizes)

    @cached_property
    def overlaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in a, place in b, shared bytes) of all overlapping tokens."""
        n = int(self.a_sizes.sum())
        of_a, of_b = (Incidence(np.concatenate([[0], ends]), np.arange(n, dtype=np.int32), n) for ends in self.ends)
        return of_a.times(of_b.transposed())

    @cached_property
    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(place in a, place in b) of the overlapping tokens that end together."""
        i, j, _ = self.overlaps
        together = self.ends[0][i] == self.ends[1][j]
        return i[together], j[together]

    @cached_property
    def groups(self) -> tuple[Incidence, Incidence]:
        """Which group each token of a and of b is in."""
        return tuple(Incidence(np.arange(len(flat) + 1), before(at, len(flat)), len(at)) for flat, at in zip((self.a, self.b), self.links, strict=True))

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in a, place in b) of all tokens of one group, in blocks."""
        of_a, of_b = self.groups[0], self.groups[1].transposed()
        block = np.cumsum(of_b.sizes[of_a.columns]) // BLOCK_ENTRIES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(self.a)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            i, j, _ = of_a.times(of_b, begin, end)
            yield i, j


def byte_letters() -> dict[str, int]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteTokens(Encoder):
    """The byte-level side, special tokens' strings being plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = []

    def entries(self) -> list[bytes]:
        letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        out = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        return out


class PieceTokens(Encoder):
    """The piece side. Pieces hold U+2581, which stands for a space, at their start or nowhere else but in runs of it, so a text may be cut before each run of spaces."""

    CUT = re.compile(r"(?<=[^ ]) ")
    SPACE = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(re.search(f"[^{self.SPACE}]{self.SPACE}", p) for p in pieces)
        self.special = []
        self.spaced = np.array([p.startswith(self.SPACE) for p in pieces])
        self.alone = [self.model.piece_to_id(self.SPACE)]
        self.known, self.again = {}, np.zeros(0, bool)
        self.pool, self.begins, self.sizes, self.held = [], [], [], 0

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        """Of texts that start with a space, which the model adds again; of an empty one nothing."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [np.array(self.alone if t == " " else ids, "<u4") for t, ids in zip(texts, found, strict=True)]

    def _gather(self, pieces: pa.Array, offsets: np.ndarray) -> list[np.ndarray] | np.ndarray:
        empty = pc.equal(pieces, "").to_numpy(zero_copy_only=False)
        empty[offsets[:-1]] = False  # each text starts with a space
        if empty.any():
            return np.unique(np.searchsorted(offsets, np.flatnonzero(empty), "right") - 1)
        coded = pieces.dictionary_encode()
        return self._ids(coded.dictionary, coded.indices.to_numpy(), offsets)

    def entries(self) -> list[bytes]:
        every = range(self.model.get_piece_size())
        return [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace(self.SPACE, " ").encode() for i in every]


def learnt(encoder: Encoder, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct ``pieces``, each behind a space, one after the other, and how many each has."""
    names, pool, sizes = [], [], []
    scratch = copy(encoder)
    scratch._remember = lambda some, ids, n: (names.append(some), pool.extend(ids), sizes.append(n))
    scratch._learn(pieces)
    numbers = pc.index_in(pieces, value_set=pa.concat_arrays(names)).to_numpy()
    n = np.concatenate(sizes)
    return picked(np.concatenate(pool), (np.cumsum(n) - n)[numbers], n[numbers]), n[numbers]


class Pieces:
    """The ids that both tokenizers give to pieces of text behind a space; beyond KNOWN_PIECES the pieces that were met again stay, half of that number at most."""

    def __init__(self, encoders: Sequence[Encoder]):
        self.encoders = encoders
        self.known: dict[str, int] = {}
        self.again = np.zeros(0, bool)
        self.pools = [np.zeros(0, np.uint32) for _ in encoders]
        self.sizes = [np.zeros(0, np.int64) for _ in encoders]

    def _forget(self) -> None:
        kept = np.flatnonzero(self.again)[: KNOWN_PIECES // 2]
        for k, n in enumerate(self.sizes):
            self.pools[k], self.sizes[k] = picked(self.pools[k], (np.cumsum(n) - n)[kept], n[kept]), n[kept]
        names = list(self.known)
        self.known = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.again = np.zeros(len(kept), bool)

    def ids(self, pieces: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For either tokenizer the ids of ``pieces``, one after the other, and how many each piece has."""
        if len(self.known) > KNOWN_PIECES:
            self._forget()
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        numbers = np.array([self.known.get(p, -1) for p in names], np.int64)
        self.again[numbers[numbers >= 0]] = True
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh = coded.dictionary.take(pa.array(new))
            numbers[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip([names[i] for i in new.tolist()], numbers[new].tolist(), strict=True))
            self.again = np.append(self.again, np.zeros(len(new), bool))
            for k, encoder in enumerate(self.encoders):
                ids, sizes = learnt(encoder, fresh)
                self.pools[k], self.sizes[k] = np.append(self.pools[k], ids), np.append(self.sizes[k], sizes)
        numbers = numbers[coded.indices.to_numpy()]
        return [(picked(pool, (np.cumsum(n) - n)[numbers], n[numbers]), n[numbers]) for pool, n in zip(self.pools, self.sizes, strict=True)]


class Aligner:
    """Both tokenizers, their entries as bytes, and the pieces that groups are written with."""

    def __init__(self, path_a: str, path_b: str):
        self.encoders = ByteTokens(path_a), PieceTokens(path_b)
        self.pieces = Pieces(self.encoders)
        entries = [e.entries() for e in self.encoders]
        self.sizes = [np.array([len(x) for x in held], np.int64) for held in entries]
        self.begins = [np.cumsum(n) - n for n in self.sizes]
        self.bytes = [np.frombuffer(b"".join(held), np.uint8) for held in entries]
        self.n_b = len(entries[1])
        self.pair_type = "<u4" if len(entries[0]) * self.n_b <= 1 << 32 else "<u8"
        self.spelt = pa.array([f"{i}{mark}" for held, last in zip(entries, "|;", strict=True) for i in range(len(held)) for mark in (",", last)])

    def _encode(self, spaced: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of texts that start with a space, by either tokenizer, one text after the other, and how many each text has.

        Both tokenizers cut a text before a space that has no other white space near, so most texts are split once and their pieces looked up for both.
        """
        cut = pc.split_pattern(spaced, " ")
        pieces, offsets = cut.flatten(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        starts, ends = (pc.match_substring_regex(pieces, x).to_numpy(zero_copy_only=False) for x in (STARTS_BLANK, ENDS_BLANK))
        near = ends[:-1] & starts[1:]
        near[offsets[1:-1] - 1] = False  # pieces of two texts
        empty = pc.equal(pieces, "").to_numpy(zero_copy_only=False)
        first = np.zeros(len(pieces), bool)
        first[offsets[:-1]] = True
        whole = np.zeros(len(spaced), bool)
        whole[np.searchsorted(offsets, np.flatnonzero(np.append(near, False) | (empty & ~first)), "right") - 1] = True
        whole |= not all(e.cuts for e in self.encoders)
        text = np.repeat(np.arange(len(spaced)), np.diff(offsets))
        used = ~first & ~whole[text]
        out = []
        for encoder, (ids, sizes) in zip(self.encoders, self.pieces.ids(pieces.filter(pa.array(used))), strict=True):
            counts = np.bincount(text[used], sizes, len(spaced)).astype(np.int64)
            if whole.any():
                others = encoder.encode(spaced.filter(pa.array(whole)))
                parts = np.split(ids, np.cumsum(counts[~whole])[:-1])
                at = np.argsort(np.concatenate([np.flatnonzero(~whole), np.flatnonzero(whole)]))
                every = [*parts[: int((~whole).sum())], *others]
                ids = np.concatenate([every[k] for k in at.tolist()])
                counts[whole] = [len(x) for x in others]
            out.append((ids.astype(np.int64), counts))
        return out

    def tokens(self, texts: pa.Array) -> tuple[Aligned, np.ndarray, list[np.ndarray]]:
        """What is aligned, which texts it holds, and where each of them ends in a and in b."""
        todo = pc.and_(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.match_substring(texts, PieceTokens.SPACE)))
        at = np.flatnonzero(pc.fill_null(todo, False).to_numpy(zero_copy_only=False))
        none = np.zeros(0, np.int64)
        if not len(at):
            return Aligned(none, none, none, none), at, [none, none]
        spaced = pc.binary_join_element_wise(pa.scalar(""), texts.take(pa.array(at)), pa.scalar(" "))
        wanted = spaced.cast(pa.binary()).to_pylist()
        kept = np.ones(len(at), bool)
        found = self._encode(spaced)
        for (flat, counts), sizes, begins, held in zip(found, self.sizes, self.begins, self.bytes, strict=True):
            joined = picked(held, begins[flat], sizes[flat]).tobytes()
            upto = np.concatenate([[0], np.cumsum(sizes[flat])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
            kept &= np.array([joined[b:e] == w for b, e, w in zip(upto, upto[1:], wanted, strict=False)], bool)
        flats = [flat if kept.all() else flat[np.repeat(kept, counts)] for flat, counts in found]
        return Aligned(*flats, *(n[x] for n, x in zip(self.sizes, flats, strict=True))), at[kept], [np.cumsum(counts[kept]) for _, counts in found]

    def spell(self, found: Aligned, ends: Sequence[int]) -> list[str]:
        """The groups of each text as ``a1,a2|b1;a3|b2``; ``ends``: of each text's groups."""
        marks = []
        for flat, of, base in zip((found.a, found.b), found.groups, (0, 2 * len(self.sizes[0])), strict=True):
            last = np.diff(of.columns, append=-1) != 0
            marks.append(base + 2 * flat + last)
        a, b = (x.transposed() for x in found.groups)
        order = np.empty(len(found.a) + len(found.b), np.int64)
        order[np.arange(len(found.a)) + b.starts[found.groups[0].columns]] = marks[0]
        order[np.arange(len(found.b)) + a.starts[found.groups[1].columns + 1]] = marks[1]
        spelt = self.spelt.take(pa.array(order))
        _, offsets, data = spelt.buffers()
        upto = np.frombuffer(offsets, np.int32)[np.concatenate([[0], (a.starts + b.starts)[ends]])].tolist()
        return [str(data[x : y - 1], "ascii") for x, y in zip(upto, upto[1:], strict=False)]


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process."""
    return Aligner(path_a, path_b)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_shared long, groups string, pairs binary"


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    own = aligner(path_a, path_b)
    for batch in batches:
        texts = batch.column("text")
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(upto // SLICE_BYTES)) + 1).tolist(), len(texts)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if end > begin:
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(begin, end - begin)} | _figures(own, texts.slice(begin, end - begin)))


def per_text(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of ``places``, in order, are in each text, given where texts end."""
    return np.diff(np.searchsorted(places, ends), prepend=0)


def _figures(own: Aligner, texts: pa.Array) -> dict[str, pa.Array]:
    found, at, (a_ends, b_ends) = own.tokens(texts)
    i, j = found.links
    links = per_text(i, a_ends)
    ends = np.cumsum(links)  # a group ends with each link
    pairs = (found.a[i] * own.n_b + found.b[j]).astype(own.pair_type)
    sizes = [of.transposed().sizes for of in found.groups]

    def placed(values: np.ndarray) -> pa.Array:
        out = np.zeros(len(texts), np.int64)
        out[at] = values
        return pa.array(out)

    def placed_list(values: list, empty: str | bytes) -> pa.Array:
        out = [empty] * len(texts)
        for k, x in zip(at.tolist(), values, strict=True):
            out[k] = x
        return pa.array(out)

    cuts = [0, *ends.tolist()]
    return {
        "n_a": placed(np.diff(a_ends, prepend=0)), "n_b": placed(np.diff(b_ends, prepend=0)), "n_groups": placed(links), "n_links": placed(links),
        "n_overlaps": placed(per_text(found.overlaps[0], a_ends)), "n_shared": placed(np.diff(np.concatenate([[0], np.cumsum(sizes[0] * sizes[1])])[ends], prepend=0)),
        "groups": placed_list(own.spell(found, ends), ""), "pairs": placed_list([pairs[b:e].tobytes() for b, e in zip(cuts, cuts[1:], strict=False)], b""),
    }


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per text (doc_id, text) ALIGNED: how many tokens, groups, links, overlap links and shared-group links it has, its groups (``a1,a2|b1;a3|b2``), and ``pairs``,
    the id pair of each link in order: a's id times b's vocabulary plus b's id, in 4 bytes where that is enough and else in 8. One pass, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _aligned(batches, path_a, path_b), ALIGNED)


SHARED = "doc_id long, a_at long, b_at long, a int, b int"


def _shared(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    own = aligner(path_a, path_b)
    for batch in batches:
        for n in range(len(batch)):
            found, _, _ = own.tokens(batch.column("text").slice(n, 1))
            key = batch.column("doc_id").slice(n, 1)
            for i, j in found.shared():
                yield pa.RecordBatch.from_arrays([key.take(pa.array(np.zeros(len(i), np.int64))), pa.array(i), pa.array(j.astype(np.int64)), pa.array(found.a[i].astype(np.int32)), pa.array(found.b[j].astype(np.int32))], [c.split()[0] for c in SHARED.split(", ")])


def shared_group_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each two tokens of one group: their places in their text, and their ids. Blocks of rows leave a task as they are made."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _shared(batches, path_a, path_b), SHARED)


def _pairs(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches with about PAIRS_AT_ONCE pairs, all their pairs, and how many each row has."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column("pairs")).to_numpy(zero_copy_only=False).astype(np.int64)) // np.dtype(kind).itemsize
        cuts = [0, *(np.flatnonzero(np.diff(upto // PAIRS_AT_ONCE)) + 1).tolist(), len(batch)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(begin, end - begin)
            yield part, np.frombuffer(b"".join(part.column("pairs").to_pylist()), kind), np.diff(upto, prepend=0)[begin:end]


def _counted(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, pairs, _ in _pairs(batches, kind):
        new, n = np.unique(pairs, return_counts=True)
        keys, of = np.unique(np.concatenate([keys, new.astype(np.int64)]), return_inverse=True)
        counts = np.bincount(of, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"pair": pa.array(keys), "n": pa.array(counts)})


def pair_counts(aligned: DataFrame, kind: str) -> DataFrame:
    """(pair, n): how many links of the whole corpus hold each id pair. A task sends a row a pair it met at most."""
    return aligned.select("pairs").mapInArrow(lambda batches: _counted(batches, kind), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _weighed(batches: Iterator[pa.RecordBatch], model, kind: str) -> Iterator[pa.RecordBatch]:
    keys, counts, best = model.value
    for part, pairs, sizes in _pairs(batches, kind):
        at = np.searchsorted(keys, pairs.astype(keys.dtype))
        ends = np.cumsum(sizes)
        sums = [np.diff(np.concatenate([[0], np.cumsum(values[at], dtype=np.int64)])[ends], prepend=0) for values in (best, counts)]
        names = [c for c in part.schema.names if c != "pairs"]
        yield pa.RecordBatch.from_arrays([*map(part.column, names), *map(pa.array, sums)], [*names, "n_best", "count_sum"])


def with_corpus_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``aligned`` (some of ALIGNED, with ``pairs``) with n_best, the links whose pair's corpus-wide count is the highest of its b id (ties included), and count_sum, what the links' counts sum to.

    ``aligned`` is written to the shared folder once and read twice; the counts, bounded by the vocabularies, are broadcast.
    """
    spark = aligned.sparkSession
    own = aligner(path_a, path_b)
    kind, n_b = own.pair_type, own.n_b
    path = new_table_path(spark, "alignments")
    aligned.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(aligned.schema).parquet(path)
    counts = pair_counts(rows, kind).toArrow().sort_by("pair")
    keys, n = counts["pair"].to_numpy(), counts["n"].to_numpy()
    highest = np.zeros(n_b, np.int64)
    np.maximum.at(highest, keys % n_b, n)
    model = spark.sparkContext.broadcast((keys, n, n == highest[keys % n_b]))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "pairs") + ", n_best long, count_sum long"
    return rows.mapInArrow(lambda batches: _weighed(batches, model, kind), schema)
