"""Token-ID output: fixed-width bit packing in blocks.

``write_token_files`` tokenizes whole texts in ascending ``doc_id`` order and stores each id in
the fewest bits that the vocabulary needs. A shard is one range of ``doc_id``; its blocks hold
whole documents, so a document is decoded from one block:

    blocks/    shard, block, start (ids before it in its shard), n_tokens, width,
               doc_ids, doc_ends (ids up to and with each document), payload (packed bits)
    manifest/  shard, base (ids of all shards before it), n_tokens

Both are Parquet tables, so any store that Spark reaches will do, the commit protocol drops the
files of lost tasks, and the statistics of ``shard``, ``start`` and ``first_doc`` make point reads
touch few row groups. Id ``i`` of a block is at bit ``i * width`` of its payload, least significant
bit first, so any slice unpacks with numpy and nothing before it is read.

Defined results: a null text counts as empty and yields the end id alone; rows with a null
``doc_id`` come first; repeated ids stay, ordered by text; an empty table gives empty files; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowquery.llm.common import partitions

BLOCK_TOKENS = 1 << 16
FIELDS = [
    ("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("first_doc", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())), ("payload", pa.binary()),
]
BLOCKS = "shard int, block int, start long, n_tokens long, width int, first_doc long, doc_ids array<long>, doc_ends array<long>, payload binary"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` at ``width`` bits each, least significant bit first."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    eights = np.zeros((-(-len(ids) // 8), 8), np.uint64)  # eight ids fill ``width`` bytes
    eights.ravel()[: len(ids)] = ids
    out = np.zeros((len(eights), width), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * width, 8)
        moved = eights[:, k] << np.uint64(shift)
        for j in range((shift + width + 7) // 8):
            out[:, byte + j] |= (moved >> np.uint64(8 * j)).astype(np.uint8)
    return out.tobytes()[: (len(ids) * width + 7) // 8]


def unpack(payload: bytes, width: int, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` (exclusive) of a packed block; reads only the bytes that hold them."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{width // 8}", count=end - begin, offset=begin * width // 8).astype("<u4")
    first, last = begin // 8, -(-end // 8)
    held = np.frombuffer(payload, np.uint8)[first * width : last * width]
    eights = np.zeros((last - first, width), np.uint8)
    eights.ravel()[: len(held)] = held
    out = np.zeros((last - first, 8), "<u4")
    for k in range(8):
        byte, shift = divmod(k * width, 8)
        wide = np.zeros(len(eights), np.uint64)
        for j in range((shift + width + 7) // 8):
            wide |= eights[:, byte + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, k] = (wide >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    return out.ravel()[begin - 8 * first : end - 8 * first]


#: White space, also beyond ASCII, as an RE2 class; an empty piece counts as both kinds of edge.
SPACE = r"[\t-\r \x1c-\x1f\x{85}\p{Z}]"
STARTS_BLANK, ENDS_BLANK = f"^(?:$|{SPACE})", f"(?:^|{SPACE})$"
#: Pieces that are encoded in one call of the library, and that a worker remembers; beyond them it keeps those that it met in several slices.
PIECES_A_CALL, KNOWN_PIECES = 20_000, 400_000
#: Pieces of characters that are letters, digits or marks in every version of Unicode, line ends between them allowed.
PLAIN = r"^[!-~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17e}]+(?:\n+[!-~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17e}]+)*$"
#: How byte-level vocabularies spell bytes: printable ones as themselves, the others, in order, from U+0100 on.
SPELT = np.arange(256, dtype="<u4")
SPELT[[*range(0x21), *range(0x7F, 0xA1), 0xAD]] = np.arange(0x100, 0x144)
#: What a byte-level tokenizer's pattern finds in such pieces, each behind a space, as they are spelt: U+0120 is a space, U+010A a line end.
PARTS = re.compile("'(?:[stmd]|re|ve|ll)|\u0120?[^!-@\\[-`{-~\u0120\u010a]+|\u0120?[0-9]+|\u0120?[!-/:-@\\[-`{-~]+|\u010a+(?=\u010a)|\u010a")
#: Bytes of text that are encoded at once; a longer text is alone.
SLICE_BYTES = 3_000_000


def picked(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parts of ``pool`` of those places and sizes, one after the other."""
    upto = np.cumsum(sizes)
    return pool[np.repeat(begins - (upto - sizes), sizes) + np.arange(int(sizes.sum()))]


class Encoder:
    """Encodes batches of texts with the tokenizers library, each distinct piece of a batch once.

    A byte-level tokenizer splits texts by a fixed pattern before it merges, and that pattern
    always splits before a space between other characters. So texts are cut there, in Arrow; the
    distinct pieces are joined by spaces and encoded, and as no token but a piece's first one starts with a
    space, the ids fall apart into pieces again. Pieces of characters whose kind is beyond doubt are spelt and
    split here as the pattern does it, many at once, which leaves the library its merges. A text with a space amid other white space is cut only
    where no blank is near; texts with special tokens go to the library whole, and so do all texts of
    tokenizers of other kinds.
    """

    #: Where a text may be cut for certain.
    CUT = re.compile(r"(?<=\S) (?=\S)")
    #: The library's merges, of parts that are spelt and split already, where the pattern is known.
    merges = None

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec.get("normalizer") is None
        self.special = [x["content"] for x in spec.get("added_tokens", ())]
        if self.cuts:
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # how such vocabularies spell a space
        self.known: dict[str, int] = {}  # the number of each piece, in order
        self.again = np.zeros(0, bool)  # whether it was met again
        self.pool, self.begins, self.sizes, self.held = [], [], [], 0

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: pa.Array) -> None:
        """Add the ids of ``pieces``, each behind a space, to the pool."""
        if self.merges:
            plain = pc.match_substring_regex(pieces, PLAIN)
            self._learn_plain(pieces.filter(plain))
            pieces = pieces.filter(pc.invert(plain))
        blank = pc.match_substring_regex(pieces, f"^$|^{SPACE}|{SPACE}$| ").to_numpy(zero_copy_only=False)
        for at in range(0, len(pieces), PIECES_A_CALL):
            some, odd = pieces.slice(at, PIECES_A_CALL), blank[at : at + PIECES_A_CALL]
            plain, others = some.filter(pa.array(~odd)), some.filter(pa.array(odd))
            if len(plain):
                joined = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), " ")[0].as_py()
                [ids] = self._each([" " + joined])
                first = np.flatnonzero(self.spaced[ids])
                if len(first) == len(plain):
                    self._remember(plain, [ids], np.diff(first, append=len(ids)))
                else:  # a special token across pieces
                    others = some
            if len(others):
                found = self._each([" " + p for p in others.to_pylist()])
                self._remember(others, found, np.array([len(x) for x in found]))

    def _learn_plain(self, pieces: pa.Array) -> None:
        """The same of pieces that match PLAIN."""
        for at in range(0, len(pieces), PIECES_A_CALL):
            some = pieces.slice(at, PIECES_A_CALL)
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py()
            spelt = SPELT[np.frombuffer(f" {joined}".encode(), np.uint8)].tobytes().decode("utf-32-le")
            [found] = self.merges.encode_batch_fast([" ".join(PARTS.findall(spelt))], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            first = np.flatnonzero(self.spaced[ids])
            self._remember(some, [ids], np.diff(first, append=len(ids)))

    def _remember(self, pieces: pa.Array, ids: list[np.ndarray], sizes: np.ndarray) -> None:
        known = len(self.known)
        self.known.update(zip(pieces.to_numpy(zero_copy_only=False).tolist(), range(known, known + len(pieces)), strict=True))
        self.begins.append(self.held + np.cumsum(sizes) - sizes)
        self.sizes.append(sizes)
        self.pool += ids
        self.held += int(sizes.sum())

    def _forget(self) -> None:
        """Keep the pieces that were met again since they were learnt or last kept, half of KNOWN_PIECES at most."""
        kept = np.flatnonzero(self.again)[: KNOWN_PIECES // 2]
        sizes = self.sizes[0][kept]
        self.pool = [picked(self.pool[0], self.begins[0][kept], sizes)]
        self.begins, self.sizes, self.held = [np.cumsum(sizes) - sizes], [sizes], len(self.pool[0])
        names = list(self.known)
        self.known = {names[i]: n for n, i in enumerate(kept.tolist())}
        self.again = np.zeros(len(kept), bool)

    def _spaced(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of ``pieces``, each behind a space, in the pool."""
        if len(self.known) > KNOWN_PIECES:
            self._forget()
        names = pieces.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(numbers < 0)
        self.again[numbers[numbers >= 0]] = True
        if len(new):
            self.again = np.append(self.again, np.zeros(len(new), bool))
            self._learn(pieces.take(pa.array(new)))
            numbers[new] = [self.known[names[i]] for i in new.tolist()]
            for parts in (self.pool, self.begins, self.sizes):
                parts[:] = [np.concatenate(parts)]
        return numbers

    def _gather(self, pieces: pa.Array, offsets: np.ndarray) -> list[np.ndarray] | np.ndarray:
        """The ids of texts that are cut into ``pieces``, or which texts are cut where they may not be."""
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        starts, ends = np.zeros((2, len(coded.dictionary)), bool)
        edge = np.flatnonzero(pc.match_substring_regex(coded.dictionary, f"^$|^{SPACE}|{SPACE}$").to_numpy(zero_copy_only=False))  # few
        for flags, x in ((starts, STARTS_BLANK), (ends, ENDS_BLANK)):
            flags[edge] = pc.match_substring_regex(coded.dictionary.take(pa.array(edge)), x).to_numpy(zero_copy_only=False)
        near = ends[codes[:-1]] & starts[codes[1:]]
        near[offsets[1:-1] - 1] = False  # pieces of two texts
        if near.any():
            return np.unique(np.searchsorted(offsets, np.flatnonzero(near), "right") - 1)
        return self._ids(coded.dictionary, codes, offsets)

    def _ids(self, distinct: pa.Array, codes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        first, of = np.unique(codes[offsets[:-1]], return_inverse=True)
        bare = self._each(distinct.take(pa.array(first)).to_pylist())  # no space stands before a text's first piece
        lengths = np.array([len(x) for x in bare])
        numbers = self._spaced(distinct)
        begins = np.concatenate([self.begins[0][numbers], self.held + np.cumsum(lengths) - lengths])
        sizes = np.concatenate([self.sizes[0][numbers], lengths])
        codes = codes.astype(np.int64)
        codes[offsets[:-1]] = len(distinct) + of
        flat = picked(np.concatenate([self.pool[0], *bare]), begins[codes], sizes[codes])
        return np.split(flat, np.cumsum(sizes[codes])[offsets[1:-1] - 1])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each of ``texts`` (null: none)."""
        out: list[np.ndarray] = []
        for _, some in slices(texts):
            out += self._encode(pc.fill_null(some, ""))
            pa.default_memory_pool().release_unused()
        return out

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        whole = np.full(len(texts), not self.cuts)
        for x in self.special if self.cuts else ():
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(texts)
        todo, cut = np.flatnonzero(~whole), None
        if len(todo):
            cut = pc.split_pattern(texts.take(pa.array(todo)), " ")
            found = self._gather(cut.flatten(), cut.offsets.to_numpy() - cut.offsets[0].as_py())
            if isinstance(found, np.ndarray):
                careful = np.zeros(len(todo), bool)
                careful[found] = True
                for i, x in zip(todo[careful].tolist(), self._carefully(texts.take(pa.array(todo[careful]))), strict=True):
                    out[i] = x
                todo = todo[~careful]
                cut = cut.filter(pa.array(~careful))
                found = self._gather(cut.flatten(), cut.offsets.to_numpy() - cut.offsets[0].as_py()) if len(todo) else []
            for i, x in zip(todo.tolist(), found, strict=True):
                out[i] = x
        rest = np.flatnonzero(whole)
        for i, x in zip(rest.tolist(), self._each(texts.take(pa.array(rest)).to_pylist()), strict=True):
            out[i] = x
        return out

    def _carefully(self, texts: pa.Array) -> list[np.ndarray]:
        cut = [self.CUT.split(x) for x in texts.to_pylist()]
        coded = pa.array([p for x in cut for p in x], pa.string()).dictionary_encode()
        return self._ids(coded.dictionary, coded.indices.to_numpy(), np.concatenate([[0], np.cumsum([len(x) for x in cut])]))


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of ``texts`` of about SLICE_BYTES, with the place of their first: what is encoded at once takes several times its size."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(upto // SLICE_BYTES)) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
        if end > begin:
            yield begin, texts.slice(begin, end - begin)


@cache
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def _encode_shard(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    end = np.array([end_id], "<u4")
    docs: list = []
    ids: list[np.ndarray] = []
    held = block = start = 0

    def flush() -> pa.RecordBatch:
        nonlocal docs, ids, held, block, start
        ends = np.cumsum([len(x) + 1 for x in ids])
        row = [shard, block, start, int(ends[-1]), width, docs[0], docs, ends, pack(np.concatenate([y for x in ids for y in (x, end)]), width)]
        docs, ids, held, block, start = [], [], 0, block + 1, start + int(ends[-1])
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, (_, kind) in zip(row, FIELDS, strict=True)], [name for name, _ in FIELDS])

    for batch in batches:
        keys = batch.column("doc_id").to_pylist()
        for begin, texts in slices(batch.column("text")):
            for key, found in zip(keys[begin:], encoder(path).encode(texts), strict=False):
                docs.append(key)
                ids.append(found.copy())  # not a view of all that was encoded at once
                held += len(found) + 1
                if held >= BLOCK_TOKENS:
                    yield flush()
    if docs:
        yield flush()


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Write the token files of ``docs`` (doc_id, text) under ``path``.

    One shuffle deals the texts by ranges of ``doc_id``; each task then streams its range in order.
    """
    spark = docs.sparkSession
    width = bits_for(max(encoder(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda batches: _encode_shard(batches, tokenizer_path, end_id, width), BLOCKS).write.parquet(f"{path}/blocks")
    shards = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"))
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    shards.select("shard", F.coalesce(before, F.lit(0)).cast("long").alias("base"), "n_tokens").coalesce(1).write.parquet(f"{path}/manifest")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``base``, the ids before their shard. The manifest has a row a shard, so it is broadcast."""
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "base")
    return spark.read.parquet(f"{path}/blocks").join(F.broadcast(manifest), "shard")


def _decode(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"], row["width"], 0, row["n_tokens"])
            ends = np.array(row["doc_ends"], np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            parts = [ids[b:e] for b, e in zip(begins, ends, strict=True)]
            out = {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "start": pa.array(row["base"] + row["start"] + begins, pa.int64()),
                "n_tokens": pa.array(ends - begins, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return read_blocks(spark, path).mapInArrow(lambda batches: _decode(batches, with_ids), schema)


def read_ids(spark: SparkSession, path: str, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` (exclusive) of the whole corpus: a point read, for small ranges."""
    first = F.col("base") + F.col("start")
    near = read_blocks(spark, path).where((first < end) & (first + F.col("n_tokens") > begin)).select(first.alias("first"), "n_tokens", "width", "payload")
    parts = [unpack(r.payload, r.width, max(0, begin - r.first), min(r.n_tokens, end - r.first)) for r in sorted(near.collect())]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")
