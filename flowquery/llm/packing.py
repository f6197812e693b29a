"""Best-fit packing of token ids into sequences of several permitted lengths.

Whole texts are encoded and an end id is appended to each. Documents are cut into pieces of the longest permitted
length at most (nothing is dropped) and dealt by a hash to groups of about ``GROUP_TOKENS`` ids; each group is
packed by itself, so no task grows with the corpus. In a group, pieces go in order of falling length to the open
bin that they fill best. Where none has room, the bin opened is that of the least cost for each token it can be
expected to hold, given what is left to pack. That is done once for every choice of the longest length in use, the
cheapest packing is taken, and at last every bin is given the shortest permitted length that holds its contents.
Each bin comes out as a sequence: its ids, packed in the vocabulary's bits, and which pieces they are.

Defined results: a null or empty text is one piece of its end id; pieces of one length go in order of ``doc_id``
(null first), then of a hash of the text, then of their place in it, and of bins that fit equally well the first
opened is taken; repeated rows are packed each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquery.llm.common import materialize
from flowquery.llm.token_files import bits_for, encoder, slices
from flowquery.llm.token_files import pack as pack_bits
from flowquery.llm.token_files import unpack as unpack_bits

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: A sequence costs its length and this much more.
OVERHEAD = 16
GROUP_TOKENS = 4_000_000


def default_cost(capacity: int) -> float:
    return capacity + OVERHEAD


def _pack_up_to(lengths: Sequence[int], capacities: Sequence[int], top: int, cost: Callable[[int], float]) -> tuple[list[int], list[int]]:
    """Best fit, falling lengths given, with bins of ``top`` at most where pieces allow it: the bin of each piece, the capacity of each bin."""
    left = sum(lengths)
    free: list[tuple[int, int]] = []  # (room, bin) in order
    bins: list[int] = []
    caps: list[int] = []
    for n in lengths:
        at = bisect_left(free, (n, -1))
        if at < len(free):
            room, which = free.pop(at)
        else:
            fits = [c for c in capacities if c >= n]
            room = min([c for c in fits if c <= top] or fits[:1], key=lambda c: (cost(c) / min(c, left), c))
            which = len(caps)
            caps.append(room)
        bins.append(which)
        left -= n
        if room > n:
            insort(free, (room - n, which))
    return bins, caps


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = default_cost) -> tuple[list[int], list[int]]:
    """The bin of each piece and the capacity of each bin. ``lengths`` must fall."""
    capacities = sorted(capacities)
    best: tuple[float, list[int], list[int]] | None = None
    for top in capacities:
        bins, caps = _pack_up_to(lengths, capacities, top, cost)
        held = np.bincount(bins, weights=lengths, minlength=len(caps)).astype(int) if bins else []
        fitted = [min((c for c in capacities if c >= h), key=cost) for h in held]  # downsized
        total = sum(map(cost, fitted))
        if best is None or total < best[0]:
            best = total, bins, fitted
    return best[1], best[2]


PIECES = "doc_id long, digest long, copy int, piece int, start long, length int, ids binary"
SEQUENCES = "bin_id string, capacity int, n_tokens int, doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<int>, width int, payload binary"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: int, most: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    for batch in batches:
        keys, seen = list(zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), strict=True)), Counter()
        for begin, texts in slices(batch.column("text")):
            found = []
            for key, ids in zip(keys[begin:], encoder(path).encode(texts), strict=False):
                ids = np.append(ids, np.uint32(end_id))
                for n, at in enumerate(range(0, len(ids), most)):
                    part = ids[at : at + most]
                    found.append((*key, seen[key], n, at, len(part), pack_bits(part, width)))
                seen[key] += 1
            columns = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, most: int = max(CAPACITIES)) -> DataFrame:
    """The token ids of each text, packed in ``width`` bits, in pieces of ``most`` at most. ``copy`` tells equal rows of a batch apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _pieces(batches, tokenizer_path, end_id, width, most), PIECES)


def id_width(spark: SparkSession, tokenizer_path: str, end_id: int = 0) -> int:
    """The bits of an id. A task asks the tokenizer: the driver loads none."""
    sizes = spark.range(0, 1, 1, 1).mapInArrow(lambda batches: _vocabulary_sizes(batches, tokenizer_path), "size long")
    return bits_for(max(sizes.first()["size"], end_id + 1))


def _vocabulary_sizes(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([encoder(path).tokenizer.get_vocab_size()] * len(batch), pa.int64())], ["size"])


def _pack_group(rows: pd.DataFrame, capacities: Sequence[int], width: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "digest", "piece"], ascending=[False, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
    lengths = rows["length"].tolist()
    bins, caps = pack(lengths, capacities)
    ids = [None if pd.isna(d) else int(d) for d in rows["doc_id"]]
    numbers, starts, payloads = rows["piece"].tolist(), rows["start"].tolist(), rows["ids"].tolist()
    held: list[list[int]] = [[] for _ in caps]
    for i, b in enumerate(bins):
        held[b].append(i)
    out = []
    for b, inside in enumerate(held):
        sizes = [lengths[i] for i in inside]
        payload = pack_bits(np.concatenate([unpack_bits(payloads[i], width, 0, lengths[i]) for i in inside]), width)
        out.append((f"{rows['grp'].iloc[0]}:{b}", caps[b], sum(sizes), [ids[i] for i in inside], [numbers[i] for i in inside], [starts[i] for i in inside], sizes, width, payload))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SEQUENCES.split(", ")])


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """The packed sequences, as SEQUENCES: ``payload`` holds ``n_tokens`` ids at ``width`` bits, piece by piece.

    ``starts``: each piece's first token in its document. What is shuffled are the packed ids.
    """
    width = id_width(docs.sparkSession, tokenizer_path, end_id)
    cut = materialize(pieces(docs, tokenizer_path, end_id, width, max(capacities)), "pieces")
    groups = max(1, math.ceil((cut.agg(F.sum("length")).first()[0] or 0) / GROUP_TOKENS))
    cut = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "digest", "copy", "piece"), F.lit(groups)).cast("int"))
    return cut.groupBy("grp").applyInPandas(lambda x: _pack_group(x, capacities, width), SEQUENCES)


def placements(sequences: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_offset, capacity, bin_crc32) of each piece, from the sequences; ``bin_crc32``: of its sequence's payload."""
    before = F.aggregate(F.slice("lengths", 1, F.col("at")), F.lit(0), lambda a, x: a + x)
    whole = sequences.select("bin_id", "capacity", "doc_ids", "pieces", "starts", "lengths", F.crc32("payload").alias("bin_crc32"))  # once a sequence, not a piece
    rows = whole.select("*", F.posexplode("lengths").alias("at", "length"))
    return rows.select(
        F.get("doc_ids", "at").alias("doc_id"), F.get("pieces", "at").alias("piece"), F.get("starts", "at").alias("start"), "length",
        "bin_id", before.alias("bin_offset"), "capacity", "bin_crc32",
    )
