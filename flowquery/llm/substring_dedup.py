"""Substring dedup by fixed-block anchors.

A window is ``WINDOW`` = 13 consecutive words. Any window that two documents share holds, whole, one of
the non-overlapping ``BLOCK`` = 7-word blocks into which either document is cut (2 * 7 - 1 = 13). So:

1. ``index`` and ``probe``: each document sends its non-overlapping blocks as reference blocks, and every
   rolling 7-word window as a probe, to the bucket of its hash; a bucket answers which probes meet a
   block of a document with a smaller id, and which blocks are met;
2. ``extend``: windows around an answered place are extended word by word, as far as all 13-word windows on
   the way are repeats of a document with a smaller id, decided by two independent 64-bit hashes of whole windows in
   a second exchange. The runs of repeated windows are the maximal repeats; their words go.

Whole copies are settled before: a text that a smaller id has, too, loses all its words (if it has a window
at all) and is no reference for others, as the smaller id is. So copies, however many, send nothing; what is known of
a text goes to each group that has it once.

Documents are dealt to groups by a hash of ``doc_id`` (about ``GROUP_CHARS`` characters each), and that one
shuffle of the texts serves all steps. What two documents of one group share is settled in it, and of a
group only the smallest (or, as a probe, also the greatest) id with a block or window sends it: a passage that a third of all
documents share reaches its bucket once a group. Exchanges carry packed arrays, a few bytes a probe: parts
of a hash where a false alarm costs only an extension try, whole 64-bit hashes where windows are
decided, of both of two lanes.

Defined results: a null text has no words; texts under 13 words keep all; a row with a null
``doc_id`` is after all others and keeps all its words, as no id is smaller than a null; rows with one id
never remove each other's words; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from flowquery.llm.common import materialize

WINDOW, BLOCK = 13, 7
#: Characters in a group of documents, and words whose windows a bucket gets, on average.
GROUP_CHARS = 4_000_000
BUCKET_WORDS = 2_000_000
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (a fixed bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Odd factors for positions in a window, one for each lane of hashes.
IN_WINDOW = (U(0xD6E8FEB86659FD93), U(0x5851F42D4C957F2D))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two lanes of 64-bit hashes of all words (between blanks) of ``texts``, each distinct word hashed once, and the number of words of each text."""
    packed = pa.array(texts, pa.large_binary())
    cut = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(packed), *packed.buffers()[1:]))
    words, offsets = cut.flatten(), cut.offsets.to_numpy()
    full = pc.not_equal(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    coded = words.filter(full).cast(pa.large_binary()).dictionary_encode()
    distinct = np.frombuffer(b"".join(map(xxh3_128_digest, coded.dictionary.to_numpy(zero_copy_only=False).tolist())), "<u8").reshape(-1, 2)
    return distinct[coded.indices.to_numpy()].T.copy(), np.diff(before[offsets])


def windows(words: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= IN_WINDOW[lane]
        out += words[k : k + n]
    return _mix(out)


class Group:
    """The documents of one group in order of id, and all their windows.

    ``doc``: the row of each window; ``rank``: the order of its id; ``place``: its number among all windows of its size.
    """

    def __init__(self, rows: pd.DataFrame):
        rows = rows.assign(text=[x if isinstance(x, bytes) else b"" for x in rows["text"]])
        self.rows = rows.sort_values(["doc_id", "text"], kind="stable").reset_index(drop=True)
        self.ids = self.rows["doc_id"].to_numpy(np.int64)
        self.words, self.counts = word_hashes(self.rows["text"].tolist())

    def numbers(self, size: int) -> np.ndarray:
        """How many windows of ``size`` each document has."""
        return np.maximum(self.counts - size + 1, 0)

    def rolling(self, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """hash, row and first word of each window of ``size``."""
        n = self.numbers(size)
        row = np.repeat(np.arange(len(n)), n)
        first = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return windows(self.words[lane], size, lane)[(np.cumsum(self.counts) - self.counts)[row] + first], row, first

    def ends(self, hashes: np.ndarray, row: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per window: the id of its document, and the least and the greatest id of the group's documents with it. ``second``: the other lane's hashes, which must be equal, too."""
        ids = self.ids[row]
        _, of = np.unique(hashes, return_inverse=True)
        if second is not None and len(of):
            one = np.zeros(of.max() + 1, np.uint64)
            one[of] = second
            if (one[of] != second).any():  # different windows with one hash
                _, of = np.unique(np.stack([hashes, second]), axis=1, return_inverse=True)
                of = of.ravel()
        low = np.full(of.max() + 1 if len(of) else 0, np.iinfo(np.int64).max)
        high = np.full(len(low), np.iinfo(np.int64).min)
        np.minimum.at(low, of, ids)
        np.maximum.at(high, of, ids)
        return ids, low[of], high[of]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U(40)) % U(buckets)).astype(np.int64)


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(buckets[part[0]]), part


def places(numbers: np.ndarray) -> bytes:
    """Rising numbers as their steps: a byte each, 255 and the whole in 8 bytes where a step is larger."""
    steps = np.diff(numbers, prepend=0)
    if not len(steps) or steps.max() < 255:
        return steps.astype(np.uint8).tobytes()
    out, small = [], steps < 255
    at = 0
    for k in np.flatnonzero(~small):
        out.append(steps[at:k].astype(np.uint8).tobytes() + b"\xff" + int(steps[k]).to_bytes(8, "little"))
        at = k + 1
    return b"".join(out) + steps[at:].astype(np.uint8).tobytes()


def numbers(data: bytes) -> np.ndarray:
    """What ``places`` packed."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw) or raw.max() < 255:
        return np.cumsum(raw, dtype=np.int64)
    steps, at = [], 0
    while True:
        k = data.find(b"\xff", at)
        steps.append(raw[at : k if k >= 0 else None].astype(np.int64))
        if k < 0:
            return np.cumsum(np.concatenate(steps))
        steps.append(np.array([int.from_bytes(data[k + 1 : k + 9], "little")], np.int64))
        at = k + 9


SENT = "bucket int, grp int, blocks binary, block_ids binary, block_at binary, probes binary, probe_ids binary, probe_at binary"
ANSWER = "grp int, bucket int, at binary"


def copies(dealt: DataFrame) -> DataFrame:
    """As ANSWER with bucket -1, the MD5 of a text that several ids have and their least id: a row for each group that has a greater one.

    Ids are reduced to the least and greatest of a text in a group before anything meets, and both sides of the join are tables, so Spark can split a text that all groups have.
    """
    marked = dealt.where(F.col("text").isNotNull()).select("doc_id", "grp", F.unhex(F.md5("text")).alias("digest"))
    pairs = materialize(marked.groupBy("digest", "grp").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "copies_by_group")
    first = materialize(pairs.groupBy("digest").agg(F.min("least").alias("first"), F.max("most").alias("last")).where("first < last").select("digest", "first"), "first_copies")
    found = pairs.join(first, "digest").where("most > first")
    return found.select("grp", F.lit(-1).alias("bucket"), F.concat("digest", F.unhex(F.lpad(F.hex("first"), 16, "0"))).alias("at"))


def _split(rows: pd.DataFrame, answers: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, list[bytes]]:
    """The rows that are no copies, the copies, and the places answered."""
    first = {a[:16]: int.from_bytes(a[16:], signed=True) for b, a in zip(answers["bucket"], answers["at"], strict=True) if b < 0}
    copy = np.zeros(len(rows), bool)
    if first:
        copy = np.array([isinstance(t, bytes) and first.get(hashlib.md5(t).digest(), d) < d for d, t in zip(rows["doc_id"].tolist(), rows["text"], strict=True)], bool)
    return rows[~copy], rows[copy], [a for b, a in zip(answers["bucket"], answers["at"], strict=True) if b >= 0]


def _send_blocks(rows: pd.DataFrame, known: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Step 1 in a group: its reference blocks, of each hash only the least id's, and its probes, of each hash only those of the least and the greatest id."""
    out = []
    rows, _, _ = _split(rows, known)
    group = Group(rows)
    hashes, row, first = group.rolling(BLOCK)
    ids, low, high = group.ends(hashes, row)
    asks = (ids == low) | (ids == high)
    own = np.flatnonzero(first % BLOCK == 0)
    refers = np.zeros(len(ids), bool)
    refers[own] = ids[own] == group.ends(hashes[own], row[own])[1]
    for bucket, at in by_bucket(np.where(asks | refers, bucket_of(hashes, buckets), -1)):
        if bucket >= 0:
            blocks, probes = at[refers[at]], at[asks[at]]
            packed = [f(x) for x in (blocks, probes) for f in (lambda x: hashes[x].astype(np.uint32).tobytes(), lambda x: _runs(ids[x]), places)]
            out.append((bucket, rows["grp"].iloc[0], *packed))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SENT.split(", ")])


def _runs(ids: np.ndarray) -> bytes:
    """Rising ids, one for each entry, as ids and the number of entries of each."""
    values, counts = np.unique(ids, return_counts=True)
    return np.stack([values, counts]).astype("<i8").tobytes()


def _unrun(data: bytes) -> np.ndarray:
    values, counts = np.frombuffer(data, "<i8").reshape(2, -1)
    return np.repeat(values, counts)


def _meet_blocks(sent: pd.DataFrame) -> pd.DataFrame:
    """Step 1 in a bucket: the probes that meet a block of a smaller id, and the blocks that a larger id's probe meets."""
    block = np.concatenate([np.frombuffer(x, np.uint32) for x in sent["blocks"]])
    probe = np.concatenate([np.frombuffer(x, np.uint32) for x in sent["probes"]])
    block_id = np.concatenate([_unrun(x) for x in sent["block_ids"]])
    probe_id = np.concatenate([_unrun(x) for x in sent["probe_ids"]])
    low = _extreme(block, block_id, probe, np.minimum, np.iinfo(np.int64).max)
    high = _extreme(probe, probe_id, block, np.maximum, np.iinfo(np.int64).min)
    met_probe, met_block = low < probe_id, high > block_id
    out, p, b = [], 0, 0
    for r in sent.itertuples():
        np_, nb = len(r.probes) // 4, len(r.blocks) // 4
        found = np.union1d(numbers(r.probe_at)[met_probe[p : p + np_]], numbers(r.block_at)[met_block[b : b + nb]])
        if len(found):
            out.append((r.grp, r.bucket, places(found)))
        p, b = p + np_, b + nb
    return pd.DataFrame(out, columns=["grp", "bucket", "at"])


def _extreme(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, better: np.ufunc, none: int) -> np.ndarray:
    """For each of ``asked`` the least or greatest of the values whose key is equal, else ``none``."""
    out = np.full(len(asked), none)
    if not len(keys):
        return out
    order = np.argsort(keys, kind="stable")
    own, first = np.unique(keys[order], return_index=True)
    best = better.reduceat(values[order], first)
    at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
    found = own[at] == asked
    out[found] = best[at[found]]
    return out


ASKED = "bucket int, grp int, hashes binary, seconds binary, ids binary, at binary"


def _extend(rows: pd.DataFrame, met: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Step 2 in a group: the windows around met places, of equal ones only the smallest document's, to be decided by whole hashes of both lanes."""
    out = []
    rows, _, places_met = _split(rows, met)
    if len(rows):
        group = Group(rows)
        hashes, row, first = group.rolling(WINDOW)
        second = group.rolling(WINDOW, 1)[0]
        ids, low, _ = group.ends(hashes, row, second)
        for bucket, at in by_bucket(np.where((ids == low) & _near(group, places_met, row, first), bucket_of(hashes, buckets), -1)):
            if bucket >= 0:
                out.append((bucket, rows["grp"].iloc[0], hashes[at].tobytes(), second[at].tobytes(), _runs(ids[at]), places(at)))
    return pd.DataFrame(out, columns=["bucket", "grp", "hashes", "seconds", "ids", "at"])


def _near(group: Group, met: list[bytes], row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The windows that hold, whole, a block-sized window at a met place, or one that a document of the group shares."""
    hashes, block_row, _ = group.rolling(BLOCK)
    _, low, high = group.ends(hashes, block_row)
    hit = low != high
    for at in met:
        hit[numbers(at)] = True
    before = np.concatenate([[0], np.cumsum(hit)])
    counts = group.numbers(BLOCK)
    base = (np.cumsum(counts) - counts)[row] + first if len(row) else np.zeros(0, np.int64)
    return before[base + WINDOW - BLOCK + 1] > before[base]


def _decide(asked: pd.DataFrame) -> pd.DataFrame:
    """Step 2 in a bucket: the windows that a smaller id has."""
    hashes, second = (np.concatenate([np.frombuffer(x, np.uint64) for x in asked[c]]) for c in ("hashes", "seconds"))
    ids = np.concatenate([_unrun(x) for x in asked["ids"]])
    order = np.lexsort((ids, second, hashes))
    new = np.concatenate([[True], (np.diff(hashes[order]) != 0) | (np.diff(second[order]) != 0)])
    least = ids[order][np.flatnonzero(new)[np.cumsum(new) - 1]]  # the first of each run of equal windows
    repeated = np.zeros(len(ids), bool)
    repeated[order] = least < ids[order]
    out, p = [], 0
    for r in asked.itertuples():
        n = len(r.hashes) // 8
        if (found := numbers(r.at)[repeated[p : p + n]]).size:
            out.append((r.grp, r.bucket, places(found)))
        p += n
    return pd.DataFrame(out, columns=["grp", "bucket", "at"])


RESULT = "doc_id long, n_words long, n_removed long, kept_text binary"


def _remove(rows: pd.DataFrame, decided: pd.DataFrame) -> pd.DataFrame:
    """The words of each document outside all repeated windows."""
    out = []
    rows, whole, places_gone = _split(rows, decided)
    for doc_id, text in zip(whole["doc_id"], whole["text"], strict=True):
        words = text.split()
        kept = words if len(words) < WINDOW else []
        out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept)))
    if len(rows):
        group = Group(rows)
        hashes, row, first = group.rolling(WINDOW)
        ids, low, _ = group.ends(hashes, row, group.rolling(WINDOW, 1)[0])
        gone = ids != low  # a smaller id of the same group has it
        for at in places_gone:
            gone[numbers(at)] = True
        counts = group.numbers(WINDOW)
        bases = np.cumsum(counts) - counts
        for k, (doc_id, text) in enumerate(zip(group.rows["doc_id"], group.rows["text"], strict=True)):
            words = text.split()
            starts = np.flatnonzero(gone[bases[k] : bases[k] + counts[k]])
            if not len(starts):
                out.append((doc_id, len(words), 0, b" ".join(words)))
                continue
            marks = np.zeros(len(words) + 1, np.int64)
            marks[starts] += 1
            np.add.at(marks, starts + WINDOW, -1)
            covered = np.cumsum(marks)[:-1] > 0
            kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept)))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = max(1, math.ceil(chars / GROUP_CHARS)), max(1, math.ceil(chars / 6 / BUCKET_WORDS))
    dealt = docs.where(F.col("doc_id").isNotNull()).withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))
    by_group = dealt.groupBy("grp")
    known = materialize(copies(dealt), "copies")

    def told(function, answers: DataFrame, schema: str) -> DataFrame:
        """``function`` of each group's documents and of what is known and answered about them."""
        return by_group.cogroup(answers.groupBy("grp")).applyInPandas(function, schema)

    met = told(lambda rows, a: _send_blocks(rows, a, buckets), known, SENT).groupBy("bucket").applyInPandas(_meet_blocks, ANSWER)
    asked = told(lambda rows, a: _extend(rows, a, buckets), met.unionByName(known), ASKED)
    decided = asked.groupBy("bucket").applyInPandas(_decide, ANSWER)
    out = told(_remove, decided.unionByName(known), RESULT)
    return out.unionByName(docs.where(F.col("doc_id").isNull()).mapInPandas(_keep_all, RESULT))


def _keep_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = [(x or b"").split() for x in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": [len(w) for w in words], "n_removed": 0, "kept_text": [b" ".join(w) for w in words]})


def brute_force(texts: list[tuple[int, str]]) -> list[tuple[int, int, int, str]]:
    """(doc_id, n_words, n_removed, kept_sha256), for small tests: looks at all windows of all texts."""
    split = [(d, (t or "").encode().split()) for d, t in texts]
    least: dict[tuple, int] = {}
    for d, w in split:
        for k in range(len(w) - WINDOW + 1):
            key = tuple(w[k : k + WINDOW])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, w in split:
        gone = {p for k in range(len(w) - WINDOW + 1) if least[tuple(w[k : k + WINDOW])] < d for p in range(k, k + WINDOW)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
