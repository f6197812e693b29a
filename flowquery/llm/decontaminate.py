"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

A window is ``n`` consecutive words of a benchmark item (an item of fewer is one window). Each window
is looked up by its rarest terms:

1. ``term_counts``: how often each benchmark term occurs in the corpus;
2. ``anchors``: the ``ANCHORS`` rarest terms of each window, and the ``SIDE_ANCHORS`` rarest of each of its halves, with their
   offsets in it;
3. ``postings``: (term, document, position) of the anchor terms in the corpus, with the words around
   the position; other terms are not stored;
4. ``intersect``: offset-adjusted postings (position - offset) are intersected over a window's anchors;
   what agrees is compared with the window's words in full: exact matches;
5. ``near``: places where every side anchor stands within ``SLOP`` words of where the rarest one has it, although the window
   does not: proximity matches, which see words that were inserted, left out or replaced in either half.

A posting of a window's rarest term carries the words around it, so no match needs a second read of the texts. A corpus
row meets only the windows that share a rare term with it, and what is shuffled are agreeing postings and one row per
document. Terms go to all tasks in blocks of ``TERM_ROWS`` at most; windows do so up to ``BLOCK_ROWS`` rows, and beyond that are
joined with the postings by a shuffle of both.

Defined results: a null or empty text has no words and is clean; repeated rows each give their row;
a null ``item_id`` counts as an item without a name (in ``n_items``, not in the digest's names);
an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquery.llm.common import fold_ascii, materialize

N = 10
ANCHORS, SIDE_ANCHORS = 2, 2
SLOP = 3
#: Rows of anchors (under 1 kB each) and terms (some 50 bytes) that go to all tasks at once.
BLOCK_ROWS, TERM_ROWS = 20_000, 500_000
#: As the words' separators, but A-Z, which are folded word by word.
CASED_NON_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Tells rows apart, with ``doc_id``: equal ones hold equal texts.
KEY = ("doc_id", "digest")


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{CASED_NON_WORD}]+"), "")


def fold_word(word: Column) -> Column:
    return F.when(F.lower(word) == word, word).otherwise(fold_ascii(word))


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(win, item_id, size, words): the distinct windows of each item; ``win`` numbers contents."""
    items = benchmark.select("item_id", raw_words(fold_ascii(F.col("text"))).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - n + 1, F.lit(1)))
    rows = items.select("item_id", "all", F.explode(starts).alias("at")).select("item_id", F.slice("all", F.col("at"), n).alias("words"))
    return rows.distinct().select(F.xxhash64("words").alias("win"), "item_id", F.size("words").alias("size"), "words")


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, words, pos, term) for each word."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), raw_words(F.col("text")).alias("words"))
    return rows.select(*KEY, "words", F.posexplode("words").alias("pos", "raw")).select(*KEY, "words", "pos", fold_word(F.col("raw")).alias("term"))


def blocks(rows: DataFrame, count: int, key: str) -> list[DataFrame]:
    """``rows`` in parts of about ``TERM_ROWS``, whole by ``key``."""
    parts = max(1, math.ceil(count / TERM_ROWS))
    return [rows] if parts == 1 else [rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in the corpus of each of ``terms``. Counts are summed before they are shuffled."""
    found = [tokens(docs).join(F.broadcast(part), "term").groupBy("term").agg(F.count("*").alias("n")) for part in blocks(terms, terms.count(), "term")]
    return terms.join(reduce(DataFrame.union, found), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(windows: DataFrame, counts: DataFrame, k: int = ANCHORS) -> DataFrame:
    """(term, win, size, rank, offset, of, second, sides, words): the ``k`` rarest distinct terms of each window, rank 0 the rarest, of ``of``; ``second``: the offset of the last of them; ``sides``: (offset, term) of the rarest of each half.

    The offset is that of the term's first occurrence (in ``sides``: in its half). Every anchor of a window must agree, so
    terms that the corpus lacks rule their windows out without any posting.
    """
    contents = windows.dropDuplicates(["win", "words"]).select("win", "size", "words")
    places = contents.select("win", "size", "words", F.posexplode("words").alias("offset", "term")).join(counts, "term")
    terms = places.groupBy("win", "size", "words", "term", "n").agg(F.min("offset").alias("offset"))
    by = Window.partitionBy("win", "words").orderBy("n", "term")
    ranked = terms.withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < k)
    half = (2 * F.col("offset") >= F.col("size")).alias("half")
    sides = places.groupBy("win", "words", half, "term", "n").agg(F.min("offset").alias("offset"))
    sides = sides.withColumn("rank", F.row_number().over(Window.partitionBy("win", "words", "half").orderBy("n", "term"))).where(F.col("rank") <= SIDE_ANCHORS)
    sides = sides.groupBy("win", "words").agg(F.sort_array(F.collect_list(F.struct("offset", "term"))).alias("sides"))
    whole = Window.partitionBy("win", "words")
    return ranked.withColumn("of", F.count("*").over(whole)).withColumn("second", F.max_by("offset", "rank").over(whole)).join(sides, ["win", "words"])


def postings(docs: DataFrame, terms: DataFrame, n: int = N) -> DataFrame:
    """(term, doc_id, digest, pos, before, around): occurrences of ``terms`` (term, rarest).

    ``around``: the words from ``before`` places ahead to as many behind, unfolded, as a window and its slop may reach, kept for terms that are the rarest of some window.
    """
    reach = n - 1 + SLOP
    before = F.least(F.col("pos"), F.lit(reach))
    around = F.when(F.col("rarest"), F.slice("words", F.col("pos") - before + 1, before + reach + 1))
    hits = tokens(docs).join(F.broadcast(terms), "term")
    return hits.select("term", *KEY, "pos", before.alias("before"), around.alias("around"))


def intersect(posts: DataFrame, anchors_: DataFrame) -> DataFrame:
    """(win, words, size, doc_id, digest, at, exact): where all anchors of a window agree on its start ``at``."""
    moved = posts.join(anchors_, "term").select("win", "size", "words", "rank", "of", *KEY, (F.col("pos") - F.col("offset")).alias("at"), "before", "around", "offset", "second")
    moved = moved.where(F.col("at") >= 0)
    # The rarest term's context is compared first where the other anchor should be, then in full; what differs is not shuffled.
    begin = F.col("before") - F.col("offset") + 1
    other = fold_word(F.get("around", begin - 1 + F.col("second"))) == F.element_at("words", F.col("second") + 1)
    full = F.transform(F.slice("around", F.greatest(begin, F.lit(1)), F.col("size")), fold_word) == F.col("words")
    moved = moved.withColumn("same", F.when(F.col("rank") == 0, F.when(other, full).otherwise(False))).where((F.col("rank") > 0) | F.col("same"))
    agreeing = moved.groupBy("win", "size", "of", *KEY, "at")
    # Which ranks agree, as bits: rows that are repeated do not count twice.
    found = agreeing.agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("rank"))).alias("ranks"), F.bool_or("same").alias("exact"))
    return found.where((F.bit_count("ranks") == F.col("of")) & F.col("exact")).select("win", "size", *KEY, "at")


def near(posts: DataFrame, anchors_: DataFrame, slop: int = SLOP) -> DataFrame:
    """(win, words, doc_id, digest, at): the rarest term's postings around which every side anchor stands within ``slop`` places of where the window has it, the window itself or not.

    Looks at the posting's own context, so nothing is shuffled before it holds. Windows with a single anchor have no neighbours.
    """
    rarest = anchors_.where((F.col("rank") == 0) & (F.size("sides") > 1)).select("term", "win", "words", "sides", "offset")
    moved = posts.where(F.col("around").isNotNull()).join(rarest, "term")

    def stands(side: Column) -> Column:
        here = side["offset"] - F.col("offset") + F.col("before") + 1
        first = F.greatest(here - slop, F.lit(1))
        some = F.slice("around", first, F.greatest(here + slop - first + 1, F.lit(0)))
        return F.exists(some, lambda w: fold_word(w) == side["term"])

    return moved.where(F.forall("sides", stands)).select("win", "words", *KEY, (F.col("pos") - F.col("offset")).alias("at")).distinct()


def only_near(close: DataFrame, exact: DataFrame, slop: int = SLOP) -> DataFrame:
    """The proximity matches without an exact match of their window within ``slop`` places."""
    exact = exact.select(F.col("win").alias("__win"), *(F.col(k).alias(f"__{k}") for k in KEY), F.col("at").alias("__at"))
    on = [close["win"] == exact["__win"], *(close[k].eqNullSafe(exact[f"__{k}"]) for k in KEY), F.abs(close["at"] - exact["__at"]) <= slop]
    return close.join(exact, reduce(lambda a, b: a & b, on), "left_anti")


def covered(matches: DataFrame) -> DataFrame:
    """(doc_id, digest, n_hit): words inside any match. Overlaps count once."""
    spans = matches.groupBy(*KEY, "at").agg(F.max("size").alias("size"))
    end = F.col("at") + F.col("size")
    reached = F.max(end).over(Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(end - F.greatest(F.col("at"), F.coalesce(reached, F.lit(0))), F.lit(0))
    return spans.withColumn("new", new).groupBy(*KEY).agg(F.sum("new").alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (proximity matches) and digest (a hash of the text)."""
    docs = docs.select("doc_id", "text")
    windows = materialize(item_windows(benchmark.select("item_id", "text"), n), "windows")
    terms = windows.select(F.explode("words").alias("term")).distinct()
    counts = materialize(term_counts(docs, terms), "term_counts")
    picked = materialize(anchors(windows, counts), "anchors")
    wanted = materialize(picked.groupBy("term").agg(F.bool_or(F.col("rank") == 0).alias("rarest")), "anchor_terms")
    posts = materialize(reduce(DataFrame.union, [postings(docs, part, n) for part in blocks(wanted, wanted.count(), "term")]), "postings")
    picked = F.broadcast(picked) if picked.count() <= BLOCK_ROWS else picked
    found = materialize(intersect(posts, picked), "matches")
    hits = covered(found)
    items = found.select("win", *KEY).distinct().join(windows.select("win", "item_id"), "win").select(*KEY, "item_id").distinct()
    names = F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",")
    by_doc = items.groupBy(*KEY).agg(F.count("*").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"))
    nearby = only_near(near(posts, picked), found).groupBy(*KEY).agg(F.count("*").alias("n_near"))
    flagged = _null_safe(_null_safe(hits, by_doc, "inner"), nearby, "full")
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.size(raw_words(F.col("text"))).cast("long").alias("n_words"))
    out = _null_safe(rows, flagged, "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items", "n_near")}
    return out.select(
        "doc_id", "n_words", zero["n_hit"], zero["n_items"],
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), zero["n_near"], "digest",
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window."""
    marked = docs.withColumn("__text", F.xxhash64("text"))
    bad = contamination(docs, benchmark, n).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    return marked.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__digest")), "left_anti").select(*docs.columns)


def _null_safe(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join by KEY, where a null ``doc_id`` equals another."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in KEY})
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"__{k}"]) for k in KEY))
    out = left.join(right, on, how)
    if how == "full":
        out = out.withColumns({k: F.coalesce(k, f"__{k}") for k in KEY})
    return out.drop(*(f"__{k}" for k in KEY))
