"""Secret scans with a trigram inverted index, in DataFrame functions only.

``trigram_query`` derives from each rule's regex the Boolean trigram query that any text it matches must satisfy: a
disjunction of clauses, each a conjunction of trigrams. ``trigram_index`` holds, per shard of documents and
trigram, the list of documents with it, for the trigrams of a set of rules; it is written once and serves all rules
whose trigrams it has. ``candidates`` intersects the postings of each clause and unites the clauses. ``find_secrets``
verifies the candidates with the regexes themselves; rules without a mandatory trigram scan every text.

Postings are split by a hash of ``doc_id`` into shards of about ``SHARD_DOCS`` documents, so no list
grows with the corpus or with a common trigram. Candidates are broadcast only where their counted
number is within ``BROADCAST_ROWS``; beyond it the join is a shuffle join.

Defined results: a null text counts as empty; an empty text has no spans; rows with a null ``doc_id``
are verified for every rule; repeated rows each give their own row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from re import _parser  # the only part of Python that gives a regex's structure

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquery.llm.common import materialize

SHARD_DOCS = 4096
#: Candidate rows (some 40 bytes each) that may be broadcast.
BROADCAST_ROWS = 1_000_000


#: Strings of one part of a regex, clauses of a query and characters of a class that are told apart; more count as anything.
MOST_STRINGS, MOST_CLAUSES, MOST_CHARACTERS = 128, 128, 10

Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset((frozenset(),))


def _least(clauses) -> Clauses:
    """Without clauses that another one implies."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    """And. Where that makes too many clauses, the shorter side alone, which asks for less."""
    if len(a) * len(b) > MOST_CLAUSES:
        return min(a, b, key=len) if ANY not in (a, b) else max(a, b, key=len)
    return _least({x | y for x in a for y in b})


@dataclass(frozen=True)
class Part:
    """What a part of a regex matches: all its strings (``exact``), or how they begin and end and what they must hold."""

    exact: frozenset[str] | None
    begins: frozenset[str] = frozenset(("",))
    ends: frozenset[str] = frozenset(("",))
    query: Clauses = ANY


ANYTHING = Part(None)


def _holding(strings: frozenset[str]) -> Clauses:
    """What a text that holds one of ``strings`` must hold."""
    return _least({frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in strings})


def _loose(part: Part) -> Part:
    """The same without the whole strings."""
    if part.exact is None:
        return part
    return Part(None, frozenset(x[:2] for x in part.exact), frozenset(x[-2:] for x in part.exact), _holding(part.exact))


def _joined(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return Part(frozenset(x + y for x in a.exact for y in b.exact))
    ends = a.exact if a.exact is not None else a.ends
    begins = b.exact if b.exact is not None else b.begins
    query = _both(_loose(a).query, _loose(b).query)
    across = frozenset(x + y for x in ends for y in begins) if len(ends) * len(begins) <= MOST_STRINGS else frozenset(("",))
    query = _both(query, _holding(across))
    first = across if a.exact is not None else a.begins
    last = across if b.exact is not None else b.ends
    return Part(None, frozenset(x[:2] for x in first), frozenset(x[-2:] for x in last), query)


def _either(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST_STRINGS:
        return Part(frozenset().union(*(p.exact for p in parts)))
    loose = [_loose(p) for p in parts]
    clauses = frozenset().union(*(p.query for p in loose))
    return Part(None, frozenset().union(*(p.begins for p in loose)), frozenset().union(*(p.ends for p in loose)), _least(clauses) if len(clauses) <= MOST_CLAUSES else ANY)


def _letters(characters: set[int]) -> Part:
    """One of ``characters``; those beyond ASCII may fold in other ways and count as anything."""
    folded = {chr(c).lower() for c in characters}
    return Part(frozenset(folded)) if characters and len(folded) <= MOST_CHARACTERS and max(characters) < 128 else ANYTHING


def _class(items: list) -> Part:
    found: set[int] = set()
    for kind, value in items:
        if str(kind) == "LITERAL":
            found.add(value)
        elif str(kind) == "RANGE":
            found |= set(range(value[0], min(value[1], value[0] + 256) + 1))
        else:  # negated, or a category
            return ANYTHING
    return _letters(found)


def _sequence(parsed) -> Part:
    out = Part(frozenset(("",)))
    for kind, value in parsed:
        out = _joined(out, _part(str(kind), value))
    return out


def _part(kind: str, value) -> Part:
    if kind == "LITERAL":
        return _letters({value})
    if kind == "IN":
        return _class(value)
    if kind == "BRANCH":
        return _either([_sequence(x) for x in value[1]])
    if kind == "SUBPATTERN":
        return _sequence(value[-1])
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = value
        once = _sequence(inner)
        if least == 0:
            return _either([Part(frozenset(("",))), once]) if most == 1 else ANYTHING
        out = once
        for _ in range(min(least, 3) - 1):
            out = _joined(out, once)
        if most == least <= 3:
            return out
        last = _loose(once)  # what follows the copies looked at is anything, but ends as the last copy
        return Part(None, _loose(out).begins, last.ends, _loose(out).query)
    return Part(frozenset(("",))) if kind == "AT" else ANYTHING


def trigram_query(regex: str) -> Clauses:
    """Clauses of trigrams, in lower case, one of which all matches of ``regex`` satisfy in full (ANY: no mandatory trigram)."""
    return _loose(_sequence(_parser.parse(regex))).query


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters, else the match is dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0

    def clauses(self) -> list[tuple[str, ...]]:
        """The derived query; none where it asks for nothing."""
        query = trigram_query(self.regex)
        return [] if frozenset() in query else sorted(tuple(sorted(c)) for c in query)


ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE_RULES = (
    Rule("assign", ASSIGN, 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
)
#: Kinds of credentials with a published prefix.
PREFIX_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + PREFIX_RULES


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """An index to keep: ``postings``, and a row without shard for each trigram that it covers, found in a text or not."""
    grams = sorted({g for r in rules for c in r.clauses() for g in c})
    covered = docs.sparkSession.createDataFrame([(g,) for g in grams], "gram string")
    own = postings(docs, rules)
    return own.union(covered.select(F.lit(None).cast(own.schema["shard"].dataType).alias("shard"), "gram", F.array().cast(own.schema["postings"].dataType).alias("postings")))


def served(rule: Rule, grams: set[str]) -> list:
    """The rule's clauses as far as an index of ``grams`` can answer them; none if one of them cannot be narrowed at all."""
    left = [[g for g in clause if g in grams] for clause in rule.clauses()]
    return left if all(left) else []


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(shard, gram, postings): the documents of a shard whose folded text holds ``gram``, for every trigram of the rules' queries."""
    grams = sorted({g for r in rules for c in r.clauses() for g in c})
    shards = max(1, math.ceil(docs.count() / SHARD_DOCS))
    low = F.lower(F.coalesce("text", F.lit("")))  # folds more than A-Z: no match is missed
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams))) if grams else F.array().cast("array<string>")
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", low.alias("low")).select("doc_id", F.explode(held).alias("gram"))
    return rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "gram").agg(F.collect_set("doc_id").alias("postings"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES, clauses_of: dict[str, list] | None = None) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query a document satisfies. ``clauses_of``: a rule's clauses by kind, if not its own."""
    spark = index.sparkSession
    asked = [(r.kind, n, g, len(c)) for r in rules for n, c in enumerate(r.clauses() if clauses_of is None else clauses_of[r.kind]) for g in c]
    clauses = spark.createDataFrame(asked, "kind string, clause int, gram string, grams int")
    lists = index.join(F.broadcast(clauses), "gram").groupBy("shard", "kind", "clause", "grams").agg(F.collect_list("postings").alias("lists"))
    met = F.reduce(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), F.array_intersect)
    found = lists.where(F.size("lists") == F.col("grams")).select(F.explode(met).alias("doc_id"), "kind")
    return found.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def sums(xs: Column, first: Column) -> Column:
    """first, first + x1, first + x1 + x2, ..."""
    return F.reduce(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def running_ends(steps: Column) -> Column:
    """Prefix sums, by blocks of about the root of their number: long lists cost n^1.5, not n^2."""
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(steps))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(steps) - 1) / block).cast("int")), lambda b: F.slice(steps, b * block + 1, block))

    def joined(blocks: Column) -> Column:
        bases = sums(F.transform(blocks, lambda xs: F.reduce(xs, F.lit(0), lambda a, x: a + x)), F.lit(0))
        return F.flatten(F.zip_with(blocks, F.slice(bases, 1, F.size(blocks)), lambda xs, b: F.slice(sums(xs, b), 2, F.size(xs))))

    return let(blocks, joined)


def spans_of(rule: Rule, text: Column) -> Column:
    """The rule's spans in ``text``, leftmost and non-overlapping: array of (start, kind no., kind, end)."""
    number = RULES.index(rule) if rule in RULES else len(RULES)

    def part(group: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(group)), F.char_length)

    def located(x: Column) -> Column:
        """x: the lengths of the matches and of their groups, and of what stands before each."""
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["lengths"])), x["lengths"], lambda g, n: g + n)
        ends = let(steps, running_ends)
        rows = F.filter(F.arrays_zip(ends.alias("end"), x["lengths"].alias("n"), x["kept"].alias("kept")), lambda r: r["kept"] >= rule.least)
        return F.transform(rows, lambda r: F.struct((r["end"] - r["n"]).alias("start"), F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), r["end"].alias("end")))

    gaps = F.transform(F.split(text, rule.regex, -1), F.char_length)
    return let(F.struct(part(0).alias("lengths"), part(rule.group).alias("kept"), gaps.alias("gaps")), located)


def no_spans() -> Column:
    return F.array().cast("array<struct<start:int,number:int,kind:string,end:int>>")


def scan_filter(rule: Rule) -> str:
    """A regex that finds whether a text holds the rule at all."""
    return rule.regex.removesuffix("+") + f"{{{rule.least}}}" if re.fullmatch(r"\[[^\]]*\]\+", rule.regex) and not rule.group and rule.least else rule.regex


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``spans``: by start, then by the order of ``rules``. A null text becomes an empty one.

    ``index``: a ``trigram_index`` of the same documents, made for any rules; without it one is made. Trigrams that it does not cover are
    not asked, and a rule of which nothing can be asked is looked for in every text.
    """
    docs = docs.withColumn("text", F.coalesce("text", F.lit(""))).drop("spans")
    if index is None:
        index, clauses_of = postings(docs, rules), {r.kind: r.clauses() for r in rules}
    else:  # what an index covers are the trigrams of some rules
        grams = {r["gram"] for r in index.where("shard IS NULL").select("gram").distinct().collect()}
        clauses_of = {r.kind: served(r, grams) for r in rules}
    cands = materialize(candidates(index, rules, clauses_of), "secret_candidates")
    small = cands.count() <= BROADCAST_ROWS
    cands = cands.select(F.col("doc_id").alias("__id"), F.col("kinds").alias("__kinds"))
    text = F.col("text")
    found = []
    for rule in rules:
        indexed = bool(clauses_of[rule.kind])
        if indexed:
            may = F.col("doc_id").isNull() | F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False))
        else:
            may = text.rlike(scan_filter(rule))
        holds = may & text.rlike(rule.regex) if indexed else may
        found.append(F.when(holds, spans_of(rule, text)).otherwise(no_spans()))
    marked = docs.join(F.broadcast(cands) if small else cands, F.col("doc_id") == F.col("__id"), "left")
    return marked.select(*docs.columns, F.array_sort(reduce(F.concat, found)).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping ones, replaced by the first one's kind in brackets."""

    def step(done: Column, x: Column) -> Column:
        between = F.substring(text, done["end"] + 1, x["start"] - done["end"])
        out = F.when(x["start"] >= done["end"], F.concat(done["out"], between, F.lit("["), x["kind"], F.lit("]"))).otherwise(done["out"])
        return F.struct(F.greatest(done["end"], x["end"]).alias("end"), out.alias("out"))

    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.reduce(spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["end"] + 1, F.char_length(text)))))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def summary(found: DataFrame, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Per row: the number of spans of each base kind, the digest of the base spans, and all spans."""
    kinds = [r.kind for r in base]
    own = F.filter("spans", lambda x: x["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *(count_of(F.col("spans"), k).alias(f"n_{k}") for k in kinds),
        F.sha2(span_list(own).cast("binary"), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )
