"""Secret scanning with a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query over trigrams that any match must contain. The postings (trigram,
document) of the queries' trigrams are combined by document, which intersects them; the documents that fulfil a rule's
query are its candidates, and only they are matched with its expression. A rule whose expression demands no trigram is
matched with every document. Trigrams are taken from the lower-cased text, so a query never misses a match. The postings
hold a few trigrams a document, whatever the number of rules' matches, and the candidates' join is a broadcast only where
their measured number allows it.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, small


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of `regex` that do not overlap; those whose group `group` is shorter than `shortest` are dropped."""

    kind: str
    regex: str
    group: int = 0
    shortest: int = 0


#: Fixed patterns. hex and access state their least length in the expression: both match whole runs, so it is the same.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
_MOST = 64
#: Bits that a word of a mask uses.
WORD = 62

Query = frozenset  # of alternatives, each a frozenset of trigrams that must all occur; an empty alternative demands nothing


def trigram_query(regex: str) -> Query:
    """The trigrams that every match of regex contains, as an OR of ANDs over lower-cased text."""
    query: set[frozenset] = {frozenset()}
    run: set[str] = {""}

    def close() -> None:
        nonlocal query, run
        found = {frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in run}
        query, run = _minimal({a | b for a in query for b in found}), {""}

    for node in parser.parse(regex):
        texts = _texts(node)
        if texts is not None and len(run) * len(texts) <= _MOST:
            run = {a + b for a in run for b in texts}
            continue
        close()
        if texts is not None:
            run = texts
    close()
    return frozenset(query)


def _minimal(alternatives: set[frozenset]) -> set[frozenset]:
    return {a for a in alternatives if not any(b < a for b in alternatives)}


def _texts(node: tuple) -> set[str] | None:
    """All strings that the node matches, if they are few."""
    kind, what = node
    if kind is kinds.LITERAL:
        return {chr(what)}
    if kind is kinds.IN:
        found = set()
        for k, v in what:
            if k is kinds.LITERAL:
                found.add(chr(v))
            elif k is kinds.RANGE and v[1] - v[0] < 16:
                found |= {chr(c) for c in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= 16 else None
    if kind is kinds.SUBPATTERN:
        return _product(what[-1])
    if kind is kinds.BRANCH:
        parts = [_product(x) for x in what[1]]
        return None if None in parts else set().union(*parts)
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and what[1] <= 2:
        one = _product(what[2])
        return None if one is None else {"".join(x) for n in range(what[0], what[1] + 1) for x in product(one, repeat=n)}
    return None


def _product(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        texts = _texts(node)
        if texts is None or len(found) * len(texts) > _MOST:
            return None
        found = {a + b for a in found for b in texts}
    return found


def _once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index (trigram: its place in trigrams, doc_id) of the given trigrams over docs' lower-cased texts."""
    found = _once(F.lower("text"), lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(x)), F.lit(i)) for i, x in enumerate(trigrams)])))
    return docs.where("doc_id is not null").select("doc_id", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, queries: list[Query], trigrams: list[str]) -> DataFrame:
    """Rows (doc_id, rules): words of WORD bits, in which bit i is set if the document's postings fulfil queries[i].

    A document's trigrams are a mask of as many words as the trigrams need, so neither they nor the rules are limited.
    """
    number, none = F.col("trigram"), F.lit(0).cast("long")
    own = lambda w: F.when(F.floor(number / WORD) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (number % WORD).cast("int")))
    have = [F.coalesce(F.bit_or(own(w)), none).alias(f"have{w}") for w in range(-(-len(trigrams) // WORD))]
    mask, place = index.groupBy("doc_id").agg(*have), {t: i for i, t in enumerate(trigrams)}
    rules = [none] * -(-len(queries) // WORD)
    for i, query in enumerate(queries):
        fulfilled = F.lit(False)
        for alternative in query:
            want: dict[int, int] = {}
            for t in alternative:
                want[place[t] // WORD] = want.get(place[t] // WORD, 0) | 1 << place[t] % WORD
            whole = F.lit(True)
            for w, bits in sorted(want.items()):
                whole = whole & (F.col(f"have{w}").bitwiseAND(F.lit(bits)) == F.lit(bits))
            fulfilled = fulfilled | whole
        rules[i // WORD] = rules[i // WORD].bitwiseOR(F.when(fulfilled, F.lit(1 << i % WORD).cast("long")).otherwise(none))
    return mask.select("doc_id", F.array(*rules).alias("rules")).where(F.exists("rules", lambda r: r != 0))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _folded(steps: Column, number: int) -> Column:
    """struct<at, spans> of one block of steps (gap, hit, good): its length, and its good hits' spans from its start."""
    state = f"struct<at:int,spans:{_SPANS}>"

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + x["hit"]
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["good"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans")).cast(state), step)


def _spans(rule: Rule, number: int) -> Column:
    """array<struct<start, kind, end>> of the rule's spans in column text, in code points.

    A fold copies its list at each hit, so hits are folded in blocks of the square root of their number, then the blocks'
    starts are; the work grows with the hits' number to the power of one and a half.
    """
    none = F.array().cast(_SPANS)

    def located(hits: Column) -> Column:
        gaps = F.split("text", rule.regex, -1)
        group = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(rule.group)) if rule.shortest else hits
        steps = F.transform(
            F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), group.alias("group")),
            lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("hit"), (F.length(z["group"]) >= rule.shortest).alias("good")),
        )
        return _once(steps, in_blocks)

    def in_blocks(steps: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(steps))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(steps), size), lambda i: _folded(F.slice(steps, i, size), number))
        return _once(blocks, lambda found: _once(starts(found), lambda at: F.flatten(F.transform(found, lambda b, i: shifted(b["spans"], F.get(at, i))))))

    def starts(found: Column) -> Column:
        add = lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b["at"]))
        return F.aggregate(found, F.array(F.lit(0)), add)

    def shifted(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))

    return _once(F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, located(hits)).otherwise(none))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Rows (doc_id, spans: array<struct<start int, kind int, end int>>) for every row of docs (doc_id, text).

    kind is the rule's place in rules; spans are ordered by start, then kind; offsets are code points, the end exclusive.
    A null or empty text has no spans. Rows with a null doc_id are matched with every rule; rows that share a doc_id share
    their candidacy, which changes no match. An empty table gives no rows. Other columns are ignored.
    """
    queries = [trigram_query(r.regex) for r in rules]
    indexed = [i for i, q in enumerate(queries) if frozenset() not in q]
    trigrams = sorted({t for i in indexed for a in queries[i] for t in a})
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    if indexed:
        found = small(checkpointed(candidates(postings(texts, trigrams), [queries[i] for i in indexed], trigrams))).withColumnRenamed("doc_id", "candidate")
        words = -(-len(indexed) // WORD)
        every, none = F.array(*[F.lit((1 << WORD) - 1)] * words), F.array(*[F.lit(0).cast("long")] * words)
        texts = texts.join(found, F.col("doc_id") == F.col("candidate"), "left").withColumn("rules", F.when(F.col("doc_id").isNull(), every).otherwise(F.coalesce("rules", none)))
    none = F.array().cast(_SPANS)
    parts = []
    for i, rule in enumerate(rules):
        spans = _spans(rule, i)
        if i in indexed:
            at = indexed.index(i)
            spans = F.when(F.get("rules", F.lit(at // WORD)).bitwiseAND(F.lit(1 << at % WORD)) != 0, spans).otherwise(none)
        parts.append(spans)
    return texts.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
