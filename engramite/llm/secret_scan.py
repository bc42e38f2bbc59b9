"""Secret scan by a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is turned, on the driver, into a Boolean query over trigrams that any match must
contain: an OR of ANDs. Postings of the trigrams that the queries name are kept as id lists by trigram and block of
ids; within a block the lists are intersected and united as the queries say, and the candidates are verified with the
rule itself. A rule from which no trigram can be derived is run on every text. Trigrams are those of the lower-cased
text, so a query holds for either case.

Matches are leftmost and do not overlap within a kind; positions count code points, ends are exclusive. A match whose
``group`` is shorter than ``least`` is dropped after matching.

Edge cases: null and empty texts have no spans; rows with a null id are verified with every rule; rows with the same
id are candidates if one of them is; an empty table gives an empty result; columns other than the id and the text are
ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, then those that the method adds.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
]
ADDED = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]

#: Ids in a block of the index, on average; strings followed side by side while a query is derived.
BLOCK_IDS, MOST_STRINGS = 4096, 64

Query = frozenset  # of frozensets of trigrams: an OR of ANDs; an empty AND holds always
ALWAYS: Query = frozenset([frozenset()])


def _absorb(query: Query) -> Query:
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: Query, b: Query) -> Query:
    crossed = _absorb(frozenset(x | y for x in a for y in b))
    return crossed if len(crossed) <= MOST_STRINGS else min(a, b, key=len)


def _trigrams(strings: frozenset[str]) -> Query:
    return _absorb(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _derive(items) -> tuple[frozenset[str] | None, Query]:
    """(all strings that the items match, or None if too many; what every match contains)."""
    exact, whole, query = frozenset([""]), True, ALWAYS
    for op, arg in items:
        strings, needs = None, ALWAYS
        if op is sre.LITERAL:
            strings = frozenset([chr(arg).lower()])
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            strings = frozenset(chr(a).lower() for _, a in arg)
        elif op is sre.SUBPATTERN:
            strings, needs = _derive(arg[3])
        elif op is sre.BRANCH:
            parts = [_derive(b) for b in arg[1]]
            if all(p[0] is not None for p in parts):
                strings = frozenset().union(*(p[0] for p in parts))
            else:
                needs = _absorb(frozenset().union(*(p[1] for p in parts)))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, inner_needs = _derive(body)
            if high == 1 and inner is not None:
                strings = inner | frozenset([""]) if low == 0 else inner
            elif low >= 1:
                needs = inner_needs
        elif op is sre.AT:
            strings = frozenset([""])
        if strings is not None and len(exact) * len(strings) <= MOST_STRINGS:
            exact = frozenset(a + b for a in exact for b in strings)
            continue
        query, exact, whole = _both(query, _trigrams(exact)), frozenset([""]), False
        if strings is not None and len(strings) <= MOST_STRINGS:
            exact = strings
        else:
            query = _both(query, needs)
    query = _both(query, _trigrams(exact))
    return (exact if whole else None), query


def trigram_query(pattern: str) -> Query:
    """The OR of ANDs of lower-case trigrams that every match of the pattern contains; ALWAYS if none can be derived."""
    query = _derive(parser.parse(pattern))[1]
    return ALWAYS if frozenset() in query else query


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (block, trigram, ids). A list is bounded by the ids of its block."""
    blocks = max(1, -(-docs.count() // BLOCK_IDS))
    low = F.lower(F.col(text_col).cast("string")).alias("low")
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), low)
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    rows = rows.select("id", F.explode(held).alias("trigram"))
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("id").alias("ids"))


def _tagged(kind: str):
    return lambda i: F.struct(i.alias("id"), F.lit(kind).alias("kind"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(id, kinds): ids whose trigrams satisfy the query of one rule or more, by intersecting and uniting lists."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
    id_array = dict(index.dtypes)["ids"]

    def ids(trigram: str) -> Column:
        return F.coalesce(F.try_element_at("lists", F.lit(trigram)), F.array().cast(id_array))

    found = []
    for rule in rules:
        wanted = None
        for conjunction in sorted(map(sorted, trigram_query(rule.pattern))):
            hit = ids(conjunction[0])
            for trigram in conjunction[1:]:
                hit = F.array_intersect(hit, ids(trigram))
            wanted = hit if wanted is None else F.array_union(wanted, hit)
        found.append(F.transform(wanted, _tagged(rule.kind)))
    return lists.select(F.explode(F.concat(*found)).alias("c")).groupBy("c.id").agg(F.collect_set("c.kind").alias("kinds"))


_SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in a text, from the lengths of its matches and of what lies between them."""
    pattern = F.lit(rule.pattern)
    gaps, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), kept.alias("kept"))

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.length(part["kept"]) >= max(1, rule.least), F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
    return F.aggregate(parts, start, add, lambda s: s["spans"])


def _full_scan(text: Column, rule: Rule) -> Column:
    """Whether a text is worth the positions: a cheap test for rules of one repeated class with a least length."""
    if rule.least and rule.group == 0 and re_single_class(rule.pattern):
        return text.rlike(f"{rule.pattern[:-1]}{{{rule.least},}}")
    return text.rlike(rule.pattern)


def re_single_class(pattern: str) -> bool:
    items = parser.parse(pattern)
    return len(items) == 1 and items[0][0] is sre.MAX_REPEAT and pattern.endswith("+") and len(items[0][1][2]) == 1


def free_name(frame: DataFrame, name: str) -> str:
    """The name, with as many underscores as make it a new one in the frame (names differ in more than case)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` with ``spans_col``: array of (start, rank, end, kind), ordered by start, then the order of the rules.

    All columns of ``docs`` stay, whatever their names; only one named ``spans_col`` is replaced.
    """
    rules = rules or BASE + ADDED
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = [r for r in rules if queries[r.kind] != ALWAYS]
    trigrams = sorted({t for r in indexed for c in queries[r.kind] for t in c})
    rows = docs.drop(spans_col)
    key, kinds = free_name(docs, "__id"), free_name(docs, "__kinds")
    if indexed:
        picked = candidates(postings(docs, trigrams, id_col, text_col), indexed).select(F.col("id").alias(key), F.col("kinds").alias(kinds))
        rows = rows.join(picked, F.col(id_col) == F.col(key), "left")
    text, none = F.col(text_col).cast("string"), F.array().cast(f"array<{_SPAN}>")
    spans = []
    for rank, rule in enumerate(rules):
        if rule in indexed:
            wanted = F.when(F.col(id_col).isNull(), F.lit(True)).otherwise(F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False)))
        else:
            wanted = F.coalesce(_full_scan(text, rule), F.lit(False))
        spans.append(F.when(wanted & text.isNotNull(), matches(text, rule, rank)).otherwise(none))
    return rows.withColumn(spans_col, F.array_sort(F.concat(*spans))).drop(key, kinds)


def render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(scanned: DataFrame, base: list[Rule] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_<kind> of the base rules, base_sha256, spans): counts and digest of a scan."""
    base = base or BASE
    kinds = [r.kind for r in base]
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds]
    own = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return scanned.select(id_col, *counts, F.sha2(render(own), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))


def redact(scanned: DataFrame, mark: str = "[SECRET]", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """The scanned rows with every span of the text replaced by a mark (overlapping ones by one mark)."""
    text = F.col(text_col)

    def add(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        between = F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(fresh, between).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans_col, start, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return scanned.withColumn(text_col, F.when(F.size(spans_col) > 0, done).otherwise(text))
