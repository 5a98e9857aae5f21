"""Secret scanning over a trigram inverted index, in DataFrame expressions only.

1. ``trigram_query``   a rule's regex -> a Boolean query (OR of ANDs of lower-case trigrams) that
                       every match satisfies; None if the regex has no mandatory trigram.
2. ``build_index``     documents -> postings ``(trigram, key)`` for the trigrams of a rule set.
3. ``candidates``      postings intersected per rule -> ``(key, rules)``.
4. ``scan``            verifies the candidates of indexed rules with the regex itself; rules without
                       a trigram query scan every text.  ``redact`` replaces what was found.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import staged, whole_text


@dataclass(frozen=True)
class Rule:
    """``pattern`` is in the syntax that Java, RE2 and Python share.  A match counts if its
    ``group`` has at least ``least`` characters; a match that fails still uses up its text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base rules first.  A run of hex digits is maximal, so asking for 24 in
#: the pattern drops the same matches as a length check afterwards.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
BASE_KINDS = ("assign", "access", "hex")
MAX_STRINGS = 64  # alternatives kept while a run of the regex is spelled out
MAX_CLASS = 6     # largest character class that is spelled out


def _spell(items) -> list[set[str] | None]:
    """The regex as a chain of elements: a set of strings that may stand there, or None (anything)."""
    chain: list[set[str] | None] = []
    for op, arg in items:
        if op is sre.LITERAL:
            chain.append({chr(arg).lower()})
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= MAX_CLASS:
            chain.append({chr(a).lower() for _, a in arg})
        elif op is sre.SUBPATTERN:
            chain += _spell(arg[3])
        elif op is sre.BRANCH:
            ways = [_spelled(_spell(way)) for way in arg[1]]
            chain.append(None if any(w is None for w in ways) else set().union(*ways))
        elif op is sre.MAX_REPEAT:
            low, high, body = arg
            inner = _spelled(_spell(body))
            if inner is not None and high == 1:
                chain.append(inner | ({""} if low == 0 else set()))
            elif inner is not None and low >= 1:
                chain += [inner] * min(low, 8) + ([] if low == high else [None])
            else:
                chain.append(None)
        else:
            chain.append(None)
    return chain


def _spelled(chain: list[set[str] | None]) -> set[str] | None:
    """All strings of a chain, or None if there are too many to list."""
    out = {""}
    for part in chain:
        if part is None or len(out) * len(part) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _clauses(strings: set[str]) -> set[frozenset[str]]:
    ways = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    return {w for w in ways if not any(o < w for o in ways)}  # a weaker way covers a stronger one


def trigram_query(pattern: str) -> list[list[str]] | None:
    """OR of ANDs: every text with a match holds, in lower case, all trigrams of one clause."""
    runs: list[set[str]] = [{""}]
    for part in _spell(sre_parser.parse(pattern)):
        if part is None:
            runs.append({""})
        elif len(runs[-1]) * len(part) <= MAX_STRINGS:
            runs[-1] = {a + b for a in runs[-1] for b in part}
        else:
            runs.append(set(part))
    queries = [q for q in map(_clauses, runs) if frozenset() not in q]
    if not queries:
        return None
    both = {frozenset().union(*ways) for ways in itertools.product(*queries)}
    return sorted(sorted(w) for w in both if not any(o < w for o in both))


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) or [] for t in clause})


def build_index(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``(trigram, key)``: one row for each listed trigram that the lower-cased text of a
    row holds, unordered; repeated keys give repeated postings."""
    low = docs.select(F.col(key).alias("key"), F.lower(whole_text(text_col)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("key", held.alias("held")).select(F.explode("held").alias("trigram"), "key")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(key, rules)``: kinds whose trigram query the postings of a key satisfy.  The set per key
    is bounded by the rules' trigrams."""
    held = postings.groupBy("key").agg(F.collect_set("trigram").alias("held"))
    met = []
    for r in rules:
        if query := trigram_query(r.pattern):
            one = [F.size(F.array_except(F.array(*map(F.lit, clause)), "held")) == 0 for clause in query]
            any_of = one[0]
            for c in one[1:]:
                any_of = any_of | c
            met.append(F.when(any_of, F.lit(r.kind)))
    return held.select("key", F.array_compact(F.array(*met)).alias("rules")).filter(F.size("rules") > 0)


SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of the rule in the text: the text is split at the matches, and a match starts where
    the pieces and matches before it end (code points)."""
    whole, pieces = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    steps = F.zip_with(F.arrays_zip(whole.alias("w"), judged.alias("g")), F.slice(pieces, 1, F.size(whole)), lambda m, p: F.struct(
        F.length(p).alias("skip"), F.length(m["w"]).alias("len"), (F.length(m["g"]) >= rule.least).alias("ok")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPANS).alias("out"))

    def step(acc, m):
        at = acc["pos"] + m["skip"]
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (at + m["len"]).alias("end"))
        return F.struct((at + m["len"]).alias("pos"), F.when(m["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(SPANS).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(steps, start, step)["out"]).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``spans`` to every row: ``array<struct<start, rank, kind, end>>`` in code points, end
    exclusive, by start and then rule order.  All columns and rows stay, repeated ones too; null
    text scans as empty; rows that share a key (null included) share candidates but are verified
    on their own text."""
    if clash := {"spans", "_rules", "_key"} & set(docs.columns):
        docs = docs.drop(*clash)
    postings = staged(build_index(docs, vocabulary(rules), key, text_col))
    found = staged(candidates(postings, rules).select(F.col("key").alias("_key"), F.col("rules").alias("_rules")).distinct())
    # ``found`` is a written table, so Spark knows its size: few candidates are broadcast, more join by key.
    both = docs.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    text = whole_text(text_col)
    per_rule = []
    for rank, r in enumerate(rules):
        spans = _matches(text, r, rank)
        per_rule.append(spans if trigram_query(r.pattern) is None
                        else F.when(F.array_contains("_rules", r.kind), spans).otherwise(F.array().cast(SPANS)))
    return both.withColumn("spans", F.array_sort(F.concat(*per_rule))).drop("_rules")


def redact(scanned: DataFrame, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """Replaces each maximal run of overlapping spans by ``mark``; texts without spans stay as they
    are, null included."""
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        fresh = F.array(F.substr(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"),
                        F.when((s["start"] >= acc["pos"]) & ((s["start"] > acc["pos"]) | (F.size(acc["out"]) == 0)), F.concat(acc["out"], fresh)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["pos"] + 1, F.length(text))))
    return scanned.withColumn(text_col, F.when(F.size("spans") > 0, done).otherwise(text))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
