"""Secret scans: a trigram inverted index picks the texts that each rule is verified on.

From each rule's regular expression a Boolean query over trigrams is derived:
every match must hold the trigrams of its mandatory strings (alternatives become
OR, a string's trigrams AND). The inverted index has a posting (trigram, doc_id)
for each query trigram in the lower-cased text. Postings are intersected per
document, and a document that fulfils a rule's query is a candidate for it. Only
candidates are verified with the rule's expression on the whole text. A rule
without a mandatory trigram (hex runs) is run on all texts.

All of it is DataFrame functions. The candidates are a written table; when its
files are under ``spark.sql.autoBroadcastJoinThreshold``, Spark sends it to the
tasks and no text moves, else texts and candidates meet by doc_id, once.

Spans are counted in code points, the end exclusive; per rule they are leftmost
and don't overlap. Kinds are ordered as in ``RULES``.

Cases: a null or empty text has no spans (``redact`` leaves it as it is);
documents that share a doc_id share candidates, which verification sorts out,
null doc_ids too; repeated rows are scanned alike; an empty table gives no rows;
other columns are not read, or (``redact``) pass through unchanged.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, read_table

MASK = "[SECRET]"
MOST_STRINGS = 64


class Rule(NamedTuple):
    """A kind of secret. A match counts if ``group`` of it has ``shortest`` characters or more."""
    kind: str
    pattern: str
    group: int = 0
    shortest: int = 1


# The first three rules.
BASE_RULES = [
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
]
RULES = [
    *BASE_RULES,
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}"),
    Rule("slack", r"xox[baprs]-[0-9A-Za-z-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"(?:sk|rk)_live_[0-9A-Za-z]{16,}"),
]


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Conjunction of disjunctions of trigram sets that every match fulfils; empty if there is none.

    Walks the parsed expression with the set of strings that the part read so far
    can be; where it is no longer finite or small, the strings become one clause.
    A string that holds another one needs no alternative of its own, and of a
    string, trigrams that together cover it are enough.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> set[str]:
        if all(len(s) >= 3 for s in strings):
            least = [s for s in strings if not any(other != s and other in s for other in strings)]
            grams = {frozenset(s[i:i + 3] for i in {*range(0, len(s) - 2, 3), len(s) - 3}) for s in least}
            clauses.append(sorted(grams, key=sorted))
        return {""}

    def finite(node) -> set[str] | None:
        """The strings of a node, or None."""
        op, arg = str(node[0]), node[1]
        if op == "LITERAL":
            return {chr(arg).lower()}
        if op == "IN" and all(str(x[0]) == "LITERAL" for x in arg):
            return {chr(x[1]).lower() for x in arg}
        if op == "SUBPATTERN":
            return sequence(arg[-1])
        if op == "BRANCH":
            parts = [sequence(x) for x in arg[1]]
            return set().union(*parts) if None not in parts else None
        if op == "MAX_REPEAT" and arg[:2] == (0, 1):
            inner = sequence(arg[2])
            return inner | {""} if inner is not None else None
        return None

    def sequence(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            found = finite(node)
            if found is None or len(out) * len(found) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in found}
        return out

    strings = {""}
    for node in re._parser.parse(pattern):
        found = finite(node)
        if found is None:
            strings = close(strings)
        elif len(strings) * len(found) > MOST_STRINGS:
            strings = close(strings)
            strings = found
        else:
            strings = {a + b for a in strings for b in found}
    close(strings)
    return clauses


def all_trigrams(rules: list[Rule]) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r.pattern) for grams in clause for g in grams})


def build_index(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings ``trigram, doc_id`` of the given trigrams over the lower-cased texts."""
    low = docs.select(F.col(doc_id).alias("doc_id"), lower_ascii(F.col(text)).alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams)))
    return low.select("doc_id", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id, kinds``: the documents whose postings fulfil a rule's query, and those rules."""
    has = F.col("grams")

    def fulfils(rule: Rule) -> Column:
        def holds(grams: frozenset[str]) -> Column:
            return reduce(lambda a, b: a & b, (F.array_contains(has, g) for g in sorted(grams)))
        clauses = [reduce(lambda a, b: a | b, map(holds, clause)) for clause in trigram_query(rule.pattern)]
        return reduce(lambda a, b: a & b, clauses)

    kinds = F.array_compact(F.array(*(F.when(fulfils(r), F.lit(r.kind)) for r in rules)))
    grams = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("grams"))
    return grams.select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans (start, rank, end, kind) of a rule in a text: what lies between matches gives their places."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    before = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    steps = F.transform(F.arrays_zip(before.alias("before"), found.alias("found"), judged.alias("judged")),
                        lambda x: F.struct(F.length(x["before"]).cast("long").alias("before"),
                                           F.length(x["found"]).cast("long").alias("found"),
                                           (F.length(x["judged"]) >= rule.shortest).alias("counts")))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["before"]
        end = start + x["found"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"),
                        F.when(x["counts"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step,
                       lambda acc: acc["spans"])


def with_spans(docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``spans``, an array of (start, rank, end, kind) in order of start and kind."""
    indexed = [r for r in rules if trigram_query(r.pattern)]
    index = build_index(docs, all_trigrams(indexed), doc_id, text)
    found = materialise(candidates(index, indexed), "secret-candidates").withColumnRenamed("doc_id", "_candidate")
    joined = docs.join(found, F.col(doc_id).eqNullSafe(F.col("_candidate")), "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    parts = []
    for rank, rule in enumerate(rules):
        due = F.array_contains("kinds", rule.kind) if rule in indexed else whole.rlike(rule.pattern)
        parts.append(F.when(due, rule_spans(whole, rule, rank)).otherwise(none))
    return joined.withColumn("spans", F.array_sort(F.concat(*parts))).drop("_candidate", "kinds")


def scan_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id, spans`` of every document's whole text."""
    return with_spans(docs.select("doc_id", "text"), rules).select("doc_id", "spans")


def redact(docs: DataFrame, rules: list[Rule] = RULES, mask: str = MASK) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; spans that overlap become one."""
    inner = [f"_c{k}" for k in range(len(docs.columns))]
    text, doc_id = (inner[docs.columns.index(c)] for c in ("text", "doc_id"))
    marked = with_spans(docs.toDF(*inner), rules, doc_id, text)

    def step(acc: Column, x: Column) -> Column:
        gap = F.col(text).substr((acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        clean = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), clean.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("spans", start, step, lambda acc: F.concat(
        acc["out"], F.col(text).substr((acc["at"] + 1).cast("int"), F.length(text))))
    clean = F.when(F.size("spans") > 0, masked).otherwise(F.col(text))
    return marked.withColumn(text, clean).select(*inner).toDF(*docs.columns)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                 x["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    counts = map(count, base)
    return found.select("doc_id", *counts,
                        F.sha2(_listed(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))
