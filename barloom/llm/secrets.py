"""Secret scans through a trigram inverted index (DataFrame functions only).

Each rule's regular expression is turned into a Boolean query over trigrams that any match
must hold. The index has a posting (trigram, content key) for the trigrams that some rule asks
for; the postings of each conjunction are intersected by counting, and only the candidate
texts of a rule are searched with its expression. A rule without mandatory trigrams scans all.
The index is over lower-cased text, so a posting never misses a match; the expression decides.

Defined results: a null text counts as empty; an empty text has no spans; equal texts share a
content key and get equal spans; positions are in code points, end exclusive; other columns
pass through; where one is called `secrets` the result is `_secrets` (free_name); an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, fresh, materialise, table, text_of

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Matches whose group is shorter are dropped.
    group: int = 0
    least: int = 1
    base: bool = False


#: Base rules (fixed values), then those that the index makes cheap to add.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

#: Conjunctions of trigrams, any of which must hold; None: no trigram is mandatory.
Query = frozenset[frozenset[str]] | None
_MOST = 24


def _trigrams(words: set[str]) -> Query:
    if any(len(w) < 3 for w in words):
        return None
    return frozenset(frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words)


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    joined = frozenset(x | y for x, y in product(a, b))
    return joined if len(joined) <= _MOST else min(a, b, key=len)


def _either(a: Query, b: Query) -> Query:
    return None if a is None or b is None else a | b


def _class_chars(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 6:
            out.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return out if len(out) <= 6 else None


def _exact(op, arg) -> set[str] | None:
    """All lower-cased strings that an item matches, if they are few."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        return _class_chars(arg)
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])[0]
    if op is sre.BRANCH:
        parts = [_sequence(x)[0] for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 2:
        inner = _sequence(arg[2])[0]
        if inner is not None:
            return set().union(*({"".join(p) for p in product(inner, repeat=k)} for k in range(arg[0], arg[1] + 1)))
    return None


def _sequence(items) -> tuple[set[str] | None, Query]:
    """(exact strings if few, trigram query) of a sequence of items."""
    run: set[str] = {""}
    whole, query = True, None
    for op, arg in items:
        if op is sre.AT:
            continue
        strings = _exact(op, arg)
        if strings is not None and len(strings) * len(run) <= _MOST:
            run = {a + b for a in run for b in strings}
            continue
        whole = False
        query = _both(query, _trigrams(run))
        run = {""} if strings is None or len(strings) > _MOST else strings
        if op is sre.SUBPATTERN:
            query = _both(query, _sequence(arg[-1])[1])
        elif op is sre.BRANCH:
            query = _both(query, reduce(_either, (_sequence(x)[1] for x in arg[1])))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            query = _both(query, _sequence(arg[2])[1])
    query = _both(query, _trigrams(run))
    return (run if whole else None), query


def trigram_query(pattern: str) -> Query:
    """Conjunctions of lower-case trigrams, one of which any text with a match holds."""
    query = _sequence(sre_parse.parse(pattern))[1]
    # A conjunction that holds another is implied by it.
    return query and frozenset(c for c in query if not any(d < c for d in query))


def candidates(docs: DataFrame, key: str, lowered: str, queries: dict[str, Query]) -> DataFrame:
    """key, kinds: the rules whose trigram query a text satisfies. docs has one row for each
    text or more. The rule table has a row for each trigram of each conjunction: its size is
    that of the rules."""
    wanted = sorted({t for q in queries.values() if q for c in q for t in c})
    postings = docs.select(key, F.explode(F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(F.col(lowered), t))).alias("trigram")).distinct()
    rows = [(kind, f"{kind}-{i}", t, len(c)) for kind, q in queries.items() if q for i, c in enumerate(sorted(q, key=sorted)) for t in sorted(c)]
    rules = F.broadcast(docs.sparkSession.createDataFrame(rows, "kind string, conjunction string, trigram string, needed int"))
    met = postings.join(rules, "trigram").groupBy(key, "kind", "conjunction", "needed").agg(F.count("*").alias("n")).where("n = needed")
    return met.groupBy(key).agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Struct(start, order, end) of a rule's matches. What lies between matches comes from a
    split at them, so running lengths give the positions."""
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    sizes = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("n"), F.transform(judged, F.length).alias("judged"))
    empty = F.array().cast("array<struct<start:int,order:int,end:int,judged:int>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(a: Column, x: Column) -> Column:
        start = a.at + x.gap
        one = F.struct(start.alias("start"), F.lit(order).alias("order"), (start + x.n).alias("end"), x.judged.alias("judged"))
        return F.struct((start + F.coalesce(x.n, F.lit(0))).alias("at"), F.when(x.n.isNull(), a.found).otherwise(F.concat(a.found, F.array(one))).alias("found"))

    found = F.aggregate(sizes, zero, step, lambda a: a.found)
    kept = F.filter(found, lambda s: s.judged >= rule.least)
    return F.transform(kept, lambda s: F.struct(s.start.alias("start"), s.order.alias("order"), s.end.alias("end")))


def scan(docs: DataFrame, text_col: str = "text", *, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] | None = None) -> DataFrame:
    """The columns in carry (all, by default) and a column `secrets`: an array of
    struct(start, order, end), sorted; order is the rule's place in rules."""
    carry = tuple(docs.columns) if carry is None else carry
    text, key, low, ckey, kinds = fresh(docs, "text", "key", "lowered", "ckey", "kinds")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    df = docs.withColumn(text, text_of(text_col)).withColumn(key, F.sha2(F.col(text), 256))
    found = materialise(candidates(df.select(key, F.lower(text).alias(low)), key, low, queries).withColumnRenamed(key, ckey), "secret-candidates")
    # A merge join at any size: it needs no bound on the candidates.
    df = df.join(found.withColumnRenamed("kinds", kinds).hint("merge"), F.col(key) == F.col(ckey), "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    parts = []
    for order, rule in enumerate(rules):
        hits = spans(F.col(text), rule, order)
        if queries[rule.kind] is None:
            # No index: a cheap test of the expression before the costlier split.
            parts.append(F.when(F.col(text).rlike(rule.pattern), hits).otherwise(none))
        else:
            parts.append(F.when(F.array_contains(kinds, rule.kind), hits).otherwise(none))
    return df.select(*carry, F.sort_array(F.concat(*parts)).alias(free_name(docs, "secrets", carry)))


def written(found: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s.order), s.start.cast("string"), s.end.cast("string"))), ",")


def op5_query(spark, sf_dir: str) -> DataFrame:
    df = scan(table(spark, sf_dir, "documents"), carry=("doc_id",))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.order == [r.kind for r in RULES].index(kind))).cast("long")
    last = max(i for i, r in enumerate(RULES) if r.base)
    base = F.filter("secrets", lambda s: s.order <= last)
    return df.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(written(base, RULES), 256).alias("base_sha256"), written(F.col("secrets"), RULES).alias("spans"),
    )
