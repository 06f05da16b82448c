"""Strategies: dictionaries of a direction and rules, as JSON files, checked and compiled.

Files are small and go through the session's Hadoop file system, so any store will do.
"""

from __future__ import annotations

import json
import logging
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.identity import identity

from . import rules as R  # noqa: N812

#: The conditions that each rule of a direction carries (fixed values).
CONTEXT = {d: (f"[tf_permission_{d}] IS Active (1)", f"[lwc_pullback_reversal_{d}] IS Active (1)") for d in ("long", "short")}
AUDIT = ("strategy_id", "strategy_contract", "provenance")


class StrategyError(ValueError):
    """A strategy that breaks its contract."""


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put_text(spark: SparkSession, path: str, text: str, create_only: bool = False) -> None:
    """Write a small file. create_only: raise FileExistsError if it is there; the store decides,
    so of two writers one fails."""
    fs, p = _path(spark, path)
    try:
        out = fs.create(p, not create_only)
    except Exception as e:
        if create_only and fs.exists(p):
            raise FileExistsError(path) from e
        raise
    out.write(bytearray(text.encode()))
    out.close()


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it isn't there."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    source = fs.open(p)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    source.close()
    return text


def _number(value, what: str) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        raise StrategyError(f"{what} must be a number, not {value!r}") from None


def feature_of(condition: str) -> str | None:
    try:
        return R.parse_condition(condition)[0]
    except ValueError:
        return None


def check_rule(rule: object, number: int = 1) -> dict:
    """A rule with numbers as floats. Labels aren't checked against features: a strategy may be
    for another tape."""
    if not isinstance(rule, dict) or not {"tp", "sl", "capital_pct", "conditions"} <= rule.keys():
        raise StrategyError(f"rule {number} needs tp, sl, capital_pct and conditions")
    out = {k: _number(rule[k], f"rule {number}: {k}") for k in ("tp", "sl", "capital_pct")}
    if not any(out.values()):
        raise StrategyError(f"rule {number}: tp, sl and capital_pct are all zero")
    conditions = rule["conditions"]
    if not isinstance(conditions, list) or not conditions:
        raise StrategyError(f"rule {number} needs a list of conditions")
    try:
        for c in conditions:
            if not isinstance(c, str):
                raise StrategyError(f"rule {number}: a condition is text, not {c!r}")
            if R.parse_symbols(c) is None:
                R.parse_condition(c)
        R.split_conditions(conditions)
    except ValueError as e:
        raise StrategyError(f"rule {number}: {e}") from None
    return out | {"conditions": list(conditions)}


def check_context(direction: str, rules: list[dict], required: bool = True) -> None:
    """No context of the other direction, none twice, and both of this one if required."""
    other = {feature_of(c) for c in CONTEXT["short" if direction == "long" else "long"]}
    own = {feature_of(c) for c in CONTEXT[direction]}
    for k, rule in enumerate(rules, 1):
        mine = [c.strip() for c in rule["conditions"] if feature_of(c) in own | other]
        if any(feature_of(c) in other for c in mine):
            raise StrategyError(f"rule {k}: context of the other direction")
        if len(mine) != len(set(mine)):
            raise StrategyError(f"rule {k}: a context condition occurs twice")
        missing = [c for c in CONTEXT[direction] if c not in mine]
        if required and missing:
            raise StrategyError(f"rule {k} lacks {missing[0]!r}")


def check(strategy: object, *, least: int = 1, most: int = 20, require_context: bool = False) -> dict:
    """The strategy, normalised: direction, rules_set and the audit keys. Rules beyond `most` go
    from the end of the ranked list to dropped_rules, and a warning says so; an empty set passes only
    if it says that it isn't accepted for deployment."""
    if not isinstance(strategy, dict) or not {"direction", "rules_set"} <= strategy.keys():
        raise StrategyError("a strategy needs direction and rules_set")
    if strategy["direction"] not in CONTEXT:
        raise StrategyError(f"direction must be long or short, not {strategy['direction']!r}")
    if not isinstance(strategy["rules_set"], list):
        raise StrategyError("rules_set must be a list")
    rules, dropped = strategy["rules_set"][:most], strategy["rules_set"][most:]
    if dropped:
        logging.getLogger(__name__).warning("rules_set has %d rules more than the %d allowed", len(dropped), most)
    if len(rules) < least and not (not rules and strategy.get("deployment_accepted") is False):
        raise StrategyError(f"rules_set needs {least} rules at least, not {len(rules)}")
    rules = [check_rule(r, k) for k, r in enumerate(rules, 1)]
    check_context(strategy["direction"], rules, require_context)
    return {"direction": strategy["direction"], "rules_set": rules} | ({"dropped_rules": dropped} if dropped else {}) | {k: strategy[k] for k in AUDIT if k in strategy}


def clean(strategy: dict) -> dict:
    """What an evaluator reads: direction and rules alone."""
    return {"direction": strategy["direction"], "rules_set": strategy["rules_set"]}


def write(spark: SparkSession, strategy: dict, path: str, **how) -> dict:
    """Check and write a strategy, and beside it the clean form, by direction."""
    done = check(strategy, **how)
    put_text(spark, path, json.dumps(done, indent=2))
    put_text(spark, f"{path.rsplit('/', 1)[0]}/evaluator_clean/{done['direction']}_evaluator_clean.json", json.dumps(clean(done), indent=2))
    return done


def read(spark: SparkSession, path: str, **how) -> dict:
    text = get_text(spark, path)
    if text is None:
        raise StrategyError(f"no file {path}")
    try:
        data = json.loads(text)
    except ValueError as e:
        raise StrategyError(f"{path} isn't JSON: {e}") from None
    return check(data, **how)


def capital_of(source: dict) -> float | None:
    """capital_pct under any of its names; it must be positive."""
    for name in ("capital_pct", "trade_capital_pct", "TRADE_CAPITAL_PCT"):
        if source.get(name) is not None:
            value = _number(source[name], name)
            if not math.isfinite(value) or value <= 0:
                raise StrategyError(f"invalid {name}: {source[name]!r}")
            return value
    return None


def compile_rules(strategy: dict) -> list[dict]:
    """Rules for assign(): conditions, tp, sl, capital_pct (the rule's, else the strategy's)."""
    if not strategy.get("rules_set"):
        raise StrategyError("rules_set is empty")
    shared, out = capital_of(strategy), []
    for k, r in enumerate(strategy["rules_set"], 1):
        rule = {"conditions": list(r.get("conditions", []))}
        for name in ("tp", "sl"):
            rule[name] = _number(r.get(name), f"rule {k}: {name}")
            if not math.isfinite(rule[name]) or rule[name] <= 0:
                raise StrategyError(f"rule {k}: {name} must be positive")
        own = capital_of(r)
        if own is None and shared is None:
            raise StrategyError(f"rule {k} has no capital, nor has the strategy")
        out.append(rule | {"capital_pct": shared if own is None else own})
    return out


def budgeted(rules: list[dict], limit: float = 100.0) -> list[dict]:
    """Capital scaled down to the limit in all, rounded to six digits."""
    total = sum(float(r["capital_pct"]) for r in rules)
    if total <= limit + 1e-9:
        return [dict(r) for r in rules]
    return [r | {"capital_pct": round(float(r["capital_pct"]) * limit / total, 6)} for r in rules]


def assemble(direction: str, rules: list[dict], horizon: int, cost_model: str, *, require_context: bool = True, **extra) -> dict:
    """A strategy with its identity. Fails if a rule lost its context, or the budget is exceeded."""
    rules = budgeted(rules)
    if sum(r["capital_pct"] for r in rules) > 100.0 + 1e-6:
        raise StrategyError("capital budget exceeded")
    check_context(direction, rules, require_context)
    key = {"direction": direction, "horizon": horizon, "cost_model": cost_model, "rules": [[sorted(r["conditions"]), float(r["tp"]), float(r["sl"])] for r in rules]}
    return {"direction": direction, "rules_set": rules, "strategy_id": identity(key, 20), "strategy_contract": {"horizon_bars": horizon, "cost_model_id": cost_model, "capital_is_sizing_only": True}} | extra


def fail_closed(spark: SparkSession, folder: str, direction: str, reason: str, horizon: int = 96, cost_model: str = "none") -> dict:
    """Write an explicitly empty strategy, its clean form and a report of why."""
    s = assemble(direction, [], horizon, cost_model, deployment_accepted=False, fail_closed=True, reason=reason)
    put_text(spark, f"{folder}/{direction}.json", json.dumps(s, indent=2))
    put_text(spark, f"{folder}/evaluator_clean/{direction}_evaluator_clean.json", json.dumps(clean(s), indent=2))
    put_text(spark, f"{folder}/report_{direction}.json", json.dumps({"direction": direction, "selected_rules": 0, "fail_closed": True, "reason": reason}, indent=2))
    return s


def rule_table(spark: SparkSession, texts: DataFrame, col: str = "json") -> DataFrame:
    """One row for each rule of strategies that are JSON texts in a column: the other columns,
    direction, rule (from 0), tp, sl, capital_pct, conditions, features and symbols."""
    schema = "direction string, capital_pct double, rules_set array<struct<conditions:array<string>,tp:double,sl:double,capital_pct:double>>"
    df = texts.withColumn("_s", F.from_json(col, schema)).select(*[c for c in texts.columns if c != col], "_s.direction", F.col("_s.capital_pct").alias("_capital"), F.posexplode("_s.rules_set").alias("rule", "_r"))
    symbol = lambda c: c.rlike(R.SYMBOL_CONDITION)
    return df.select(
        *[c for c in texts.columns if c != col], "direction", "rule", "_r.tp", "_r.sl", F.coalesce("_r.capital_pct", "_capital").alias("capital_pct"), "_r.conditions",
        F.transform(F.filter("_r.conditions", lambda c: ~symbol(c)), lambda c: F.regexp_extract(c, r"^\s*\[([^\]]+)\]", 1)).alias("features"),
        F.array_distinct(F.flatten(F.transform(F.filter("_r.conditions", symbol), lambda c: F.transform(F.split(F.regexp_extract(c, R.SYMBOL_CONDITION, 1), ","), R.normalize_symbol)))).alias("symbols"),
    )


def decode(genes: Column, features: list[tuple[str, str]]) -> Column:
    """Conditions of a dense chromosome. features: (name, mode) by place; a gene that isn't a class
    of its mode is idle."""
    names = {"binary": ("Inactive (0)", "Active (1)"), "ternary": ("Negative (-1)", "Neutral (0)", "Positive (1)")}
    labels = [names.get(mode) or R.FAMILIES[{"sparse_positive": "positive"}.get(mode, mode)][0] for _, mode in features]
    texts = [F.concat(F.lit(f"[{n}] IS "), F.get(F.array(*map(F.lit, labs)), F.get(genes, k))) for k, ((n, _), labs) in enumerate(zip(features, labels, strict=True))]
    return F.array_compact(F.array(*texts))


def specialised(rule: dict, symbols: list[str], most: int = 10) -> list[dict]:
    """The rule for each single symbol and for all of them; a rule with a symbol stays as it is."""
    features, own = R.split_conditions(rule["conditions"])
    if own or not symbols:
        return [rule]
    sets = [[s] for s in symbols] + ([symbols] if len(symbols) > 1 else [])
    return [rule | {"conditions": [*features, *(f"symbol is {s}" for s in x)]} for x in sets[:most]]
