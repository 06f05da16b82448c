"""Files of a run: manifests, splits with freshness, phase log, resume, reports.

All are small JSON or CSV files, written through the session's file system.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.identity import identity
from barloom.operators.strategy import get_text, put_text

SPLITS = ("train", "val", "fitness", "selection")


def put_json(spark: SparkSession, path: str, value) -> None:
    put_text(spark, path, json.dumps(value, indent=2, sort_keys=True, default=str))


def get_json(spark: SparkSession, path: str):
    """The value of a file; None if it isn't there or isn't JSON."""
    text = get_text(spark, path)
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def fingerprint(config: dict) -> str:
    return identity(config, 16)


def changed_at(spark: SparkSession, path: str) -> int | None:
    """When the newest file of a path changed, in milliseconds; None if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    newest, files = 0, fs.listFiles(p, True)
    while files.hasNext():
        newest = max(newest, files.next().getModificationTime())
    return newest


def fold_manifest(bounds: DataFrame, config: dict, reference_rows: int) -> dict:
    """The geometry of the folds (symbol, fold, v_start, v_end, train_end: a few rows a symbol)."""
    b = bounds.withColumn("_last", F.max("fold").over(Window.partitionBy("symbol")))
    rows = b.groupBy("fold").agg(F.sum("train_end").alias("train"), F.sum(F.col("v_end") - F.col("v_start")).alias("valid"), F.max("train_end").alias("end"), F.min("v_start").alias("a"), F.max("v_end").alias("b"), F.bool_and(F.col("fold") == F.col("_last")).alias("last")).orderBy("fold").collect()
    folds = [{"fold_id": r["fold"], "is_holdout": r["last"], "n_train_rows": r["train"], "n_valid_rows": r["valid"], "train_end_bar": r["end"], "valid_start_bar": r["a"], "valid_end_bar": r["b"]} for r in rows]
    return {"config": config, "config_fingerprint": fingerprint(config), "reference_rows": reference_rows, "n_folds": len(folds), "folds": folds}


def write_splits(spark: SparkSession, splits: dict[str, DataFrame], folder: str, manifest: dict) -> None:
    """One Parquet folder for each split, and the manifest last."""
    for name, df in splits.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    put_json(spark, f"{folder}/manifest.json", manifest)


def fresh_splits(spark: SparkSession, folder: str, source: str, config: dict, columns: list[str], reference_rows: int | None = None) -> dict[str, DataFrame] | None:
    """The cached splits if they are newer than their source, of this configuration and row count,
    and have the columns; None otherwise."""
    manifest = get_json(spark, f"{folder}/manifest.json")
    born = changed_at(spark, source)
    times = [changed_at(spark, f"{folder}/{s}.parquet") for s in SPLITS]
    if not manifest or born is None or None in times or min(times) < born or manifest.get("config_fingerprint") != fingerprint(config):
        return None
    if reference_rows is not None and manifest.get("reference_rows") != reference_rows:
        return None
    out = {s: spark.read.parquet(f"{folder}/{s}.parquet") for s in SPLITS}
    return out if all(set(columns) <= set(df.columns) for df in out.values()) else None


def check_enriched(spark: SparkSession, source: str, manifest_path: str, version: str, suffix: str = "_hwc_mwc_lwc.csv") -> None:
    """Refuse an enriched tape that has no manifest, or was made under another context contract."""
    if not source.endswith(suffix):
        return
    m = get_json(spark, manifest_path)
    if not isinstance(m, dict):
        raise RuntimeError(f"{source} has no readable manifest at {manifest_path}")
    found = m.get("context_algorithm_version", (m.get("context_contract") or {}).get("algorithm_version") if isinstance(m.get("context_contract"), dict) else None)
    if str(found) != version:
        raise RuntimeError(f"{source} was made under contract {found!r}, not {version!r}")


def enrichment_manifest(thresholds: dict[str, DataFrame], version: str, source: str, lineage: dict | None = None) -> dict:
    """Thresholds of each timeframe (a row each), the contract and where the tape comes from."""
    rows = {k: t.first().asDict() for k, t in thresholds.items()}
    return {"context_algorithm_version": version, "thresholds": rows, "threshold_hash": identity(rows, 16), "source": source, "lineage": lineage or {}}


def claim_once(spark: SparkSession, folder: str, tape_hash: str) -> None:
    """Refuse a forward tape that was used before. The store creates one file for each hash, so of
    two runs one fails."""
    try:
        put_text(spark, f"{folder}/{tape_hash}.lock", tape_hash, create_only=True)
    except FileExistsError:
        raise RuntimeError("this forward tape was used before") from None


class Run:
    """A run's folder: its identity, the log of its phases and what can be taken up again."""

    def __init__(self, spark: SparkSession, folder: str, config: dict):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config
        self.id = identity({"config": config}, 20)

    def log(self, phase: str, status: str, **more) -> dict:
        """One JSON line of a phase, appended by a job of its own."""
        record = {"run": self.id, "phase": phase, "status": status, "at": time.time()} | more
        self.spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/phases")
        return record

    def finish(self, phase: str, artifact) -> None:
        put_json(self.spark, f"{self.folder}/{phase}.json", {"run": self.id, "config_fingerprint": fingerprint(self.config), "artifact": artifact})
        self.log(phase, "done")

    def resume(self, phase: str, required: tuple[str, ...] = ()):
        """A phase's artifact if this run finished it under the same configuration and it has the
        required keys; None otherwise, so the phase is done again."""
        kept = get_json(self.spark, f"{self.folder}/{phase}.json")
        if not kept or kept.get("run") != self.id or kept.get("config_fingerprint") != fingerprint(self.config):
            return None
        artifact = kept.get("artifact")
        return artifact if all(k in artifact for k in required) else None

    def drop_stale(self, phases: list[str]) -> list[str]:
        """Delete artifacts of other configurations; their names."""
        gone = []
        for phase in phases:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{phase}.json")
            fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            if fs.exists(p) and self.resume(phase) is None:
                fs.delete(p, False)
                gone.append(phase)
        return gone

    def phases(self) -> DataFrame:
        schema = "run string, phase string, status string, at double"
        return self.spark.read.text(f"{self.folder}/phases").select(F.from_json("value", schema).alias("r")).select("r.*")


def write_report(df: DataFrame, path: str) -> None:
    """A report table, which is small, as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def split_report(spark: SparkSession, metrics: DataFrame, path: str, direction: str, split: str, diagnostic: bool) -> dict:
    """The metrics of one split (a row) as JSON, marked if they are for diagnosis only."""
    row = metrics.first()
    out = {"direction": direction, "split": split, "diagnostic_only": diagnostic, "metrics": row.asDict() if row else {}}
    put_json(spark, path, out)
    return out


def evaluation_outputs(spark: SparkSession, metrics: DataFrame, log: DataFrame, folder: str) -> None:
    """The summary as JSON, the trade log as CSV, and the metrics of the splits as one table."""
    put_json(spark, f"{folder}/summary.json", [r.asDict() for r in metrics.collect()])
    log.write.mode("overwrite").csv(f"{folder}/trades", header=True)
    write_report(metrics, f"{folder}/splits")


def count_trials(search: dict | None = None, rules: dict | None = None) -> int:
    """How many evaluations the artifacts of a run stand for: lists by their length, archives and
    generations by their sizes, and what rule selection scored."""
    size = lambda d, *names: sum(int(d.get(n) or 0) for n in names)
    total = sum(len(v) if isinstance(v, list) else size(v, "archive_size", "generations") if isinstance(v, dict) else 0 for v in (search or {}).values())
    for v in (rules or {}).values():
        if isinstance(v, dict):
            total += size(v, "n_positive_single_rules", "selected_rules") + (len(v["risk_history"]) if isinstance(v.get("risk_history"), list) else 0)
    return max(0, total)


def check_config(config: dict, checks: dict) -> list[str]:
    """The names of the checks that a configuration fails, in order. checks: name to a predicate
    of the configuration; one that can't be evaluated fails."""
    failed = []
    for name, ok in checks.items():
        try:
            good = bool(ok(config))
        except (KeyError, TypeError, ValueError, ZeroDivisionError):
            good = False
        if not good:
            failed.append(name)
    return failed


#: Checks across parameters.
CONFIG_CHECKS = {
    "positive_capital": lambda c: c["initial"] > 0, "fee_in_percent": lambda c: 0 <= c["fee_pct"] < 100, "horizon": lambda c: c["horizon"] >= 1, "embargo_covers_horizon": lambda c: c["embargo"] >= c["horizon"],
    "rules_range": lambda c: 0 <= c["min_rules"] <= c["max_rules"], "split_fraction": lambda c: 0 < c["fraction"] < 1, "folds": lambda c: c["folds"] >= 1, "exposure": lambda c: c["max_exposure_pct"] > 0,
}
