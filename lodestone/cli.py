"""Commands: ``python -m lodestone scan all --repo DIR --store DIR``, ``rules list``, ``rules validate``, ``rules init``.

Each returns an exit code: 0 for none, 1 for findings as bad as ``--fail-on``, 2 for a faulty configuration.
"""

from __future__ import annotations

import argparse
import datetime as dt
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import reports, scan
from .sources import config, store


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("scan")
    one.add_argument("what", choices=["all", *scan.DETECTORS, "churn"])
    one.add_argument("--repo", default=".")
    one.add_argument("--store", required=True)
    one.add_argument("--run-id", default=None)
    one.add_argument("--append", action="store_true", help="add to a run that is there")
    one.add_argument("--fail-on", default="Error", choices=["Error", "Warning", "Info"])
    one.add_argument("--since", default=None, help="days of history, as 90d")
    one.add_argument("--env-pattern", default=None, help="names of files of environments: base, environment, ending")
    one.add_argument("--rule", action="append", default=[], metavar="ID=SEVERITY|off")
    rules = commands.add_parser("rules")
    rules.add_argument("what", choices=["list", "validate", "init"])
    rules.add_argument("--repo", default=".")
    return top


def rules(what: str, repo: str, say=print) -> int:
    """``list`` the rules in force, ``validate`` the files that set them, or write templates (``init``)."""
    top = config.find_root(repo)
    if what == "init":
        for path in config.scaffold(top):
            say(path)
        return 0
    bundle = config.load(top)
    config.side_files(top, bundle)
    if what == "list":
        for rule, severity, enabled, source in config.rule_list(bundle):
            say(f"{rule}\t{severity}\t{'on' if enabled else 'off'}\t{source}")
    for kind, lines in (("error", bundle.errors), ("warning", bundle.warnings)):
        for line in lines:
            say(f"{kind}: {line}")
    return 2 if bundle.errors else 0


def main(args: list[str] | None = None, spark: SparkSession | None = None, say=print) -> int:
    a = _parser().parse_args(args)
    if a.command == "rules":
        return rules(a.what, a.repo, say)
    spark = spark or SparkSession.builder.getOrCreate()
    overrides = {r.partition("=")[0]: False if r.partition("=")[2].lower() == "off" else r.partition("=")[2] for r in a.rule}
    run_id = a.run_id or uuid.uuid4().hex
    code = scan.scan_repository(
        spark, a.repo, a.store, run_id, dt.datetime.now(dt.timezone.utc), overrides, None if a.what == "all" else [a.what], a.append, a.fail_on, since=a.since, env_pattern=a.env_pattern
    )
    if code == 2:
        return rules("validate", a.repo, say)
    s = store.read(spark, a.store)
    mine = F.col("run_id") == run_id
    for r in reports.console_summary(s.findings.where(mine), metrics=s.metrics.where(mine)).collect():
        say(f"{r.kind}\t{r.name}\t{r.n}")
    return code
