"""python -m brindle.app analyze|verify|query ...: exit codes 0 done, 1 error, 3 verification failed."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from brindle.app import analysis
from brindle.app.config import load_config
from brindle.app.files import append_summary, dump_rules, load_rules, write_atomic
from brindle.logql.compile import LogStore
from brindle.topology import load_yaml


def time_ns(text: str) -> int:
    t = datetime.fromisoformat(text)
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp()) * 10**9


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="brindle")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("analyze", "verify"):
        s = sub.add_parser(name)
        s.add_argument("--config", required=True)
        s.add_argument("--end", required=True, type=time_ns)
        s.add_argument("--out", default=".")
        s.add_argument("--summary", help="a page that the report is added to")
        if name == "verify":
            s.add_argument("--rules", required=True)
    q = sub.add_parser("query")
    q.add_argument("--logs", required=True)
    q.add_argument("--at", type=time_ns)
    q.add_argument("--start", type=time_ns)
    q.add_argument("--end", type=time_ns)
    q.add_argument("--step", type=int, help="seconds")
    q.add_argument("text")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("brindle").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "query":
        store = LogStore(spark.read.parquet(a.logs))
        if a.at is not None:
            df = store.instant(a.text, a.at)
        elif a.step:
            if a.end <= a.start:
                p.error("end is after start")
            df = store.over(a.text, a.start, a.end, a.step * 10**9)
        else:
            df = store.logs(a.text, a.start, a.end)
        for row in df.toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), ensure_ascii=False))
        return 0
    c = load_config(load_yaml(Path(a.config).read_text()))
    digest = analysis.drain_config(c).digest()
    out = Path(a.out)
    if a.command == "analyze":
        r = analysis.analyze(spark, c, a.end)
        write_atomic(out / "report.json", analysis.report_json(r))
        write_atomic(out / "report.md", analysis.report_markdown(r))
        if a.summary:
            append_summary(a.summary, analysis.report_markdown(r))
        write_atomic(out / "rules.json", dump_rules(r.rules(), digest, c.structured))
        return 0
    v = analysis.verify(spark, c, load_rules(Path(a.rules).read_text(), digest), a.end)
    write_atomic(out / "verify.json", json.dumps({"ok": v.ok, "keep": v.keep, "violations": [[i, q.expr, q.reason] for i, q in v.violations], "drift": v.drift, "gaps": [vars(g) for g in v.gaps]}, indent=1))
    if a.summary:
        append_summary(a.summary, f"# Verification\n\n{len(v.keep)} rules stay; {len(v.violations)} readings, {len(v.gaps)} gaps.\n")
    return 0 if v.ok else 3


if __name__ == "__main__":
    sys.exit(main())
