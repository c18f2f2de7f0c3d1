"""The whole analysis over a synthetic corpus, its files, and verification."""

import json
import os

import pytest
from pyspark.sql import functions as F

from brindle.app import analysis, config, files
from brindle.app.__main__ import main
from brindle.operators.enforce import enforce
from brindle.operators.mining import LineRule
from brindle.sources import logs

NS = 10**9
END = 1_767_571_200 * NS + 20 * NS


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("world")
    corpus = logs.synthetic_logs(spark, 20_000)
    corpus.select("labels", "ts_ns", "line").write.parquet(str(d / "logs"))
    line = lambda q: 'level=info ts=x caller=metrics.go:1 component=frontend query_type=metric query="' + q.replace('"', '\\"') + '"'
    rows = [(END - 20 * NS, line('sum(count_over_time({service_name="kiln"} |= "/ready" [5m]))')), (END - NS, line('{service_name="ferry"} |= "missed the gate"'))]
    spark.createDataFrame(rows, "ts_ns long, line string").write.parquet(str(d / "querylog"))
    (d / "rules").mkdir()
    (d / "rules" / "ruler.json").write_text(json.dumps({"ns": [{"name": "g", "rules": [{"alert": "a", "expr": 'sum(rate({service_name="kiln"} |= "fired at 12" [1m])) > 1'}]}]}))
    ip = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
    doc = {
        "logs": str(d / "logs"), "query_log": str(d / "querylog"), "ruler_rules": str(d / "rules"), "structured": {"loom": "msg"}, "discovery": {"window": "20s", "slices": 4, "sample_lines": 4000},
        "templating": {"masks": {"ip": ip}, "seeds": {"kiln": ["INFO probe /ready answered <*> in <*>", "INFO batch <*> fired at <*> for <*>", "DEBUG door sensor <*> reads <*>"], "ferry": ["INFO passenger <*> boarded deck <*>"]}}, "policy": {"actions": ["dedupe", "aggregate"]},
    }
    return d, doc, analysis.analyze(spark, config.load_config(doc), END)


def test_analysis(world):
    _, _, r = world
    by = {x.candidate.template: x for x in r.recommendations}
    assert by["INFO probe /ready answered <*> in <*>"].action == "none" and by["INFO probe /ready answered <*> in <*>"].readers[0].source == "querylog"
    assert by["INFO batch <*> fired at <*> for <*>"].readers[0].source == "ruler"
    assert by["INFO kiln idle"].action == "dedupe" and by["INFO kiln idle"].upper_bound
    assert by["INFO passenger <*> boarded deck <*>"].action == "aggregate" and not by["INFO passenger <*> boarded deck <*>"].readers
    assert by["shuttle passed in <*>"].action == "aggregate" and by["shuttle passed in <*>"].candidate.structured, by["shuttle passed in <*>"].blockers
    assert any("error-like" in b for t, x in by.items() if "ERROR" in t for b in x.blockers) or not any("ERROR" in t for t in by)
    assert not r.gaps and r.removed_per_day() > 0
    for x in r.recommendations:
        lines, size = r.volumes[x.candidate.id]
        assert lines > 0 and size == x.candidate.bytes


def test_shadow_counts_what_enforcement_removes(world, spark):
    _, doc, r = world
    rows = analysis.log_rows(spark, config.load_config(doc), r.start_ns, r.end_ns).select("service", "text", "ts_ns")
    rules = [LineRule(x.id, x.service, x.language, "drop") for x in r.rules()]
    shadow, real = enforce(rows, rules, ("service",), shadow=True), enforce(rows, rules, ("service",))
    assert rows.count() - real.kept.count() == shadow.volume.agg(F.sum("lines")).first()[0] == sum(r.volumes[x.id][0] for x in rules)


def test_reports_and_rules_file(world, tmp_path):
    _, doc, r = world
    digest = analysis.drain_config(config.load_config(doc)).digest()
    text = files.dump_rules(r.rules(), digest, doc["structured"])
    assert [x.id for x in files.load_rules(text, digest)] == [x.id for x in r.rules()]
    for bad in (text.replace('"aggregate"', '"melt"', 1), text.replace('"keep": 0', '"keep": "0"', 1), text.replace('"version": 1', '"version": 2'), text.replace("r-", "r-f", 1), '{"version": 1, "version": 1}', text.replace('"templating"', '"more": 1, "templating"')):
        with pytest.raises(ValueError):
            files.load_rules(bad, digest)
    with pytest.raises(ValueError):
        files.load_rules(text, "other")
    assert json.loads(analysis.report_json(r))["recommendations"] and "| rule |" in analysis.report_markdown(r)


def test_verify(world, spark):
    _, doc, r = world
    c = config.load_config(doc)
    good = analysis.verify(spark, c, r.rules(), END)
    assert good.ok and good.keep == [x.id for x in r.rules()]
    narrow = LineRule("r-x", "ferry", r"\AINFO passenger ines boarded deck 1\z", "drop", template="INFO passenger <*> boarded deck <*>")
    read = next(x for x in r.recommendations if x.readers)
    bad = analysis.verify(spark, c, [narrow, LineRule(read.candidate.id, read.candidate.service, read.candidate.language)], END)
    assert not bad.ok and bad.drift[0][1] == "drifting" and bad.violations[0][0] == read.candidate.id and bad.keep == []
    missing = analysis.verify(spark, config.load_config({k: v for k, v in doc.items() if k != "query_log"}), r.rules(), END)
    assert not missing.ok and missing.keep == [] and missing.gaps[0].key == "query-log"


def test_command_line(world, tmp_path, capsys):
    d, doc, _ = world
    (tmp_path / "c.json").write_text(json.dumps(doc))
    end = "2026-01-05T00:00:20+00:00"
    assert main(["analyze", "--config", str(tmp_path / "c.json"), "--end", end, "--out", str(tmp_path)]) == 0
    assert main(["verify", "--config", str(tmp_path / "c.json"), "--end", end, "--out", str(tmp_path), "--rules", str(tmp_path / "rules.json")]) == 0
    assert main(["query", "--logs", doc["logs"], "--at", end, 'sum(count_over_time({service_name="ferry"} [1h]))']) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["value"] > 1000


@pytest.mark.parametrize("doc", [{}, {"logs": 1}, {"logs": "x", "more": 1}, {"logs": "x", "discovery": {"window": "0h"}}, {"logs": "x", "discovery": {"window": "4000d"}}, {"logs": "x", "policy": {"actions": ["melt"]}}, {"logs": "x", "policy": {"sample_percent": 100}}, {"logs": "x", "structured": {"s": "a.b"}}, {"logs": "x", "policy": {"error_pattern": "("}}, {"logs": "x", "services": "y"}, []])
def test_bad_configuration(doc):
    with pytest.raises(config.BadConfig):
        config.load_config(doc)


def test_files(tmp_path):
    p = tmp_path / "f"
    files.write_atomic(p, "one")
    assert p.read_text() == "one" and p.stat().st_mode & 0o777 == 0o600
    os.chmod(p, 0o640)
    files.write_atomic(p, "two")
    assert p.read_text() == "two" and p.stat().st_mode & 0o777 == 0o640 and os.listdir(tmp_path) == ["f"]
    page = tmp_path / "page"
    files.append_summary(page, "a\n")
    files.append_summary(page, "b\n" * 100, limit=60)
    assert page.read_text().startswith("a\nb\n") and page.read_text().endswith("full)\n") and page.stat().st_size <= 60
    files.append_summary(page, "c\n" * 100, limit=page.stat().st_size)
    assert "c\n" not in page.read_text()
    page.unlink()
    assert files.printable("a\x1b[0m‮") == "a\\u{1b}[0m\\u{202e}"
    assert files.code("a`b``c") == "```a`b``c```" and files.code("`x") == "`` `x ``"
    assert files.differences({"a": [1, {"b": 2}], "c": 1}, {"a": [1, {"b": 3}], "d": 1}) == [".a[1].b: 2 became 3", ".c: missing", ".d: added"]
    assert files.deployed_difference({"a": 1}, {"a": 2, "b": 1}, {"a": 1, "b": 1}) == [".b: missing"]
