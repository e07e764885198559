"""Command line: `python -m tabweave.cli --inputs ... --output ...`.

Exit codes: 0 done, 1 no input files, 2 wrong arguments, 3 the run failed, 130 cancelled.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
import tempfile

from .operators.contract import as_contract
from .plans import workflow
from .plans.config import Config
from .plans.engine import Engine
from .session import session
from .sources import scan, sinks
from .streaming import watch


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabweave", description="Consolidates tables of many files into one.")
    p.add_argument("--config", help="JSON document of configuration fields")
    p.add_argument("--replay", help="saved workflow to run again")
    p.add_argument("--save-workflow")
    p.add_argument("--workflow-history")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--inputs", nargs="+", default=[])
    p.add_argument("--output")
    p.add_argument("--stdin-format", default="csv", choices=["csv", "tsv", "jsonl"])
    p.add_argument("--delimiter", dest="out_delimiter")
    p.add_argument("--encoding", dest="out_encoding")
    p.add_argument("--no-header", action="store_true")
    p.add_argument("--collision-policy", dest="collision", choices=["replace", "fail", "backup"])
    p.add_argument("--no-manifest", action="store_true")
    p.add_argument("--no-dedupe", action="store_true")
    p.add_argument("--dedupe-columns", nargs="+")
    p.add_argument("--fuzzy-dedupe-threshold", type=float)
    p.add_argument("--dedupe-aggregate", choices=["none", "max", "min", "sum", "concat"])
    p.add_argument("--preview", action="store_true")
    p.add_argument("--preview-rows", type=int, default=100)
    p.add_argument("--preview-scan-rows", type=int, default=5000)
    p.add_argument("--preview-scan-bytes", type=int, default=8 << 20)
    p.add_argument("--preview-columns", type=int, default=256)
    p.add_argument("--preview-cell-bytes", type=int, default=16 << 10)
    p.add_argument("--filter", action="append", default=[], metavar="COL:OP:VALUE")
    p.add_argument("--sort", action="append", default=[], metavar="COL[:asc|desc]")
    p.add_argument("--columns", nargs="+")
    p.add_argument("--exclude-columns", dest="exclude", nargs="+")
    p.add_argument("--rename", action="append", default=[], metavar="OLD=NEW")
    p.add_argument("--header-normalize", choices=["none", "trim", "lowercase", "snake_case"])
    p.add_argument("--schema-mode", choices=["union", "intersection", "first_file"])
    p.add_argument("--column-template")
    p.add_argument("--source-column")
    p.add_argument("--source-path", action="store_true")
    p.add_argument("--invalid-row-policy", dest="invalid_rows", choices=["fail", "warn", "quarantine"])
    p.add_argument("--quarantine")
    p.add_argument("--max-rows", type=int)
    p.add_argument("--max-file-bytes", type=int)
    p.add_argument("--max-cell-bytes", type=int)
    p.add_argument("--max-json-nesting", type=int)
    p.add_argument("--max-decompressed-bytes", type=int)
    p.add_argument("--schema-report")
    p.add_argument("--schema-contract")
    p.add_argument("--export-schema")
    p.add_argument("--validation-mode", choices=["strict", "advisory", "quarantine"])
    p.add_argument("--validate-only", action="store_true")
    p.add_argument("--profile")
    p.add_argument("--quality-max-distinct", type=int, default=100_000)
    p.add_argument("--repair-edits")
    p.add_argument("--sql")
    p.add_argument("--sql-file")
    p.add_argument("--sql-max-rows", type=int, default=100_000)
    p.add_argument("--sql-timeout-seconds", type=float, default=30)
    p.add_argument("--redact-sensitive", dest="redact", action="store_true")
    p.add_argument("--redaction-token")
    p.add_argument("--unpivot", nargs="+")
    p.add_argument("--pivot-column")
    p.add_argument("--pivot-value")
    p.add_argument("--pivot-aggregate", choices=["first", "sum", "min", "max", "concat"])
    p.add_argument("--join-on", nargs="+")
    p.add_argument("--join-type", default="inner", choices=["inner", "left", "right", "outer", "full", "semi", "anti"])
    p.add_argument("--join-conflict-policy", default="keep-both", choices=["keep-both", "fail"])
    p.add_argument("--key-normalization", default="trim-casefold", choices=["exact", "trim", "casefold", "trim-casefold"])
    p.add_argument("--three-way-base")
    p.add_argument("--three-way-ours")
    p.add_argument("--three-way-theirs")
    p.add_argument("--key-columns", nargs="+", default=[])
    p.add_argument("--conflict-resolution", default="fail", choices=["fail", "ours", "theirs", "base", "mark"])
    p.add_argument("--watch", action="store_true")
    p.add_argument("--watch-interval", type=float, default=2)
    p.add_argument("--watch-settle-seconds", type=float, default=1)
    p.add_argument("--watch-rounds", type=int)
    p.add_argument("--watch-state")
    p.add_argument("--stats-json")
    return p


def configured(a: argparse.Namespace) -> Config:
    """The configuration document with the flags over it."""
    document = json.load(open(a.config, encoding="utf-8")) if a.config else {}
    given = {f.name: getattr(a, f.name) for f in dataclasses.fields(Config) if getattr(a, f.name, None) not in (None, [], False)}
    for name in ("columns", "exclude", "unpivot"):
        if name in given:
            given[name] = [c for x in given[name] for c in x.split(",")]
    given.pop("sort", None)
    given.pop("rename", None)
    if a.filter:
        given["filters"] = [(*f.split(":", 2), "")[:3] for f in a.filter]
    if a.sort:
        given["sort"] = [(s.rpartition(":")[0], s.endswith(":asc")) if s.endswith((":asc", ":desc")) else (s, True) for s in a.sort]
    if a.rename:
        given["rename"] = dict(r.split("=", 1) for r in a.rename)
    if a.no_dedupe:
        given["dedupe"] = False
    if a.fuzzy_dedupe_threshold is not None:
        if not 50 <= a.fuzzy_dedupe_threshold <= 100:
            raise ValueError("the fuzzy threshold goes from 50 to 100")
        given["fuzzy_threshold"] = a.fuzzy_dedupe_threshold
    if a.no_header:
        given["header"] = False
    if a.no_manifest:
        given["manifest"] = False
    if a.schema_contract:
        given["contract"] = json.load(open(a.schema_contract, encoding="utf-8"))
    if a.repair_edits:
        given["repairs"] = json.load(open(a.repair_edits, encoding="utf-8"))
    if a.out_delimiter == "\\t":
        given["out_delimiter"] = "\t"
    listed = lambda v: [listed(x) for x in v] if isinstance(v, (list, tuple)) else v
    return Config.of({k: listed(v) for k, v in (document | given).items()})


def run(a: argparse.Namespace) -> int:
    config, inputs, output = configured(a), a.inputs, a.output
    if a.replay:
        config, inputs, output = workflow.replayed(workflow.load(a.replay))
        inputs, output = a.inputs or inputs, a.output or output
    spark = session("tabweave-cli")
    merging = a.three_way_base and a.three_way_ours and a.three_way_theirs
    files = [scan.staged_stdin(a.stdin_format) if f == "-" else f for f in scan.expand(inputs, spark=spark)]
    if not files and not merging:
        print("no input files", file=sys.stderr)
        return 1
    if a.save_workflow or a.workflow_history:
        document = workflow.build(config, files, output)
        if a.save_workflow:
            workflow.save(a.save_workflow, document)
        if a.workflow_history:
            try:
                past = workflow.load(a.workflow_history)
            except OSError:
                past = None
            workflow.save(a.workflow_history, workflow.remembered(past, document))
    if a.dry_run:
        print(json.dumps({"files": files, "output": output, "config": config.document()}, default=str, indent=2))
        return 0
    engine = Engine(spark, config)
    put = lambda df, order=(): sinks.write(df, output, [c for c in df.columns if c not in order], [df[o].asc_nulls_last() for o in order], config.out_delimiter, config.out_encoding, config.quoting, config.header, config.line_ending, config.collision)
    rows = lambda df: [r.asDict() for r in df.collect()]
    stats: dict = {}
    if a.export_schema:
        df, _ = engine.scanned(files[:1])
        sinks.write_json(a.export_schema, as_contract(df.select(*scan.visible(df))))
    elif a.validate_only:
        some = False
        print("[", end="")
        for r in engine.validate(files).toLocalIterator():
            print((", " if some else "") + json.dumps(r.asDict(), default=str, ensure_ascii=False), end="")
            some = True
        print("]")
        return 3 if some and config.validation_mode == "strict" else 0
    elif a.sql or a.sql_file:
        text = a.sql or open(a.sql_file, encoding="utf-8").read()
        found, report = engine.sql(files, text, max_rows=a.sql_max_rows, timeout=a.sql_timeout_seconds)
        stats = dataclasses.asdict(report)
        if output:
            put(engine.spark.createDataFrame([tuple(r) for r in found], ", ".join(f"`{c}` string" for c in report.columns)))
        else:
            print(json.dumps([r.asDict() for r in found], ensure_ascii=False))
    elif a.schema_report:
        sinks.write_json(a.schema_report, engine.schema_report(files))
    elif a.profile:
        sinks.write_json(a.profile, {"format": "quality-profile", "version": 1, "columns": rows(engine.profile(files, distinct=a.quality_max_distinct))})
    elif a.preview:
        print(json.dumps(rows(engine.preview(files, a.preview_rows, a.preview_scan_rows, a.preview_columns, a.preview_cell_bytes, a.preview_scan_bytes)), ensure_ascii=False))
    elif merging:
        put(*engine.merged(a.three_way_base, a.three_way_ours, a.three_way_theirs, a.key_columns, a.conflict_resolution, form=a.key_normalization))
    elif a.join_on:
        put(*engine.joined(files, a.join_on, a.join_type, a.key_normalization, a.join_conflict_policy))
    elif a.watch:
        watch.loop(lambda: scan.expand(inputs), lambda: engine.process(scan.expand(inputs), output), a.watch_state or f"{output}.watch.json", a.watch_interval, a.watch_settle_seconds, config.identity(), a.watch_rounds)
    elif output == "-":
        out = engine.frame(files)
        with tempfile.TemporaryDirectory() as folder:
            path = sinks.write(out, f"{folder}/out.csv", [c for c in out.columns if c not in scan.HIDDEN], [out[c] for c in ("_file", "_ord") if c in out.columns])
            sys.stdout.write(open(path, encoding="utf-8").read())
    else:
        stats = engine.process(files, output)
    if a.stats_json:
        sinks.write_json(a.stats_json, {"format": "cli-stats", "version": 1, "exit_code": 0, "stats": stats})
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return run(a)
    except KeyboardInterrupt:
        return 130
    except (ValueError, OverflowError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
