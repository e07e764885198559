"""Runs: files in, one plan, one result out; and the reports that only look."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import contract, dedupe, filters, joins, merge, profile, project, repair, reshape, sort, transforms
from ..sources import files, scan, sinks
from . import sql_lane
from .config import Config

ORDER = ["_file", "_ord"]


def compiled(df: DataFrame, c: Config) -> DataFrame:
    """The plan over rows with the order columns `_file` and `_ord`: contract, repairs, columns, filters, transforms,
    reshape, dedupe, redaction. Sorting is left to the sink, which also has the order columns."""
    hidden = [x for x in ORDER if x in df.columns]
    if c.contract:
        df = contract.enforced(df, c.contract, hidden, c.validation_mode)
    if c.repairs:
        df = repair.repair(df, c.repairs, hidden or df.columns)
    df = filters.apply(df, c.filters, c.filter_logic)
    names = [x for x in df.columns if x not in hidden]
    mapping = project.checked_mapping(c.rename, names) if c.rename else {}
    kept = project.select(df.select(*[F.col(X.quoted(n)) for n in names]), c.columns, c.exclude, c.column_order).columns
    body = transforms.apply(_only(df, names, hidden), c.transforms, c.case, c.empty_value, mapping, c.fill_blank)
    made = [n for n in body.columns if n not in hidden and n not in [mapping.get(x, x) for x in names]]
    df = body.select(*[F.col(X.quoted(mapping.get(n, n))) for n in kept], *[F.col(X.quoted(n)) for n in made], *hidden)
    if c.unpivot:
        ids = [n for n in df.columns if n not in c.unpivot]
        df = reshape.unpivot(df, ids, c.unpivot, c.unpivot_name, c.unpivot_value)
    if c.pivot_column and c.pivot_value:
        index = list(c.pivot_index) if c.pivot_index is not None else [n for n in df.columns if n not in (c.pivot_column, c.pivot_value, *hidden)]
        df = reshape.pivot(df, c.pivot_column, c.pivot_value, index, c.pivot_aggregate, hidden or index, c.pivot_separator)
        hidden = []
    names = [n for n in df.columns if n not in hidden]
    if c.dedupe:
        df = _deduped(df, c, names, hidden or names)
    return transforms.redact(df, c.redaction_token, names) if c.redact else df


def _only(df: DataFrame, names: Sequence[str], hidden: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(X.quoted(n)) for n in names], *hidden)


def _deduped(df: DataFrame, c: Config, names: Sequence[str], order: Sequence[str]) -> DataFrame:
    mapping = c.rename or {}
    keys = [mapping.get(k, k) for k in c.dedupe_columns if mapping.get(k, k) in names] if c.dedupe_columns else list(names)
    if c.fuzzy_threshold is not None:
        return dedupe.fuzzy(df, keys, c.fuzzy_threshold, order, c.fuzzy_block_by)
    if c.dedupe_aggregate != "none" and len(keys) < len(names):
        return dedupe.aggregate(df, [*keys, *[o for o in order if o not in names]], c.dedupe_aggregate, order, c.dedupe_separator, c.case_sensitive)
    return dedupe.distinct(df, keys, c.dedupe_keep, order, c.case_sensitive)


def _in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(o).asc_nulls_last() for o in order]).drop(*order)


class Engine:
    """The entry points over files."""

    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config()

    def scanned(self, files: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        c = self.config
        limits = scan.Limits(c.max_file_bytes, c.max_rows, c.max_columns, c.max_cell_bytes, c.max_json_nesting, c.max_decompressed_bytes)
        return scan.read_all(self.spark, files, c.invalid_rows, c.schema_mode, limits, delimiter=c.delimiter, encoding=c.encoding, headers=c.header_normalize, trim=c.trim, source_column=c.source_column, source_path=c.source_path)

    def frame(self, files: Sequence[str]) -> DataFrame:
        """The result's rows, with their order columns where they still have one."""
        return self._result(self.scanned(files)[0])

    def _result(self, df: DataFrame) -> DataFrame:
        c = self.config
        if c.column_template:
            first = scan.visible(scan.read(self.spark, c.column_template))
            c = dataclasses.replace(c, column_order=tuple(first))
        return compiled(df, c)

    def process(self, files: Sequence[str], output: str) -> dict:
        """Writes the result and gives its figures; the manifest goes beside it."""
        c = self.config
        df, bad = self.scanned(files)
        if c.invalid_rows == "quarantine" and c.quarantine:
            sinks.quarantine(bad, c.quarantine, files)
        out = self._result(df)
        names = [n for n in out.columns if n not in ORDER]
        by = [(n, up) for n, up in c.sort if n in names]
        keyed, order = sort.projected(out, by, [o for o in ORDER if o in out.columns], numeric_aware=c.sort_numeric_aware, case_sensitive=c.case_sensitive)
        path = sinks.write(keyed, output, names, order, c.out_delimiter, c.out_encoding, c.quoting, c.header, c.line_ending, c.collision)
        stats = {"files": len(files), "rows_in": df.count(), "rows_out": out.count(), "bad_rows": bad.count(), "columns": names}
        if c.manifest:
            sinks.write_json(f"{path}.manifest.json", sinks.manifest(path, files, c.document(), names, stats))
        return stats

    def preview(self, files: Sequence[str], rows: int = 100, scan_rows: int = 5000, columns: int = 256, cell_bytes: int = 16 << 10, scan_bytes: int = 8 << 20) -> DataFrame:
        """The whole plan on the first rows of the scan, at most scan_rows of at most scan_bytes together, cells clipped.

        No file is read further than its first split.
        """
        c = self.config
        tables = [scan.read(self.spark, f, i, c.delimiter, c.encoding, c.header_normalize, c.trim, c.source_column, c.source_path, beginning=True) for i, f in enumerate(files)]
        df = project.union(tables, c.schema_mode)
        first = df.limit(sort.fitting(df.drop(*scan.HIDDEN), scan_rows, scan_bytes))
        good, _ = scan.judged(first, c.invalid_rows)
        out = compiled(good.drop("_bad"), c)
        return sort.preview(out.select(*[F.col(X.quoted(n)) for n in out.columns if n not in ORDER]), rows, scan_rows, columns, cell_bytes)

    def profile(self, files: Sequence[str], column: str | None = None, value: str | None = None, distinct: int = 100_000) -> DataFrame:
        """The columns' figures; up to `distinct` values of a column are counted exactly."""
        df, _ = self.scanned(files)
        df = profile.facet_rows(df, column, value or "") if column else df
        return profile.bounded(df, scan.visible(df), distinct)

    def schema_report(self, files: Sequence[str]) -> dict:
        """Columns, types and samples of each file, and how the files differ."""
        tables = {f: scan.read(self.spark, f, i, self.config.delimiter, self.config.encoding, self.config.header_normalize) for i, f in enumerate(files)}
        shown = {f: d.select(*[F.col(X.quoted(n)) for n in scan.visible(d)]) for f, d in tables.items()}
        report = profile.drift(shown)
        for f, d in tables.items():
            kinds = {r["column"]: r["type"] for r in profile.column_types(shown[f]).collect()} if shown[f].columns else {}
            seen: dict[str, list[str]] = {}
            for r in profile.samples(d, shown[f].columns, ORDER).orderBy("column", "rank").collect() if shown[f].columns else []:
                seen.setdefault(r["column"], []).append(r["value"])
            report["files"][f] |= {"types": kinds, "samples": seen}
        return report

    def validate(self, files: Sequence[str]) -> DataFrame:
        """Errors against the contract, each file by itself."""
        df, _ = self.scanned(files)
        return contract.errors(df, self.config.contract, ORDER, within=["_file"])

    def _ordered(self, engine: Engine, path: str, order: str) -> DataFrame:
        """A file's columns and its row order as the column `order`."""
        table = engine.scanned([path])[0]
        return table.select(*[F.col(X.quoted(n)) for n in scan.visible(table)], F.struct(*ORDER).alias(order))

    def joined(self, files: Sequence[str], keys: Sequence[str], how: str = "inner", form: str = "trim-casefold", conflict_policy: str = "keep-both") -> tuple[DataFrame, list[str]]:
        """The files joined in the given order, then filters, transforms and redaction; and the names of the columns that
        hold the result's order (nulls last): the left rows' own, matches in the right rows' order, unmatched right rows last."""
        plain = Engine(self.spark, dataclasses.replace(self.config, filters=(), source_column=None))
        order = [f"_order{i}" for i in range(len(files))]
        out, *rest = [self._ordered(plain, f, o) for f, o in zip(files, order, strict=True)]
        for t, o in zip(rest, order[1:], strict=True):
            if conflict_policy == "fail" and not joins.conflicts(out.drop(*order), t.drop(o), keys, form).isEmpty():
                raise joins.JoinError("shared columns differ")
            out = joins.join(out, t, keys, how, form)
        out = transforms.apply(filters.apply(out, self.config.filters, self.config.filter_logic), self.config.transforms, self.config.case, order=order)
        order = [o for o in order if o in out.columns]
        return (transforms.redact(out, self.config.redaction_token, [c for c in out.columns if c not in order]) if self.config.redact else out), order

    def join(self, *args, **options) -> DataFrame:
        """The rows of `joined` in their order."""
        return _in_order(*self.joined(*args, **options))

    def merged(self, base: str, ours: str, theirs: str, keys: Sequence[str] = (), resolution: str = "fail", **options) -> tuple[DataFrame, list[str]]:
        """The three-way merge, and the names of the columns that hold its order: base rows first, then those that ours and theirs added."""
        out = merge.merge(*[self._ordered(self, f, "_order") for f in (base, ours, theirs)], keys, resolution, order="_order", **options)
        return out, ["base_order", "ours_order", "theirs_order"]

    def merge(self, *args, **options) -> DataFrame:
        """The rows of `merged` in their order."""
        return _in_order(*self.merged(*args, **options))

    def sql(self, files: Sequence[str], text: str, **bounds) -> tuple[list, sql_lane.Report]:
        """A query over typed views of the files."""
        return_frame, report = sql_lane.query([typed(self.spark, f) for f in files], text)
        rows = sql_lane.collected(return_frame, **bounds)
        report.rows = len(rows)
        return rows, report


def typed(spark: SparkSession, path: str) -> DataFrame:
    """A file with inferred types; an empty one has the column `__empty_input`, a malformed row is an error."""
    suffix = files.suffix(path)
    if files.length(spark, path) == 0:
        return spark.createDataFrame([], "__empty_input string")
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix in scan.LINES:
        return spark.read.json(path)
    df, _ = scan.judged(scan.read(spark, path, trim=False), "fail")
    return df.drop(*scan.HIDDEN) if suffix == ".xlsx" else scan.typed(df)
