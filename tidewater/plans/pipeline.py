"""Pipelines: lists of steps that compile to one lazy plan."""

from __future__ import annotations

import inspect
import json
import os
import tempfile
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.errors import PipelineSerializationError, PipelineStepError, TidewaterError, UnknownStepError
from tidewater.operators import columns as C
from tidewater.operators import rows as R
from tidewater.operators import values as V
from tidewater.operators.rowid import with_row_id

LINEAGE = "__tidewater_lineage__"


def clean(df: DataFrame, *, strip_whitespace=True, drop_nulls=False, drop_duplicates=False) -> DataFrame:
    """Strip, then drop nulls, then drop duplicates; each a flag or the step's options."""
    for on, step in ((strip_whitespace, V.strip_whitespace), (drop_nulls, R.drop_nulls), (drop_duplicates, R.drop_duplicates)):
        if on is not False and not isinstance(on, bool | dict):
            raise TypeError("clean: each option must be a flag or a dict of options")
        if on or on == {}:
            df = step(df, **(on if isinstance(on, dict) else {}))
    return df


_BUILTIN: dict[str, Callable] = {
    f.__name__: f
    for f in (
        R.filter_rows, R.drop_nulls, R.keep_rows_with_nulls, R.drop_duplicates, R.drop_constant_columns, R.drop_empty_columns,
        C.validate_columns_exist, C.select_columns, C.drop_columns, C.drop_columns_matching, C.rename_columns, C.rename_columns_matching, C.trim_column_names,
        C.clean_column_names, C.sanitize_column_names, C.slugify_column_names, C.make_column_names_unique, C.combine_columns, C.coalesce_columns, C.split_column, C.encode_categorical,
        V.strip_whitespace, V.normalize_whitespace, V.remove_control_characters, V.normalize_case, V.normalize_unicode, V.hash_columns, V.fill_nulls, V.cast_types,
        V.parse_bool_strings, V.parse_numeric_strings, V.standardize_missing_tokens, V.map_values, V.replace_values, V.clip_numeric, V.winsorize_outliers,
        V.normalize_minmax, V.round_numeric_columns, V.collapse_rare_categories, V.safe_divide_columns, clean,
    )
}
_custom: dict[str, Callable] = {}
_lock = threading.RLock()
#: Steps that can be written as a bare mapping.
_MAPPING = ("rename_columns", "cast_types")
#: Steps that look at single rows and so work on streams as well.
ROW_LOCAL = {
    "filter_rows", "drop_nulls", "keep_rows_with_nulls", "validate_columns_exist", "select_columns", "drop_columns", "drop_columns_matching", "rename_columns", "rename_columns_matching",
    "trim_column_names", "clean_column_names", "sanitize_column_names", "slugify_column_names", "make_column_names_unique", "combine_columns", "coalesce_columns", "strip_whitespace",
    "normalize_whitespace", "remove_control_characters", "normalize_case", "normalize_unicode", "hash_columns", "fill_nulls", "cast_types", "parse_numeric_strings",
    "standardize_missing_tokens", "map_values", "replace_values", "clip_numeric", "round_numeric_columns", "safe_divide_columns",
}


@dataclass(frozen=True)
class PipelineContext:
    """Given to a step that has a parameter ``context``."""

    step_name: str
    step_index: int
    total_steps: int
    dry_run: bool


@dataclass(frozen=True)
class LineageReport:
    """Row numbers that each step dropped."""

    dropped: dict[str, list[int]]

    @property
    def total_dropped(self) -> int:
        return sum(map(len, self.dropped.values()))

    def to_dict(self) -> dict:
        return {"dropped": self.dropped, "total_dropped": self.total_dropped}


def register_step(name: str, fn: Callable, overwrite: bool = False) -> None:
    """Adds ``fn(df, **options) -> df`` as a step."""
    if not isinstance(name, str) or not name.strip():
        raise ValueError("register_step: the name must be a string with text")
    if not callable(fn):
        raise TypeError("register_step: the step must be callable")
    with _lock:
        if name in _BUILTIN:
            raise ValueError(f"register_step: {name!r} is built in")
        if name in _custom and not overwrite:
            raise ValueError(f"register_step: {name!r} is registered")
        _custom[name] = fn


def unregister_step(name: str) -> None:
    with _lock:
        if name in _BUILTIN:
            raise ValueError(f"unregister_step: {name!r} is built in")
        if name not in _custom:
            raise UnknownStepError(name, list_steps())
        del _custom[name]


def reset_steps() -> None:
    """Forgets all registered steps."""
    with _lock:
        _custom.clear()


def list_steps() -> list[str]:
    with _lock:
        return sorted([*_BUILTIN, *_custom])


def get_builtin_step_signatures() -> dict[str, inspect.Signature]:
    """Signatures of the built-in steps without their frame."""
    out = {}
    for name, fn in _BUILTIN.items():
        s = inspect.signature(fn)
        out[name] = s.replace(parameters=list(s.parameters.values())[1:])
    return out


def parse_steps(steps) -> list[tuple[str, dict]]:
    """Steps as (name, options), their form checked."""
    if isinstance(steps, str | bytes) or not hasattr(steps, "__iter__"):
        raise TypeError("a pipeline is a list of steps")
    out = []
    for k, step in enumerate(steps):
        if isinstance(step, str):
            raise TypeError(f"step {k} must be a tuple, such as ({step!r},)")
        if not isinstance(step, tuple | list) or not 1 <= len(step) <= 2:
            raise ValueError(f"step {k} must be (name,) or (name, options)")
        name, options = step[0], (step[1] if len(step) == 2 else {})
        if not isinstance(name, str):
            raise TypeError(f"step {k}: the name must be a string")
        if not isinstance(options, dict):
            raise TypeError(f"step {k}: the options must be a dict")
        if name in _MAPPING and options and "mapping" not in options:
            options = {"mapping": options}
        out.append((name, options))
    return out


def _call(fn: Callable, df: DataFrame, name: str, options: dict, context: PipelineContext, custom: bool) -> DataFrame:
    if custom:
        options = dict(options)
        try:
            if "context" in inspect.signature(fn).parameters and "context" not in options:
                options["context"] = context
        except ValueError:
            pass
    try:
        out = fn(df, **options)
    except (TidewaterError, KeyError, ValueError, TypeError) if not custom else ():
        raise
    except Exception as error:
        raise PipelineStepError(name, error) from error
    if not isinstance(out, DataFrame):
        raise TypeError(f"step {name!r} must return a DataFrame, not {type(out).__name__}")
    return out


def pipeline(df: DataFrame, steps, *, return_metadata: bool = False, dry_run: bool = False, track_lineage: bool = False):
    """Applies steps in order. Nothing runs, but for what single steps must know of the data.

    ``dry_run`` builds each step on the one before, so that errors show, and
    returns the frame unchanged. ``return_metadata`` counts rows before and
    after (two jobs) and returns (frame, metadata). ``track_lineage`` returns
    (frame, LineageReport): rows are numbered, and the numbers that a step
    dropped are found by anti joins.
    """
    if return_metadata and track_lineage:
        raise ValueError("pipeline: return_metadata and track_lineage exclude each other")
    todo = parse_steps(steps)
    with _lock:
        known = {**_BUILTIN, **_custom}
        custom = set(_custom)
    for name, _ in todo:
        if name not in known:
            raise UnknownStepError(name, list(known))
    now = with_row_id(df, name=LINEAGE) if track_lineage else df
    timings, dropped = [], {}
    for k, (name, options) in enumerate(todo):
        began = time.perf_counter()
        before = now
        if track_lineage:
            now = _tracked(known[name], now, name, options, PipelineContext(name, k, len(todo), dry_run), name in custom)
            ids = [r[0] for r in before.select(LINEAGE).join(now.select(LINEAGE), LINEAGE, "left_anti").orderBy(LINEAGE).collect()]
            dropped[name] = sorted(dropped.get(name, []) + ids)
        else:
            now = _call(known[name], now, name, options, PipelineContext(name, k, len(todo), dry_run), name in custom)
        timings.append({"step": name, "seconds": time.perf_counter() - began})
    result = df if dry_run else now.drop(LINEAGE) if track_lineage else now
    if track_lineage:
        return result, LineageReport(dropped)
    if return_metadata:
        rows = {"before": df.count(), "after": now.count()}
        names = [n for n, _ in todo]
        summary = {"total_steps": len(todo), "total_seconds": sum(t["seconds"] for t in timings), "rows_removed": rows["before"] - rows["after"], "dry_run": dry_run}
        return result, {"applied_steps": names, "row_counts": rows, "step_timings": timings, "execution_summary": summary}
    return result



def _tracked(fn: Callable, df: DataFrame, name: str, options: dict, context: PipelineContext, custom: bool) -> DataFrame:
    own = [c for c in df.columns if c != LINEAGE]
    options = dict(options)
    if name in ("fill_nulls", "map_values", "drop_duplicates", "drop_nulls", "keep_rows_with_nulls", "combine_columns") and options.get("subset") is None and "columns" not in options:
        options["subset"] = own
    if name == "replace_values" and options.get("column") is None:
        fn, name, options = V.map_values, "map_values", {"mapping": options["mapping"], "subset": own}
    if name in ("clip_numeric", "winsorize_outliers", "normalize_minmax") and options.get("subset") is None:
        options["subset"] = [c for c in own if V.is_number(df, c)]
        if not options["subset"]:
            return df
    if name == "drop_duplicates" and options.get("order_by") is None:
        options["order_by"] = LINEAGE
    if name == "select_columns":
        options["columns"] = [*options["columns"], LINEAGE]
    if name == "drop_constant_columns":
        kept = fn(df.drop(LINEAGE)).columns
        return df.select(*kept, LINEAGE)
    if name in ("clean_column_names", "sanitize_column_names", "slugify_column_names", "rename_columns_matching", "drop_columns_matching"):
        bare = fn(df.drop(LINEAGE), **options)
        if name == "drop_columns_matching":
            return df.select(*[V.quoted(c) for c in bare.columns], LINEAGE)
        return df.select(*[V.quoted(a).alias(b) for a, b in zip(own, bare.columns, strict=True)], LINEAGE)
    out = _call(fn, df, name, options, context, custom)
    if LINEAGE not in out.columns:
        raise PipelineStepError(name, ValueError("the step removed the hidden row number"))
    return out


def plan_lines(df: DataFrame) -> list[str]:
    """The physical plan, for tests of pushdown and shuffles."""
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def save_pipeline(steps, filepath) -> None:
    """Writes the steps as JSON or YAML, by the suffix; the file appears whole or not at all."""
    todo = [[n, o] for n, o in parse_steps(steps)]
    path = Path(filepath)
    try:
        if path.suffix in (".yaml", ".yml"):
            import yaml

            body = yaml.safe_dump({"steps": todo}, sort_keys=False, allow_unicode=True)
        elif path.suffix == ".json":
            body = json.dumps({"steps": todo}, indent=2, ensure_ascii=False)
        else:
            raise PipelineSerializationError(f"unknown suffix {path.suffix!r}; use .json, .yaml or .yml")
    except (TypeError, ValueError) as error:
        raise PipelineSerializationError(f"the pipeline can't be saved: {error}") from error
    write_whole(path, body)


def write_whole(path: Path, body: str) -> None:
    handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=path.name)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(body)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def load_pipeline(filepath) -> list[tuple[str, dict[str, Any]]]:
    """Steps of a file that ``save_pipeline`` wrote."""
    path = Path(filepath)
    try:
        text = path.read_text(encoding="utf-8")
        if path.suffix in (".yaml", ".yml"):
            import yaml

            found = yaml.safe_load(text)
        elif path.suffix == ".json":
            found = json.loads(text)
        else:
            raise PipelineSerializationError(f"unknown suffix {path.suffix!r}; use .json, .yaml or .yml")
    except PipelineSerializationError:
        raise
    except Exception as error:
        raise PipelineSerializationError(f"{path}: {error}") from error
    if isinstance(found, dict):
        found = found.get("steps")
    if not isinstance(found, list):
        raise PipelineSerializationError(f"{path}: no list of steps")
    try:
        return parse_steps([tuple(s) if isinstance(s, list) else s for s in found])
    except (TypeError, ValueError) as error:
        raise PipelineSerializationError(f"{path}: {error}") from error


def counted(df: DataFrame, name: str):
    """The frame and an observation of its row count, filled by whatever action runs next."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
