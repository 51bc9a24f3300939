"""Behaviour of operators, pipelines, contracts, sources and sinks on small frames."""

from __future__ import annotations

import difflib
import gzip
import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import tidewater as tw
from tidewater.plans.pipeline import plan_lines


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "  Ann ", 31, 1.5, True), (2, None, None, None, None), (3, "bob\t", 31, float("nan"), False), (1, "  Ann ", 31, 1.5, True)], "id long, name string, age long, score double, ok boolean").coalesce(1)


# -- values -------------------------------------------------------------------
def test_strip_and_case(spark):
    df = spark.createDataFrame([("\v\fSão Paulo\r\n",), (" x ",), (None,), ("",)], "s string")
    assert rows(tw.strip_whitespace(df)) == [("São Paulo",), (" x ",), (None,), ("",)]
    assert rows(tw.normalize_whitespace(df)) == [("São Paulo",), ("x",), (None,), ("",)]
    assert rows(tw.normalize_case(tw.strip_whitespace(df), case_type="upper"))[0] == ("SãO PAULO",)
    title = spark.createDataFrame([("foo-bar_baz.qux/ünder it's",)], "s string")
    assert rows(tw.normalize_case(title, case_type="title")) == [("Foo-Bar_Baz.Qux/ünder It's",)]
    with pytest.raises(ValueError, match="case_type"):
        tw.normalize_case(df, case_type="x")


def test_unicode_controls_hash(spark):
    df = spark.createDataFrame([("é\x07\x7f",), (None,)], "s string")
    assert rows(tw.normalize_unicode(tw.remove_control_characters(df))) == [("é",), (None,)]
    with pytest.raises(TypeError):
        tw.hash_columns(spark.range(2), subset=["id"])
    with pytest.raises(ValueError, match="form"):
        tw.normalize_unicode(df, form="x")


def test_nulls_and_nan_differ(people):
    assert tw.drop_nulls(people, subset=["score"]).count() == 3
    assert tw.keep_rows_with_nulls(people, subset=["score"]).count() == 1
    filled = rows(tw.fill_nulls(people, 7, subset=["age", "score"]).select("age", "score"))
    assert filled[1] == (7, 7.0) and math.isnan(filled[2][1])
    for bad in (1.5, "x", float("inf")):
        with pytest.raises(ValueError):
            tw.fill_nulls(people, bad, subset=["age"])
    with pytest.raises(ValueError):
        tw.fill_nulls(people, 1)


def test_casts(spark):
    df = spark.createDataFrame([("+12", "true"), (" 3", "0"), ("1.5", "yes"), ("99999999999999999999", None)], "a string, b string")
    assert rows(tw.cast_types(df, {"a": "int64", "b": "bool"}, errors="coerce")) == [(12, True), (3, False), (None, None), (None, None)]
    _, failures = tw.cast_types(df, {"a": "int64", "b": "bool"}, errors="report")
    assert sorted(rows(failures)) == [("a", 2, "1.5", "int64"), ("a", 3, "99999999999999999999", "int64"), ("b", 2, "yes", "bool")]
    with pytest.raises(Exception, match="can't be int64"):
        tw.cast_types(df, {"a": "int64"}).collect()
    with pytest.raises(tw.TypeCastError, match="row 3"):
        tw.checked_cast(df, {"a": "int64"})
    with pytest.raises(ValueError):
        tw.cast_types(df, {"zz": "int64"})
    floats = spark.createDataFrame([(1.0,)], "x double")
    assert rows(tw.cast_types(floats, {"x": "int64"}, errors="coerce")) == [(None,)]


def test_parsing(spark):
    df = spark.createDataFrame([(" Yes", "$1,200"), ("n", "12%"), (None, "abc"), ("0", "£-3.5")], "b string, n string")
    assert rows(tw.parse_bool_strings(df, subset=["b"]).select("b")) == [(True,), (False,), (None,), (False,)]
    mixed = spark.createDataFrame([("YES",), ("maybe",)], "b string")
    assert rows(tw.parse_bool_strings(mixed)) == [("true",), ("maybe",)]
    assert rows(tw.parse_numeric_strings(df, subset=["n"]).select("n")) == [(1200.0,), (0.12,), (None,), (-3.5,)]
    with pytest.raises(Exception, match="abc"):
        tw.parse_numeric_strings(df, subset=["n"], errors="raise").collect()


def test_mapping_and_clipping(people):
    assert [r[0] for r in rows(tw.map_values(people, {31: 13, None: 0}, subset=["age"]).select("age"))] == [13, 0, 13, 13]
    assert [r[0] for r in rows(tw.map_values(people, {31: "x"}, subset=["age"]).select("age"))] == ["x", None, "x", "x"]
    with pytest.raises(TypeError):
        tw.map_values(people, {(1,): 2})
    assert [r[0] for r in rows(tw.clip_numeric(people, upper=2, subset=["id"]).select("id"))] == [1, 2, 2, 1]
    for options in ({"lower": 1.5, "subset": ["id"]}, {"lower": 3, "upper": 1}, {}, {"lower": 1, "subset": ["name"]}):
        with pytest.raises(ValueError):
            tw.clip_numeric(people, **options)
    with pytest.raises(ValueError):
        tw.winsorize_outliers(people, subset=["name"])


def test_rounding_and_division(spark):
    df = spark.createDataFrame([(2.5, 0), (3.5, 2), (-0.5, None)], "x double, d long")
    assert [r[0] for r in rows(tw.round_numeric_columns(df).select("x"))] == [2.0, 4.0, 0.0]
    assert [r[-1] for r in rows(tw.safe_divide_columns(df, "x", "d", "q", 9.0))] == [9.0, 1.75, 9.0]
    constant = spark.createDataFrame([(4,), (None,), (4,)], "x long")
    assert rows(tw.normalize_minmax(constant)) == [(0.0,), (None,), (0.0,)]


# -- columns ------------------------------------------------------------------
def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a b` long, `a.b` long")
    with pytest.raises(ValueError, match="repeat"):
        tw.clean_column_names(df)
    assert tw.select_columns(df, ["a.b"]).collect()[0][0] == 2
    assert tw.drop_columns(df, ["a.b"]).columns == ["a b"]
    with pytest.raises(ValueError):
        tw.drop_columns(df, ["a b", "a.b"])
    assert tw.Frame(df).drop_columns(["a b", "a.b"]).columns == []
    with pytest.raises(ValueError):
        tw.rename_columns(df, {"a b": "a.b"})
    with pytest.raises(ValueError, match="nests"):
        tw.drop_columns_matching(df, "(a+)+")
    with pytest.raises(KeyError):
        tw.validate_columns_exist(df, ["x"])


def test_combine_and_split(spark):
    df = spark.createDataFrame([("a", None, True, 1e10), (None, None, None, None), ("b", "c", False, 0.5)], "x string, y string, z boolean, w double")
    assert [r[-1] for r in rows(tw.combine_columns(df, ["x", "y", "z", "w"], "o", separator="-"))] == ["a--True-10000000000.0", None, "b-c-False-0.5"]
    parts = spark.createDataFrame([("a|b",), ("c",), (None,)], "s string")
    assert rows(tw.split_column(parts, "s", into=["l", "r"], separator="|")) == [("a", "b"), ("c", None), (None, None)]
    with pytest.raises(ValueError):
        tw.split_column(parts, "s", into=["l", "m", "r"], separator="|")
    assert rows(tw.split_column(parts, "s", into=["k"], pattern="([ab])", keep_original=True)) == [("a|b", "a"), ("c", None), (None, None)]


def test_encoding(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "c string")
    out = tw.encode_categorical(df, ["c"])
    assert out.columns == ["c_a", "c_b"] and rows(out) == [(0, 1), (0, 0), (1, 0)]
    with pytest.raises(Exception, match="no ordinal"):
        tw.encode_categorical(df, ["c"], method="ordinal", ordinal_mappings={"c": {"a": 1}}).collect()


def test_rolling():
    assert tw.rolling_window([1, 2, 3, 4, 5], 3, 2) == [[1, 2, 3], [3, 4, 5]]
    for bad in ((9, 1), (0, 1), (2, 0)):
        with pytest.raises(ValueError):
            tw.rolling_window([1, 2, 3], *bad)


# -- rows ---------------------------------------------------------------------
def test_filter_types(people):
    assert tw.filter_rows(people, "name", "==", 3).count() == 0
    assert tw.filter_rows(people, "name", "!=", 3).count() == 3
    with pytest.raises(TypeError):
        tw.filter_rows(people, "name", "<", 3)
    with pytest.raises(KeyError):
        tw.filter_rows(people, "x", "<", 3)


def test_duplicates(spark, people):
    assert tw.drop_duplicates(people).count() == 3
    assert tw.drop_duplicates(people, keep=False).count() == 2
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "k long, v string").coalesce(1)
    assert sorted(r[1] for r in rows(tw.drop_duplicates(df, subset=["k"]))) == ["a", "c"]
    assert sorted(r[1] for r in rows(tw.drop_duplicates(df, subset=["k"], keep="last"))) == ["b", "d"]


def test_fuzzy_against_all_pairs(spark):
    texts = ["apple pie", "apple  PIE", "aple pie", "orange", "oranges", None, "", "zebra crossing", "zebra crosing", "apple pies!"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    clean = [" ".join((t or "").split()).lower() for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if clean[i] == clean[j] or difflib.SequenceMatcher(None, clean[i], clean[j]).ratio() >= 0.85:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(i)
    assert tw.find_fuzzy_duplicates(df, subset=["s"]) == [g for g in groups.values() if len(g) > 1]
    with pytest.raises(ValueError):
        tw.find_fuzzy_duplicates(df, max_rows=3)


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1, "", None, 5), (2, "", None, None)], "a long, b string, c long, d long")
    assert tw.drop_constant_columns(df).columns == ["a", "d"]
    assert tw.drop_empty_columns(df).columns == ["a", "d"]
    assert tw.drop_empty_columns(df.limit(0)).columns == df.columns


# -- pipelines ----------------------------------------------------------------
def test_pipeline(people, tmp_path):
    steps = [("strip_whitespace",), ("drop_nulls", {"subset": ["name"]}), ("drop_duplicates",), ("rename_columns", {"name": "who"})]
    out = tw.pipeline(people, steps)
    assert out.columns[1] == "who" and sorted(r[1] for r in rows(out)) == ["Ann", "bob"]
    assert tw.pipeline(people, steps, dry_run=True) is people
    with pytest.raises(tw.UnknownStepError):
        tw.pipeline(people, [("nope",)])
    with pytest.raises(TypeError):
        tw.pipeline(people, ["strip_whitespace"])
    for name in ("p.json", "p.yaml"):
        tw.save_pipeline(steps, tmp_path / name)
        assert tw.load_pipeline(tmp_path / name)[3] == ("rename_columns", {"mapping": {"name": "who"}})
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(tw.PipelineSerializationError):
        tw.load_pipeline(tmp_path / "bad.json")


def test_custom_steps(people):
    seen = []

    def step(df, n, context):
        seen.append((context.step_index, context.total_steps))
        return df.limit(n)

    tw.register_step("first", step)
    try:
        assert tw.pipeline(people, [("drop_nulls",), ("first", {"n": 1})]).count() == 1
        assert seen == [(1, 2)]
        with pytest.raises(ValueError):
            tw.register_step("first", step)
        with pytest.raises(ValueError):
            tw.unregister_step("drop_nulls")
        tw.register_step("bad", lambda df: None)
        with pytest.raises(TypeError):
            tw.pipeline(people, [("bad",)])
    finally:
        tw.reset_steps()
    with pytest.raises(tw.UnknownStepError):
        tw.unregister_step("first")
    assert "df" not in tw.get_builtin_step_signatures()["drop_nulls"].parameters


def test_lineage(people):
    out, report = tw.pipeline(people, [("drop_nulls", {"subset": ["name"]}), ("drop_duplicates", {"subset": ["id"]})], track_lineage=True)
    assert report.dropped == {"drop_nulls": [1], "drop_duplicates": [3]} and out.columns == people.columns
    with pytest.raises(ValueError):
        tw.pipeline(people, [], track_lineage=True, return_metadata=True)


def test_plans(spark, tiny):
    """Filters and columns reach the scan, row-local pipelines don't shuffle, and full-row dedup shuffles once."""
    df = spark.read.parquet(f"{tiny}/customer.parquet")
    lines = "\n".join(plan_lines(tw.pipeline(df, [("filter_rows", {"column": "c_custkey", "op": ">", "value": 5}), ("select_columns", {"columns": ["c_name"]}), ("strip_whitespace",)])))
    assert "Exchange" not in lines and "GreaterThan(c_custkey,5)" in lines and "c_acctbal" not in lines
    assert "\n".join(plan_lines(tw.drop_duplicates(df))).count("Exchange") == 1


# -- profiles and contracts ---------------------------------------------------
def test_profile_against_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"x": np.r_[rng.normal(size=200), np.nan, 50.0], "s": ["a", "bb", None] * 67 + ["a"]})
    report = tw.profile(tw.from_pandas(pdf, spark=spark))
    x = report.columns["x"]
    for stat, want in (("mean", pdf.x.mean()), ("std", pdf.x.std()), ("q25", pdf.x.quantile(0.25)), ("q95", pdf.x.quantile(0.95)), ("min", pdf.x.min())):
        assert getattr(x, stat) == pytest.approx(want)
    counts, edges = np.histogram(pdf.x.dropna(), bins=10)
    assert [h[2] for h in x.histogram] == counts.tolist() and x.histogram[0][0] == pytest.approx(edges[0])
    assert "potential_outliers" in x.warnings and x.null_count == 1
    assert report.columns["s"].top_values[0][:2] == ("a", 68)
    assert json.loads(report.to_json())["row_count"] == 202
    assert "| x |" in report.to_markdown() and "<table>" in report.to_html()


def test_score_and_auto_clean(spark):
    df = spark.createDataFrame([(" 1",), ("2 ",), ("2 ",)], "n string").coalesce(1)
    report = tw.profile(df)
    assert {s.step for s in report.suggestions} == {"strip_whitespace", "cast_types", "drop_duplicates"}
    assert sorted(rows(tw.auto_clean(df))) == [("1",), ("2",), ("2",)]
    assert sorted(rows(tw.auto_clean(df, mode="strict", allow_lossy_casts=True, confirmed_casts={"n": "int64"}))) == [(1,), (2,)]
    with pytest.raises(ValueError):
        tw.auto_clean(df, mode="strict", allow_lossy_casts=True, confirmed_casts={})


def test_contract(spark, people):
    schema = tw.Schema({"id": tw.Int64(unique=True), "name": tw.String(nullable=False, max_length=5), "age": tw.Int64(max=30), "gone": tw.Bool()}, strict=True)
    got = tw.validate(people, schema)
    found = sorted((i.column, i.rule, i.row_index) for i in got.issues if i.row_index)
    assert found == [("age", "max", 1), ("age", "max", 3), ("age", "max", 4), ("id", "unique", 1), ("id", "unique", 4), ("name", "max_length", 1), ("name", "max_length", 4), ("name", "nullable", 2)]
    assert {i.rule for i in got.issues if i.row_index is None} == {"required_column", "unexpected_column"}
    cut = tw.validate(people, schema, 2)
    assert cut.issue_count == 2 and cut.truncated
    with pytest.raises(tw.SchemaValidationError):
        got.raise_for_errors()
    again = tw.Schema.from_json(schema.to_json())
    assert not tw.diff_schema(schema, again).changed
    assert tw.schema_from_yaml(tw.schema_to_yaml(schema)).fields == schema.fields
    with pytest.raises(ValueError):
        tw.Regex("(a+)+")


def test_gates_and_drift(spark):
    a = spark.createDataFrame([(float(i), "x") for i in range(100)], "v double, s string")
    b = spark.createDataFrame([(float(i) * 2, "x") for i in range(150)], "v double, s string")
    assert {i.gate for i in tw.check_quality_gates(a, b).issues} == {"row_count", "duplicate_ratio", "numeric_mean", "numeric_std"} - ({"duplicate_ratio"})
    assert tw.check_quality_gates(a, a).passed
    assert not tw.detect_drift(a, a).has_drift and tw.detect_drift(a, b).has_drift
    assert tw.diff_dataframes(a, b).row_count_delta == 50
    assert tw.compare_profiles(a, a).status == "ok"


# -- sources and sinks --------------------------------------------------------
def write(path, text: str, encoding: str = "utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_inference(spark, tmp_path):
    p = write(tmp_path / "a.csv", "﻿a, b ,c,d,e,f\n 1,true,007,1.5,99999999999999999999,\n2,FALSE,2.5,3,x,\n")
    df = tw.read_csv(p, spark=spark)
    assert df.dtypes == [("a", "bigint"), ("b", "boolean"), ("c", "string"), ("d", "double"), ("e", "string"), ("f", "string")]
    assert rows(df) == [(1, True, "007", 1.5, "99999999999999999999", None), (2, False, "2.5", 3.0, "x", None)]
    assert df.count() == 2 and df.select("d").count() == 2


def test_csv_quotes_and_policies(spark, tmp_path):
    p = write(tmp_path / "q.csv", 'a,b\n"x\ny","say ""hi"""\nhel"lo,2\n')
    assert rows(tw.read_csv(p, spark=spark)) == [("x\ny", 'say "hi"'), ('hel"lo', "2")]
    p = write(tmp_path / "bad.csv", "a,b\n1,2\n3,4,5\n6\n7,8\n")
    with pytest.raises(tw.CsvReadError):
        tw.read_csv(p, spark=spark)
    assert rows(tw.read_csv(p, on_bad_lines="skip", spark=spark)) == [(1, 2), (7, 8)]
    with pytest.warns(UserWarning):
        assert tw.read_csv(p, on_bad_lines="warn", spark=spark).count() == 2
    assert rows(tw.read_csv(p, mode="permissive", on_bad_lines="skip", spark=spark)) == [(1, 2), (6, None), (7, 8)]
    for text in ("a,a\n1,2\n", "a,\n1,2\n", ""):
        with pytest.raises(tw.CsvReadError):
            tw.read_csv(write(tmp_path / "h.csv", text), spark=spark)
    with pytest.raises(tw.CsvReadError, match="NUL"):
        tw.read_csv(write(tmp_path / "n.csv", "a\n\0\n"), spark=spark)


def test_csv_options(spark, tmp_path):
    p = write(tmp_path / "o.csv", "junk line\na;b;c\n1.234,5;x;NA\n2,0;y;3\n")
    df = tw.read_csv(p, delimiter=";", skiprows=1, decimal_separator=",", thousands_separator=".", null_values=["na"], usecols=["a", "c"], spark=spark)
    assert rows(df) == [(1234.5, None), (2.0, 3)]
    p = write(tmp_path / "l.csv", "né,b\né,2\n", "latin-1")
    assert rows(tw.read_csv(p, encoding="latin-1", spark=spark)) == [("é", 2)]
    assert rows(tw.read_csv(write(tmp_path / "k.csv", "я,b\nж,2\n", "koi8-r"), encoding="koi8-r", spark=spark)) == [("ж", 2)]
    with pytest.raises(tw.CsvReadError):
        tw.read_csv(p, spark=spark)
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("a\n1\n")
    assert rows(tw.read_csv(str(tmp_path / "z.csv.gz"), spark=spark)) == [(1,)]
    p = write(tmp_path / "nh.csv", "1,2\n3,4\n")
    assert tw.read_csv(p, has_header=False, nrows=1, spark=spark).columns == ["col_0", "col_1"]
    assert tw.sniff_delimiter(write(tmp_path / "s.csv", "a|b\n1|2\n"), spark=spark) == "|"
    with pytest.raises(ValueError):
        tw.sniff_delimiter(write(tmp_path / "s1.csv", "a\n1\n"), spark=spark)
    chunks = list(tw.read_csv_chunked(write(tmp_path / "c.csv", "a\n" + "".join(f"{i}\n" for i in range(25))), chunksize=10, delimiter=",", spark=spark))
    assert [c.count() for c in chunks] == [10, 10, 5]
    with pytest.raises(tw.CsvReadError):
        list(tw.read_csv_chunked(write(tmp_path / "m.csv", "a\n1\nx\n"), chunksize=1, delimiter=",", spark=spark))


def test_handles_reach_the_shared_folder(spark, tmp_path, monkeypatch):
    import io

    from tidewater.sources import remote

    monkeypatch.setattr(remote, "shared_root", lambda: f"file://{tmp_path}")
    assert rows(tw.read_csv(io.StringIO("a,b\n1,x\n"), spark=spark)) == [(1, "x")]
    assert any(p.name.startswith("tidewater-scratch-") for p in tmp_path.iterdir())
    with pytest.raises(tw.RemoteReadError):
        tw.read_csv("http://127.0.0.1:9/x.csv", spark=spark)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(st.characters(blacklist_categories=["Cs", "Cc"]), max_size=8), st.integers(-(10**6), 10**6)), min_size=1, max_size=6))
def test_csv_round_trip(spark, tmp_path, data):
    df = spark.createDataFrame([(f"t{s}", n) for s, n in data], "s string, n long").coalesce(1)
    tw.write_csv(df, tmp_path / "r.csv")
    assert rows(tw.read_csv(str(tmp_path / "r.csv"), dtype={"s": "string"}, spark=spark)) == rows(df)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 0.1, None, True), ("x,y", None, 2, None)], "s string, f double, n long, b boolean").coalesce(1)
    tw.write_csv(df, tmp_path / "w.csv", safe_for_spreadsheet=True)
    assert (tmp_path / "w.csv").read_text() == "s,f,n,b\n'=1+1,0.10000000000000001,,true\n\"x,y\",,2,\n"
    tw.write_csv(df, tmp_path / "w.csv", append=True)
    assert len((tmp_path / "w.csv").read_text().splitlines()) == 5
    with pytest.raises(ValueError):
        tw.write_csv(df.select("s"), tmp_path / "w.csv", append=True)
    tw.write_json(df, tmp_path / "w.json", orient="split")
    assert json.loads((tmp_path / "w.json").read_text())["columns"] == ["s", "f", "n", "b"]
    tw.write_jsonl(df, tmp_path / "w.jsonl")
    assert rows(tw.read_jsonl(str(tmp_path / "w.jsonl"), spark=spark)) == rows(df)
    tw.write_parquet(df, str(tmp_path / "w.parquet"), compression="zstd")
    assert rows(tw.read_parquet(str(tmp_path / "w.parquet"), usecols=["n"], spark=spark)) == [(None,), (2,)]
    with pytest.raises(ValueError):
        tw.read_parquet(str(tmp_path / "w.parquet"), usecols=["n"], columns=["n"], spark=spark)


def test_jsonl_errors(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"a": 1}\n\n{"b": "x", "a": null}\n')
    assert tw.read_jsonl(p, spark=spark).columns == ["a", "b"]
    with pytest.raises(tw.JsonlReadError, match="line 2"):
        tw.read_jsonl(write(tmp_path / "b.jsonl", '{"a": 1}\n[1]\n'), spark=spark)
    with pytest.raises(TypeError):
        tw.read_jsonl(write(tmp_path / "c.jsonl", '{"a": [1]}\n'), spark=spark)


def test_memory(spark):
    pdf = pd.DataFrame({"a": [1, None], "b": ["x", None], "c": [True, False]})
    df = tw.from_pandas(pdf, spark=spark)
    assert rows(df)[1][1:] == (None, False)
    assert tw.to_dict(tw.from_records([{"a": 1}, {"b": "y"}], spark=spark), "split") == {"columns": ["a", "b"], "data": [[1, None], [None, "y"]]}
    assert rows(tw.from_arrow(pa.table({"x": pa.chunked_array([[1], [2]])}), spark=spark)) == [(1,), (2,)]
    with pytest.raises(ValueError):
        tw.to_numpy(tw.from_dict({"a": [1, None]}, spark=spark))
    assert tw.to_numpy(tw.from_dict({"a": [1, None]}, spark=spark), fill_value=0).tolist() == [[1], [0]]
    with pytest.raises(TypeError):
        tw.from_dict({"a": [[1]]}, spark=spark)
    with pytest.raises(TypeError):
        tw.from_pandas(pd.DataFrame({"a": pd.to_datetime(["2024-01-01"])}), spark=spark)
    assert "| " in tw.preview(df) and len(tw.Frame(df)) == 2


def test_duckdb(spark):
    import duckdb

    con = duckdb.connect()
    tw.register_duckdb(spark.range(3), "t", con)
    assert con.execute("SELECT sum(id) FROM t").fetchall() == [(3,)]


def test_stream_refuses_global_steps(spark, tmp_path):
    from tidewater.streaming.stream import stream_csv, stream_pipeline

    write(tmp_path / "x.csv", "a\n1\n")
    with pytest.raises(ValueError, match="drop_duplicates"):
        stream_pipeline(stream_csv(str(tmp_path), {"a": "int64"}, spark=spark), [("drop_duplicates",)])


def test_command_line(tmp_path, capsys, spark):
    from tidewater.cli import main

    p = write(tmp_path / "a.csv", "a,b\n1,x\n2,y\n")
    assert main(["scan", p]) == 0
    assert "int64" in capsys.readouterr().out


def test_flat_types(spark):
    with pytest.raises(TypeError):
        tw.flat(spark.sql("SELECT array(1) AS a"))
    assert tw.flat(spark.sql("SELECT 1 AS a, CAST(1.5 AS FLOAT) AS b")).dtypes == [("a", "bigint"), ("b", "double")]
