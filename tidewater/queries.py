"""A query for every operator, over whole tables, with SQL that gives the same rows.

The tables hold no defects, so a base of each table adds some by expressions
that Spark and DuckDB read alike; the SQL sees it under the name ``dirty``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.contract import schema as S
from tidewater.contract.validate import issues, validate_chunked
from tidewater.functions.types import flat
from tidewater.operators import columns as C
from tidewater.operators import frame as R
from tidewater.operators import fuzzy
from tidewater.operators import rows as W
from tidewater.operators import values as V
from tidewater.plans.pipeline import clean, pipeline
from tidewater.quality import drift, infer, profile, score
from tidewater.sources import csv, jsonl, memory, parquet, writers
from tidewater.sources.work import work_path
from tidewater.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_BASES: dict[str, tuple[str, list[str]]] = {
    "customer": ("customer", [
        "c_custkey",
        "CASE WHEN c_custkey % 3 = 0 THEN concat('  ', c_name, chr(9), ' ') ELSE c_name END AS c_name",
        "CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS c_mktsegment",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal",
        "CASE WHEN c_custkey % 11 = 0 THEN 'N/A' WHEN c_custkey % 13 = 0 THEN '' ELSE CAST(c_nationkey AS STRING) END AS nation",
        "CAST(c_nationkey AS BIGINT) AS c_nationkey",
        "c_custkey % 5 = 0 AS flag",
        "CASE WHEN c_custkey % 4 = 0 THEN ' Yes' ELSE 'n' END AS answer",
        "CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE c_mktsegment END AS segment",
    ]),
    "plain_customer": ("customer", ["c_custkey", "c_name", "CAST(c_nationkey AS BIGINT) AS c_nationkey", "c_acctbal", "c_mktsegment"]),
    "line": ("lineitem", [
        "l_orderkey", "CAST(l_linenumber AS BIGINT) AS l_linenumber", "l_partkey",
        "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
        "CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice END AS l_extendedprice",
        "l_discount", "l_tax", "l_returnflag",
    ]),
    "part": ("part", [
        "p_partkey", "p_name", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS p_brand",
        "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS p_type", "CAST(p_size AS BIGINT) AS p_size", "p_retailprice",
        "concat('$', CAST(p_size AS STRING), ',000') AS price_text", "concat(' ', CAST(p_size AS STRING), '%') AS percent_text",
        "CASE WHEN p_partkey < 0 THEN 'x' ELSE '' END AS empty_text", "CASE WHEN p_partkey < 0 THEN p_partkey END AS empty_number", "CASE WHEN p_partkey < 0 THEN 'x' ELSE 'same' END AS constant",
    ]),
    "orders": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_orderdate", "o_orderpriority"]),
    "event": ("events", ["event_id", "user_id", "CASE WHEN event_id % 50 = 0 THEN 'rare' ELSE event_type END AS event_type", "value"]),
    "document": ("documents", ["doc_id", "text", "lang", "source"]),
    "coded": ("customer", [
        "c_custkey",
        "CASE WHEN c_custkey % 4 = 0 THEN 'no address' ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email",
        "CASE WHEN c_custkey % 4 = 1 THEN 'ftp://example.com/x' ELSE concat('https://example.com/', CAST(c_custkey AS STRING)) END AS url",
        "CASE WHEN c_custkey % 4 = 2 THEN '12ab' ELSE concat('+49 30 5550', CAST(c_custkey % 10 AS STRING)) END AS phone",
        "CASE WHEN c_custkey % 4 = 3 THEN '300.1.1.1' ELSE concat('10.0.0.', CAST(c_custkey % 256 AS STRING)) END AS ip",
        "CASE WHEN c_custkey % 5 = 0 THEN '00:1A:2B:3C:4D' ELSE '00:1A:2B:3C:4D:5E' END AS mac",
        "CASE WHEN c_custkey % 5 = 1 THEN '2024-02-30' WHEN c_custkey % 5 = 2 THEN '2019-12-31' ELSE '2024-02-29' END AS day",
        "CASE WHEN c_custkey % 5 = 2 THEN 'XX' ELSE 'DE' END AS country",
        "CASE WHEN c_custkey % 5 = 3 THEN 'xx' ELSE 'fr' END AS lang",
        "CASE WHEN c_custkey % 5 = 4 THEN 'ABC' ELSE 'EUR' END AS currency",
        "CASE WHEN c_custkey % 6 = 0 THEN 'Mars/Base' ELSE 'Europe/Paris' END AS zone",
        "CASE WHEN c_custkey % 6 = 1 THEN '123' ELSE '123e4567-e89b-42d3-a456-426614174000' END AS uid",
        "CASE WHEN c_custkey % 6 = 2 THEN 'fe80::zz' ELSE 'fe80::1' END AS ip6",
        "CASE WHEN c_custkey % 6 = 3 THEN '4111 1111 1111 1112' ELSE '4111 1111 1111 1111' END AS card",
        "CASE WHEN c_custkey % 6 = 4 THEN '2024-13-01 00:00:00' ELSE '2024-03-01 12:30:00' END AS stamp",
    ]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, exprs = _BASES[name]
    return table(spark, sf_dir, source).selectExpr(*exprs)


def add(name: str, of: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Registers f on a base, and SQL on ``dirty``."""
    QUERIES[name] = lambda spark, sf_dir: f(base(spark, sf_dir, of))
    if sql is not None:
        source, exprs = _BASES[of]
        SQL[name] = f"WITH dirty AS (SELECT {', '.join(exprs)} FROM {source}) {sql}"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_U = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_STRIP = r"regexp_replace({}, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


# -- text ---------------------------------------------------------------------
add("strip_whitespace", "customer", lambda d: V.strip_whitespace(d, subset=["c_name"]).select("c_custkey", "c_name"), f"SELECT c_custkey, {_STRIP.format('c_name')} AS c_name FROM dirty")
add("normalize_whitespace", "document", lambda d: V.normalize_whitespace(d, columns=["text"]).select("doc_id", "text"), f"SELECT doc_id, trim(regexp_replace(text, '{_U}', ' ', 'g')) AS text FROM dirty")
add("remove_control_characters", "document", lambda d: V.remove_control_characters(d, subset=["text"]).select("doc_id", "text"), r"SELECT doc_id, regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g') AS text FROM dirty")
add("normalize_case_lower", "document", lambda d: V.normalize_case(d, subset=["text"]).select("doc_id", "text"), f"SELECT doc_id, {_LOW.format('text')} AS text FROM dirty")
add("normalize_case_upper", "document", lambda d: V.normalize_case(d, subset=["text"], case_type="upper").select("doc_id", "text"), f"SELECT doc_id, {_UP.format('text')} AS text FROM dirty")
add("normalize_case_title", "part", lambda d: V.normalize_case(d, subset=["p_name"], case_type="title").select("p_partkey", "p_name"), "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat(upper(left(w, 1)), lower(substr(w, 2)))), ' ') AS p_name FROM dirty")
add("normalize_unicode", "document", lambda d: V.normalize_unicode(d, subset=["text"], form="NFC").select("doc_id", "text"), "SELECT doc_id, nfc_normalize(text) AS text FROM dirty")
add("hash_columns_sha256", "customer", lambda d: V.hash_columns(d, subset=["c_name", "segment"]).select("c_custkey", "c_name", "segment"), "SELECT c_custkey, sha256(c_name) AS c_name, sha256(segment) AS segment FROM dirty")
add("hash_columns_md5", "customer", lambda d: V.hash_columns(d, subset=["c_name"], algorithm="md5").select("c_custkey", "c_name"), "SELECT c_custkey, md5(c_name) AS c_name FROM dirty")
add("standardize_missing_tokens", "customer", lambda d: V.standardize_missing_tokens(d, subset=["nation"]).select("c_custkey", "nation"), "SELECT c_custkey, CASE WHEN nation NOT IN ('N/A', '') THEN nation END AS nation FROM dirty")

# -- types and values ---------------------------------------------------------
add("fill_nulls", "customer", lambda d: V.fill_nulls(d, 0, subset=["c_acctbal"]).select("c_custkey", "c_acctbal"), "SELECT c_custkey, coalesce(c_acctbal, 0) AS c_acctbal FROM dirty")
add("cast_types_coerce", "customer", lambda d: V.cast_types(d, {"nation": "int64"}, errors="coerce").select("c_custkey", "nation"), r"SELECT c_custkey, CASE WHEN regexp_full_match(nation, '[+-]?[0-9]+') THEN CAST(nation AS BIGINT) END AS nation FROM dirty")
add("cast_types_report", "customer", lambda d: V.cast_types(d, {"nation": "int64"}, errors="report", order_by="c_custkey")[1], r"""SELECT 'nation' AS "column", "row", nation AS "value", 'int64' AS target FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS "row" FROM dirty) WHERE NOT regexp_full_match(nation, '[+-]?[0-9]+')""")
add("astype", "customer", lambda d: R.Frame(d.select("c_custkey", "c_nationkey")).astype({"c_nationkey": "string"}).df, "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM dirty")
add("parse_bool_strings", "customer", lambda d: V.parse_bool_strings(d, subset=["answer"]).select("c_custkey", "answer"), "SELECT c_custkey, lower(trim(answer)) = 'yes' AS answer FROM dirty")
add("parse_numeric_strings", "part", lambda d: V.parse_numeric_strings(d, subset=["price_text", "percent_text"]).select("p_partkey", "price_text", "percent_text"), "SELECT p_partkey, CAST(p_size * 1000 AS DOUBLE) AS price_text, CAST(p_size AS DOUBLE) / 100 AS percent_text FROM dirty")
add("map_values", "event", lambda d: V.map_values(d, {"click": "c", "view": None}, subset=["event_type"]).select("event_id", "event_type"), "SELECT event_id, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN NULL ELSE event_type END AS event_type FROM dirty")
add("replace_values", "customer", lambda d: V.replace_values(d, {None: "none"}, column="segment").select("c_custkey", "segment"), "SELECT c_custkey, coalesce(segment, 'none') AS segment FROM dirty")
add("clip_numeric", "line", lambda d: V.clip_numeric(d, lower=5, upper=30000, subset=["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 5 WHEN l_quantity > 30000 THEN 30000 ELSE l_quantity END AS l_quantity, CASE WHEN l_extendedprice < 5 THEN 5 WHEN l_extendedprice > 30000 THEN 30000 ELSE l_extendedprice END AS l_extendedprice FROM dirty")
add("winsorize_outliers", "line", lambda d: rounded(V.winsorize_outliers(d, subset=["l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), 2), "SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(least(l_extendedprice, hi), lo), 2) AS l_extendedprice FROM dirty, (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM dirty)")
add("normalize_minmax", "customer", lambda d: rounded(V.normalize_minmax(d, subset=["c_acctbal"]).select("c_custkey", "c_acctbal"), 8), "SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 8) AS c_acctbal FROM dirty, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM dirty)")
add("round_numeric_columns", "orders", lambda d: V.round_numeric_columns(d, subset=["o_totalprice"], decimals=0).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, round_even(o_totalprice, 0) AS o_totalprice FROM dirty")
add("collapse_rare_categories", "event", lambda d: V.collapse_rare_categories(d, "event_type", 0.05).select("event_id", "event_type"), "SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY event_type) < 0.05 * count(*) OVER () THEN 'Other' ELSE event_type END AS event_type FROM dirty")
add("safe_divide_columns", "line", lambda d: V.safe_divide_columns(d, "l_quantity", "l_discount", "q", -1.0).select("l_orderkey", "l_linenumber", "l_partkey", "q"), "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_quantity / nullif(l_discount, 0), -1) AS q FROM dirty")
add("clean", "customer", lambda d: clean(d.select("c_custkey", "c_name", "c_acctbal"), drop_nulls=True, drop_duplicates=True), f"SELECT DISTINCT c_custkey, {_STRIP.format('c_name')} AS c_name, c_acctbal FROM dirty WHERE c_acctbal IS NOT NULL")

# -- columns ------------------------------------------------------------------
add("select_columns", "customer", lambda d: C.select_columns(d, ["c_name", "c_custkey"]), "SELECT c_name, c_custkey FROM dirty")
add("select_dtypes", "customer", lambda d: C.select_dtypes(d, include=["int64", "bool"]), "SELECT c_custkey, c_nationkey, flag FROM dirty")
add("drop_columns", "plain_customer", lambda d: C.drop_columns(d, ["c_name", "c_acctbal"]), "SELECT c_custkey, c_nationkey, c_mktsegment FROM dirty")
add("drop_columns_matching", "plain_customer", lambda d: C.drop_columns_matching(d, "name|acct"), "SELECT c_custkey, c_nationkey, c_mktsegment FROM dirty")
add("drop_constant_columns", "part", lambda d: W.drop_constant_columns(d.select("p_partkey", "p_size", "constant", "empty_text")), "SELECT p_partkey, p_size FROM dirty")
add("drop_empty_columns", "part", lambda d: W.drop_empty_columns(d.select("p_partkey", "p_brand", "constant", "empty_text", "empty_number")), "SELECT p_partkey, p_brand, constant FROM dirty")
add("validate_columns_exist", "plain_customer", lambda d: C.validate_columns_exist(d, ["c_custkey", "c_name"]).select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM dirty")
add("rename_columns", "plain_customer", lambda d: C.rename_columns(d.select("c_custkey", "c_name"), {"c_custkey": "key"}), "SELECT c_custkey AS \"key\", c_name FROM dirty")
add("rename_columns_matching", "plain_customer", lambda d: C.rename_columns_matching(d, "^c_", ""), "SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM dirty")
add("trim_column_names", "plain_customer", lambda d: C.trim_column_names(d.select("c_custkey", "c_name").toDF(" key ", "name\t")), "SELECT c_custkey AS \"key\", c_name AS name FROM dirty")
add("clean_column_names", "plain_customer", lambda d: C.clean_column_names(d.select("c_custkey", "c_name", "c_acctbal").toDF("Customer Key!", "__Name--", "!!")), "SELECT c_custkey AS customer_key, c_name AS name, c_acctbal AS \"column\" FROM dirty")
add("sanitize_column_names", "plain_customer", lambda d: C.sanitize_column_names(d.select("c_custkey", "c_name").toDF("_a__b_", "Name")), "SELECT c_custkey AS a_b, c_name AS \"Name\" FROM dirty")
add("slugify_column_names", "plain_customer", lambda d: C.slugify_column_names(d.select("c_custkey", "c_name").toDF(" Customer - Key ", "Name (full)")), "SELECT c_custkey AS customer_key, c_name AS name_full FROM dirty")
add("make_column_names_unique", "plain_customer", lambda d: C.make_column_names_unique(d.select("c_custkey", "c_name", "c_acctbal").toDF("a", "a", "a_1")), "SELECT c_custkey AS a, c_name AS a_2, c_acctbal AS a_1 FROM dirty")
add("combine_columns", "part", lambda d: C.combine_columns(d, ["p_brand", "p_type"], "joined", separator="-").select("p_partkey", "joined"), "SELECT p_partkey, CASE WHEN p_brand IS NOT NULL OR p_type IS NOT NULL THEN concat(coalesce(p_brand, ''), '-', coalesce(p_type, '')) END AS joined FROM dirty")
add("coalesce_columns", "part", lambda d: C.coalesce_columns(d, subset=["p_brand", "p_type", "p_size"], output_column="first").select("p_partkey", "first"), "SELECT p_partkey, coalesce(p_brand, p_type, CAST(p_size AS VARCHAR)) AS \"first\" FROM dirty")
add("split_column_separator", "part", lambda d: C.split_column(d.select("p_partkey", "p_brand"), "p_brand", separator="#", into=["maker", "no"]), "SELECT p_partkey, string_split(p_brand, '#')[1] AS maker, string_split(p_brand, '#')[2] AS no FROM dirty")
add("split_column_pattern", "part", lambda d: C.split_column(d.select("p_partkey", "p_brand"), "p_brand", pattern=r"(\d)(\d)$", into=["a", "b"]), r"SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '(\d)(\d)$') THEN regexp_extract(p_brand, '(\d)(\d)$', 1) END AS a, CASE WHEN regexp_matches(p_brand, '(\d)(\d)$') THEN regexp_extract(p_brand, '(\d)(\d)$', 2) END AS b FROM dirty")
_TYPES = ("click", "error", "purchase", "rare", "signup", "view")
add("encode_categorical_one_hot", "event", lambda d: C.encode_categorical(d.select("event_id", "event_type"), ["event_type"]), "SELECT event_id, " + ", ".join(f"CAST(event_type = '{t}' AS BIGINT) AS event_type_{t}" for t in _TYPES) + " FROM dirty")
add("encode_categorical_ordinal", "event", lambda d: C.encode_categorical(d.select("event_id", "event_type"), ["event_type"], method="ordinal", ordinal_mappings={"event_type": {t: i for i, t in enumerate(_TYPES)}}), f"SELECT event_id, CAST(list_position({list(_TYPES)}, event_type) - 1 AS BIGINT) AS event_type FROM dirty")
add(
    "rolling_windows", "event",
    lambda d: C.rolling_windows(d, "value", 3, 2, partition_by="user_id", order_by="event_id").select("user_id", F.col("start").cast("long").alias("start"), *[F.get("window", F.lit(i)).alias(f"w{i}") for i in range(3)]),
    'SELECT user_id, "start", w0, w1, w2 FROM (SELECT user_id, row_number() OVER w - 1 AS "start", value AS w0, lead(value, 1) OVER w AS w1, lead(value, 2) OVER w AS w2, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM dirty WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 3 AND "start" % 2 = 0',
)

# -- rows ---------------------------------------------------------------------
for _name, _op, _sql in (("gt", ">", ">"), ("lt", "<", "<"), ("ge", ">=", ">="), ("le", "<=", "<="), ("eq", "==", "="), ("ne", "!=", "<>")):
    add(f"filter_rows_{_name}", "customer", lambda d, op=_op: W.filter_rows(d, "c_nationkey", op, 12).select("c_custkey", "c_nationkey"), f"SELECT c_custkey, c_nationkey FROM dirty WHERE c_nationkey {_sql} 12")
add("filter_rows_nulls", "customer", lambda d: W.filter_rows(d, "c_acctbal", "!=", 0.0).select("c_custkey", "c_acctbal"), "SELECT c_custkey, c_acctbal FROM dirty WHERE c_acctbal <> 0")
add("drop_nulls", "customer", lambda d: W.drop_nulls(d, subset=["c_acctbal", "segment"]).select("c_custkey", "c_acctbal", "segment"), "SELECT c_custkey, c_acctbal, segment FROM dirty WHERE c_acctbal IS NOT NULL AND segment IS NOT NULL")
add("keep_rows_with_nulls", "customer", lambda d: W.keep_rows_with_nulls(d, subset=["c_acctbal", "segment"]).select("c_custkey", "c_acctbal", "segment"), "SELECT c_custkey, c_acctbal, segment FROM dirty WHERE c_acctbal IS NULL OR segment IS NULL")
add("drop_duplicates_first", "orders", lambda d: W.drop_duplicates(d, subset=["o_custkey"], order_by="o_orderkey"), "SELECT * FROM dirty QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
add("drop_duplicates_last", "orders", lambda d: W.drop_duplicates(d, subset=["o_custkey"], keep="last", order_by="o_orderkey"), "SELECT * FROM dirty QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
add("drop_duplicates_none", "orders", lambda d: W.drop_duplicates(d, subset=["o_custkey", "o_orderstatus"], keep=False), "SELECT * FROM dirty QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderstatus) = 1")
add("drop_duplicates_rows", "customer", lambda d: W.drop_duplicates(d.select("segment", "c_nationkey")), "SELECT DISTINCT segment, c_nationkey FROM dirty")
add("head", "plain_customer", lambda d: W.head(d.orderBy("c_custkey"), 20), "SELECT * FROM dirty ORDER BY c_custkey LIMIT 20")
add("tail", "plain_customer", lambda d: W.tail(d.orderBy("c_custkey"), 20), "SELECT * FROM dirty ORDER BY c_custkey DESC LIMIT 20")
#: Not in SQL: the ratio of Python's difflib. tests/test_frame.py holds it against all pairs.
add("find_fuzzy_duplicates", "part", lambda d: fuzzy.fuzzy_pairs(d.orderBy("p_partkey"), ["p_type"], 0.5))

# -- profiles -----------------------------------------------------------------
_NUMBERS = """count({c}) AS "count", count(*) - count({c}) AS "nulls", 0 AS non_finite, round(avg({c}), 4) AS mean, round(min({c}), 4) AS "min", round(max({c}), 4) AS "max", CAST(NULL AS BIGINT) AS "true", CAST(NULL AS BIGINT) AS "false", CAST(NULL AS DOUBLE) AS true_ratio, CAST(NULL AS BIGINT) AS "unique" FROM dirty"""
_BLANK = """CAST(NULL AS BIGINT) AS non_finite, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS "min", CAST(NULL AS DOUBLE) AS "max", """
add(
    "describe", "customer", lambda d: rounded(R.describe_frame(d.select("c_custkey", "c_acctbal", "flag", "segment"))),
    " UNION ALL ".join([
        f"""SELECT 'c_custkey' AS "column", 'int64' AS dtype, {_NUMBERS.format(c="c_custkey")}""",
        f"""SELECT 'c_acctbal' AS "column", 'float64' AS dtype, {_NUMBERS.format(c="c_acctbal")}""",
        f"""SELECT 'flag', 'bool', count(flag), count(*) - count(flag), {_BLANK} count_if(flag), count_if(NOT flag), round(count_if(flag) / count(flag), 4), NULL FROM dirty""",
        f"""SELECT 'segment', 'string', count(segment), count(*) - count(segment), {_BLANK} NULL, NULL, NULL, count(DISTINCT segment) FROM dirty""",
    ]),
)


def _rows(df: DataFrame, rows: list[tuple], shape: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, shape)


add(
    "schema_summary", "customer", lambda d: _rows(d, [(s.name, s.dtype, s.nullable) for s in R.schema_summary(d.select("c_custkey", "c_acctbal", "segment"))], "name string, dtype string, nullable boolean"),
    "SELECT 'c_custkey' AS name, 'int64' AS dtype, count(*) > count(c_custkey) AS nullable FROM dirty UNION ALL SELECT 'c_acctbal', 'float64', count(*) > count(c_acctbal) FROM dirty UNION ALL SELECT 'segment', 'string', count(*) > count(segment) FROM dirty",
)
add(
    "memory_usage", "plain_customer", lambda d: _rows(d, list(R.memory_usage(d.select("c_custkey", "c_name"), deep=True).items()), "name string, bytes long"),
    "SELECT 'c_custkey' AS name, count(*) * 9 AS bytes FROM dirty UNION ALL SELECT 'c_name', CAST(count(*) * 9 + sum(strlen(c_name)) AS BIGINT) FROM dirty",
)
add("compare_schema", "customer", lambda d: _rows(d, [(R.compare_schema(d, d.select(*reversed(d.columns))), R.compare_schema(d, d.select(*reversed(d.columns)), strict=True))], "by_name boolean, strict boolean"), "SELECT true AS by_name, false AS strict")
add("duplicate_rows", "customer", lambda d: _rows(d, [(profile.duplicate_rows(d.select("segment", "c_nationkey")),)], "n long"), "SELECT (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT segment, c_nationkey FROM dirty)) AS n")
add(
    "numeric_statistics", "line", lambda d: rounded(profile.column_stats(d, ["l_quantity", "l_extendedprice"]).select("name", "row_count", "null_count", "unique_count", "min", "max", "mean", "std", "q25", "q50", "q75", "q95"), 2),
    " UNION ALL ".join(f"""SELECT '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, round(min({c}), 2) AS "min", round(max({c}), 2) AS "max", round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, round(quantile_cont({c}, 0.25), 2) AS q25, round(quantile_cont({c}, 0.5), 2) AS q50, round(quantile_cont({c}, 0.75), 2) AS q75, round(quantile_cont({c}, 0.95), 2) AS q95 FROM dirty""" for c in ("l_quantity", "l_extendedprice")),
)
add(
    "string_statistics", "customer", lambda d: rounded(profile.column_stats(d, ["c_name", "nation"]).select("name", "row_count", "null_count", "unique_count", "whitespace_count", "empty_string_count", "ints", "min", "max", "mean")),
    " UNION ALL ".join(rf"""SELECT '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, count_if({c} <> regexp_replace({c}, '^\s+|\s+$', '', 'g')) AS whitespace_count, count_if({c} = '') AS empty_string_count, count_if(regexp_full_match(trim({c}), '[+-]?[0-9]+')) AS ints, CAST(min(length({c})) AS DOUBLE) AS "min", CAST(max(length({c})) AS DOUBLE) AS "max", round(avg(length({c})), 4) AS mean FROM dirty""" for c in ("c_name", "nation")),
)
add(
    "top_values", "orders", lambda d: profile.value_counts(d, ["o_orderstatus", "o_orderpriority", "o_custkey"]).select("name", "value", "n", F.col("rank").cast("long").alias("rank")),
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM (SELECT name, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value FROM dirty" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")) + ") GROUP BY name, value)) WHERE rank <= 5",
)


def _histogram(d: DataFrame) -> DataFrame:
    lo, hi = d.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    return _rows(d, list(enumerate(profile.histograms(d, {"o_totalprice": (lo, hi)})["o_totalprice"][0])), "bin long, n long")


add("histogram", "orders", _histogram, "SELECT bin, count(*) AS n FROM (SELECT least(9, CAST(floor((o_totalprice - lo) / ((hi - lo) / 10)) AS BIGINT)) AS bin FROM dirty, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM dirty)) GROUP BY bin")
add(
    "missingness_correlation", "customer", lambda d: _rows(d, [(m["left"], m["right"], m["correlation"]) for m in profile.missingness_correlations(d.select("c_custkey", "c_acctbal", "segment"), threshold=0.1)], "l string, r string, correlation double"),
    "SELECT 'c_acctbal' AS l, 'segment' AS r, round(corr(CAST(c_acctbal IS NULL AS INT), CAST(segment IS NULL AS INT)), 6) AS correlation FROM dirty",
)
_PROFILED = ["c_custkey", "c_acctbal", "segment"]
add(
    "profile", "customer", lambda d: _rows(d, [(p.name, p.row_count, p.null_count, p.null_ratio, p.unique_count, p.unique_ratio) for p in profile.profile(d.select(*_PROFILED)).columns.values()], "name string, row_count long, null_count long, null_ratio double, unique_count long, unique_ratio double"),
    " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*), 6) AS null_ratio, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count({c}), 6) AS unique_ratio FROM dirty" for c in _PROFILED),
)
add(
    "quality_score", "customer", lambda d: _rows(d, [(r.quality_score, r.score_components["duplicate_penalty"], r.score_components["null_penalty"]) for r in [profile.profile(d.select(*_PROFILED))]], "score double, duplicates double, nulls double"),
    "SELECT round(100 - nulls, 2) AS score, 0.0 AS duplicates, nulls FROM (SELECT round(least(40, (round((count(*) - count(c_acctbal)) / count(*), 6) + round((count(*) - count(segment)) / count(*), 6)) / 3 * 100), 2) AS nulls FROM dirty)",
)
add("suggest_cleaning", "customer", lambda d: _rows(d, [(s.step, s.confidence_score) for s in score.suggest_cleaning(d.select("c_name", "c_acctbal"))], "step string, confidence double"), "SELECT 'strip_whitespace' AS step, 0.95 AS confidence")
add("auto_clean", "customer", lambda d: score.auto_clean(d.select("c_custkey", "c_name")), f"SELECT c_custkey, {_STRIP.format('c_name')} AS c_name FROM dirty")
add("infer_schema", "coded", lambda d: _rows(d, [(c.column, c.inferred_type) for c in infer.infer_schema(d.orderBy("c_custkey").select("email", "url")).columns.values()], "name string, kind string"), "SELECT 'email' AS name, 'email' AS kind UNION ALL SELECT 'url', 'url'")


def _two(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(base(spark, sf_dir, "plain_customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), base(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_custkey").alias("c_name"), "flag"))


_DIRTY = f"WITH dirty AS (SELECT {', '.join(_BASES['customer'][1])} FROM customer) "
def _drift(a: DataFrame, b: DataFrame) -> DataFrame:
    r = drift.detect_drift(a, b)
    found = {"added": r.added_columns, "removed": r.removed_columns, "dtype": r.dtype_changes, "null_ratio": r.null_ratio_changes}
    return _rows(a, [(change, c) for change, names in found.items() for c in names], "change string, name string")


QUERIES["detect_drift"] = _two(_drift)
SQL["detect_drift"] = _DIRTY + "SELECT 'added' AS change, 'flag' AS name UNION ALL SELECT 'removed', 'c_mktsegment' UNION ALL SELECT 'dtype', 'c_name' UNION ALL SELECT 'null_ratio', 'c_acctbal' FROM dirty HAVING count(*) > count(c_acctbal)"
QUERIES["check_quality_gates"] = _two(lambda a, b: _rows(a, [(i.gate, i.column) for i in drift.check_quality_gates(a, b).issues], "gate string, name string"))
SQL["check_quality_gates"] = _DIRTY + "SELECT 'missing_column' AS gate, 'c_mktsegment' AS name UNION ALL SELECT 'new_column', 'flag' UNION ALL SELECT 'dtype', 'c_name' UNION ALL SELECT 'null_ratio', 'c_acctbal' FROM dirty HAVING count(*) - count(c_acctbal) > 0.05 * count(*)"
def _diff(a: DataFrame, b: DataFrame) -> DataFrame:
    r = drift.diff_dataframes(a, b)
    return _rows(a, [(x.change, x.column) for x in (*r.added, *r.removed, *r.dtype_changed, *r.null_ratio_changed)], "change string, name string")


QUERIES["diff_dataframes"] = _two(_diff)
SQL["diff_dataframes"] = _DIRTY + "SELECT 'added' AS change, 'flag' AS name UNION ALL SELECT 'removed', 'c_mktsegment' UNION ALL SELECT 'dtype_changed', 'c_name' UNION ALL SELECT 'null_ratio_changed', 'c_acctbal' FROM dirty HAVING count(*) > count(c_acctbal)"
add(
    "compare_profiles", "customer",
    lambda d: _rows(d, [(n, c["status"]) for n, c in drift.compare_profiles(d.select("c_custkey", F.coalesce("c_acctbal", F.lit(0.0)).alias("c_acctbal")), d.select("c_custkey", "c_acctbal")).columns.items()], "name string, status string"),
    "SELECT 'c_custkey' AS name, 'ok' AS status UNION ALL SELECT 'c_acctbal', CASE WHEN r >= 0.25 THEN 'changed' WHEN r >= 0.1 THEN 'warning' ELSE 'ok' END FROM (SELECT (count(*) - count(c_acctbal)) / count(*) AS r FROM dirty)",
)


# -- contracts ----------------------------------------------------------------
def contract(name: str, of: str, fields: dict, key: str, broken: list[tuple[str, str, str]], **settings) -> None:
    """A query of the issues of a contract; SQL from (column, rule, condition)."""
    add(
        f"validate_{name}", of, lambda d: issues(d, S.Schema(fields, **settings), row_id=key).select("column", "rule", "row_index"),
        " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{r}' AS rule, {key} AS row_index FROM dirty WHERE {w}""" for c, r, w in broken),
    )


contract("nullable", "customer", {"c_acctbal": S.Float64(nullable=False), "nation": S.String(nullable=False)}, "c_custkey", [("c_acctbal", "nullable", "c_acctbal IS NULL"), ("nation", "nullable", "nation = ''")])
contract("required_if", "customer", {"segment": S.String(required_if=("flag", True))}, "c_custkey", [("segment", "required_if", "flag AND segment IS NULL")])
contract("unique", "orders", {"o_custkey": S.Int64(unique=True)}, "o_orderkey", [("o_custkey", "unique", "o_custkey IN (SELECT o_custkey FROM dirty GROUP BY 1 HAVING count(*) > 1)")])
contract("composite_unique", "orders", {}, "o_orderkey", [("o_custkey,o_orderstatus", "composite_unique", "(o_custkey, o_orderstatus) IN (SELECT (o_custkey, o_orderstatus) FROM dirty GROUP BY 1 HAVING count(*) > 1)")], unique=["o_custkey", "o_orderstatus"])
contract("allowed", "customer", {"c_mktsegment": S.Choice(["BUILDING", "MACHINERY"])}, "c_custkey", [("c_mktsegment", "allowed", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")])
contract("allowed_any_case", "customer", {"c_mktsegment": S.Choice(["building", "Machinery"], case_sensitive=False)}, "c_custkey", [("c_mktsegment", "allowed", "lower(c_mktsegment) NOT IN ('building', 'machinery')")])
contract("bounds", "customer", {"c_acctbal": S.Float64(min=100, max=9000)}, "c_custkey", [("c_acctbal", "min", "c_acctbal < 100"), ("c_acctbal", "max", "c_acctbal > 9000")])
contract("numeric", "customer", {"nation": S.Field(min=3)}, "c_custkey", [("nation", "numeric", "nation IN ('N/A', '')"), ("nation", "min", "nation NOT IN ('N/A', '') AND TRY_CAST(nation AS BIGINT) < 3")])
contract("pattern", "part", {"p_brand": S.Regex(r"Brand#1\d?")}, "p_partkey", [("p_brand", "pattern", r"NOT regexp_full_match(p_brand, 'Brand#1\d?')")])
contract("lengths", "part", {"p_name": S.String(min_length=9, max_length=10)}, "p_partkey", [("p_name", "min_length", "length(p_name) < 9"), ("p_name", "max_length", "length(p_name) > 10")])
contract(
    "semantic", "coded",
    {"email": S.Email(), "url": S.URL(), "phone": S.PhoneNumber(), "ip": S.IPv4(), "mac": S.MACAddress(), "country": S.CountryCode(), "lang": S.LanguageCode(), "currency": S.CurrencyCode(), "zone": S.TimeZone(), "uid": S.UUID(version=4), "ip6": S.IPAddress(version=6), "card": S.CreditCard()}, "c_custkey",
    [("email", "email", "c_custkey % 4 = 0"), ("url", "url", "c_custkey % 4 = 1"), ("phone", "phone", "c_custkey % 4 = 2"), ("ip", "ipv4", "c_custkey % 4 = 3"), ("mac", "mac_address", "c_custkey % 5 = 0"), ("country", "country_code", "c_custkey % 5 = 2"), ("lang", "language_code", "c_custkey % 5 = 3"), ("currency", "currency_code", "c_custkey % 5 = 4"), ("zone", "timezone", "c_custkey % 6 = 0"), ("uid", "uuid", "c_custkey % 6 = 1"), ("ip6", "ip_address", "c_custkey % 6 = 2"), ("card", "credit_card", "c_custkey % 6 = 3")],
)
contract("email_strict", "coded", {"email": S.Email(validation="strict"), "url": S.URL(allowed_schemes=["ftp"])}, "c_custkey", [("email", "email", "c_custkey % 4 = 0"), ("url", "url", "c_custkey % 4 <> 1")])
contract("date", "coded", {"day": S.Date(min="2020-01-01")}, "c_custkey", [("day", "date", "c_custkey % 5 = 1"), ("day", "min", "c_custkey % 5 = 2")])
contract("datetime", "coded", {"stamp": S.DateTime(format="%Y-%m-%d %H:%M:%S", min="2024-03-02")}, "c_custkey", [("stamp", "format", "c_custkey % 6 = 4"), ("stamp", "min", "c_custkey % 6 <> 4")])


def _custom(d: DataFrame) -> DataFrame:
    S.register_validator("tidewater_even", lambda v: v % 2 == 0, overwrite=True)
    return issues(d, S.Schema({"c_nationkey": S.Custom("tidewater_even")}), row_id="c_custkey").select("column", "rule", "row_index")


add("validate_custom", "customer", _custom, """SELECT 'c_nationkey' AS "column", 'custom' AS rule, c_custkey AS row_index FROM dirty WHERE c_nationkey % 2 <> 0""")


def _cross(d: DataFrame) -> DataFrame:
    def rule(df: DataFrame) -> DataFrame:
        bad = df.where("flag and c_nationkey > 12")
        return bad.select(F.lit("flag").alias("column"), F.lit("flag_nation").alias("rule"), F.lit("too far").alias("message"), F.col("c_custkey").alias("row_index"), F.lit(None).cast("string").alias("value"), F.lit("error").alias("severity"))

    return issues(d, S.Schema({}, rules=[rule]), row_id="c_custkey").select("column", "rule", "row_index")


add("validate_rules", "customer", _cross, """SELECT 'flag' AS "column", 'flag_nation' AS rule, c_custkey AS row_index FROM dirty WHERE flag AND c_nationkey > 12""")
add(
    "validate_columns", "plain_customer", lambda d: issues(d, S.Schema({"c_custkey": S.String(), "c_phone": S.String(), "c_name": S.String()}, strict=True), row_id="c_custkey").select("column", "rule", "row_index"),
    """SELECT * FROM (VALUES ('c_custkey', 'dtype', CAST(NULL AS BIGINT)), ('c_phone', 'required_column', NULL), ('c_nationkey', 'unexpected_column', NULL), ('c_acctbal', 'unexpected_column', NULL), ('c_mktsegment', 'unexpected_column', NULL)) t("column", rule, row_index)""",
)
add(
    "validate_numbered", "orders", lambda d: issues(d, S.Schema({"o_orderstatus": S.Choice(["F", "O"])}), order_by=["o_totalprice", "o_orderkey"]).select("column", "rule", "row_index"),
    """SELECT 'o_orderstatus' AS "column", 'allowed' AS rule, rid AS row_index FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rid FROM dirty) WHERE o_orderstatus NOT IN ('F', 'O')""",
)
add(
    "diff_schema", "customer", lambda d: _rows(d, [(e.column, e.change) for e in S.diff_schema(S.Schema({"a": S.Int64(), "b": S.String()}), S.Schema({"b": S.String(min_length=1), "c": S.Bool()}, strict=True)).entries], "name string, change string"),
    "SELECT * FROM (VALUES ('a', 'missing_field'), ('c', 'extra_field'), ('b', 'changed_min_length'), (NULL, 'changed_strict')) t(name, change)",
)

# -- pipelines ----------------------------------------------------------------
STEPS = [("strip_whitespace", {"subset": ["c_name"]}), ("normalize_case", {"subset": ["c_mktsegment"]}), ("standardize_missing_tokens", {"subset": ["nation"]}), ("drop_nulls", {"subset": ["c_acctbal", "nation"]}), ("cast_types", {"nation": "int64"}), ("clip_numeric", {"lower": 0, "subset": ["c_acctbal"]}), ("drop_duplicates", {"subset": ["nation", "c_mktsegment"], "order_by": "c_custkey"}), ("select_columns", {"columns": ["c_custkey", "c_name", "c_mktsegment", "c_acctbal", "nation"]})]
add("pipeline_steps", "customer", lambda d: pipeline(d, STEPS), f"SELECT c_custkey, {_STRIP.format('c_name')} AS c_name, lower(c_mktsegment) AS c_mktsegment, greatest(c_acctbal, 0) AS c_acctbal, CAST(nation AS BIGINT) AS nation FROM dirty WHERE c_acctbal IS NOT NULL AND nation NOT IN ('N/A', '') QUALIFY row_number() OVER (PARTITION BY CAST(nation AS BIGINT), lower(c_mktsegment) ORDER BY c_custkey) = 1")
add(
    "pipeline_lineage", "customer", lambda d: _rows(d, [(s, i) for s, ids in pipeline(d.orderBy("c_custkey"), [("drop_nulls", {"subset": ["c_acctbal"]}), ("filter_rows", {"column": "c_nationkey", "op": "<", "value": 20})], track_lineage=True)[1].dropped.items() for i in ids], "step string, id long"),
    "SELECT CASE WHEN c_acctbal IS NULL THEN 'drop_nulls' ELSE 'filter_rows' END AS step, id FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM dirty) WHERE c_acctbal IS NULL OR c_nationkey >= 20",
)
add(
    "pipeline_metadata", "customer", lambda d: _rows(d, [(m["row_counts"]["before"], m["row_counts"]["after"]) for m in [pipeline(d, [("drop_nulls", {"subset": ["c_acctbal"]})], return_metadata=True)[1]]], "n_before long, n_after long"),
    "SELECT count(*) AS n_before, count(c_acctbal) AS n_after FROM dirty",
)

# -- sources and sinks --------------------------------------------------------
_SOURCE = ["c_custkey", "c_name", "c_acctbal", "c_nationkey", "flag"]
_SOURCE_SQL = "SELECT c_custkey, c_name, c_acctbal, c_nationkey, flag FROM dirty"


def _folder(write, read) -> Callable[[DataFrame], DataFrame]:
    def f(d: DataFrame) -> DataFrame:
        path = work_path(d.sparkSession, "table")
        write(d.select(*_SOURCE), path)
        return read(d.sparkSession, path)

    return f


add("csv_round_trip", "customer", _folder(writers.write_csv, lambda s, p: csv.read_csv(p, spark=s)), _SOURCE_SQL)
add("csv_typed", "customer", _folder(lambda d, p: writers.write_csv(d, p, delimiter=";"), lambda s, p: csv.read_csv(p, delimiter=";", dtype={"c_nationkey": "string"}, usecols=["c_custkey", "c_nationkey"], spark=s)), "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM dirty")
add("csv_scan", "plain_customer", lambda d: _scan(d), "SELECT * FROM (VALUES ('c_custkey', 'int64'), ('c_name', 'string'), ('c_nationkey', 'int64'), ('c_acctbal', 'float64'), ('c_mktsegment', 'string')) t(name, dtype)")
add("jsonl_round_trip", "customer", _folder(writers.write_jsonl, lambda s, p: jsonl.read_jsonl(p, spark=s)), _SOURCE_SQL)
add("parquet_round_trip", "customer", _folder(lambda d, p: writers.write_parquet(d, p + ".parquet", compression="zstd"), lambda s, p: parquet.read_parquet(p + ".parquet", columns=["c_custkey", "c_acctbal"], spark=s)), "SELECT c_custkey, c_acctbal FROM dirty")
add("escape_formulas", "coded", lambda d: writers.escape_formulas(d.select("c_custkey", "phone")), "SELECT c_custkey, CASE WHEN phone LIKE '+%' THEN concat('''', phone) ELSE phone END AS phone FROM dirty")
QUERIES["arrow_round_trip"] = lambda spark, sf_dir: memory.from_arrow(memory.to_arrow(flat(table(spark, sf_dir, "nation"))), spark=spark)
SQL["arrow_round_trip"] = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
QUERIES["pandas_round_trip"] = lambda spark, sf_dir: memory.from_pandas(memory.to_pandas(flat(table(spark, sf_dir, "nation"))), spark=spark)
SQL["pandas_round_trip"] = SQL["arrow_round_trip"]
QUERIES["records_round_trip"] = lambda spark, sf_dir: memory.from_records(memory.to_dict(flat(table(spark, sf_dir, "region")), "records"), spark=spark)
SQL["records_round_trip"] = "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"
QUERIES["dict_round_trip"] = lambda spark, sf_dir: memory.from_dict(memory.to_dict(flat(table(spark, sf_dir, "region"))), spark=spark)
SQL["dict_round_trip"] = SQL["records_round_trip"]


def _scan(d: DataFrame) -> DataFrame:
    path = work_path(d.sparkSession, "scan")
    writers.write_csv(d, path)
    return _rows(d, list(csv.scan_csv(path, delimiter=",", spark=d.sparkSession).items()), "name string, dtype string")


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "chunks")
    writers.write_csv(flat(table(spark, sf_dir, "supplier")), path)
    seen = [(k, c.count()) for k, c in enumerate(csv.read_csv_chunked(path, chunksize=1000, delimiter=",", spark=spark))]
    return spark.createDataFrame([(sum(n for _, n in seen), max((n for _, n in seen), default=0) <= 1000)], "n long, within boolean")


QUERIES["csv_chunked"] = _chunked
SQL["csv_chunked"] = "SELECT count(*) AS n, true AS within FROM supplier"


def _validate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "chunks")
    writers.write_jsonl(flat(table(spark, sf_dir, "supplier")).coalesce(1), path)
    got = validate_chunked(jsonl.read_jsonl_chunked(path, chunksize=500, spark=spark), {"s_acctbal": S.Float64(min=0)})
    return spark.createDataFrame([(got.issue_count, got.row_count)], "issues long, n long")


QUERIES["validate_chunked"] = _validate_chunks
SQL["validate_chunked"] = "SELECT count_if(s_acctbal < 0) AS issues, count(*) AS n FROM supplier"


# -- streams ------------------------------------------------------------------
def _streamed(spark: SparkSession, start: Callable[[str], DataFrame], mode: str = "append") -> DataFrame:
    """What a stream over all that is there gives, as a table."""
    out = work_path(spark, "stream")
    frame = start(out)
    frame.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{out}/rows")


def _stream_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "in")
    writers.write_csv(base(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), path)
    steps = [("normalize_case", {"subset": ["c_mktsegment"]}), ("drop_nulls", {"subset": ["c_acctbal"]}), ("filter_rows", {"column": "c_acctbal", "op": ">", "value": 0.0})]
    return _streamed(spark, lambda _: stream.stream_pipeline(stream.stream_csv(path, {"c_custkey": "int64", "c_mktsegment": "string", "c_acctbal": "float64"}, spark=spark), steps))


QUERIES["stream_pipeline"] = _stream_pipeline
SQL["stream_pipeline"] = _DIRTY + "SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment, c_acctbal FROM dirty WHERE c_acctbal > 0"


def _stream_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "in")
    writers.write_jsonl(flat(table(spark, sf_dir, "supplier")), path)
    source = stream.stream_jsonl(path, {"s_suppkey": "int64", "s_acctbal": "float64"}, spark=spark)
    query, state = stream.validate_stream(source, {"s_acctbal": S.Float64(min=0)}, checkpoint=work_path(spark, "checkpoint"))
    query.awaitTermination()
    return spark.createDataFrame([(len(state.issues), state.rows)], "issues long, n long")


QUERIES["stream_validate"] = _stream_validate
SQL["stream_validate"] = SQL["validate_chunked"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strip, lower case, drop nulls, drop duplicates over line items: the cleaning that the published baselines time."""
    rows = base(spark, sf_dir, "line").select("l_orderkey", "l_linenumber", F.concat(F.lit("  "), "l_returnflag", F.lit(" ")).alias("l_returnflag"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return pipeline(rows, [("strip_whitespace",), ("normalize_case", {"case_type": "lower"}), ("drop_nulls",), ("drop_duplicates",)])


QUERIES["flagship"] = flagship
SQL["flagship"] = "WITH dirty AS (SELECT " + ", ".join(_BASES["line"][1]) + " FROM lineitem) SELECT DISTINCT l_orderkey, l_linenumber, lower(l_returnflag) AS l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM dirty WHERE l_quantity IS NOT NULL"
