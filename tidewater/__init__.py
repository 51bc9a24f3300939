"""Data preparation and data quality on PySpark: sources, cleaning steps, pipelines, profiles, contracts and sinks.

Everything takes and gives plain DataFrames. Names are loaded when first used, so
that Python workers which need one module don't load the rest.
"""

from importlib import import_module

__version__ = "0.1.0"

_MODULES = {
    "contract.schema": """
        URL UUID Bool Choice CountryCode CreditCard CurrencyCode Custom Date DateTime Email Field Float64 Int64 IPAddress IPv4 LanguageCode MACAddress
        PhoneNumber Regex Schema SchemaDiff SchemaDiffEntry String TimeZone diff_schema register_validator schema_from_yaml schema_to_dict
        schema_to_yaml
    """,
    "contract.validate": """
        ValidationIssue ValidationResult issues validate validate_chunked
    """,
    "errors": """
        CsvReadError JsonlReadError PipelineSerializationError PipelineStepError RemoteReadError SchemaValidationError TidewaterError TypeCastError
        UnknownStepError
    """,
    "functions.types": """
        dtypes flat
    """,
    "operators.columns": """
        clean_column_names coalesce_columns combine_columns drop_columns drop_columns_matching encode_categorical make_column_names_unique
        rename_columns rename_columns_matching rolling_window rolling_windows sanitize_column_names select_columns select_dtypes slugify_column_names
        split_column trim_column_names validate_columns_exist
    """,
    "operators.frame": """
        ColumnSummary Frame compare_schema describe describe_frame memory_usage preview schema_summary
    """,
    "operators.fuzzy": """
        find_fuzzy_duplicates fuzzy_pairs
    """,
    "operators.rowid": """
        with_row_id
    """,
    "operators.rows": """
        drop_constant_columns drop_duplicates drop_empty_columns drop_nulls filter_rows head keep_rows_with_nulls tail
    """,
    "operators.values": """
        cast_types checked_cast clip_numeric collapse_rare_categories fill_nulls hash_columns map_values normalize_case normalize_minmax
        normalize_unicode normalize_whitespace parse_bool_strings parse_numeric_strings remove_control_characters replace_values round_numeric_columns
        safe_divide_columns standardize_missing_tokens strip_whitespace winsorize_outliers
    """,
    "plans.pipeline": """
        LineageReport PipelineContext clean get_builtin_step_signatures list_steps load_pipeline pipeline register_step reset_steps save_pipeline
        unregister_step
    """,
    "quality.drift": """
        ColumnDiff DataFrameDiffReport DriftReport ProfileComparison QualityGateIssue QualityGateResult check_quality_gates compare_profiles
        detect_drift diff_dataframes
    """,
    "quality.infer": """
        ColumnInference InferredSchema infer_schema
    """,
    "quality.profile": """
        CleaningSuggestion ColumnProfile DataQualityReport missingness_correlations profile
    """,
    "quality.score": """
        CleanExplanation CleanStepRecord auto_clean suggest_cleaning
    """,
    "sources.csv": """
        read_csv read_csv_chunked scan_csv sniff_delimiter
    """,
    "sources.jsonl": """
        read_jsonl read_jsonl_chunked
    """,
    "sources.memory": """
        from_arrow from_dict from_pandas from_polars from_records register_duckdb to_arrow to_dict to_numpy to_pandas to_polars
    """,
    "sources.parquet": """
        read_parquet
    """,
    "sources.writers": """
        escape_formulas write_csv write_json write_jsonl write_parquet
    """,
}
_HOME = {name: module for module, names in _MODULES.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module 'tidewater' has no attribute {name!r}")
    value = getattr(import_module(f"tidewater.{_HOME[name]}"), name)
    globals()[name] = value
    return value


def __dir__() -> list[str]:
    return [*__all__, "__version__"]
