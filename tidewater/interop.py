"""The pandas accessor, and a transformer for Spark ML pipelines."""

from __future__ import annotations

import pandas as pd
from pyspark.ml import Transformer
from pyspark.sql import DataFrame

from tidewater.contract.validate import validate
from tidewater.functions.types import dtypes
from tidewater.plans.pipeline import clean, parse_steps, pipeline
from tidewater.quality.drift import diff_dataframes
from tidewater.quality.profile import profile
from tidewater.sources.memory import from_pandas, to_numpy, to_pandas


@pd.api.extensions.register_dataframe_accessor("tidewater")
class PandasAccessor:
    """``pdf.tidewater``: the library on a pandas frame."""

    def __init__(self, pdf: pd.DataFrame):
        self._pdf = pdf

    @property
    def frame(self) -> DataFrame:
        return from_pandas(self._pdf)

    def clean(self, **options) -> pd.DataFrame:
        return to_pandas(clean(self.frame, **options))

    def pipeline(self, steps) -> pd.DataFrame:
        return to_pandas(pipeline(self.frame, steps))

    def profile(self, **options):
        return profile(self.frame, **options)

    def validate(self, schema, max_errors: int | None = None):
        return validate(self.frame, schema, max_errors)

    def diff(self, other: pd.DataFrame, **options):
        return diff_dataframes(self.frame, from_pandas(other), **options)

    def to_numpy(self, fill_value=None):
        return to_numpy(self.frame, fill_value)


class PipelineTransformer(Transformer):
    """Cleaning steps as a stage of a Spark ML pipeline.

    ``fit`` remembers the columns and types; ``transform`` refuses other ones, and
    with ``keep_rows`` steps that change the number of rows.
    """

    def __init__(self, steps, keep_rows: bool = False):
        super().__init__()
        self.steps, self.keep_rows, self.seen = parse_steps(steps), keep_rows, None

    def fit(self, df: DataFrame, params=None) -> PipelineTransformer:
        self.seen = dtypes(df)
        return self

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.seen is not None and dtypes(df) != self.seen:
            raise ValueError(f"the frame has {dtypes(df)}, fitted was {self.seen}")
        out = pipeline(df, self.steps)
        if self.keep_rows and out.count() != df.count():
            raise ValueError("the steps changed the number of rows")
        return out

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)
