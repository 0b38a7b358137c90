"""The text kernels as SQL functions of a session, Arrow batches at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import text, wikitext


def register_functions(spark: SparkSession) -> list[str]:
    """Make the kernels callable from SQL; the names."""

    def scalar(f, kind: str):
        def run(values: pd.Series) -> pd.Series:
            return values.map(f)

        run.__annotations__ = {"values": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, kind)

    found = {
        "wikitext_visible": scalar(wikitext.visible, "string"),
        "comparison_tokens": scalar(wikitext.comparison_tokens, "array<string>"),
        "structural_flags": scalar(wikitext.structural_flags, "array<string>"),
        "text_folded": scalar(text.folded, "string"),
        "text_simhash": scalar(lambda t: text.simhash64_trigrams(text.normalized_words(t)), "long"),
        "html_visible": scalar(text.visible_text, "string"),
    }
    for name, f in found.items():
        spark.udf.register(name, f)
    return sorted(found)
