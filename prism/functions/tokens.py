"""Tokens of a public tokenizer, whose file is a parameter and must lie where every task can read it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_loaded: dict[str, object] = {}


def _encode(file: str, texts: list[str]) -> list[list[int]]:
    if file not in _loaded:
        from tokenizers import Tokenizer

        _loaded[file] = t = Tokenizer.from_file(file)
        t.no_padding()
        t.no_truncation()
    return [e.ids for e in _loaded[file].encode_batch(texts, add_special_tokens=False)]


def token_ids(text: Column, file: str) -> Column:
    """array<int>: the ids of a text, special tokens not added; null for null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        ids = iter(_encode(file, [t for t in s if t is not None]))
        return pd.Series([None if t is None else next(ids) for t in s], dtype=object)

    return run(text)


def token_count(text: Column, file: str) -> Column:
    return F.size(token_ids(text, file))
