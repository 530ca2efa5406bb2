"""Token counts and cuts by a real vocabulary, where its file is at hand.

The vocabulary file and the splitting pattern are parameters; without them the
functions of ``text`` count four characters as one token. The encoder is built
once in each Python worker and called on Arrow batches.
"""

from __future__ import annotations

import base64
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X


@cache
def encoder(path: str, pattern: str):
    """The encoding of a file of base-64 tokens and ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counter(path: str, pattern: str):
    """A column function: tokens of a text; null has none."""

    @F.pandas_udf(T.IntegerType())
    def count(column: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in encoder(path, pattern).encode_ordinary_batch([t or "" for t in column], num_threads=1)])

    return lambda text: count(X.col(text))


def truncater(path: str, pattern: str):
    """A column function (text, limit): at most ``limit`` tokens, with a notice;
    a character that the cut splits goes whole."""

    def cut(text: Column | str, limit: int) -> Column:
        @F.pandas_udf(T.StringType())
        def run(column: pd.Series) -> pd.Series:
            known, out = encoder(path, pattern), []
            for t in column:
                ids = known.encode_ordinary(t) if t else []
                out.append(t if len(ids) <= limit else known.decode_bytes(ids[:limit]).decode("utf-8", "ignore") + X.truncated_note(limit))
            return pd.Series(out, dtype=object)

        return run(X.col(text))

    return cut
