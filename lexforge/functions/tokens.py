"""Token ids of texts, for ``render.masked_example`` and ``training.sft_rows``."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenizer(path: str) -> Callable[[Column], Column]:
    """A function from a text column to its ids under a tokenizer file, without special tokens of the file's own; null has none.

    Texts go through in Arrow batches. ``path`` is read by the tasks, so it names a file that all machines have.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        read = _READ.get(path) or _READ.setdefault(path, Tokenizer.from_file(path))
        return pd.Series([e.ids for e in read.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)])

    return ids


_READ: dict = {}
