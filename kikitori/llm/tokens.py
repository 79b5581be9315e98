"""Token counts of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def token_counter(path: str = TOKENIZER):
    """A column function: tokens of each text, whole texts; null and empty texts have none."""

    @F.pandas_udf(IntegerType())
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for part in parts:
            texts = part.tolist()
            sizes = [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]
            yield pd.Series([n if t else 0 for n, t in zip(sizes, texts)], dtype="int32")

    return lambda text: counted(text)


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    return token_counter(path)(text)
