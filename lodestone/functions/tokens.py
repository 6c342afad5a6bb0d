"""Token counts by vocabulary files of public tokenizers; a file is named by its path, or by a name that the package of public tokenizers knows."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def located(name: str) -> str:
    """The file on the machine that asks: executors look for their own."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=8)
def counter(name: str) -> Callable[[str], int]:
    """How many ids a text has, by the kind of file: .json, .tiktoken or .model; strings of special tokens count as ordinary text."""
    path = located(name)
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda t: len(encoding.encode_ordinary(t))
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(pieces.encode(t, num_threads=1))
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return lambda t: len(model.encode(t, add_special_tokens=False).ids)


def token_count(c: Column | str, tokenizer: str) -> Column:
    """Ids of a text; null has none (0)."""

    def count(texts: pd.Series) -> pd.Series:
        of = counter(tokenizer)
        return texts.map(lambda t: of(t) if t else 0).astype("int64")

    return F.pandas_udf(count, "long")(col(c))


def worst_count(c: Column | str, tokenizers: list[str]) -> Column:
    """The most ids that any of several tokenizers gives a text: a row must fit all that it is trained under."""

    def count(texts: pd.Series) -> pd.Series:
        of = [counter(t) for t in tokenizers]
        return texts.map(lambda t: max(f(t) for f in of) if t else 0).astype("int64")

    return F.pandas_udf(count, "long")(col(c))
