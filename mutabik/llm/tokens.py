"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizer's files on every machine; MUTABIK_TOKENIZERS changes it.
FOLDER = os.environ.get("MUTABIK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(folder: str, vocabulary: str):
    import tiktoken

    spec = importlib.util.spec_from_file_location("_tokenizer_folder", f"{folder}/__init__.py")
    about = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(about)
    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=about.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> int:
    return len(encoding(folder, vocabulary).encode_ordinary(text)) if text else 0


def token_sizes(docs: DataFrame, keep: list[str], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and tokens, the size of the whole text; null and empty texts have 0."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def size(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, vocabulary)
        for p in parts:
            out = p[[*keep]].copy()
            out["tokens"] = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in p["_text"]]
            yield out

    return docs.select(*keep, F.col("text").alias("_text")).mapInPandas(size, f"{schema}, tokens bigint")
