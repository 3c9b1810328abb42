"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; all executors see it under this path.
FOLDER = os.environ.get("FOLIOLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

_ENCODERS: dict[str, object] = {}
#: A longer text is cut where the tokenizer's own pattern cuts it, as the time of a whole one grows faster than its length.
LONG = 20_000


def encoder(path: str):
    """One encoder per worker process."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


@cache
def pretoken() -> regex.Pattern:
    """What the tokenizer never joins across: no token crosses the ends of a match."""
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def count(text: str | None, path: str) -> int:
    if not text:
        return 0
    e = encoder(path)
    if len(text) <= LONG:
        return len(e.encode_ordinary(text))
    words = Counter(m.group() for m in pretoken().finditer(text))
    return sum(n * len(e._encode_single_piece(w)) for w, n in words.items())


def with_tokens(documents: DataFrame, path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """(doc_id, source, tokens) of every row with a doc_id; a null or empty text has 0 tokens."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [count(t, path) for t in b["text"]]})

    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, tokens bigint")
