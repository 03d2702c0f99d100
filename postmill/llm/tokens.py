"""Sizes of texts in tokens of a public tokenizer, whose file is a parameter and never copied."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("POSTMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the usual pattern by which byte-level BPE cuts a text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens with the library that the file is for: .tiktoken, .json (tokenizers) or .model (sentencepiece)."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]


def sized(df: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str | None = None) -> DataFrame:
    """``keep`` and n_tokens, the size of the whole text; a null text has none."""
    path = tokenizer or TOKENIZER
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text")

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = counter(path)
        for pdf in it:
            yield pdf[list(keep)].assign(n_tokens=size(list(pdf["__text"])))

    return rows.mapInPandas(count, f"{kinds}, n_tokens bigint")
