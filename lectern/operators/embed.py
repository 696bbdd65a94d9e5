"""Embedding through the provider plug point, with an offline provider for tests and dry runs."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.functions.fixed import EMBED_BATCH
from lectern.operators.provider import Provider, call_provider

#: Over the UTF-8 bytes of a text: all bytes of other scripts are beyond ASCII.  ``bytes.lower`` folds A-Z only.
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GRAIN = 4096


def term_embedder(dims: int = 256, *, text: str = "text") -> Provider:
    """Offline provider: ``vec`` = L2-normed counts of the text's pairs of neighbouring words (A-Z folded; ASCII letters,
    digits and all other scripts), each at md5(pair) modulo ``dims``; zeros for texts of fewer than two words.  Components are
    rounded to 1/GRAIN, so distances are exact sums and equal ones tie on every engine."""
    def places(words: list[bytes]) -> np.ndarray:
        digests = b"".join([hashlib.md5(a + b" " + b).digest() for a, b in zip(words, words[1:])])
        return np.frombuffer(digests, ">u4")[::4] % dims

    def provider(batch: pd.DataFrame) -> pd.DataFrame:
        vecs = []
        for t in batch[text]:
            n = np.bincount(places(_TERM.findall(t.encode().lower()) if t is not None else []), minlength=dims).astype(np.float64)
            norm = np.sqrt((n * n).sum())
            vecs.append(np.floor(n / norm * GRAIN + 0.5) / GRAIN if norm else n)
        out = batch.copy()
        out["vec"] = vecs
        return out
    return provider


def embed(df: DataFrame, provider: Provider, *, batch_size: int = EMBED_BATCH, **retry) -> DataFrame:
    """``df`` with a column ``vec`` (array of doubles) that the provider computes in batches of ``batch_size`` rows.

    The provider gets and returns whole rows; failed calls are retried as ``call_provider`` says.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name != "vec"] + [T.StructField("vec", T.ArrayType(T.DoubleType()))])
    return call_provider(df.drop("vec"), provider, schema, batch_size=batch_size, **retry)
