"""Provider plug point: a user function ``provider(pandas.DataFrame) -> pandas.DataFrame``
(embedding, answering or grading service) applied over Arrow batches.

Rows reach the provider in batches of at most ``batch_size`` (the reference
embeds 100 texts per call).  A failing call is retried ``max_retries`` times
with exponential backoff; after that the task fails (and Spark retries the task)
or, with ``on_error="null"``, the batch's outputs are null, except that columns the
input has (keys) are carried over.  A reply with another number of rows than the
batch is a failed call, so rows are never lost.  The provider runs inside executor tasks; nothing is collected to the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.functions.fixed import EMBED_BATCH

Provider = Callable[[pd.DataFrame], pd.DataFrame]


def call_provider(df: DataFrame, provider: Provider, schema: T.StructType | str, *, batch_size: int = EMBED_BATCH,
                  max_retries: int = 5, backoff_seconds: float = 1.0, on_error: str = "raise") -> DataFrame:
    if on_error not in ("raise", "null"):
        raise ValueError("on_error must be 'raise' or 'null'")
    out_schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = [f.name for f in out_schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size].reset_index(drop=True)
                for attempt in range(max_retries + 1):
                    try:
                        res = provider(part)
                        if len(res) != len(part):
                            raise ValueError(f"the provider returned {len(res)} rows for a batch of {len(part)}")
                        break
                    except Exception:  # noqa: BLE001 - provider errors are retried, then surfaced
                        if attempt == max_retries:
                            if on_error == "raise":
                                raise
                            res = pd.DataFrame({n: part[n] if n in part else [None] * len(part) for n in names})
                            break
                        time.sleep(backoff_seconds * (2 ** attempt))
                yield res[names]

    return df.mapInPandas(run, schema=out_schema)


def exact_match_grader(batch: pd.DataFrame) -> pd.DataFrame:
    """Offline grader (stands in for a grading model): CORRECT when the model answer
    equals the reference after whitespace normalisation, else INCORRECT."""
    def norm(s):
        return " ".join(str(s).split()) if s is not None else ""
    replies = ["GRADE: CORRECT" if norm(m) == norm(a) else "GRADE: INCORRECT"
               for m, a in zip(batch["model_answer"], batch["answer"])]
    return pd.DataFrame({"conv_id": batch["conv_id"], "turn": batch["turn"], "grader_reply": replies})
