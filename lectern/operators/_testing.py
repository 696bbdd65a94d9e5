"""Deterministic flaky providers for tests of the provider plug point (importable on executors)."""

from __future__ import annotations

import os

import pandas as pd


def flaky_upper(batch: pd.DataFrame) -> pd.DataFrame:
    """Fails the first two calls (counted by marker files in the batch's ``marker_dir``),
    then upper-cases ``text``."""
    marker_dir = batch["marker_dir"].iloc[0]
    n = len([f for f in os.listdir(marker_dir) if f.startswith("fail-")])
    if n < 2:
        open(os.path.join(marker_dir, f"fail-{n}"), "w").close()
        raise RuntimeError("transient provider error")
    return pd.DataFrame({"id": batch["id"], "out": batch["text"].str.upper()})


def always_fails(batch: pd.DataFrame) -> pd.DataFrame:
    raise RuntimeError("provider down")
