"""Scalar text expressions (JVM-side, codegen friendly).

All helpers return ``pyspark.sql.Column`` built from built-in functions, so
they stay inside whole-stage codegen.  Regular expressions are written in the
subset that Java regex and RE2 read the same way, so the SQL oracle can reuse
the very same pattern strings.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.fixed import (ANSWER_MARKER, ANSWER_MARKER_ALT, DIACRITICS_RE,  # noqa: F401
                                     FENCE_CHARS, MIN_ANSWER_LENGTH, NEAR_DUP_RATIO, PY_SPACE_CLASS,
                                     REFUSAL_SENTENCE)

STRIP_RE = rf"\A{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+\z"


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: remove all Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), STRIP_RE, "")


def is_blank(c: Column | str) -> Column:
    """True when the text is null or only whitespace (Python ``not s.strip()``)."""
    c = _col(c)
    return c.isNull() | (py_strip(c) == F.lit(""))


def strip_diacritics(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), DIACRITICS_RE, "")


def similarity_ratio(a: Column | str, b: Column | str) -> Column:
    """``1 - lev(lower a, lower b) / max(len a, len b)``; null when both are empty."""
    a, b = _col(a), _col(b)
    maxlen = F.greatest(F.length(a), F.length(b))
    dist = F.levenshtein(F.lower(a), F.lower(b))
    return F.when(maxlen > 0, F.lit(1.0) - dist / maxlen)


def token_estimate(c: Column | str) -> Column:
    """Offline token estimate: ceil(characters / 4) (BPE codec not built)."""
    return F.ceil(F.length(F.coalesce(_col(c), F.lit(""))) / F.lit(4)).cast("long")


def word_count(c: Column | str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"\w+"), 0)).cast("long")


def grade_label(c: Column | str) -> Column:
    """Grader reply -> CORRECT / INCORRECT / UNKNOWN (INCORRECT tested first, case-sensitive)."""
    c = F.coalesce(_col(c), F.lit(""))
    return (F.when(c.contains("INCORRECT"), F.lit("INCORRECT"))
            .when(c.contains("CORRECT"), F.lit("CORRECT"))
            .otherwise(F.lit("UNKNOWN")))


def strip_charset(c: Column | str, chars: str) -> Column:
    """Python ``s.strip(chars)``: drop any of ``chars`` from both ends."""
    cls = "[" + "".join("\\" + ch if ch in "]\\^-[" else ch for ch in chars) + "]"
    return F.regexp_replace(_col(c), rf"\A{cls}+|{cls}+\z", "")


def template_parts(template: str, names: list[str]) -> list[tuple[str, str | None]]:
    """Split a ``{name}`` template once into (literal, placeholder) pieces.

    Filling by concatenation (not chained replace) keeps a value that itself
    contains ``{context}`` untouched.
    """
    pat = re.compile("|".join(re.escape("{" + n + "}") for n in names))
    out, pos = [], 0
    for m in pat.finditer(template):
        out.append((template[pos:m.start()], m.group(0)[1:-1]))
        pos = m.end()
    out.append((template[pos:], None))
    return out


def fill_template(template: str, values: Mapping[str, Column | str]) -> Column:
    pieces: list[Column] = []
    for literal, name in template_parts(template, list(values)):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(F.coalesce(_col(values[name]), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
