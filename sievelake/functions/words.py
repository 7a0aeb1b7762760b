"""Words of a text: maximal runs of letters or digits after lower-casing, each ideograph U+4E00-U+9FFF alone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For Java's regex engine.
WORD_PATTERN = r"[\x{4E00}-\x{9FFF}]|[\p{L}\p{N}&&[^\x{4E00}-\x{9FFF}]]+"
_PY_WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")


def words(text: Column) -> Column:
    """Array of words; empty for null or empty text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def py_words(text: str | None) -> list[str]:
    """The same in Python, for stages that already run there."""
    return _PY_WORD.findall(text.lower()) if text else []
