"""The normal form of item texts: what a reader cannot see is taken out, everything else stays."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_TRAILING = re.compile(r"[^\S\n]+(?=\n|\Z)")
_BLANK_LINES = re.compile(r"\n{3,}")


def normal_form(text: str | None) -> str | None:
    """Composed characters, no leading byte-order mark, LF line ends, no white space at line
    ends, at most one empty line in a row, none at either end. Null stays null."""
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        text = text[1:] if text[:1] == "﻿" else text
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _BLANK_LINES.sub("\n\n", _TRAILING.sub("", text)).strip("\n")


@F.pandas_udf(T.StringType())
def _normal_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([normal_form(t) for t in texts], dtype=object)


def normal_text(column: str | Column) -> Column:
    """Column form of :func:`normal_form`."""
    return _normal_udf(column)
