"""Text helpers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Badge labels per output style, for deficit / superavit / anything else.
ALERT_LABELS = {
    "report": ("Déficit", "Superávit", "Estable"),
    "mail": ("DÉFICIT", "SUPERÁVIT", "NORMAL"),
    "ui": ("DÉFICIT", "SUPERÁVIT", "ESTABLE"),
}

def _fold_table(last: int = 0x2FFFF) -> tuple[str, str]:
    """Characters whose canonical decomposition (NFD) is one base character plus
    combining marks, mapped to that character, as a ``translate`` table so that
    folding runs inside the JVM."""
    src, dst = [], []
    for cp in range(0xC0, last + 1):
        ch = chr(cp)
        base = fold_char(ch)
        if base and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def fold_char(ch: str) -> str:
    """The base character of ``ch``; nothing for a combining mark; ``ch`` itself if
    its decomposition has several base characters."""
    if unicodedata.category(ch) == "Mn":
        return ""
    base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
    return base if len(base) == 1 else ch


_ACCENTED, _PLAIN = _fold_table()


def alert_label(type_col: Column, style: str = "report") -> Column:
    if style not in ALERT_LABELS:
        raise ValueError(f"unknown label style {style!r}; expected one of {sorted(ALERT_LABELS)}")
    deficit, superavit, neutral = ALERT_LABELS[style]
    return (
        F.when(type_col == "deficit", F.lit(deficit))
        .when(type_col == "superavit", F.lit(superavit))
        .otherwise(F.lit(neutral))
    )


def normalize_text(c: Column) -> Column:
    """Fold accents (base characters, combining marks dropped, whether a name is
    stored composed or decomposed) and lower-case; NULL -> ''."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), _ACCENTED, _PLAIN), r"\p{Mn}+", ""))


def short_name(name: Column, n: int = 10) -> Column:
    return F.substring(name, 1, n)
