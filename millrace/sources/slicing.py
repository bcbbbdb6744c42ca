"""Sliced bodies: what controls the flow or calls something stays, the rest is folded."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bodies of at most so many lines stay whole.
WHOLE_LINES = 6

_KEEP = re.compile(r"^\s*(?:if|elif|else|for|while|loop|match|switch|case|default|try|except|catch|finally|with|return|break|continue|raise|throw|yield|await|defer|go|select|panic!|unreachable!|todo!|assert)\b|\?\s*;?\s*$|\b[A-Za-z_][\w.:]*!?\s*\(")
_BRACKETS = re.compile(r"^\s*[\])}]+[;,]?\s*$")


def sliced(source: str, python: bool = False) -> str:
    """`source` with runs of lines that neither steer nor call folded into one marker line.

    The head, the closing line, a Python docstring and a tail expression stay.
    """
    lines = source.split("\n")
    if len(lines) - 2 <= WHOLE_LINES:
        return source
    keep = [bool(_KEEP.search(x)) or bool(_BRACKETS.match(x)) or x.rstrip().endswith(("{", ":")) for x in lines]
    keep[0] = keep[-1] = True
    body = next((i for i, x in enumerate(lines) if i and x.strip() and keep[0] and not x.strip().startswith(("#", "//"))), 1)
    if python and re.match(r"\s*(?:[rbuf]*)(\"\"\"|''')", lines[body]):
        quote = re.match(r"\s*(?:[rbuf]*)(\"\"\"|''')", lines[body]).group(1)
        end = body
        while end < len(lines) - 1 and lines[end].count(quote) + (lines[body].count(quote) if end > body else 0) < 2:
            end += 1
        for i in range(body, end + 1):
            keep[i] = True
    tail = next((i for i in range(len(lines) - 2, 0, -1) if lines[i].strip()), None)
    if not python and tail is not None and not lines[tail].rstrip().endswith(";"):
        keep[tail] = True
    out: list[str] = []
    folded = 0
    for x, k in zip(lines, keep, strict=True):
        if k or not x.strip():
            if folded:
                out.append(" " * (len(x) - len(x.lstrip())) + f"... [{folded} lines elided] ...")
                folded = 0
            if k:
                out.append(x)
        else:
            folded += 1
    return "\n".join(out)


def slice_symbols(sources: DataFrame) -> DataFrame:
    """(id, sliced, lines, kept): `sources` (id, source, file_path) sliced."""

    @F.pandas_udf("string")
    def cut(source: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else sliced(s, bool(p) and p.endswith(".py")) for s, p in zip(source, path, strict=True)], dtype=object)

    x = sources.withColumn("sliced", cut("source", "file_path"))
    return x.select("id", "sliced", F.size(F.split("source", "\n")).alias("lines"), F.size(F.split("sliced", "\n")).alias("kept"))
