"""Text comparisons that no built-in function gives, as Arrow-batched functions over candidate pairs."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def ratio(a: str, b: str) -> float:
    """Share of matching characters by longest matching blocks."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two token arrays, a row at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        # a cell is the best of the cell above, the cell above to the left plus one where tokens agree, and the cell to the left
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return int(row[-1])


def rouge_l(reference: list[str], summary: list[str]) -> float:
    """F-measure of the longest common subsequence; 0 if a side is empty."""
    if not len(reference) or not len(summary):
        return 0.0
    code = {w: i for i, w in enumerate(dict.fromkeys([*reference, *summary]))}
    n = lcs_length(np.array([code[w] for w in summary]), np.array([code[w] for w in reference]))
    return 2 * n / (len(reference) + len(summary))


def column(fn, kind: str):
    """A column function over two columns from a function of two values; null if either is null."""

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(batch, kind)


def salvage_json(text: str, keys: list[str]) -> str | None:
    """The longest JSON object in a text that has one of the keys, as compact JSON; null without one.

    Objects are found by their balanced braces outside of strings; a missing end is added. Commas before a closing bracket are dropped, and single quotes are read as double ones if nothing else helps.
    """
    import json

    found, done = [], 0
    for start in (m.start() for m in re.finditer(r"\{", text)):
        if start < done:  # inside of an object that counts, so shorter
            continue
        quoted, skip, stack = False, False, []
        end = len(text)
        for i in range(start, len(text)):
            ch = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = ch == "\\", ch != '"'
            elif ch == '"':
                quoted = True
            elif ch in "{[":
                stack.append("}" if ch == "{" else "]")
            elif ch in "}]" and stack:
                stack.pop()
                if not stack:
                    end = i + 1
                    break
        body = text[start:end] + ('"' if quoted else "") + "".join(reversed(stack))
        body = re.sub(r",\s*([}\]])", r"\1", body)
        for form in (body, body.replace("'", '"')):
            try:
                value = json.loads(form)
            except ValueError:
                continue
            if isinstance(value, dict) and any(k in value for k in keys):
                found.append(json.dumps(value))
                done = end
                break
    return max(found, key=len, default=None)
