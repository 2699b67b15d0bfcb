"""Secret scans: fixed credential patterns, and windows of high Shannon entropy in candidate strings.

Spans are [start, end) in code points of the whole text. Base kinds are ``assign``, ``access`` and ``hex``, each matched
from the left without overlaps. The kind ``entropy`` comes from a window that slides over every candidate string of one
character class; its symbol counts change by one in and one out at each step. Overlapping windows that reach the class's
threshold merge into one span. Candidates that the allow-list knows (UUIDs, dates, host names, plain words, ...) give no
entropy spans; it never touches base spans.

Defined cases: a null text is empty and has no spans; long texts are scanned whole; repeated rows give repeated results;
a column that is named as the result is replaced, and other columns, whatever their names, pass through; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded_batches

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "entropy")

# Candidate strings by character class with window and threshold in bits.
CLASSES = (
    ("hex", re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{24,}(?![A-Za-z0-9])"), 24, 3.0),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 3.9),
)
# words, also run together with capitals; random letters of both cases have too few small ones behind theirs
_WORDS = r"(?:(?:[A-Z]?[a-z]{2,}+)++|[A-Z]++|[a-z]++)"
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUIDs
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}[T_0-9-]*"  # dates and times
    rf"|[0-9]+|{_WORDS}(?:[-_/=+]{_WORDS})*[-_/=+]*"  # numbers; words and paths of words
    r"|[-_=+/]+|(?:[A-Za-z]+[-_/]){2,}[A-Za-z0-9]{0,12}"  # rules; names with a short tail
)

SPANS_TYPE = "array<struct<kind:string,start:long,end:long>>"


def windows(text: str, size: int, least: float) -> Iterator[tuple[int, int]]:
    """Maximal [start, end) covered by windows of ``size`` symbols whose entropy is ``least`` bits or more."""
    counts: dict[str, int] = {}
    weighted = 0.0  # sum of c * log2(c) over the window's symbols
    cost = [0.0] + [c * math.log2(c) for c in range(1, size + 1)]
    bound = (math.log2(size) - least) * size + 1e-9
    start = end = -1
    for i, symbol in enumerate(text):
        c = counts.get(symbol, 0)
        counts[symbol] = c + 1
        weighted += cost[c + 1] - cost[c]
        if i + 1 < size:
            continue
        if weighted <= bound:
            if start >= 0 and i + 1 - size <= end:
                end = i + 1
            else:
                if start >= 0:
                    yield start, end
                start, end = i + 1 - size, i + 1
        gone = text[i + 1 - size]
        c = counts[gone]
        counts[gone] = c - 1
        weighted += cost[c - 1] - cost[c]
    if start >= 0:
        yield start, end


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end), by start and then kind."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    seen = set()
    for _, pattern, size, least in CLASSES:
        for m in pattern.finditer(text):
            if not ALLOWED.fullmatch(m[0]):
                seen |= {(m.start() + a, m.start() + b) for a, b in windows(m[0], size, least)}
    found += [("entropy", a, b) for a, b in seen]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in texts], dtype=object)


def find_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with a column of spans."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(into, F.pandas_udf(_spans, SPANS_TYPE)(docs[text]))


def _masked(texts: pd.Series) -> pd.Series:
    return pd.Series([mask(t) for t in texts], dtype=object)


def mask(text: str | None) -> str | None:
    """The text with every span, overlapping ones together, replaced by ``[SECRET]``."""
    spans = scan(text)
    if not spans:
        return text
    out, at, end = [], 0, -1
    for _, a, b in spans:
        if a >= end:
            out += [text[at:a], "[SECRET]"]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text`` masked; texts without any, and nulls, stay as they are."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(text, F.pandas_udf(_masked, "string")(docs[text]))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
