"""Chat formatting: layouts recognised by schema fingerprints, canonical turns, and a reversible template.

A layout is a set of nested field paths and a declarative mapping, found by the hash of the paths, its fingerprint. A table
(or a JSON record) has its own paths normalised, which leaves out wrappers and fields that no layout speaks of, and their
fingerprint selects the mapping.

The template writes a turn as ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts, a backslash goes behind every
backslash and behind the first character of every control string, so no control string is left in them, and dropping
each backslash while keeping the character behind it restores them.

Output comes in parts of bounded size, in order, so a conversation of any length neither fills a row nor a worker: parts
of one conversation, joined, are its formatted text. ``mask`` holds the [start, end) of assistant texts in a part.

Defined cases: a null text or role is empty; rows with equal turns are ordered by role and text, nulls first; a null
conv_id is a conversation of its own; an empty table gives an empty result; repeated rows are repeated turns; texts of any
length are formatted whole. The digests of a conversation run along its turns, so one task reads a conversation, in parts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import bounded_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: First characters of control strings (this template's and other common ones), and the backslash.
_TO_ESCAPE = r"(\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_FRAME = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

# Known layouts. Paths carry [] for an array's elements.
LAYOUTS = (
    {"name": "turn rows", "paths": ["conv_id", "turn", "role", "text"], "rows": ("conv_id", "turn", "role", "text")},
    {"name": "messages", "paths": ["messages[].role", "messages[].content"], "items": ("messages", "role", "content")},
    {"name": "from and value", "paths": ["conversations[].from", "conversations[].value"], "items": ("conversations", "from", "value")},
    {"name": "instruction with input", "paths": ["instruction", "input", "output"], "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "instruction", "paths": ["instruction", "output"], "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"name": "system, prompt and response", "paths": ["system", "prompt", "response"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "prompt and completion", "paths": ["prompt", "completion"], "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "prompt and response", "paths": ["prompt", "response"], "fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "question and answer", "paths": ["question", "answer"], "fields": [("user", ["question"]), ("assistant", ["answer"])]},
)


def fingerprint(paths: set[str] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


_BY_PRINT = {fingerprint(x["paths"]): x for x in LAYOUTS}
_BY_LENGTH = sorted(LAYOUTS, key=lambda x: sorted(x["paths"]))  # of equal lengths the first in order of names
_NAMES = {re.split(r"\.", p)[-1] for x in LAYOUTS for p in x["paths"]}
_LEAVES = {p.split(".")[-1] for x in LAYOUTS if "items" in x for p in x["paths"]}  # role and content, from and value
_ARRAYS = {p.split("[]")[0] for x in LAYOUTS for p in x["paths"] if "[]" in p}


def canonical_path(path: str) -> str | None:
    """A nested path without what wraps it: from the last array on, or its last name; None where no layout speaks of it."""
    steps = path.split(".")
    at = max((k for k, step in enumerate(steps) if step.endswith("[]")), default=len(steps) - 1)
    rest = steps[at:]
    known = rest[0][:-2] in _ARRAYS if rest[0].endswith("[]") else True
    return ".".join(rest) if known and len(rest) <= 2 and rest[-1] in _NAMES else None


@lru_cache(maxsize=4096)
def layout_of(paths: frozenset[str]) -> dict | None:
    """The layout whose fingerprint the paths have, and where each of its paths is found.

    Metadata and wrappers are normalised away first. Should fields of several layouts meet, the largest set of paths that has
    a known fingerprint counts, the first in order of names among equals; of several paths that are canonically the same, the
    shortest.
    """
    where: dict[str, str] = {}
    for p in sorted(paths, key=lambda p: (p.count("."), p)):
        if (c := canonical_path(p)) is not None:
            where.setdefault(c, p)
    fit = max((x for x in _BY_LENGTH if set(where) >= set(x["paths"])), key=lambda x: len(x["paths"]), default=None)
    layout = _BY_PRINT[fingerprint(fit["paths"])] if fit else None
    return layout | {"where": {c: where[c] for c in layout["paths"]}} if layout else None


def schema_paths(schema: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a Spark type."""
    if isinstance(schema, T.StructType):
        return set().union(*[schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in schema.fields]) if schema.fields else set()
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    return {at}


def value_paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a parsed JSON value. What a message says is one value, whatever it is made of."""
    if at.split(".")[-1] in _LEAVES:
        return {at}
    if isinstance(value, dict):
        return set().union(*[value_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()]) if value else set()
    if isinstance(value, list):
        return set().union(*[value_paths(v, f"{at}[]") for v in value]) if value else {f"{at}[]"}
    return {at}


def _column(df: DataFrame, path: str) -> Column:
    names = path.split(".")
    out = df[f"`{names[0]}`"]
    for name in names[1:]:
        out = out[name]
    return out


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text of a table in any known layout, by the fingerprint of its schema."""
    layout = layout_of(frozenset(schema_paths(df.schema)))
    if layout is None:
        raise ValueError(f"no layout has the fingerprint of {sorted(schema_paths(df.schema))}")
    at = layout["where"]
    if "rows" in layout:
        i, n, role, text = (_column(df, at[c]) for c in layout["rows"])
        return df.select(i.alias("conv_id"), n.cast("long").alias("turn"), _role(role).alias("role"), text.alias("text"))
    if "items" in layout:
        top, role, text = layout["items"]
        rows = df.select(df[conv_id].alias("conv_id"), F.posexplode(_column(df, at[f"{top}[].{role}"].split("[]")[0])).alias("turn", "item"))
        return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col("item")[role]).alias("role"), F.col("item")[text].alias("text"))
    turns = [F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.concat_ws("\n", *[F.when(_column(df, at[c]) != "", _column(df, at[c])) for c in cols]).alias("text")) for k, (role, cols) in enumerate(layout["fields"])]
    return df.select(df[conv_id].alias("conv_id"), F.inline(F.array(*turns)))


def _role(role):
    out = role
    for a, b in ROLES.items():
        out = F.when(role == a, F.lit(b)).otherwise(out)
    return out


def _inside(record: object, path: str) -> object:
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def _said(value: object) -> str | None:
    """A value as text: texts as they are, a list of parts by the texts in it, anything else as JSON."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, list) and all(isinstance(p, str) or (isinstance(p, dict) and isinstance(p.get("text"), str)) for p in value):
        return "\n".join(p if isinstance(p, str) else p["text"] for p in value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def _record_turns(record: object) -> list[tuple[str | None, str | None]]:
    layout = layout_of(frozenset(value_paths(record))) if isinstance(record, dict) else None
    if layout is None or "rows" in layout:
        return []
    at = layout["where"]
    if "items" in layout:
        top, role, text = layout["items"]
        items = _inside(record, at[f"{top}[].{role}"].split("[]")[0])
        return [(ROLES.get(r := _said(m.get(role)), r), _said(m.get(text))) for m in (items if isinstance(items, list) else []) if isinstance(m, dict)]
    said = {c: _said(_inside(record, at[c])) for _, cols in layout["fields"] for c in cols}
    return [(role, "\n".join(said[c] for c in cols if said[c])) for role, cols in layout["fields"]]


def _parsed(text: str | None) -> list[tuple[str | None, str | None]]:
    """The turns of a JSON record; none of what is broken, unknown or nested too deeply."""
    try:
        return _record_turns(json.loads(text)) if text else []
    except (ValueError, RecursionError):
        return []


def canonical_turns_json(df: DataFrame, conv_id: str, record: str) -> DataFrame:
    """The same for a column of JSON records, each with a layout of its own; unknown or broken records give no turns, and values that are
    not texts become texts."""

    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"role": r, "text": x} for r, x in _parsed(t)] for t in texts], dtype=object)

    turns = F.pandas_udf(parsed, "array<struct<role:string,text:string>>")
    rows = df.select(df[conv_id].alias("conv_id"), F.posexplode(turns(df[record])).alias("turn", "item"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("item.role").alias("role"), F.col("item.text").alias("text"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


PARTS = "conv_id string, part long, formatted string, mask array<struct<start:long,end:long>>"


def format_turns(turns: DataFrame, part_chars: int = 1_000_000) -> DataFrame:
    """conv_id, part, formatted and mask, in order of conv_id and part within a partition.

    Escaping runs in the JVM before the rows are dealt out by conversation and sorted; what remains joins neighbours.
    """

    def escaped(c: str):
        return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), _TO_ESCAPE, r"$1\\")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part, length, held, mask = None, 0, 0, [], []
        for batch in batches:
            out = []
            for conv, role, text in zip(batch["c"], batch["r"], batch["t"], strict=True):
                conv = None if pd.isna(conv) else conv
                if held and (conv != now or length >= part_chars):
                    out.append((now, part, "".join(held), mask))
                    part, length, held, mask = (part + 1 if conv == now else 0), 0, [], []
                now = conv
                before = len(TURN) + len(role) + len(TEXT)
                if role == "assistant":
                    mask.append({"start": length + before, "end": length + before + len(text)})
                held += [TURN, role, TEXT, text, END]
                length += before + len(text) + len(END)
            if out:
                yield _parts(out)
        if held:
            yield _parts([(now, part, "".join(held), mask)])

    bounded_batches(turns.sparkSession)
    rows = turns.select(turns["conv_id"].cast("string").alias("c"), turns["turn"].alias("n"), turns["role"].alias("r0"), turns["text"].alias("t0"))
    rows = rows.repartition("c").sortWithinPartitions("c", "n", "r0", "t0")
    # ids travel as text: a column of integers with nulls would become floats
    joined = rows.select("c", escaped("r0").alias("r"), escaped("t0").alias("t")).mapInPandas(join, PARTS)
    return joined.withColumn("conv_id", F.col("conv_id").cast("long"))


def _parts(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "part", "formatted", "mask"])


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted part."""
    return [(unescape(r), unescape(t)) for r, t in _FRAME.findall(formatted)]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_parts(parts: DataFrame) -> DataFrame:
    """What reading the formatted parts gives back: turns, text under the mask, and lengths, by conversation.

    ``parts`` must come in the order of :func:`format_turns`; the digests run along the parts, which need not fit a worker.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out = []
            for conv, part, text, mask in zip(batch["conv_id"], batch["part"], batch["formatted"], batch["mask"], strict=True):
                if part == 0:
                    if state:
                        out.append(_closed(now, state))
                    now, state = (None if pd.isna(conv) else int(conv)), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_turns(text)
                state[0] += len(turns)
                state[1].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                under = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += len(text)
            yield _digests(out)
        if state:
            yield _digests([_closed(now, state)])

    return parts.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(read, DIGESTS)


def _closed(conv: int | None, s: list) -> tuple:
    return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]


def _digests(rows: list[tuple]) -> pd.DataFrame:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
