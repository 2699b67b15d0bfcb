"""Best-fit packing: documents as token pieces, placed into sequences by minimum bin slack.

How pieces can share sequences depends on their lengths only, and there are at most ``size`` lengths, so the bins are
planned from a table of counts that does not grow with the corpus. Each bin starts from the longest length that is left; a
bitset subset-sum over the available lengths then finds the fullest combination for its room, and that combination is taken
as often as the counts allow and removed. Pieces are numbered within their length on Spark, and a piece's number tells its
bin and place. A length has as many salts as its count asks for, so a group to number stays at some hundred thousand rows
however many pieces share a length; a full piece fills a sequence by itself and is not numbered at all.

Defined cases: a null or empty text is the end token alone; longer documents are cut so that only the first piece is
short; documents that repeat are packed as often as they occur; pieces of equal length are interchangeable; an empty table
packs into nothing; other columns of the documents, whatever their names, are not read; columns of the pieces that are named
sequence_id or offset are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded_batches, written

SIZE, END_ID = 1024, 2
GROUP = 250_000  # pieces that are numbered together at the most
SPREAD = 64  # groups that a length of some hundred pieces or more has at the least
# Fixed value: how byte-level BPE splits a text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Encoder:
    """Token ids of a tokenizer file, as little-endian 32-bit bytes.

    A plain byte-level BPE file, whose ids follow its merges, is run by tiktoken with ranks taken from that file, which
    gives the same ids in a third of the time; texts that hold one of its special strings, and other files, go through
    the tokenizer itself.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = _ranked(json.loads(self.tokenizer.to_str()))

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _ranked(spec: dict):
    """A tiktoken encoding with a byte-level BPE's own ranks; None for files that it cannot stand for."""
    import tiktoken

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    # byte-level vocabularies write bytes that are no visible Latin-1 character as characters from 256 on
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in visible]
    of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(other)}
    special = {x["content"] for x in spec["added_tokens"]}
    ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(merged) + 256 != len(ranks):
        return None
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_encoders: dict[str, Encoder] = {}


def tokenize_documents(docs: DataFrame, tokenizer_file: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and tokens (little-endian unsigned 32-bit ids) of each piece."""
    end = np.array([end_id], "<u4").tobytes()
    bounded_batches(docs.sparkSession)
    fields = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    schema = f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, tokens binary"

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(tokenizer_file) or _encoders.setdefault(tokenizer_file, Encoder(tokenizer_file))
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                at, piece, start, length, tokens = [], [], [], [], []
                for row, t in enumerate(part.column("text").to_pylist()):
                    ids = encode(t or "") + end
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        at.append(row)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        tokens.append(ids[4 * a : 4 * b])
                columns = [part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "tokens"])

    return fields.mapInArrow(tokenize, schema)


def fullest(lengths: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The fullest combination of (length, how many there are) in a room, longest lengths first.

    Bit s of a set says that sum s can be reached; each step adds one run of copies of a length (1, 2, 4, ... of them).
    """
    steps, reach, goal = [], 1, 1 << room
    mask = (goal << 1) - 1
    for length, n in lengths:
        if length > room or reach & goal:
            continue
        left, run = min(n, room // length), 1
        while left > 0 and not reach & goal:
            k = min(run, left)
            steps.append((reach, length, k))
            reach |= (reach << (k * length)) & mask
            left, run = left - k, run * 2
    at, out = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            at -= k * length
            out[length] = out.get(length, 0) + k
    return sorted(out.items(), reverse=True)


def plan_bins(counts: dict[int, int], size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations of (length, copies) and how many bins take each, until no piece is left."""
    left, plan = dict(sorted(counts.items(), reverse=True)), []
    while left:
        longest = next(iter(left))
        rest = [(length, n - (length == longest)) for length, n in left.items()]
        own = dict(fullest([x for x in rest if x[1]], size - longest))
        own[longest] = own.get(longest, 0) + 1
        times = min(left[length] // k for length, k in own.items())
        for length, k in own.items():
            left[length] -= k * times
            if not left[length]:
                del left[length]
        plan.append((sorted(own.items(), reverse=True), times))
    return plan


def _segments(plan: list, size: int) -> dict[int, np.ndarray]:
    """By length: first number, copies in a bin, first bin, first offset of each stretch of numbers."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    bins = 0
    for combination, times in plan:
        offset = 0
        for length, k in combination:
            out.setdefault(length, []).append((used.get(length, 0), k, bins, offset))
            used[length] = used.get(length, 0) + k * times
            offset += k * length
        bins += times
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pack_pieces(pieces: DataFrame, length: str = "length", key: tuple[str, ...] = ("doc_id", "piece"), size: int = SIZE, group: int = GROUP) -> DataFrame:
    """``pieces`` with sequence_id and offset. Its rows are written first, so that counting and placing see the same.

    Full pieces have negative sequence_ids.
    """
    rows = written(pieces.select(F.struct(*[pieces[c] for c in pieces.columns]).alias("row"), pieces[length].cast("long").alias("n"), F.monotonically_increasing_id().alias("at")), "pieces")
    by_length = {r["n"]: r["count"] for r in rows.groupBy("n").count().collect()}  # at most `size` rows
    if by_length and (min(by_length) < 1 or max(by_length) > size):
        raise ValueError(f"lengths must be from 1 to {size}")
    short = rows.filter(F.col("n") < size)
    salts = np.ones(size + 1, np.int64)
    for n, count in by_length.items():
        salts[n] = max(min(SPREAD, -(-count // 256)), -(-count // group))
    of_length = F.element_at(F.array(*[F.lit(int(k)) for k in salts[1:]]), F.col("n").cast("int"))
    short = short.withColumn("salt", F.pmod(F.xxhash64("at"), of_length).cast("int"))
    # at most SPREAD rows for each length, and one more for each `group` pieces
    table = short.groupBy("n", "salt").count().toPandas().sort_values(["n", "salt"])
    ahead = np.zeros((size + 1, int(salts[:size].max())), np.int64)
    ahead[table["n"], table["salt"]] = table["count"]
    ahead = np.cumsum(ahead, axis=1) - ahead
    segments = _segments(plan_bins({n: c for n, c in by_length.items() if n < size}, size), size)

    def place(lengths: pd.Series, salt: pd.Series, number: pd.Series) -> pd.DataFrame:
        n = lengths.to_numpy()
        number = number.to_numpy() - 1 + ahead[n, salt.to_numpy()]
        sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for one in np.unique(n):
            at = n == one
            rows = segments[int(one)]
            rows = rows[np.searchsorted(rows[:, 0], number[at], side="right") - 1]
            inside = number[at] - rows[:, 0]
            sequence[at] = rows[:, 2] + inside // rows[:, 1]
            offset[at] = rows[:, 3] + inside % rows[:, 1] * one
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    number = F.row_number().over(Window.partitionBy("n", "salt").orderBy(*[f"row.{c}" for c in key], "at")).cast("long")
    placed = short.withColumn("number", number).select("row", F.pandas_udf(place, "sequence_id long, offset long")("n", "salt", "number").alias("place"))
    full = rows.filter(F.col("n") == size).select("row", F.struct((-1 - F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).alias("place"))
    kept = [F.col(f"row.`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    return placed.unionByName(full).select(*kept, "place.sequence_id", "place.offset")


def build_sequences(pieces: DataFrame, tokens: str = "tokens") -> DataFrame:
    """sequence_id and its tokens: the packed pieces in order of offset, at most a sequence's size together."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", F.hex(tokens).alias("t"))))
    rows = pieces.groupBy("sequence_id").agg(ordered.alias("p"))
    return rows.select("sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: x["t"]), "")).alias("tokens"))
