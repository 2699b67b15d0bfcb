"""MinHash near-dedup: band candidates, b-bit estimates, and confirmation on full shingle sets.

A text's set is its distinct five-word shingles (the whole sequence with fewer words). Documents with equal sets form a
class, and one of each class goes on. 128 minima give 32 bands of four; the low bits of the minima, packed, tell after the
bands which candidates can still be as similar as asked: matching bits are counted and corrected for chance collisions, and a
wide margin is kept. What passes is confirmed on the full sets.

Only components are asked for, so a bucket of any size is worked off without all its pairs. First every document is linked
to the least member of each of its buckets, where that passes the estimate. Then, in buckets whose members still lie in
several components, members of different components are compared by their packed signatures, in blocks, and what passes
is confirmed too. No bucket is capped.

Defined cases: null, empty and blank texts have an empty set and link with nothing; so do rows without a doc_id, whose
component is null and which are kept; rows with equal sets are one class, whatever their doc_ids, and rows that share a
doc_id but not their set are looked at on their own; texts are read whole; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded_batches, dropped, small_batches, written
from ledgerline.llm.components import connected_components

WORDS = 5
PERCENT = 75
HASHES, BAND_ROWS, BITS = 128, 4, 4
MARGIN = 0.18  # below the threshold, over four standard deviations of the estimate
BLOCK = 128
_A = np.random.default_rng(7).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(8).integers(0, 1 << 63, HASHES, dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = bytes(range(256)).lower()


class _Words(dict):
    """Hashes of words, remembered up to a number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # splits at the bytes that are no word's
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    last = len(h) - n + 1
    out = np.full(last, n, np.uint64)
    for k in range(n):
        out = _mixed(out * _M1 + h[k : k + last])
    return np.unique(out)


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        out = np.minimum(out, (s[at : at + 2048, None] * _A + _B).min(axis=0))
    return _mixed(out)


def packed(m: np.ndarray) -> bytes:
    """The low bits of the minima."""
    low = (m & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    bits = (low[:, None] >> np.arange(BITS, dtype=np.uint8)) & 1
    return np.packbits(bits.ravel()).tobytes()


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by packed signatures, in rows of bytes: shares of equal values, corrected for chance."""
    spread = a ^ b
    for step in (2, 1):  # a value takes four bits of a byte; its lowest then tells whether any differed
        spread = spread | (spread >> np.uint8(step))
    equal = 1 - np.bitwise_count(spread & np.uint8(0x11)).sum(axis=-1, dtype=np.int64) / HASHES
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


SIGNED = "doc_id long, text_key string, n_shingles long, set_key string, bands array<long>, bits binary, packed binary"


def sign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """Set size, a key of the whole set, band keys, packed signature and compressed text of each row; the key of the text
    (see :func:`text_key`) comes along."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                sizes, keys, bands, bits, texts = [], [], [], [], []
                for t in part.column("text").to_pylist():
                    s = shingles(t, words)
                    m = minima(s) if len(s) else None
                    sizes.append(len(s))
                    keys.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                    bands.append(_bands(m) if len(s) else None)
                    bits.append(packed(m) if len(s) else None)
                    texts.append(pack.compress(t.encode("utf-8", "surrogatepass")) if len(s) else None)
                columns = [part.column("doc_id"), part.column("text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "set_key", "bands", "bits", "packed"])

    bounded_batches(docs.sparkSession)
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"), text_key(docs[text]).alias("text_key")).mapInArrow(signed, SIGNED)


def text_key(text: Column) -> Column:
    """A hash by which rows with equal texts are found."""
    return F.md5(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"))


def _bands(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(-1, BAND_ROWS)
    key = np.arange(len(rows), dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = _mixed(key * _M2 + rows[:, k])
    return key.view(np.int64)


def _close(a: pd.Series, b: pd.Series) -> pd.Series:
    at = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1)
    return pd.Series(estimates(at(a), at(b)) >= PERCENT / 100 - MARGIN) if len(a) else pd.Series([], dtype=bool)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets share enough of their union."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * 100 >= (len(a) + len(b) - common) * percent


class _Sets:
    """Full sets of compressed texts, the latest of them remembered."""

    def __init__(self, words: int, remember: int = 128):
        unpack = zstandard.ZstdDecompressor()
        self.of = lru_cache(maxsize=remember)(lambda z: shingles(unpack.decompress(z).decode("utf-8", "surrogatepass"), words))


def confirmed(pairs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """The pairs (u, v) of nodes whose packed signatures are close and whose full sets are similar enough."""

    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        sets = _Sets(words)
        return pd.Series([similar(sets.of(x), sets.of(y)) for x, y in zip(a, b, strict=True)], dtype=bool)

    # callers write the result with few pairs to a batch, since texts may be long
    side = lambda c: classes.select(F.col("node").alias(c), F.col("bits").alias("b" + c), F.col("packed").alias("p" + c))
    both = pairs.join(side("u"), "u").join(side("v"), "v").filter(F.pandas_udf(_close, "boolean")("bu", "bv"))
    return both.filter(F.pandas_udf(check, "boolean")("pu", "pv")).select("u", "v")


def _classes(signed: DataFrame) -> DataFrame:
    """One row for each distinct set: a number of its own (node), the least doc_id, and signature and text of that row.

    The numbers hold because the table is written: they are read from there and never made again.
    """
    named = signed.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    one = named.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.min_by(F.struct("bands", "bits", "packed"), "doc_id").alias("x"))
    return written(one.select(F.monotonically_increasing_id().alias("node"), "set_key", "doc", "x.bands", "x.bits", "x.packed"), "classes")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    out = components(docs, text, doc_id, words)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and component of every row.

    The component's number tells apart components whose least doc_id is the same, as when rows share a doc_id; it is null
    for rows that link with nothing because they have no words or no doc_id.
    """
    signed = written(sign(docs, text, doc_id, words), "signed")
    classes = _classes(signed)
    # 16 bytes for each band; signatures and texts follow for those that share a bucket
    slots = classes.select("node", F.explode("bands").alias("band"))
    buckets = slots.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    slots = written(slots.join(buckets, "band"), "slots")
    stars = slots.filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    with small_batches(docs.sparkSession, 256):
        links = written(confirmed(stars, classes, words), "links")
    nodes = written(connected_components(links), "nodes")
    across = _across(slots, classes, nodes, words)
    dropped(slots)
    dropped(links)
    if not across.isEmpty():
        nodes = written(_merged(nodes, across), "nodes")
    # a component goes by its least doc_id; classes without links are their own
    placed = classes.select("node", "set_key", "doc").join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
    placed = placed.join(least, "component").select("set_key", "component", "component_id")
    row = signed.select("doc_id", "text_key", "n_shingles", "set_key")
    found = row.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").join(placed, "set_key").drop("set_key")
    alone = row.filter("set_key IS NULL OR doc_id IS NULL").drop("set_key")
    return found.unionByName(alone.withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")}))


def _merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and component after further links, found between the components alone."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("component").alias("c" + c))
    ends = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    over = written(connected_components(ends), "over").select(F.col("node").alias("component"), F.col("component").alias("top"))
    known = nodes.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = over.join(nodes, over["component"] == nodes["node"], "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component"))
    return known.unionByName(new)


def _block_pairs(members: DataFrame, *columns: str) -> DataFrame:
    """Pairs of blocks of a bucket's members that can hold two components, with arrays of the columns of both.

    Components with many members in a bucket form blocks of their own and the others share blocks, so a large group that
    is one component is compared with the rest of its bucket only. A pair meets under the key of its left block; the right
    ones are copied to these keys, so no key holds a bucket.
    """
    counts = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") >= BLOCK
    mixed = counts.groupBy("band").agg(
        F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)).alias("rest"),
        F.collect_list(F.when(large, F.struct(F.col("component").alias("owner"), F.ceil(F.col("n") / BLOCK).alias("blocks")))).alias("owners"),
    )
    shared = F.ceil(F.col("rest") / BLOCK)
    # owner -1 stands for the shared blocks; nodes and components count from 0
    mixed = mixed.select("band", F.concat("owners", F.when(shared > 0, F.array(F.struct(F.lit(-1).cast("long").alias("owner"), shared.alias("blocks")))).otherwise(F.expr("cast(array() AS array<struct<owner:bigint,blocks:bigint>>)"))).alias("all"))
    own = F.filter("all", lambda o: o["owner"] == F.col("component"))
    mine = F.when(F.size(own) > 0, own[0]).otherwise(F.filter("all", lambda o: o["owner"] == -1)[0])
    placed = members.join(mixed, "band").withColumn("mine", mine)
    placed = placed.withColumns({"owner": F.col("mine.owner"), "block": F.pmod(F.xxhash64("node"), F.col("mine.blocks"))})
    blocks = placed.groupBy("band", "owner", "block").agg(F.collect_list(F.struct(*columns)).alias("m"))
    lefts = F.flatten(F.transform("all", lambda o: F.transform(F.sequence(F.lit(0).cast("long"), o["blocks"] - 1), lambda k: F.struct(o["owner"].alias("owner"), k.alias("block")))))
    me = F.struct("owner", "block")
    meets = F.filter(lefts, lambda o: ((o < me) & (o["owner"] != F.col("owner"))) | ((o <= me) & (o["owner"] == -1) & (F.col("owner") == -1)))
    right = blocks.join(mixed, "band").select("band", F.col("m").alias("m2"), F.explode(meets).alias("k")).select("band", "k.owner", "k.block", "m2")
    pairs = blocks.withColumnRenamed("m", "m1").join(right, ["band", "owner", "block"])
    return pairs.select("band", *[F.col(f"m{k}.{c}").alias(f"{c}{k}") for k in (1, 2) for c in columns])


def _near(p) -> tuple[np.ndarray, np.ndarray]:
    """Positions of members of two blocks in different components whose signatures are close and whose first common
    bucket this is."""
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (p.bits1, p.bits2))
    near = (estimates(x[:, None, :], y[None, :, :]) >= PERCENT / 100 - MARGIN) & (np.asarray(p.component1)[:, None] != np.asarray(p.component2)[None, :])
    i, j = np.nonzero(near)
    if len(i):
        b1, b2 = np.stack(p.bands1), np.stack(p.bands2)
        keep = np.concatenate([b1[i[s : s + 65536]][np.arange(len(i[s : s + 65536])), (b1[i[s : s + 65536]] == b2[j[s : s + 65536]]).argmax(axis=1)] == p.band for s in range(0, len(i), 65536)])
        i, j = i[keep], j[keep]
    return i, j


def _across(slots: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Links between components, from members of a bucket other than its hub.

    Only buckets whose members lie in several components are looked at. A first pass over packed signatures finds who has a
    close partner in another component; only these take their texts to a second pass, which confirms on full sets inside the
    task and returns one link for each pair of components at most.
    """
    placed = slots.filter("n > 2").select("band", "node").join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("band")
    members = written(placed.join(several, "band"), "members")

    def partners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p in batch.itertuples():
                i, j = _near(p)
                if len(i):
                    found = np.unique(np.concatenate([np.asarray(p.node1)[np.unique(i)], np.asarray(p.node2)[np.unique(j)]]))
                    yield pd.DataFrame({"band": np.full(len(found), p.band), "node": found})

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = _Sets(words, 2 * BLOCK)
        for batch in batches:
            for p in batch.itertuples():
                done, out = set(), []
                for i, j in zip(*_near(p), strict=True):
                    ends = (p.component1[i], p.component2[j])
                    if ends not in done and similar(sets.of(p.packed1[i]), sets.of(p.packed2[j])):
                        done |= {ends, ends[::-1]}
                        out.append((p.node1[i], p.node2[j]))
                if out:
                    yield pd.DataFrame(out, columns=["u", "v"])

    signed = members.join(classes.select("node", "bands", "bits"), "node")
    with small_batches(slots.sparkSession, 64):
        busy = written(_block_pairs(signed, "node", "component", "bits", "bands").mapInPandas(partners, "band long, node long").distinct(), "busy")
    carried = members.join(busy, ["band", "node"]).join(classes.select("node", "bands", "bits", "packed"), "node")
    with small_batches(slots.sparkSession, 8):
        out = written(_block_pairs(carried, "node", "component", "bits", "bands", "packed").mapInPandas(check, "u long, v long"), "across")
    dropped(members)
    dropped(busy)
    return out
