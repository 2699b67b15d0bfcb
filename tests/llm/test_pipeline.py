"""The corpus pipeline stage by stage, and as a whole against brute force."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import langid, packing, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FILLER = ["the quick brown fox jumps over the lazy dog and runs", "der schnelle braune fuchs springt über den faulen hund hin", "le renard brun saute par dessus le chien paresseux et court"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sample_rows():
    data = [(i, f"{FILLER[i % 3]} {' '.join(f'word{i}x{k}' for k in range(20))}", ("en", "de", "fr")[i % 3], ("a", "b", None)[i % 3], 10) for i in range(30)]
    data += [(100, data[0][1], "en", "a", 1), (101, None, None, None, None), (102, "", "en", "a", 0), (103, "12 34", "en", "a", 5), (0, data[0][1], "en", "a", 10), (104, f"{FILLER[0]} token = '{'0123456789abcdef' * 2}' alone here", None, "a", 3), (None, "no id here but words", "en", "b", 1)]
    data += [(1, "another text whose row has the same id as some other document does", "en", "a", 1)]
    return data


def sample(spark):
    return spark.createDataFrame(sample_rows(), DOCS)


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def first_of_groups(data):
    """Rows that the near-duplicate stage keeps, by comparing all pairs."""
    rows = list(dict.fromkeys((r[0], r[1]) for r in data if r[0] is not None))
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    best = {}
    for g, (i, t) in zip(group, rows, strict=True):
        best.setdefault(g, []).append((i, hashlib.md5((t or "").encode()).hexdigest(), t))
    return sorted([(i, t) for i, _, t in map(min, best.values())] + [(r[0], r[1]) for r in data if r[0] is None], key=str)


def test_stages(spark):
    df = sample(spark)
    told = cp.language_stage(spark, df, "")
    assert told.columns == df.columns and told.count() == df.count() - 3 and told.filter("lang IS NULL").count() == 0
    once = cp.near_duplicate_stage(spark, told, "")
    assert once.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in once.collect()), key=str) == first_of_groups([tuple(r) for r in told.collect()])
    assert once.filter("doc_id = 1").count() == 2
    masked = cp.secret_stage(spark, once, "")
    assert masked.columns == df.columns and masked.count() == once.count()
    assert masked.filter("text LIKE '%[SECRET]%'").select("doc_id").collect() == [(104,)] and masked.filter(F.length("text") != F.col("n_chars")).count() == 0
    mixed = cp.mixture_stage(spark, masked, "")
    assert mixed.columns == df.columns and mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 3
    packed = cp.packing_stage(spark, mixed, "")
    assert packed.filter("piece = 0").count() == mixed.count()


CLASHES = ("kept", "language", "secrets", "text_key", "kept_id", "__size", "__src", "__copies", "__row", "row", "n", "salt", "place", "offset", "component")


def test_stages_with_clashing_columns_and_without_rows(spark):
    df = sample(spark).select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    for _, stage in cp.STAGES:
        for rows in (df, df.limit(0)):
            out = stage(spark, rows, "")
            if stage is cp.packing_stage:
                assert out.count() >= rows.count()
                continue
            assert out.columns == df.columns
            for r in out.collect():
                assert all(r[c] == (None if r["doc_id"] is None else f"{c} {r['doc_id']}") for c in CLASHES)


def test_stages_with_a_very_long_text(spark):
    long = " ".join(f"wort{k % 977} und der {k}" for k in range(60_000))
    df = spark.createDataFrame([(1, long, "de", "a", 1), (2, long + " ende", "de", "a", 1), (3, "the cat and the dog", "en", "b", 1)], DOCS)
    for name, stage in cp.STAGES:
        if name != "packing":
            df = stage(spark, df, "")
            kept = {r[0]: r[1] for r in df.select("doc_id", "text").collect()}
            assert kept.get(1, long) == long and (name == "language ID" or 2 not in kept)
    out = cp.packing_stage(spark, df, "").toPandas()
    whole = len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(long, add_special_tokens=False).ids) + 1
    copies = (out[out.doc_id == 1].piece == 0).sum()
    assert out[out.doc_id == 1].length.sum() == whole * copies


def mixed_by_hand(rows):
    """How often each (doc_id, text, source) is taken: places by size class, salt, size, id and hash; shares by weight."""
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    held, left = {}, set(sources)
    while True:
        share = {s: (sum(total.values()) - sum(held.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * total[s]}
        if not over:
            break
        held |= {s: 3.0 * total[s] for s in over}
        left -= over
    target, out = held | share, []
    for s in sources:
        keyed = []
        for i, t, x in rows:
            if x == s:
                n, h = size(t), hashlib.md5((t or "").encode()).hexdigest()
                salt = int(hashlib.md5(f"{'' if i is None else i}:{h}".encode()).hexdigest()[:4], 16) % 64
                keyed.append(((f"{len(f'{n:b}'):02d}{f'{n:b}'[:5].ljust(5, '0')}", salt, n, i is not None, i or 0, h), i, t))
        start = int(hashlib.md5(f"mix-1:{'true' if s is None else 'false'}:{s or ''}".encode()).hexdigest()[:6], 16) / 16777216
        ratio = target[s] / total[s] if total[s] else 0.0
        for place, (_, i, t) in enumerate(sorted(keyed)):
            out += [(i, t)] * min(int(np.floor(start + ratio * (place + 1)) - np.floor(start + ratio * place)), 3)
    return out


def test_run_against_brute_force(spark, tmp_path):
    spark.createDataFrame(sample_rows(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    data = sample_rows()
    model = langid.fit(spark.createDataFrame([r for r in data if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 != 1], DOCS))
    told = [r for r in data if model.predict(r[1])[0] != "und"]
    source = {(r[0], r[1]): r[3] for r in told}
    masked = [(i, secrets.mask(t), source[i, t]) for i, t in first_of_groups(told)]
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = []
    for i, t in mixed_by_hand(masked):
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert len(ids) <= packing.SIZE
        want.append((i, 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    got = cp.run(spark, str(tmp_path)).toPandas()
    rows = [(None if i != i else int(i), *map(int, x)) for i, *x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(rows, key=str) == sorted(want, key=str)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= packing.SIZE
    assert [name for name, _ in cp.STAGES] == ["language ID", "near duplicates", "secret scan", "source mixture", "packing"]
