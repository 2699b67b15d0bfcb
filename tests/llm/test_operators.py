"""Corpus operators against brute force, exact round trips and held-out accuracy, with the defined odd cases."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerline.llm import chat, embeddings, langid, licenses, media, minhash, mixing, packing, queries, resampling, secrets, spelling, urlfilter, warc
from ledgerline.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, source="a"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)], DOCS)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# -- mixing


def test_mixing_targets_share_by_weight_and_stop_at_three_times(spark):
    data = [(i, "w " * 10, "en", s, 20) for i, s in enumerate(["a"] * 10 + ["b"] * 40 + ["c"] * 50 + [None] * 4)]
    plan = mixing.mixing_plan(spark.createDataFrame(data, DOCS)).join(spark.createDataFrame(data, DOCS).select("doc_id", "source"), "doc_id")
    got = {r["source"]: (r["source_size"], r["target"], r["taken"]) for r in plan.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    sizes, weights = {"a": 100, "b": 400, "c": 500, None: 40}, {"a": 5, "b": 2, "c": 1, None: 5}
    want, total, free = {}, 1040.0, set(sizes)
    while True:  # share what is left by weight, hold what passes its cap, repeat
        left = total - sum(want.values())
        shares = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if shares[s] > 3 * sizes[s] + 1e-9}
        if not over:
            want |= shares
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    for s in sizes:
        assert got[s][0] == sizes[s] and got[s][1] == pytest.approx(want[s]) and abs(got[s][2] - want[s]) <= 10


def test_mixing_odd_rows_and_other_columns(spark):
    data = [(1, None, "x", None), (1, "one two", "x", "s"), (1, "one two", "x", "s"), (2, "", "y", "s"), (None, "a\x0bb c", "y", "t")]
    df = spark.createDataFrame(data, "doc_id long, text string, size string, source string")
    plan = rows(mixing.mixing_plan(df), "doc_id", "size", "taken")
    assert len(plan) == 5 and all(t <= 3 * n for _, n, t in plan) and sorted(n for _, n, _ in plan) == [0, 0, 2, 2, 3]
    mixed = mixing.repeat_documents(df)
    assert mixed.columns == df.columns
    assert mixed.filter("text <> ''").count() == sum(t // n for _, n, t in plan if n)
    assert mixing.mixing_plan(df.limit(0)).count() == 0
    assert sorted(rows(mixing.mixing_plan(df), "doc_id", "taken"), key=str) == sorted(rows(mixing.mixing_plan(df.repartition(3)), "doc_id", "taken"), key=str)
    clash = df.select("*", *[F.lit(c).alias(c) for c in ("__size", "__src", "__copies", "__row", "__place")])
    assert all(r["__size"] == "__size" and r["__row"] == "__row" for r in mixing.repeat_documents(clash).collect())
    long = docs(spark, ["w " * 300_000, "w"], "t")
    assert sorted(rows(mixing.mixing_plan(long), "doc_id", "size")) == [(0, 300_000), (1, 1)]


def test_mixing_without_words(spark):
    assert rows(mixing.mixing_plan(docs(spark, ["", None])), "size", "target", "taken") == [(0, 0.0, 0)] * 2


# -- licenses


def test_licenses_against_naming_by_exact_text(spark):
    texts = ["Prose here.\n" + t + "\nMore prose." for t in ("Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.")]
    odd = [None, "", "a license to dream", "x" * 200_000 + ".\nLicensed under CC BY-SA 4.0."]
    got = {r["doc_id"]: r["license"] for r in licenses.find_licenses(docs(spark, texts + odd)).collect()}
    assert got == {0: "MIT", 1: "Apache-2.0", 2: "CC-BY-NC-4.0", 3: "GPL-3.0", 7: "CC-BY-SA-4.0"}


def plain_scan(text):
    """Licenses of a text by rule: blocks around cues, templates by the bytes they save, all their stretches by trying each."""
    spans = [m.span() for m in re.finditer(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*", text or "")]
    cues = [m.span() for m in re.finditer(licenses.CUES, text or "", re.ASCII)]
    templates = {n: [w.lower() for w in re.findall(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*", t)] for n, t in licenses.TEMPLATES.items()}
    around = max(len(t) + len(t) // 10 for t in templates.values())
    at = [(sum(b <= c[0] for _, b in spans), sum(a < c[1] for a, _ in spans)) for c in cues]
    held = []
    for first, last in at:
        low, high = max(first - around, 0), min(last + around, len(spans))
        if held and low <= held[-1][1]:
            held[-1] = [held[-1][0], max(high, held[-1][1]), held[-1][2] + [(first, last)]]
        else:
            held.append([low, high, [(first, last)]])
    size = lambda said, dictionary: len(zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(compression_level=3, write_content_size=False, write_checksum=False, write_dict_id=False), dict_data=zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None).compress(said.encode()))
    out = []
    for k, (low, high, of) in enumerate(held):
        said = [text[a:b].lower() for a, b in spans[low:high]]
        ranks = []
        for order, (name, t) in enumerate(templates.items()):
            if sum(w not in said for w in t) > len(t) // 10:
                continue
            inside = np.zeros(len(said), bool)
            for first, last in of:
                inside[max(first - low - len(t) - 2 * (len(t) // 10), 0) : last - low + len(t) + 2 * (len(t) // 10)] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(int), [0]])))
            parts = [" ".join(said[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True)]
            ranks.append((-max(size(p, "") - size(p, " ".join(t)) for p in parts), order, name, t))
        taken, met = [], []
        for _, _, name, t in sorted(ranks):
            slack, fits = len(t) // 10, []
            for a in range(len(said)):
                for b in range(a + len(t) - slack, min(a + len(t) + slack, len(said)) + 1):
                    if said[a] in t and said[b - 1] in t:
                        missing, added = lacking(said[a:b], t)
                        if missing <= slack and added <= missing + slack:
                            fits.append((missing + added, missing, a, b, added))
            mine = []
            for _, missing, a, b, added in sorted(fits):
                if all(b <= x[0] or x[1] <= a for x in mine):
                    mine.append((a, b, missing, added))
            cut = lambda a, b: " ".join(said[a:b])
            met += [(size(cut(a, b), " ".join(t)) - size(cut(a, b), ""), len(met), a, b, name, missing, added) for a, b, missing, added in mine]
        for less, _, a, b, name, missing, added in sorted(met):
            if all(b <= x[0] or x[1] <= a for x in taken):
                taken.append((a, b, name, -less, missing, added))
        out += [(k, spans[low + a][0], spans[low + b - 1][1], *rest) for a, b, *rest in sorted(taken)]
    return out


def lacking(said, template):
    """Words of the template missing from, and words added in, a stretch, by the longest common subsequence."""
    row = [0] * (len(template) + 1)
    for w in said:
        last, row = row, [0]
        for i, t in enumerate(template):
            row.append(last[i] + 1 if w == t else max(last[i + 1], row[-1]))
    return len(template) - row[-1], len(said) - row[-1]


LICENSED = [
    None,
    "",
    "no cue here",
    "Released under the MIT License. Also under CC BY-SA 4.0, all rights reserved.",
    "x " * 30 + licenses.TEMPLATES["Apache-2.0-text"] + " http://example.org " + "y " * 20,
    "Text licensed under the GNU Affero General Public License, version 3, or under the Apache License, Version 2.0.",
    licenses.TEMPLATES["MPL-2.0-header"].replace("distributed", "given") + " license " + licenses.TEMPLATES["CC0-1.0"],
    licenses.TEMPLATES["CC-BY-SA-4.0-name"] + " license " * 3 + licenses.TEMPLATES["Unlicense-text"].replace("compile", "build"),
]


def test_license_query_by_brute_force(spark):
    got = {}
    for r in licenses.find_licenses(docs(spark, LICENSED)).collect():
        got.setdefault(r["doc_id"], []).append((r["block"], r["start"], r["end"], r["license"], r["saved"], r["missing"], r["added"]))
    for i, text in enumerate(LICENSED):
        short = lambda rows: [(k, a, b, n, v, m) for k, a, b, n, v, m, _ in rows]
        assert sorted(short(got.get(i, []))) == sorted(short(plain_scan(text))), i
    clash = docs(spark, LICENSED).withColumn("license", F.lit(1)).withColumn("start", F.lit(2))
    assert licenses.find_licenses(clash).count() == sum(map(len, got.values())) and licenses.find_licenses(clash.limit(0)).count() == 0


def test_savings_choose_among_licenses_that_overlap(monkeypatch):
    whole = "Notice. " + licenses.TEMPLATES["Apache-2.0-header"] + " End. " + licenses.TEMPLATES["BSD-3-Clause-whole"] + " End. " + licenses.TEMPLATES["MIT-whole"] + " " + licenses.TEMPLATES["GPL-header"]
    names = ["Apache-2.0-header", "BSD-3-Clause-whole", "MIT-whole", "GPL-header"]
    assert [x[3] for x in licenses.scan(whole)] == names
    for name, text in licenses.TEMPLATES.items():  # each whole template is named as itself, whatever it contains
        assert [x[3] for x in licenses.scan(f"Some words before it. {text} And some more words after it.") if x[6] + x[5] == 0][0] == name, name
    monkeypatch.setattr(licenses, "saving", lambda said, name: 1)
    assert [x[3] for x in licenses.scan(whole)] != names
    rng = random.Random(3)
    monkeypatch.setattr(licenses, "saving", lambda said, name: rng.random())
    assert any([x[3] for x in licenses.scan(whole)] != names for _ in range(5))


def test_licenses_in_long_blocks_and_wrapped_or_unpunctuated_text():
    named = lambda t: [(x[3], t[x[1] : x[2]]) for x in licenses.scan(t)]
    mit = "under the MIT License"
    for t in ("Copyright (c) 2019 Jane Roe and the project contributors.\nReleased under the MIT License.", "You may use, copy and change the accompanying source files under the MIT License.", "copyright notices " * 300 + mit + " and more words" * 300):
        assert ("MIT", mit) in named(t)
    wrapped = "\n * ".join(licenses.TEMPLATES["MIT-text"].replace("merge", "fuse").split())
    assert named(f"x {wrapped} y") == [("MIT-text", wrapped[:-1])]
    assert licenses.scan(f"x {wrapped} y")[0][5:] == (1, 1)
    assert named("all rights\n# reserved") == [("Proprietary", "all rights\n# reserved")]


def test_license_alignment_against_all_stretches():
    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *_row(row, x, b)]
        return row[-1]

    def _row(row, x, b):
        left = 0
        for j, y in enumerate(b):
            left = row[j] + 1 if x == y else max(left, row[j + 1])
            yield left

    random.seed(5)
    for _ in range(300):
        said, template = (random.choices("abcde", k=random.randint(1, n)) for n in (14, 8))
        m, more = random.randint(0, 2), random.randint(0, 2)
        want = {}
        for a in range(len(said)):
            for b in range(a + 1, len(said) + 1):
                held = longest(template, said[a:b])
                missing, added = len(template) - held, b - a - held
                if held and missing <= m and added <= missing + more:
                    want[missing + added] = want.get(missing + added, 0) + 1
        got = licenses.aligned(said, template, m, more)
        assert min((x[2] + x[3] for x in got), default=None) == min(want, default=None), (said, template, m, more)
        assert all(longest(template, said[a:b]) >= len(template) - missing and b - a == len(template) - missing + added for a, b, missing, added in got)


def test_every_license_of_a_block_is_a_row(spark):
    dual = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."
    notices = ". ".join(licenses.TEMPLATES.values()) + "."
    got = licenses.find_licenses(docs(spark, [dual, notices, dual + "\n" + dual])).orderBy("doc_id", "start").collect()
    assert [(r["license"], dual[r["start"] : r["end"]]) for r in got if r["doc_id"] == 0] == [("MIT", "under the MIT License"), ("Apache-2.0", "under the Apache License, Version 2.0")]
    assert [r["license"] for r in got if r["doc_id"] == 1] == list(licenses.TEMPLATES)
    assert [r["license"] for r in got if r["doc_id"] == 2] == ["MIT", "Apache-2.0"] * 2


# -- packing


def test_encoder_gives_the_tokenizers_ids():
    fast, plain = packing.Encoder(TOKENIZER), packing.Encoder(TOKENIZER)
    assert fast.fast is not None
    plain.fast = None
    random.seed(3)
    odd = ["", " ", "a  b", "x\n y", "don't. IT'S", "<|endoftext|> x", "é́🙂.　 d", "a" * 5000]
    for text in odd + ["".join(random.choices(list("ab1. \n\t'sé中🙂!"), k=random.randint(0, 14))) for _ in range(500)]:
        assert fast(text) == plain(text), text


def test_pieces_and_packing(spark):
    texts = [None, "", "one", "word " * 2500, "word " * 1023, "word " * 1024] + [f"some text {i} " * (i % 90) for i in range(200)]
    df = docs(spark, texts).union(docs(spark, texts[:10])).withColumn("length", F.lit("x")).withColumn("offset", F.lit(1))
    tokens = packing.tokenize_documents(df, TOKENIZER)
    out = packing.pack_pieces(tokens).toPandas()
    encode = packing.Encoder(TOKENIZER)
    for doc_id, part in out[out.doc_id >= 10].groupby("doc_id"):
        part = part.sort_values("piece")
        assert b"".join(part.tokens) == encode(texts[doc_id] or "") + b"\2\0\0\0"
        assert list(part.start) == [0, *np.cumsum(part.length)[:-1]] and (part.length[1:] == 1024).all() and (part.length <= 1024).all()
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 1024
    assert len(out) == tokens.count()
    assert out.sequence_id.nunique() <= max(-(-out.length.sum() // 1024), (out.length > 512).sum()) * 1.05 + 2
    built = packing.build_sequences(packing.pack_pieces(tokens))
    assert built.agg(F.sum(F.octet_length("tokens"))).first()[0] == 4 * out.length.sum()
    assert packing.pack_pieces(packing.tokenize_documents(df.limit(0), TOKENIZER)).count() == 0


def test_packing_query_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(TOKENIZER).encode
    out = queries.op3_packing(spark, SF).toPandas()
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        part = out[out.doc_id == doc_id].sort_values("piece")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        assert list(zip(part.piece, part.start, part.length, part.ids_crc32, strict=True)) == [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 1024


def test_full_and_repeated_pieces(spark):
    data = [(1, 0, 1024)] * 40 + [(2, 0, 512)] * 60 + [(None, 0, 300)] * 30 + [(3, k, 724) for k in range(30)]
    df = spark.createDataFrame(data, "doc_id long, piece int, length long")
    out = packing.pack_pieces(df, group=7).toPandas()
    assert sorted(out.groupby("sequence_id").length.sum()) == [1024] * 100 and len(out) == len(data)
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]]


def test_fullest_is_the_best_subset():
    random.seed(1)
    for _ in range(60):
        lengths = sorted({random.randint(1, 30): random.randint(1, 3) for _ in range(4)}.items(), reverse=True)
        room = random.randint(0, 60)
        sums = {sum(k * n for (k, _), n in zip(lengths, c, strict=True)) for c in itertools.product(*[range(n + 1) for _, n in lengths])}
        got = packing.fullest(lengths, room)
        assert sum(k * n for k, n in got) == max(s for s in sums if s <= room)
        assert all(n <= dict(lengths)[k] for k, n in got)


# -- near duplicates


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_minhash_against_all_pairs(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "Two words", "two WORDS", "a b c d e"]
    for _ in range(12):
        base = random.choices(words, k=120)
        for edits in (0, 1, 2, 4, 6, 9):
            t = base[:]
            for _ in range(edits):
                t[random.randrange(len(t))] = random.choice(words)
            texts.append(" ".join(t).title() if edits == 1 else " ".join(t))
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, linked)
    clash = docs(spark, texts).withColumn("component", F.lit("x")).withColumn("node", F.lit(1)).withColumn("bits", F.lit(None))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(clash).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) and r["n_shingles"] == len(sets[i]) for i, r in got.items())


def test_minhash_large_groups_repeats_and_nulls(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    texts = []
    for _ in range(150):
        t = base[:]
        for _ in range(rng.randrange(12)):
            t[rng.randrange(200)] = f"x{rng.randrange(900)}"
        texts.append(" ".join(t))
    sets = {i: set(minhash.shingles(t).tolist()) for i, t in enumerate(texts)}
    want = components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    df = docs(spark, texts)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == want
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(rows(minhash.near_duplicates(odd), "doc_id", "component_id", "kept"), key=str)
    assert got == sorted([(None, None, True), (3, 3, True), (3, 3, True), (None, None, True)], key=str)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_rows_that_share_an_id_are_looked_at_on_their_own(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a), (4, ""), (4, "x y")], "doc_id long, text string")
    found = {(r["doc_id"], r["text_key"]): r for r in minhash.components(df).collect()}
    key = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert {k: r["component_id"] for k, r in found.items()} == {(1, key(a)): 1, (1, key(b)): 1, (2, key(b)): 1, (3, key(a)): 1, (4, key("")): 4, (4, key("x y")): 4}
    assert found[1, key(a)]["component"] == found[3, key(a)]["component"] != found[2, key(b)]["component"] == found[1, key(b)]["component"]


def test_blocks_of_a_bucket_meet_once_and_under_many_keys(spark):
    # 5,000 members of one bucket: a component of 400, one of 130, and 4,470 on their own
    part = lambda n: 0 if n < 400 else 400 if n < 530 else n
    data = [(9, n, part(n)) for n in range(5000)]
    met = minhash._block_pairs(spark.createDataFrame(data, "band long, node long, component long"), "node", "component")
    sizes = [(len(r["node1"]), len(r["node2"]), sum(a != b for a in r["component1"] for b in r["component2"]), r["node1"][0] == r["node2"][0]) for r in met.collect()]
    across = sum(n if not same else n // 2 for _, _, n, same in sizes)
    assert across == (5000 * 5000 - 400 * 400 - 130 * 130 - 4470) // 2
    assert max(max(x[:2]) for x in sizes) < 3 * minhash.BLOCK


def test_estimates_follow_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.9):
        n = int(2000 * share)
        a, b = np.unique(pool[:2000]), np.unique(np.concatenate([pool[:n], pool[2000 : 4000 - n]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (np.frombuffer(minhash.packed(minhash.minima(s)), np.uint8)[None] for s in (a, b))
        assert abs(minhash.estimates(x, y)[0] - true) < 0.15


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    data = []
    for label in (0, 1, None):
        centres = rng.normal(size=(6, 16))
        for k in range(90):
            v = centres[k % 6] + 0.08 * rng.normal(size=16)
            data.append((len(data), [float(x) for x in v], label))
    data += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [1.0, None], 0), (1003, [float("nan")] * 16, 0), (1004, [1.0, 2.0], 0), (1005, [2.0, 4.0], 0), (1006, data[0][1], 0), (1007, data[0][1], 0), (1008, [], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("size", F.lit("x")).withColumn("links", F.lit(0))
    good = {i: (np.array(v) / np.linalg.norm(v), x) for i, v, x in data if x is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    linked = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= 0.98]
    want = components([i for i, *_ in data], linked)
    degree = {i: sum(i in p for p in linked) for i in want}
    for tile, square in ((512, 16), (4, 2)):
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, tile=tile, square=square).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert {i: r["n_links"] for i, r in got.items()} == degree
        assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


# -- language


def test_language_on_held_out_rows(spark):
    # sf0.01 has 1,000 documents; the smoke size is too small to judge by
    out = queries.op5_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 250 and right > 0.97
    assert out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_language_odd_cases(spark):
    data = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", None), (None, "en"), ("", "de"), ("123 !!", "fr"), ("the the cat", "en"), ("der der hund", "de")] * 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("key", F.lit(1)).withColumn("later", F.lit("z"))
    model = langid.fit(df)
    assert model.languages == ["de", "en"]
    got = {r["text"]: r["language"] for r in langid.identify(df, model).collect()}
    assert got["the cat and the dog"]["lang"] == "en" and got["der hund und die katze"]["lang"] == "de"
    assert all(got[t] == ("und", 0.0) for t in (None, "", "123 !!"))
    none = langid.fit(df.limit(0))
    assert rows(langid.identify(df, none), "language.lang") == [("und",)] * len(data)
    one = langid.fit(df.filter("lang = 'en'"))
    assert one.predict("anything") == ("en", 1.0)
    assert langid.letters("Äb, 1c") is not None and langid.features("x" * 100_000).sum() > 100_000


# -- WARC


def test_warc_round_trip_and_revisits(spark):
    big, other = "<p>" + "x" * 2000, "<q>" + "é" * 700
    data = [(1, "http://a/ b\n", big), (5, None, big), (3, "u", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", other), (7, "u", other), (None, "u", big), (8, "u", "")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("z")).withColumn("payload", F.lit(1))
    for size, shard in ((1 << 25, None), (300, 2500)):
        place = new_path(spark, "test-warc")
        manifest = warc.write_archives(df, place, file_bytes=size, shard_bytes=shard)
        assert manifest.agg(F.sum("records")).first()[0] == len(data)
        got = warc.read_archives(spark, place).collect()
        want = [(str(i) if i is not None else None, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in data]
        key = lambda t: (t[0] or "", *t[1:])
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got), key=key) == sorted(want, key=key)
        kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()}
        assert kinds == {("1", "revisit", "5"), ("3", "revisit", "5"), ("5", "response", None), (None, "response", None)}
        assert sorted(r["record_type"] for r in got if r["page_id"] == "7") == ["response", "revisit"]
        assert all(r["payload"] in (b"", big.encode(), b"small", other.encode()) for r in got)
    place = new_path(spark, "test-warc")
    warc.write_archives(df.limit(0), place)
    assert warc.read_archives(spark, place).count() == 0


def test_warc_files_follow_from_the_rows_alone(spark):
    rng = random.Random(3)
    data = [(i if i % 3 else 7, f"http://a/{i}", f"<p>{rng.randrange(900)} " + "x" * rng.randrange(1800)) for i in range(3000)]
    data += [(None, "u", f"{i}" * 300) for i in range(50)]
    seen, kept = set(), spark.conf.get("spark.sql.shuffle.partitions")
    for parts, deal in ((1, "4"), (7, "13"), (5, "2")):
        spark.conf.set("spark.sql.shuffle.partitions", deal)
        rng.shuffle(data)
        df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(parts)
        manifest = warc.write_archives(df, new_path(spark, "test-warc"), file_bytes=20_000, shard_bytes=100_000)
        seen.add(tuple(sorted((r["final"], r["records"], r["bytes"], r["sha1"]) for r in manifest.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(seen) == 1 and len(next(iter(seen))) > 20
    texts = spark.createDataFrame([("b", "u", "1"), ("a", "u", "2"), (None, None, "3")], "page_id string, url string, html string")
    place = new_path(spark, "test-warc")
    warc.write_archives(texts, place, shard_bytes=1)
    assert sorted(rows(warc.read_archives(spark, place), "page_id", "payload"), key=str) == sorted([("a", b"2"), ("b", b"1"), (None, b"3")], key=str)


# -- media


def by_hand(block):
    """Samples of one block of 64 coefficients in row order, by the defining sum."""
    scale = lambda k: np.sqrt(0.5) if k == 0 else 1.0
    out = np.zeros((8, 8))
    for y, x in itertools.product(range(8), repeat=2):
        out[y, x] = sum(scale(u) * scale(v) / 4 * block[v][u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u, v in itertools.product(range(8), repeat=2))
    return np.clip(np.rint(out + 128), 0, 255)


def test_frames_with_other_tables_and_the_transform():
    zigzag = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
    dc, ac = {0: "00", 3: "01", 6: "100"}, {0x00: "00", 0x03: "01", 0xF0: "100", 0x25: "1010"}
    bits = lambda v, n: f"{v if v > 0 else v + (1 << n) - 1:0{n}b}"
    # two blocks: DC 40 and then 40 + 5; values behind runs of zeros, and an end of block
    code = dc[6] + bits(40, 6) + ac[0x03] + bits(-6, 3) + ac[0xF0] + ac[0x25] + bits(19, 5) + ac[0x00] + dc[3] + bits(5, 3) + ac[0x00]
    code += "1" * (-len(code) % 8)
    body = bytes(int(code[i : i + 8], 2) for i in range(0, len(code), 8)).replace(b"\xff", b"\xff\0")
    table = lambda kind, t: bytes([kind, *[sum(len(c) == n for c in t.values()) for n in range(1, 17)], *t])
    part = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    quant = bytes([0, *range(1, 65)])
    head = b"\xff\xd8" + part(0xDB, quant) + part(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0])) + part(0xC4, table(0, dc) + table(16, ac)) + part(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    got = media.coefficients(head + body + b"\xff\xd9")
    want = np.zeros((2, 64), int)
    want[0, [0, 1, 20]], want[1, 0] = [40, -6, 19], 45
    assert (got == want).all()
    quantisers = media.parse_frame(head + body + b"\xff\xd9").quantisers
    for block, out in zip(got, media.samples(got, quantisers), strict=True):
        square = np.zeros(64)
        square[zigzag] = block * quantisers
        assert np.abs(by_hand(square.reshape(8, 8)) - out.reshape(8, 8)).max() <= 1
    # the frames that the writer makes, symbol by symbol, hold the bytes
    random.seed(2)
    x = random.randbytes(2048)
    blocks = np.concatenate([media.coefficients(f) for f in media.frames_of(media.encode(x))[0]])
    assert np.where(blocks < 0, blocks + 255, blocks).astype(np.uint8).tobytes() == x
    assert (media.samples(blocks, np.ones(64, int)) == media.decode(media.encode(x))[1]).all()


def test_media_round_trip():
    random.seed(7)
    for n in (64, 128, 1024, 1088, 4096, 20032):
        for x in (random.randbytes(n), b"\xff" * n, b"\0" * n):
            assert media.decode(media.encode(x))[0] == x
    assert media.encode(b"a" * 64)[:4] == b"RIFF"
    with pytest.raises(ValueError):
        media.decode(b"RIFF0000WAVE")


def test_media_columns(spark):
    texts = [None, "", "é" * 700, "a" * 64, "x" * 5000 + "日本" * 3000, "x" * 5000 + "日本" * 3000]
    df = docs(spark, texts).withColumn("frames", F.lit(1)).withColumn("clips", F.lit(2))
    got = {r["doc_id"]: r for r in media.read_media(media.store_media(df)).collect()}
    for i, t in enumerate(texts):
        payload, n = media.padded(t)
        r = got[i]["read"]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(payload) % 64 == 0 and len(payload) >= max(64, n)
        assert r["media_sha256"] == hashlib.sha256(got[i]["media"]).hexdigest()
        assert r["clips"][0]["start_ms"] == 0 and r["clips"][-1]["end_ms"] == r["frames"] * 40
    assert got[4]["read"] == got[5]["read"] and len(got[4]["read"]["clips"]) >= 2
    assert media.read_media(media.store_media(df.limit(0))).count() == 0
    assert media.clip_rows(media.read_media(media.store_media(df)), "doc_id").count() == sum(len(r["read"]["clips"]) for r in got.values())


# -- secrets


def entropy(text):
    counts = {c: text.count(c) for c in set(text)}
    return -sum(n / len(text) * np.log2(n / len(text)) for n in counts.values())


def test_windows_against_full_counts():
    random.seed(11)
    for _ in range(200):
        text = "".join(random.choices("abcdef0123456789" * random.randint(1, 2) + "zzzzzz", k=random.randint(1, 60)))
        covered = set()
        for i in range(len(text) - 15):
            if entropy(text[i : i + 16]) >= 3.0 - 1e-12:
                covered |= set(range(i, i + 16))
        assert set().union(*[set(range(a, b)) for a, b in secrets.windows(text, 16, 3.0)], set()) == covered


def test_secret_patterns(spark):
    key, hexa = "AKIA" + "B2" * 8, "0123456789abcdef" * 2
    texts = [None, "", f"é token = '{hexa}' x", f"PassWD:{hexa[:11]}", key, "AKIA123", "secret=mytoken:abcdefghijklmnop", "id 123e4567-e89b-12d3-a456-426614174000", "plain-words-and-more-words-joined-together", "x" * 50_000 + " " + hexa]
    for t in texts:
        found = secrets.scan(t)
        want = [("assign", *m.span()) for m in secrets.ASSIGN.finditer(t or "") if len(m[2]) >= 12] + [("access", *m.span()) for m in secrets.ACCESS.finditer(t or "") if len(m[0]) >= 18] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16]
        assert sorted(s for s in found if s[0] != "entropy") == sorted(want)
        assert found == sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2]))
    assert [s[0] for s in secrets.scan(texts[6])] == [] and secrets.scan(texts[7]) == [] and secrets.scan(texts[8]) == []
    assert secrets.mask(f"a {key} b") == "a [SECRET] b" and secrets.mask(None) is None and secrets.mask("clean") == "clean"
    df = docs(spark, texts).withColumn("kind", F.lit(1)).withColumn("spans", F.lit(2))
    assert rows(secrets.mask_secrets(df).filter("doc_id IN (0, 1, 7)"), "text") == [(None,), ("",), (texts[7],)]
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_words_are_allowed_and_random_letters_are_not():
    random.seed(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = ["".join(random.sample(letters, 32)) for _ in range(200)]
    assert all([s for s in secrets.scan(f"the key {k} here") if s[0] == "entropy"] for k in keys)
    for words in ("thisNameStandsForSomethingQuiteLongIndeed", "donaudampfschifffahrtsgesellschaftskapitaen", "some/path/to-a_file=with+parts", "SHOUTING_WORDS_IN_A_VERY_LONG_ROW"):
        assert secrets.scan(f"a {words} b") == []
    assert secrets.scan("w" * 200_000 + "1") == []


def base_by_hand(text):
    """Base spans without regular expressions: tries each start in turn and takes the longest run of allowed characters."""
    low, out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text), []
    letters = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    at = 0
    while at < len(text):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, at):
                break
        else:
            at += 1
            continue
        end = at + len(word)
        end += text[end : end + 1] in ("'", '"') and end < len(text)
        while text[end : end + 1] == " ":
            end += 1
        if text[end : end + 1] not in (":", "="):
            at += 1
            continue
        end += 1
        while text[end : end + 1] == " ":
            end += 1
        end += text[end : end + 1] in ("'", '"') and end < len(text)
        first = end
        while end < len(text) and text[end] in letters:
            end += 1
        if end == first:
            at += 1
            continue
        if end - first >= 12:
            out.append(("assign", at, end))
        at = end
    for kind, head, allowed, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18), ("hex", "", "0123456789abcdef", 16)):
        at = 0
        while at < len(text):
            end = at + len(head)
            while text.startswith(head, at) and end < len(text) and text[end] in allowed:
                end += 1
            if not text.startswith(head, at) or end == at + len(head):
                at += 1
                continue
            if end - at >= least:
                out.append((kind, at, end))
            at = end
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_secrets(spark, SF).collect():
        base = base_by_hand(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    random.seed(12)
    pieces = ["token", "PassWd", "api_key", "apikey", "secret", "'", '"', " ", ":", "=", "AKIA", "B2", "abcdef0123456789", "é", "x", "=="]
    for _ in range(400):
        text = "".join(random.choices(pieces, k=random.randint(1, 14)))
        assert [s for s in secrets.scan(text) if s[0] != "entropy"] == base_by_hand(text), text


def test_secret_query_digests(spark):
    for r in queries.op9_secrets(spark, SF).collect():
        base = [s for s in r["spans"].split(",") if s and not s.startswith("entropy")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))


# -- chat


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\ <|end|> \\\\<s> <<SYS>>x<</SYS>>", None, "", "é🙂 <|turn|>user<|text|>", "z" * 3000]
    data = [(c, t, r, said[(c or 0) + t]) for c in (0, 1, None) for t, r in enumerate(["system", "user", "assistant", "assistant", None])]
    data += [(1, 1, "user", "tie"), (1, 1, "user", "tie")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x")).withColumn("mask", F.lit(1))
    for size in (1_000_000, 40):
        got = {r["conv_id"]: r for r in chat.digest_parts(chat.format_turns(chat.canonical_turns(df), size)).collect()}
        assert set(got) == {0, 1, None}
        for c, r in got.items():
            own = sorted((x for x in data if x[0] == c), key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
            loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
            assert r["n_turns"] == len(own)
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
            assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest_parts(chat.format_turns(chat.canonical_turns(df.limit(0)))).count() == 0


def test_chat_query_against_rows(spark):
    data = spark.read.parquet(f"{SF}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    got = queries.op10_chat(spark, SF).toPandas().set_index("conv_id")
    assert len(got) == data.conv_id.nunique() + 1 and got.loc[-1, "n_turns"] == 2 and got.loc[-1, "loss_chars"] == 21
    for conv, part in data.groupby("conv_id"):
        said = "".join(f"{r}\n{t or ''}\n" for r, t in zip(part.role, part.text, strict=True))
        assert got.loc[conv, "turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_chat_layouts(spark):
    messages = spark.sql("SELECT 1L AS conv_id, array(named_struct('role', 'user', 'content', 'hi'), named_struct('role', 'assistant', 'content', 'ho')) AS messages, 'x' AS other")
    assert rows(chat.canonical_turns(messages), "turn", "role", "text") == [(0, "user", "hi"), (1, "assistant", "ho")]
    instruction = spark.sql("SELECT 2L AS conv_id, 'do' AS instruction, '' AS input, 'done' AS output")
    assert rows(chat.canonical_turns(instruction), "turn", "role", "text") == [(0, "user", "do"), (1, "assistant", "done")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))
    records = [json.dumps({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 1}), json.dumps({"prompt": "p", "completion": "c"}), "broken", None, json.dumps({"what": 1})]
    df = spark.createDataFrame(list(enumerate(records)), "id long, record string")
    wrapped = spark.sql("SELECT 3L AS conv_id, named_struct('messages', array(named_struct('role', 'user', 'content', 'a'))) AS data, 'x' AS license")
    assert rows(chat.canonical_turns(wrapped), "turn", "role", "text") == [(0, "user", "a")]
    several = spark.sql("SELECT 4L AS conv_id, 's' AS system, 'p' AS prompt, 'r' AS response, 't' AS text")
    assert rows(chat.canonical_turns(several), "role", "text") == [("system", "s"), ("user", "p"), ("assistant", "r")]
    assert chat.layout_of(frozenset({"record.prompt", "record.completion", "id"}))["name"] == "prompt and completion" and chat.layout_of(frozenset({"id"})) is None
    assert sorted(rows(chat.canonical_turns_json(df, "id", "record"), "conv_id", "role", "text")) == [(0, "assistant", "b"), (0, "user", "a"), (1, "assistant", "c"), (1, "user", "p")]


def test_chat_records_of_odd_values(spark):
    deep = "[" * 200_000 + "]" * 200_000
    rows = [
        '{"messages": [{"role": "user", "content": 5}]}',
        '{"messages": [{"role": "user", "content": "a"}, {"role": "gpt", "content": [{"type": "text", "text": "b"}, "c"]}]}',
        '{"messages": [{"role": ["u"], "content": "d"}]}',
        deep,
        '{"messages": ' + deep + "}",
        '{"prompt": {"x": [1, null]}, "response": false}',
        '{"messages": {"role": "user", "content": "e"}}',
        '{"messages": [{"role": null, "content": null}, 7]}',
        "7",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "conv_id long, record string")
    got = {}
    for r in chat.canonical_turns_json(df, "conv_id", "record").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got[0] == [("user", "5")] and got[1] == [("user", "a"), ("assistant", "b\nc")] and got[2] == [("u", "d")]
    assert 3 not in got and 4 not in got and 8 not in got and 9 not in got and got.get(7, []) == [(None, None)]
    digests = chat.digest_parts(chat.format_turns(chat.canonical_turns_json(df, "conv_id", "record")))
    assert digests.count() == len(got)


def test_layouts_are_chosen_by_their_longest_paths():
    for layout in chat.LAYOUTS:
        assert chat.layout_of(frozenset(layout["paths"] + ["id", "meta.x"]))["name"] == layout["name"]
    every = frozenset(p for x in chat.LAYOUTS for p in x["paths"])
    assert len(chat.layout_of(every)["paths"]) == max(len(x["paths"]) for x in chat.LAYOUTS) and chat.layout_of(frozenset(["z"])) is None


def test_chat_long_texts(spark):
    long = "word </s> " * 120_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "x"), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    got = chat.digest_parts(chat.format_turns(chat.canonical_turns(df))).first()
    assert got["n_turns"] == 3 and got["loss_chars"] == len(long) + 1 and got["loss_sha256"] == hashlib.sha256((long + "x").encode()).hexdigest()


def test_warc_long_payloads(spark, tmp_path):
    html = ["<p>" + "é" * 3_000_000, None, "<p>" + "é" * 3_000_000]
    df = spark.createDataFrame([(i, f"http://a.org/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    got = {int(r["page_id"]): r for r in warc.read_archives(spark, str(tmp_path / "w"), payloads=False).collect()}
    assert got[0]["payload_bytes"] == 6_000_003 and got[0]["record_type"] == "revisit" and int(got[0]["refers_to"]) == 2 and got[1]["payload_bytes"] == 0


def test_embeddings_that_share_an_id(spark):
    rows = [(1, "a", [1.0, 0.0]), (1, "a", [0.0, 1.0]), (2, "a", [1.0, 0.01]), (3, "b", [1.0, 0.0]), (3, "c", [1.0, 0.0]), (4, "c", [1.0, 0.0]), (5, "a", [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (3, 1, 3), (4, 1, 3), (5, 0, 5)]


# -- urls


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_url_parts_and_rules(spark):
    rows = [
        ("http://A.ORG/x?y", "a.org", "/x", "org/", "allow"), ("https://sub.Example.org/es/1#t", "sub.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("http://org?/x", "org", "", None, "allow"),
        ("x://notorg/", "notorg", "/", None, "allow"), ("http://b.com/fr/://q", "b.com", "/fr/://q", "com/fr/", "allow"), ("http://b.com/de/", "b.com", "/de/", "com/de/", "block"), ("b.com/de/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("://", "", "", None, "allow"),
        ("http://É.COM/fr", "É.com", "/fr", None, "allow"), ("http://a\nb.org/\n", "a\nb.org", "/\n", "org/", "allow"),
    ]
    df = pages_of(spark, [(r[0], None) for r in rows]).withColumn("host", F.lit(1)).withColumn("trust", F.lit("x"))
    got = {r["page_id"]: r for r in urlfilter.filter_urls(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(rows):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (rule is None or r["verdict"] == verdict), rows[i]
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


def link(*hosts):
    return "".join(f'<a HREF="http://{h}/p">x</a>' for h in hosts) + '<a href="/own">y</a>'


def test_reputation_follows_links_by_brute_force(spark):
    rng = random.Random(5)
    hosts = [f"h{i}.net" for i in range(12)] + ["good.org", "x.bad.com", "10.0.0.1"]
    rows = []
    for h in hosts:
        for _ in range(rng.randrange(1, 4)):
            to = [rng.choice(hosts) for _ in range(rng.randrange(0, 5))]
            rows.append((f"http://{h}/" + ("de/" if "bad" in h else "q"), link(*to) + f"<img src='//{rng.choice(hosts).upper()}/i.png'>" if rng.random() < 0.8 else None))
    rows += [("http://h3.net/q", link("good.org", "h1.net"))] * 3
    df = pages_of(spark, rows)
    got = urlfilter.filter_urls(df).toPandas()
    weights = {}
    for u, html in rows:
        src = u.split("/")[2].lower()
        for dst in re.findall(r"(?i)(?:href|src)\s*=\s*[\"']?(?:http:)?//([^/\"']+)", html or ""):
            if dst.lower() != src:
                weights[src, dst.lower()] = weights.get((src, dst.lower()), 0) + 1
    for a, b in (("x.bad.com", "bad.com"), ("bad.com", "x.bad.com")):
        weights[a, b] = weights.get((a, b), 0) + 1
    for name, flip, seed in (("trust", False, "allow"), ("distrust", True, "block")):
        edges = {((b, a) if flip else (a, b)): w for (a, b), w in weights.items()}
        mass = {}
        for r in got.itertuples():
            if r.rule is not None and r.verdict == seed:
                mass[r.host] = mass.get(r.host, 0) + urlfilter.UNIT
        total = dict(mass)
        for _ in range(urlfilter.ROUNDS):
            now = {}
            for (a, b), w in edges.items():
                if a in mass:
                    now[b] = now.get(b, 0) + mass[a] * urlfilter.DAMPING * w // (100 * sum(v for (x, _), v in edges.items() if x == a))
            mass = now
            for h, m in mass.items():
                total[h] = total.get(h, 0) + m
        assert {r.host: getattr(r, name) for r in got.itertuples()} == {h: total.get(h, 0) for h in set(got.host)}
    free = got[got.rule.isna()]
    assert ((free.verdict == "block") == (free.distrust > free.trust)).all() and len(got) == len(rows)
    plan = urlfilter.filter_urls(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# -- spelling variants


def test_letter_values_tell_pairs_apart():
    letters = [0, *range(97, 123), *range(65, 91), *range(192, 256)]
    sums = {}
    for a, b in itertools.combinations_with_replacement(letters, 2):
        assert sums.setdefault(a**5 + b**5, (a, b)) == (a, b)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in words.items():
        close = sorted((-m, v) for v, m in words.items() if near(w, v))
        out[w] = [None, w, n, len(close), None]
        if close and -close[0][0] >= 10 * n:
            out[w][0], out[w][4] = close[0][1], -close[0][0]
    for v in out.values():
        while out[v[1]][0] is not None:
            v[1] = out[v[1]][0]
    return {w: tuple(v) for w, v in out.items()}


def test_spelling_variants_by_brute_force(spark):
    rng = random.Random(7)
    base = ["alphabet", "alphabets", "Alphabet", "alphaßeta", "ÀLPHABET", "aaaaaaa", "aaaaaaaa", "aaaaaaaab", "listens", "tinsels", "silents", "commit", "commits", "übergabe"]
    texts = []
    for _ in range(60):
        said = [rng.choice(base) for _ in range(40)]
        for k, w in enumerate(said):
            if rng.random() < 0.1:
                i = rng.randrange(len(w))
                said[k] = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abz") + w[i:], w[:i] + rng.choice("abz") + w[i + 1 :]])
        texts.append(" ".join(said))
    texts += ["commits " * 300, "commitz " * 25, "commixz commixz", None, "", "12 34", "q" * 60_000 + " " + "q" * 60_000, "q" * 59_999 + " and " + "q" * 59_999]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(df).collect()}
    assert got == plain_variants(rows)
    assert got["commixz"][:2] == ("commitz", "commits") if "commixz" in got else True
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w4")], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.last_forms(forms).collect()} == dict.fromkeys([f"w{i}" for i in range(11)] + ["x"], "w11")


def test_no_table_that_grows_with_the_words_is_broadcast(spark):
    words = spark.range(2000).select(F.concat(F.lit("word"), F.translate(F.format_string("%05d", "id"), "0123456789", "abcdefghij")).alias("word"), F.lit(2).cast("long").alias("n"))
    docs = words.select(F.monotonically_increasing_id().alias("doc_id"), F.concat_ws(" ", "word", "word").alias("text"))
    for df in (spelling.near_words(words), spelling.spelling_variants(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


# -- resampling


def plain_resample(rows, target):
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    features = lambda w: [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]
    s, t = np.zeros(10000), np.zeros(10000)
    for _, text in rows:
        np.add.at(s, features(words(text)), 1)
    for text in target:
        np.add.at(t, features(words(text)), 1)
    gain = [int(np.floor(1000 * np.log((b + 1) * (s.sum() + 10000) / ((a + 1) * (t.sum() + 10000))))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc_id, text in rows:
        w = words(text)
        f = features(w)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + int(np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296.0)))), len(w)])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = [tuple(r[:4]) for r in fit[: 25 * len(fit) // 100]]
    return sorted(map(str, (tuple(r[:4]) for r in out))), drawn


def test_resampling_by_brute_force(spark):
    rng = random.Random(11)
    kinds = ["alpha beta gamma délta".split(), "one two three 4 five".split(), "Zed-YET x9 ñandú".split()]
    rows = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    rows += [(7, rows[7][1])] * 40 + [(None, "alpha beta " * 30), (None, "alpha beta " * 30), (9, None), (10, ""), (-(2**62), "one " * 25), (2**62, "one two " * 25), (5, "w " * 400_000), (-3, "- . !")]
    target = ["alpha beta gamma", None, "alpha alpha 4", ""]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, rank int, score string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    all_, drawn = plain_resample(rows, target)
    for parts in (1, 5):
        got = resampling.importance_resample(df.repartition(parts), goal).collect()
        assert sorted(str((r["doc_id"], r["n_features"], r["weight"], r["score"])) for r in got) == all_
        ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
        assert [(r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in ranked] == drawn
    assert resampling.importance_resample(df.limit(0), goal).count() == 0
    alone = resampling.importance_resample(df.filter("doc_id = 10 AND text = ''"), goal.limit(0)).collect()
    assert [(r["n_features"], r["weight"], r["rank"]) for r in alone] == [(0, 0, None)]


def test_radix_selection_finds_every_rank(spark):
    rng = random.Random(13)
    rows = [(rng.choice([-5, 3, 3, 2**62, -(2**63), 2**63 - 1]), rng.randrange(-4, 4)) for _ in range(150)]
    df = spark.createDataFrame(rows, "a long, b long")
    order = sorted(rows)
    for k in (1, 2, 50, 75, 149, 150):
        key = resampling.kth_key(df, ["a", "b"], k, bits=3)
        kept = df.filter(resampling.up_to(["a", "b"], key)).count()
        assert kept == sum(r <= order[k - 1] for r in order), k
