"""Each operator against brute force: on the smallest tables and on a fixture of awkward rows."""

import collections
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard

from matchloom.llm import bpe_dp, exact_dedup, licenses, line_dedup, packing, quality, queries, simhash, substring_dedup, suffix_dedup, token_counts, wordtokens
from matchloom.llm.cluster import materialize, row_hash
from matchloom.llm.components import connected_components

TOKENIZER = queries.vocabulary()
SCHEMA = "doc_id long, text string, lang string, n long, kept boolean, gone string, row string, fp long, rh long, d long"
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly box five jugs of liquor in the old barn"


def awkward() -> list[tuple]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = ". ".join(line(9).capitalize() for _ in range(7)) + "."
    texts = [
        None, "", " \n\t ", "one", "two words", PROSE, PROSE.upper(), PROSE + " now", PROSE + "\n" + PROSE, "ab " * 3000, "x" * 5000,
        *(line(90) + f" {passage} " + line(60) for _ in range(6)), *(line(120) + "\n" + line(40) for _ in range(4)),
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.\nunder the mit license under the MIT license",
        "Das Mädchen ißt Äpfel. " * 30, "a<|endoftext|>bK İstanbul ΣΑΣ", "naïve café\x00zero sep", line(6000) + "\n" + line(3000),
        "under the miK license the Kit",
    ]
    base = line(200)
    for i in range(6):
        w = base.split()
        w[20 * i + 3] = "changed"
        texts.append(" ".join(w))
    rows = [(i, t, "en", i, True, "g", "r", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [(3, "one", None, None, None, None, None, None, None, None), (7, PROSE, "x", 1, True, "g", "r", 1, 2, 3), (None, PROSE, "y", 1, True, "g", "r", 1, 2, 3), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def tables(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    return {"real": real, "odd": odd, "empty": odd.limit(0)}


@pytest.fixture(params=["real", "odd", "empty"])
def docs(request, tables):
    return tables[request.param]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def same(found, expected):
    assert collections.Counter(found) == collections.Counter(expected)


def ascii_lower(t):
    return (t or "").encode().lower()


def test_license_scan(docs):
    out = []
    for i, t in texts_of(docs):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
        found = {"mit": b"under the mit license", "apache-2": b"apache license version 2", "cc-by-nc": b"cc by nc"}
        at = [(k, j) for k, p in found.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        starts = [j for _, j in at]
        out.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for k, _ in at}))))
    got = licenses.scan_licenses(docs)
    same(rows_of(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")), out)
    for r in got.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert (r["score"] > 0) == bool(r["labels"]) and 0 <= r["score"] <= 1


def test_license_index_with_many_templates(spark, sf):
    """500 templates of which the texts hold some: the same places as by search, and work that follows the hits."""
    rng = random.Random(12)
    words = [f"term{i}" for i in range(300)] + ["the", "of", "under", "license"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(6, 14))) for _ in range(500)]
    templates = tuple(licenses.template(f"t{i}", t, " ".join(t.split()[1:5])) for i, t in enumerate(made))
    texts = []
    for i in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(20))]
        for t in rng.sample(made, i % 4):
            w = t.split()
            if i % 3 == 0:
                w[-1] = "damaged"
            parts += [" ".join(w), " ".join(rng.choice(words) for _ in range(5))]
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(df, templates).collect()}
    for i, text in enumerate(texts):
        w, found, best = text.split(), set(), 0.0
        for t in templates:
            n = t.stop - t.start
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) == t.words[t.start : t.stop]]
            if at:
                found.add(t.label)
                hit = {j for k in at for j, x in enumerate(t.words) if 0 <= k + j - t.start < len(w) and w[k + j - t.start] == x}
                best = max(best, len(hit | set(range(t.start, t.stop))) / len(t.words))
        assert got[i] == (",".join(sorted(found)), pytest.approx(best, abs=1e-6))
    assert any(0 < score < 1 for _, score in got.values())


def test_quality(docs):
    out = []
    for i, t in texts_of(docs):
        b = (t or "").encode()
        w, lines, win = b.split(), [x for x in b.split(b"\n") if x.split()], collections.Counter()
        for j in range(len(w) - 2):
            win[tuple(w[j : j + 3])] += 1
        hit = {k for j in range(len(w) - 2) if win[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        dups = sum(x in lines[:k] for k, x in enumerate(lines))
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x)) if x else 0.0
        low, high = [(0.0, 6.0), (1.05, 6.5), (1.15, 7.0), (1.2, 8.0), (1.25, 10.0)][sum(len(b) >= n for n in (300, 1000, 4000, 32000))]
        chunks = [b[k : k + 4096] for k in range(0, len(b) - 4095, 4096)] + ([b[-4096:]] if len(b) > 4096 and len(b) % 4096 else [])
        outside = sum(not 1.1 <= ratio(x) <= 8 for x in chunks)
        kept = not failed and low <= ratio(b) <= high and 8 * outside <= len(chunks)
        out.append((i, len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), dups, len(hit), failed, len(chunks), outside, kept))
    got = quality.rate_quality(docs)
    same(rows_of(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_chunks", "n_chunks_outside", "kept")), out)
    assert not got.where("kept AND base_failed").count()
    kept = quality.rate_quality(docs, keep_columns=True)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()


def test_quality_bands():
    rate = quality.Rater(quality.WHOLE, quality.CHUNK, quality.CHUNK_BAND, 3)
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000))
    assert rate(prose.encode())[3] and not rate(("spam " * 3000).encode())[3] and not rate(rng.randbytes(9000))[3]
    half = prose[:9000].encode() + b"again " * 3000
    assert not rate(half)[3]
    tail = prose.encode()[:8192] + b"\0" * 4000  # no full chunk of it
    assert not rate(tail)[3]


def test_exact_dedup(docs):
    rows = texts_of(docs)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[ascii_lower(t)].append(i)
    best = {k: max((x for x in v if x is not None), default=None) for k, v in groups.items()}
    expected = [(i, best[k], len(groups[k]), i == best[k], hashlib.sha256(k).hexdigest()) for i, t in rows for k in [ascii_lower(t)]]
    same(rows_of(exact_dedup.exact_dedup(docs, buckets=4)), expected)


def test_exact_index_persists(spark, tmp_path):
    first = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "B"), (10, "c"), (11, "C")], "doc_id long, text string")
    exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4).add(first).collect()
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)  # opened anew
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.add(second).collect()}
    assert got == {9: (3, False), 10: (11, False), 11: (11, True)}
    assert index.rows().count() == 3
    plan = index.new_groups(exact_dedup.digests(second))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_exact_index_adds_a_batch_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b"), (4, None), (5, "")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    # As after a crash that left a part of the batch in the index.
    index.append(index.new_groups(exact_dedup.digests(docs)).where("keep_id = 2"), "monday")
    expected = {1: (2, False), 2: (2, True), 3: (3, True), 4: (5, False), 5: (5, True)}
    for _ in range(2):
        assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.add(docs, "monday").collect()} == expected
    assert index.rows().count() == 3
    assert not any(r["kept"] for r in index.add(docs, "tuesday").collect())


def test_packing(docs):
    limit = 512
    got = packing.pack(docs, TOKENIZER, tokens=limit).collect()
    lib = wordtokens.library(TOKENIZER)
    expected = []
    for i, t in texts_of(docs):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        for k in range(0, len(ids), 4 * limit):
            expected.append((i, k // (4 * limit), k // 4, len(ids[k : k + 4 * limit]) // 4, zlib.crc32(ids[k : k + 4 * limit])))
    same([tuple(r)[:5] for r in got], expected)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    total = sum(e[3] for e in expected)
    assert max(map(len, bins.values()), default=0) <= packing.DOCUMENTS
    rooms = []  # best-fit decreasing, one piece after the other
    for n in sorted((e[3] for e in expected), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(limit - n)
    assert -(-total // limit) <= len(bins) <= len(rooms)


def test_packing_under_every_capacity(docs, monkeypatch):
    """Sequences hold few documents and a bounded cost, over ranges that are listed in parts."""
    monkeypatch.setattr(packing, "BLOCK", 2)
    monkeypatch.setattr(packing, "FAR", 4)
    for rule in ("residual", "dot"):
        bins = collections.defaultdict(list)
        for r in packing.pack(docs, TOKENIZER, tokens=512, documents=3, cost=512 * 512, weights=(1.0, 0.5, 0.5), rule=rule).collect():
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert sum(map(len, bins.values())) == packing.pack(docs, TOKENIZER, tokens=512).count()
        for parts in bins.values():
            parts.sort()
            assert len(parts) <= 3 and sum(n * n for _, n in parts) <= 512 * 512
            assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]


def test_best_fit_capacities():
    rng = random.Random(2)
    for rule in ("residual", "dot"):
        for documents, cost in ((100, 100**2), (3, 100**2), (100, 2500)):
            counts = collections.Counter(rng.randrange(1, 45) for _ in range(3000))
            plan = packing.best_fit(counts, 100, documents, cost, (1.0, 0.3, 0.3), rule)
            ranks, bins = collections.defaultdict(list), collections.defaultdict(list)
            for n, a, b, first, offset in plan:
                for r in range(a, b + 1):
                    ranks[n].append(r)
                    bins[first + r - a].append((offset, n))
            assert all(sorted(v) == list(range(counts[n])) for n, v in ranks.items()) and len(ranks) == len(counts)
            for v in bins.values():
                v.sort()
                assert all(o == sum(n for _, n in v[:i]) for i, (o, _) in enumerate(v))
                assert sum(n for _, n in v) <= 100 and len(v) <= documents and sum(n * n for _, n in v) <= cost
    with pytest.raises(ValueError):
        packing.best_fit({50: 1}, 100, 5, 100)


def sequences_of(plan, counts):
    """Sequences by number: lengths of their pieces, after a check of ranks and offsets."""
    ranks, bins = collections.defaultdict(list), collections.defaultdict(list)
    for n, a, b, first, offset in plan:
        ranks[n] += range(a, b + 1)
        for r in range(a, b + 1):
            bins[first + r - a].append((offset, n))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
    return {k: [n for _, n in v] for k, v in bins.items()}


def test_fewest_sequences():
    """As many sequences as the token bound asks for: short, mixed and long pieces. Capacities bind where they cost nothing."""
    rng = random.Random(6)
    for counts in (
        {1: 10_000},
        collections.Counter(max(1, int(rng.expovariate(1 / 12.6))) for _ in range(50_000)),
        collections.Counter(min(4096, max(1, int(rng.lognormvariate(6, 1.2)))) for _ in range(20_000)),
        {4096: 7, 4095: 3, 1: 3},
        {},
    ):
        bins = sequences_of(packing.fewest(counts, 4096, packing.DOCUMENTS, (1.0, 0.1, 0.1), "residual"), counts)
        assert max((sum(v) for v in bins.values()), default=0) <= 4096
        assert len(bins) <= -(-sum(n * c for n, c in counts.items()) // 4096) + (len(counts) > 1)
    assert len(bins) == 0
    # Pieces over half a sequence can't share one.
    assert packing.sequences(packing.fewest({2049: 50, 3000: 20}, 4096, 256, (1.0, 0.1, 0.1), "dot")) == 70


def test_capacities_bind():
    """By hand: ten pieces of 10 tokens in sequences of 100. Tokens ask for 1, four documents for 3, a cost of 5 blocks for 2."""
    price = lambda n: 1
    for documents, cost, most in ((100, 100, 1), (4, 100, 3), (100, 5, 2), (3, 5, 4)):
        bins = sequences_of(packing.best_fit({10: 10}, 100, documents, cost, (1.0, 0.1, 0.1), "residual", price), {10: 10})
        assert len(bins) == most and max(map(len, bins.values())) <= min(documents, cost)
    # Where they cost nothing, they hold: two sequences of ten pieces each, not of twelve and eight.
    counts = {100: 1, 50: 1, 5: 20}
    bins = sequences_of(packing.fewest(counts, 150, 12, (1.0, 0.1, 0.1), "residual"), counts)
    assert len(bins) == 2 and max(map(len, bins.values())) <= 24
    assert packing.attention_blocks(4096) == 528 and packing.attention_blocks(1) == 1 and all(packing.attention_blocks(n) <= n for n in range(1, 4097))


def test_numbered_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 10)
    df = spark.range(500).selectExpr("id", "IF(id < 300, 1, id) AS length")
    got = packing.numbered(df, 500).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["length"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by[1]) == 300


def test_edit_counts(docs, spark):
    got = token_counts.counted_sample(docs, TOKENIZER, leaf=64)
    lib = wordtokens.library(TOKENIZER)
    expected = []
    for i, t, edits in [tuple(r) for r in token_counts.sample_edits(docs.select("doc_id", "text")).collect()]:
        before = t = t or ""
        for e in edits:
            t = t[: e["start"]] + e["text"] + t[e["start"] + e["size"] :]
        expected.append((i, len(lib.encode(before, add_special_tokens=False).ids), len(lib.encode(t, add_special_tokens=False).ids), len(t)))
    same(rows_of(got.select("doc_id", "n_tokens", "n_tokens_after", "n_chars_after")), expected)


def test_count_tree_random_edits():
    rng, lib = random.Random(3), wordtokens.library(TOKENIZER)
    words = wordtokens.library_words(TOKENIZER)
    for _ in range(150):
        text = "".join(rng.choice(["ab", "cat", " ", "\n", "é", "'s", "1", "<|endoftext|>", "!"]) for _ in range(rng.randrange(0, 300)))
        tree = token_counts.CountTree(words, text, leaf=16)
        for _ in range(6):
            a, n = rng.randrange(0, len(text) + 5), rng.choice([0, 1, 5, 60])
            new = "".join(rng.choice(["x", " ", "don't", "9", "long words here "]) for _ in range(rng.randrange(0, 6)))
            tree.apply(token_counts.Edit(a, n, new))
            text = text[:a] + new + text[a + n :]
            assert tree.text == text and tree.total == len(lib.encode(text, add_special_tokens=False).ids)
    tree = token_counts.CountTree(words, "some words " * 5000, leaf=256)
    tree.encoded = 0
    tree.apply(token_counts.Edit(20_000, 3, "new"))
    assert tree.encoded < 2000


def test_trees_are_kept_over_batches(spark):
    """A second batch of edits reads the first one's sums and encodes only what it touches."""
    lib, rng = wordtokens.library(TOKENIZER), random.Random(12)
    text = " ".join(rng.choice(["alpha", "beta's", "gamma,", "x1"]) for _ in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "same text"), (3, "other text")], "doc_id long, text string")
    trees = materialize(token_counts.token_trees(docs, TOKENIZER))
    assert trees.where("text IS NULL AND size(tokens) = 0").count() == 1
    for start, size, new in ((50_000, 3, "one two"), (10, 40_000, ""), (5, 0, "many new words " * 1000)):
        edits = spark.createDataFrame([(1, text, [(start, size, new)]), (3, "other text", [(0, 5, "")])], "doc_id long, text string, edits array<struct<start: long, size: long, text: string>>")
        edits = edits.withColumn("rh", row_hash())
        out = materialize(token_counts.apply_edits(token_counts.edited_trees(trees, edits), TOKENIZER, keep_trees=True))
        text = text[:start] + new + text[start + size :]
        rows = {(r["doc_id"], r["text"]): r for r in out.collect()}
        one = rows[1, text]
        assert one["n_tokens_after"] == len(lib.encode(text, add_special_tokens=False).ids) == sum(one["tokens"]) and one["n_chars_after"] == len(text)
        assert one["n_chars_encoded"] <= len(new) + 2000 and one["n_edits"] == 1
        assert rows[2, ""]["n_tokens"] == 0 and rows[3, "same text"]["n_edits"] == 0 and len(rows) == 4
        trees = out.select("doc_id", "text", "chars", "tokens")


def brute_components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_simhash(docs):
    rows, prints = texts_of(docs), []
    for _, t in rows:
        w = ascii_lower(t).split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    roots = brute_components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    low = {}
    for (i, _), r in zip(rows, roots):
        low[r] = min((x for x in (low.get(r), i) if x is not None), default=None)
    same(rows_of(simhash.simhash_components(docs)), [(i, f"{p:016x}", low[r]) for (i, _), p, r in zip(rows, prints, roots)])
    kept = simhash.keep_one_each(docs, shingle=3)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()} == {v for v in low.values() if v is not None}


def test_similar_texts(spark):
    """Spread changes leave a similarity over 0.8 but more than 3 bits apart."""
    rng = random.Random(21)
    texts = []
    for _ in range(20):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        near = list(base)
        for k in (30, 90, 150, 210, 270):
            near[k] = "changed"
        far = [f"x{k}" if k % 10 == 0 else w for k, w in enumerate(base)]
        texts += [base, near, far]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bits = lambda i: simhash.fingerprint(" ".join(texts[i]).encode(), 5)
    assert any(((bits(i) ^ bits(i + 1)) & (2**64 - 1)).bit_count() > 3 for i in range(0, 60, 3))
    kept = {r["doc_id"] for r in simhash.keep_one_each(df, similar=True).collect()}
    assert kept == {i for i in range(60) if i % 3 != 1}


@pytest.mark.parametrize("radius", [1, 3])
def test_links_find_every_pair(spark, radius):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(8):
            g = f
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(simhash.signed(f) for f in fps)
    want = brute_components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= radius])
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for direct in (10_000, 3):  # 3: buckets are split
        got = dict(rows_of(connected_components(simhash.links(df, radius, direct))))
        groups = collections.defaultdict(set)
        for f, r in zip(fps, want):
            groups[r].add(f)
        assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(f for f, r in got.items() if r == x) for x in set(got.values())}


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    want = brute_components(1101, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in nodes}


def test_line_dedup(docs):
    rows = texts_of(docs)
    items = sorted(((i is None, i or 0, n, zlib.crc32((t or "").encode()), x.decode()) for i, t in rows for n, l in enumerate((t or "").encode().split(b"\n")) if (x := line_dedup.normalize(l))))
    lines = sorted({x[4] for x in items})
    sets = [{s[k : k + 8] for k in range(max(1, len(s) - 7))} for s in lines]
    linked = [(a, b) for a in range(len(lines)) for b in range(a) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = dict(zip(lines, brute_components(len(lines), linked)))
    first = {}
    for null, i, n, h, x in items:
        first.setdefault(root[x], (null, i, n))
    expected = []
    for i, t in rows:
        found = [(n, line_dedup.normalize(l).decode()) for n, l in enumerate((t or "").encode().split(b"\n")) if l.split()]
        expected.append((i, len(found), tuple(n for n, x in found if first[root[x]] != (i is None, i or 0, n))))
    got = [(r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in line_dedup.line_report(docs).collect()]
    miss = collections.Counter(got) - collections.Counter(expected)
    assert sum(miss.values()) <= 0.02 * len(rows)  # banding has a recall of 0.995 at the threshold
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert sum(len((r["text"] or "").split("\n")) for r in kept.collect()) <= sum(len((t or "").split("\n")) for _, t in rows)


def test_line_buckets_in_blocks(spark):
    rng = random.Random(8)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(99)) for _ in range(60))
    texts = []
    for i in range(60):
        w = base.split()
        for k in rng.sample(range(60), 3):
            w[k] = f"new{i}{k}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r["doc_id"]: tuple(r["removed"]) for r in line_dedup.line_report(df).collect()}
    split = {r["doc_id"]: tuple(r["removed"]) for r in line_dedup.line_report(df, direct=6).collect()}
    assert whole == split


def test_blocks_meet(spark):
    """Each line outside the largest component shares a key with every other line of the bucket."""
    for n, rest in ((15, 5), (30, 1), (40, 20)):
        rows = [(7, i, n, rest, i >= rest) for i in range(n)]
        dealt = line_dedup._in_blocks(spark.createDataFrame(rows, "k long, lid long, size long, rest long, big boolean"), 4)
        keys = collections.defaultdict(set)
        for r in dealt.collect():
            keys[r["lid"]].add(r["k"])
        assert all(keys[a] & keys[b] for a in range(rest) for b in range(n))


def test_substring_dedup(docs):
    rows = texts_of(docs)
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", row_hash().alias("h")).collect()}
    place = lambda i, t: (i is None, i or 0, hashes[i, t])
    units = [(place(i, t), k, u) for i, t in rows for k, u in enumerate(substring_dedup.split_units(t or ""))]
    first = {}
    for u in sorted(units):
        if d := substring_dedup.digest(u[2], 5):
            first.setdefault(d, u[:2])
    expected = []
    for i, t in rows:
        us = substring_dedup.split_units(t or "")
        assert "".join(us) == (t or "")
        gone = {k for k, u in enumerate(us) if (d := substring_dedup.digest(u, 5)) and first[d] != (place(i, t), k)}
        kept, spans = substring_dedup.cut(us, gone)
        expected.append((i, len(us), len(gone), sum(b - a for a, b in spans), hashlib.sha256(kept.encode()).hexdigest()))
        left, at = "", 0
        for a, b in spans:
            left, at = left + (t or "")[at:a], b
        assert left + (t or "")[at:] == kept
    same(rows_of(substring_dedup.substring_report(docs).drop("spans")), expected)
    out = substring_dedup.dedup_substrings(docs)
    assert out.columns == docs.columns
    same([hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in out.collect()], [e[4] for e in expected])


def test_units_take_one_pass():
    assert [substring_dedup.split_units(t) for t in ("", "a. b", "..  x!\n\n?", "a.b? \tc\n")] == [[], ["a. ", "b"], ["..  ", "x!\n", "\n", "?"], ["a.b? \t", "c\n"]]
    began = time.perf_counter()
    assert len(substring_dedup.split_units("." * 1_000_000)) == 1 and len(substring_dedup.split_units(".!? " * 250_000)) == 250_000
    assert time.perf_counter() - began < 2


def test_shared_doc_ids_lose_their_copies(spark):
    """Different texts under one doc_id, or under none, share a unit: one of them keeps it."""
    unit = "one two three four five six seven. "
    for i in (1, None):
        df = spark.createDataFrame([(i, unit + "Alpha"), (i, unit + "Beta"), (i, unit + "Beta")], "doc_id long, text string")
        left = sorted(r["text"] for r in substring_dedup.dedup_substrings(df).collect())
        assert left in (["Alpha", unit + "Beta", unit + "Beta"], ["Beta", "Beta", unit + "Alpha"])


def test_short_units_of_repeated_passages(spark):
    verse = "".join(f"Go {w} now.\n" for w in ("red", "blue", "green", "black", "white", "brown"))
    han = "\u5929\u5730\u7384\u9ec4\u5b87\u5b99\u6d2a\u8352\u65e5\u6708\u76c8\u6603\n"
    long = "Some first sentence of many words. Yes. Another long sentence follows it here. "
    texts = ["Alpha opens the first text here. " + long + "\n" + verse + han, "Beta opens another text right here. " + long + "\n" + verse + "End.\n" + han, "No. Yes. Gamma is a third text with its own words. Yes."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(df, runs=True).collect()}
    assert left == {0: texts[0], 1: "Beta opens another text right here. \nEnd.\n", 2: texts[2]}


def brute_short_runs(texts, least=5):
    """The units that go from texts (doc_id, text), by definition: entries by doc_id and place, the first of each text stays."""
    entries = collections.defaultdict(list)
    for i, t in texts:
        us = [(k, u.encode().lower().split(), u) for k, u in enumerate(substring_dedup.split_units(t or ""))]
        us = [(k, w, len(w) + sum(bool(substring_dedup.UNSPACED.match(c)) for c in u) // 2) for k, w, u in us if w]
        for at, (k, w, _) in enumerate(us):
            if len(w) >= least:
                entries[b" ".join(w)].append((i, k, k))
                continue
            for parts in ([us[at : e + 1] for e in range(at, len(us))], [us[e : at + 1] for e in range(at, -1, -1)]):
                enough = [p for p in parts if sum(x[2] for x in p) >= least]
                if enough:
                    entries[b" ".join(x for p in enough[0] for x in p[1])].append((i, enough[0][0][0], k))
    gone = collections.defaultdict(set)
    for found in entries.values():
        first = min(found)[:2]
        for i, start, k in found:
            if (i, start) != first:
                gone[i].add(k)
    return gone


def test_substring_report_with_runs(spark, sf, tables):
    """As registered: short units too, where they repeat with their neighbours."""
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), tables["odd"].where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        texts = texts_of(df)
        gone, expected = brute_short_runs(texts), []
        for i, t in texts:
            units = substring_dedup.split_units(t or "")
            kept, spans = substring_dedup.cut(units, gone[i])
            expected.append((i, len(units), len(gone[i]), sum(b - a for a, b in spans), hashlib.sha256(kept.encode()).hexdigest(), tuple(spans)))
        found = [(*tuple(r)[:5], tuple((s["start"], s["end"]) for s in r["spans"])) for r in substring_dedup.substring_report(df, runs=True).collect()]
        same(found, expected)
    assert not substring_dedup.substring_report(tables["empty"], runs=True).collect()


@pytest.mark.parametrize("window,sizes", [(200, {}), (40, {}), (40, {"sort_bytes": 2000, "gram_bytes": 1500})])
def test_suffix_dedup(docs, window, sizes):
    rows = [(i, (t or "").encode()) for i, t in texts_of(docs)]
    times = collections.Counter(t[k : k + window] for _, t in rows for k in range(len(t) - window + 1))
    expected = []
    for i, t in rows:
        hit = bytearray(len(t) + 1)
        for k in range(len(t) - window + 1):
            if times[t[k : k + window]] > 1:
                hit[k : k + window] = b"\1" * window
        kept = bytes(c for c, h in zip(t, hit) if not h)
        expected.append((i, len(t), len(t) - len(kept), len(re.findall(b"\1+", hit)), hashlib.sha256(kept).hexdigest()))
    same(rows_of(suffix_dedup.remove_repeats(docs, window, **sizes)), expected)


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(200):
        n, a = rng.randrange(1, 200), rng.choice([2, 3, 250])
        t = np.array([rng.randrange(a) for _ in range(n)], np.uint8)
        if rng.random() < 0.3:
            t = np.tile(t[: max(1, n // 5)], 5)
        b = t.tobytes()
        assert suffix_dedup.suffix_array(t, 1000).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_bpe(docs):
    lib = wordtokens.library(TOKENIZER)
    expected = []
    for i, t in texts_of(docs):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(rows_of(bpe_dp.encode_decode(docs, TOKENIZER)), expected)


def test_bpe_tokens_and_characters():
    bpe, lib = bpe_dp.prefix_bpe(TOKENIZER), wordtokens.library(TOKENIZER)
    assert all(bpe.encode_letters(t[:-1]) == [i] for i, t in bpe.of_id.items() if t.endswith(bpe_dp.END))
    rng = random.Random(9)
    texts = [f"ab{chr(c)}cd {chr(c)} {chr(c)}{chr(c)}1" for c in range(0x3000)]
    texts += ["".join(rng.choice([chr(rng.randrange(32, 0x3000)), " ", "a", "E"]) for _ in range(50)) for _ in range(500)]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(bpe.ids(t), "<u4").tolist() == e.ids, t


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    for name_of in ("documents", "embeddings"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name_of} AS SELECT * FROM '{sf}/{name_of}.parquet'")
    df = queries.queries()[name](spark, sf)
    sql = duckdb.sql(queries.oracle_sql()[name])
    assert sorted(sql.columns) == sorted(df.columns)
    same(rows_of(df), sql.select(*[duckdb.ColumnExpression(c) for c in df.columns]).fetchall())


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, sf), name)
        if name != "best_fit_packing":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    same(rows_of(corpus_pipeline.run(spark, sf).drop("sequence_id", "offset")), rows_of(docs.drop("sequence_id", "offset")))


def test_pipeline_on_awkward_rows(spark, sf, tables):
    """Nulls, empty and long texts, copies, clashing columns and no rows at all go through every stage."""
    import corpus_pipeline

    for name in ("odd", "empty"):
        docs = tables[name]
        for stage, f in corpus_pipeline.STAGES:
            before, docs = docs, materialize(f(spark, docs, sf), stage)
            if stage != "best_fit_packing":
                assert docs.dtypes == before.dtypes and docs.count() <= before.count()
        assert (docs.count() > 0) == (name == "odd")


def test_pipeline_catches_near_copies(spark, sf):
    """Copies with a few words changed anywhere, at a similarity of 0.8 and more, keep one document; others all stay."""
    import corpus_pipeline

    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(6000)]
    texts, near = [], 0
    sh = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randrange(150, 400))]
        texts.append(w)
        copy = list(w)
        for k in rng.sample(range(len(w)), max(1, len(w) // 60)):
            copy[k] = rng.choice(words)
        if i % 2 and len(sh(w) & sh(copy)) >= 0.8 * len(sh(w) | sh(copy)):
            texts.append(copy)
            near += 1
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.simhash_near_dedup(spark, df, sf).count()
    assert near > 20 and kept == 60
