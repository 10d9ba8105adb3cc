"""Conversation repair, periodic runs and embedding near-dedup against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from matchloom.llm import conversations, embeddings, queries, runs

SPACE = " \t\n\r\x0b\x0c"
TALK = "conv_id long, turn long, role string, text string, n long, piece int, key string, copies int"


def same(found, expected):
    assert collections.Counter(found) == collections.Counter(expected)


def odd_talk():
    rng = random.Random(3)
    rows = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "Assistant"])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", "", None, " \n", "Long. But cut", "ends. \t\n", " ", "Σ.", "a?b!c", f"text {rng.random()}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None, 2]), role, text, 1, 2, "k", 3))
    rows += [(None, 1, "user", "Hi.", 1, 1, "k", 1), (None, 2, "assistant", "Ho.", 1, 1, "k", 1), (None, None, None, None, None, None, None, None)]
    rows += [(500, 7, "user", "Same.", 1, 1, "k", 1)] * 9 + [(501, -(1 << 63), "user", "Far.", 1, 1, "k", 1), (501, (1 << 63) - 1, "assistant", "Away.", 1, 1, "k", 1)]
    return rows


@pytest.fixture(scope="module")
def talk(spark, sf):
    odd = spark.createDataFrame(odd_talk(), TALK).repartition(3)
    return {"real": spark.read.parquet(f"{sf}/conversations.parquet"), "odd": odd, "empty": odd.limit(0)}


def brute_repair(rows):
    """By a forward table of (cost, audit, repaired rows): the least by cost, then audit."""
    out = {}
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        code = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        group = groups[conv]
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        group += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in group:
            last = [c for c in text if c not in SPACE][-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

        def insert(best):
            best = dict(best)
            for _ in range(3):
                for state, (cost, audit, made) in list(best.items()):
                    for role in ("user", "assistant"):
                        to = step.get((state, role[0]))
                        new = cost + 5, audit + "I", (*made, f"{role}:")
                        if to and (to not in best or new[:2] < best[to][:2]):
                            best[to] = new
            return best

        best = {"": (0, "", ())}
        for (_, role, text), f in zip(group, faults):
            best, new = insert(best), {}
            for state, (cost, audit, made) in best.items():
                options = [(state, cost + 2, "D", made)]
                if f not in ("blank", "duplicate"):
                    extra = 5 * (f == "truncated")
                    if role and step.get((state, role[0])):
                        options.append((step[state, role[0]], cost + extra, "K", (*made, f"{role}:{text}")))
                    options += [(step[state, r[0]], cost + 1 + extra, "R", (*made, f"{r}:{text}")) for r in ("user", "assistant") if (state, r[0]) in step]
                for to, c, letter, m in options:
                    if to not in new or (c, audit + letter) < new[to][:2]:
                        new[to] = c, audit + letter, m
            best = new
        cost, audit, made = min((v for s, v in insert(best).items() if s in ("", "a")), key=lambda v: v[:2])
        turns = {t for t, _, _ in group if t is not None}
        gap = (max(turns) - min(turns) + 1 - len(turns) + (1 << 63)) % (1 << 64) - (1 << 63) if turns else 0
        wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
        counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
        out[conv] = (gap, *counts, wrong, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return [(k, *v) for k, v in out.items()]


@pytest.mark.parametrize("longest", [None, 0, 6])
@pytest.mark.parametrize("name", ["real", "odd", "empty"])
def test_conversation_repair(spark, talk, name, longest):
    """``longest`` 0 cuts every conversation into pieces, 6 some."""
    df = talk[name]
    found = conversations.repair_conversations(df, longest)
    expected = brute_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    same([tuple(r) for r in found.collect()], expected)


def test_conversation_repair_pieces(spark):
    """One conversation over many range partitions, with many equal rows."""
    rng = random.Random(8)
    rows = [(1, rng.randrange(300), rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No.", f"t{i}.", f"t{i}", ""])) for i in range(1500)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same([tuple(r) for r in conversations.repair_conversations(df, 100).collect()], brute_repair(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_dial_distances():
    rows = bytes([1, 2, 3])
    dist = conversations.distances(rows)
    assert dist[0] == 0 and conversations.walk(rows, dist, 0) == ("KKK", 3)
    assert conversations.distances(b"")[:4] == [0, 10, 5, 0]
    # Alone, a user row: an answer put in costs 5, to delete it 2.
    assert conversations.walk(bytes([2]), conversations.distances(bytes([2])), 0) == ("D", 0)


def brute_runs(words):
    """Every maximal stretch by period, without scales or hashes."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and (i, j + q) not in found:
                found[i, j + q] = q
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def brute_described(doc_id, text, damage):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if damage and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for a, size, q in found for i in range(a + q, a + size)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{a},{size},{q}\n" for a, size, q in found)
    return doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(listed), digest(" ".join(w for i, w in enumerate(words) if i not in gone))


@pytest.fixture(scope="module")
def texts(spark, sf):
    rng = random.Random(4)
    some = lambda n, k=3: " ".join(rng.choice(["ab", "c", "Σd", "e f", "g", "h", "i", "j"][:k]) for _ in range(n))
    period = lambda q, times, k=3: " ".join([some(q, k)] * times)
    rows = [None, "", " \n", "one", "x " * 23, "x " * 24, "x\t" * 500, "x y " * 12, "x y z " * 8, some(400), some(400, 2), some(300, 1) + " " + some(200)]
    rows += [some(40, 8) + " " + period(q, t, 8) + " " + some(30, 8) for q in (1, 2, 3, 7, 8, 9, 12, 15, 16, 17, 31, 32, 33, 50, 64, 100) for t in (2, 3, 4, 9)]
    rows += [period(5, 6) + " " + period(4, 9) + " " + period(11, 4), " ".join([period(3, 9, 8) + " " + some(20, 8)] * 5)]
    word = ["a", "b"]
    for _ in range(12):  # Fibonacci's words: runs of many periods
        word.append(word[-1] + word[-2])
    rows.append(" ".join(word[-1]))
    real = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 6000")
    odd = spark.createDataFrame([(i, t, i, "r") for i, t in enumerate(rows)] + [(None, "a b " * 30, 1, "r"), (None, None, None, None), (5, "x " * 24, 1, "r")], "doc_id long, text string, n_runs long, start string").repartition(3)
    return {"real": real, "odd": odd, "empty": odd.limit(0)}


@pytest.mark.parametrize("damage", [True, False])
@pytest.mark.parametrize("name", ["real", "odd", "empty"])
def test_periodic_runs(texts, name, damage):
    df = texts[name]
    found = [tuple(r) for r in runs.detect_runs(df, damage).collect()]
    same(found, [brute_described(r["doc_id"], r["text"], damage) for r in df.select("doc_id", "text").collect()])


def test_runs_of_random_words():
    rng = np.random.RandomState(1)
    for k in range(300):
        words = rng.randint(0, 1 + k % 4, rng.randint(1, 150))
        if k % 3 == 0:
            words = np.concatenate([words, np.tile(rng.randint(0, 5, rng.randint(1, 40)), rng.randint(2, 6)), words[:30]])
        assert runs.find_runs(words) == brute_runs(words.tolist())


def test_long_run():
    """A text of one word, and a long one without runs: no quadratic work."""
    assert runs.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert runs.find_runs(np.arange(300_000)) == []


def odd_vectors():
    rng = np.random.RandomState(2)
    out = []
    for _ in range(40):
        base = rng.randn(20)
        out += [(base + rng.randn(20) * s).tolist() for s in (0, 0.1, 0.25, 0.3, 0.3)[: rng.randint(1, 6)]]
    hot = rng.randn(20)
    out += [(hot + rng.randn(20) * 0.02).tolist() for _ in range(150)]
    out += [hot.tolist()] * 7 + [(hot * 1e300).tolist(), (hot * 1e-300).tolist(), hot.tolist()[:12], [0.0] * 20, [-0.0] * 20, [], None, [float("nan")] * 20, [1.0, None] * 10, [float("inf")] + [1.0] * 19]
    chain = [np.cos(a) * np.eye(20)[0] + np.sin(a) * np.eye(20)[1] for a in np.arange(0, 3, 0.4)]
    out += [c.tolist() for c in chain]
    rows = [(i, v, 1, i, "x", 2) for i, v in enumerate(out)]
    rng.shuffle(rows)
    return [tuple(r) for r in rows] + [(3, rows[0][1], 1, 1, "x", 1), (None, hot.tolist(), 1, 1, "x", 1), (None, None, None, None, None, None)]


def brute_links(rows, threshold=0.9):
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    dims = max([len(v) for (_, v), o in zip(rows, ok) if o], default=0)
    m = np.zeros((len(rows), dims))
    for i, (_, v) in enumerate(rows):
        if ok[i]:
            x = np.array(v)
            x = x / abs(x).max()
            m[i, : len(x)] = x / np.sqrt((x * x).sum())
    hit = (m @ m.T >= threshold) if len(rows) else np.zeros((0, 0), bool)
    np.fill_diagonal(hit, False)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, front = {i}, [i]
        while front:
            new = set(np.flatnonzero(hit[front].any(0)).tolist()) - seen
            seen |= new
            front = sorted(new)
        low = min([rows[j][0] for j in seen if rows[j][0] is not None], default=None)
        out.append((vec_id, int(hit[i].sum()), low, vec_id is not None and vec_id == low))
    return out


@pytest.mark.parametrize("block", [4096, 16, 3])
def test_embedding_dedup(spark, block):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node long, v string, n int").repartition(3)
    found = embeddings.near_embeddings(df, block=block)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    same([tuple(r) for r in found.collect()], brute_links([r[:2] for r in rows]))


def test_embedding_dedup_real(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    same([tuple(r) for r in embeddings.near_embeddings(df, 0.35, 64).collect()], brute_links(rows, 0.35))
    assert not embeddings.near_embeddings(df.limit(0)).collect()
    nothing = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    same([tuple(r) for r in embeddings.near_embeddings(nothing).collect()], [(1, 0, 1, True), (2, 0, 2, True)])


def test_leaving_rows_out_keeps_links():
    """The bounds leave out no pair at the threshold."""
    rng = np.random.RandomState(5)
    base = rng.randn(200, 64) * np.linspace(2, 0.2, 64)
    a, b = embeddings.unit_rows(base), embeddings.unit_rows(base[::-1] + rng.randn(200, 64) * 0.3)
    axes = embeddings.components_of(np.concatenate([a, b]))
    rows, cols, hit = embeddings.linked(a @ axes, b @ axes, 0.9)
    full = np.zeros((200, 200), bool)
    full[np.ix_(rows, cols)] = hit
    assert full.any() and (full == (a @ b.T >= 0.9)).all()


def test_queries(spark, sf):
    for name, key in (("op11_conversation_repair", "conv_id"), ("op12_periodic_runs", "doc_id"), ("op13_embedding_dedup", "vec_id")):
        assert key in queries.queries()[name](spark, sf).columns


# --- texts beyond every piece size ---------------------------------------------------------------------------------


def letters(rng, n):
    return bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=n)).decode()


def test_suffix_dedup_beyond_its_pieces(spark):
    """Two texts of over 4 MB share a passage that lies across the border of a piece: it goes from both, and nothing else."""
    from matchloom.llm import suffix_dedup

    rng = random.Random(21)
    passage = letters(rng, 1500)
    a = letters(rng, suffix_dedup.PIECE - 700) + "1" + passage + "2" + letters(rng, 400_000)
    b = "3" + passage + "4" + letters(rng, suffix_dedup.PIECE + 100_000)
    df = spark.createDataFrame([(1, a), (2, b), (3, letters(rng, 5000))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1] == (len(a), 1500, 1, digest(a.replace(passage, ""))) and got[2] == (len(b), 1500, 1, digest(b.replace(passage, ""))) and got[3][1] == 0


def test_simhash_beyond_its_pieces(spark):
    import xxhash

    from matchloom.llm import simhash

    rng = random.Random(22)
    words = [f"w{rng.randrange(5000)}" for _ in range(150_000)]
    other = list(words)
    other[70_000] = "changed"
    df = spark.createDataFrame([(1, " ".join(words)), (2, "\n".join(other).upper())], "doc_id long, text string")
    votes = np.zeros(64, np.int64)
    for i in range(len(words) - 2):
        votes += (xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) >> np.arange(64, dtype=np.uint64).astype(object) & 1).astype(np.int64)
    want = sum(1 << k for k in range(64) if 2 * votes[k] > len(words) - 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(df).collect()}
    assert got[1] == (f"{want:016x}", 1) and got[2][1] == 1


def test_line_dedup_beyond_its_pieces(spark):
    """Lines of over 1 MB: the copy and the near copy go, the other one stays."""
    from matchloom.llm import line_dedup

    rng = random.Random(23)
    line = letters(rng, 1_200_000)
    near = line[:500_000] + "changed here" + line[500_010:]
    other = letters(rng, 1_100_000)
    df = spark.createDataFrame([(1, line), (2, "short one\n" + line), (3, near), (4, other)], "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in line_dedup.line_report(df).collect()}
    assert got == {1: [], 2: [1], 3: [0], 4: []}


def test_long_rows(spark):
    """A conversation with a text of 5 MB, and a document of a million words that repeats itself at its end."""
    rng = random.Random(24)
    text = letters(rng, 5_000_000).strip() + "."
    rows = [(4, 1, "user", text), (4, 2, "assistant", "Yes."), (4, 3, "user", text)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same([tuple(r) for r in conversations.repair_conversations(df).collect()], brute_repair(rows))
    words = [f"w{rng.randrange(100_000)}" for _ in range(700_000)]
    tail = [f"v{i}" for i in range(90_000)]
    long = spark.createDataFrame([(1, " ".join(words + tail * 4))], "doc_id long, text string")
    got = runs.detect_runs(long).first()
    assert (got["n_runs"], got["start"], got["length"], got["period"], got["exponent_milli"]) == (1, 700_000, 360_000, 90_000, 4000)
    assert got["collapsed_sha256"] == hashlib.sha256(" ".join(words + tail).encode()).hexdigest()
