"""Target sampling, vector codes and SuperMinHash against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import superminhash, target_sampling, vector_codes
from tallygrid.llm.common import window_hashes

from .corpus import LOWER, documents, frame, words


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def runs(text, n):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return ws, [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


def brute_sample(rows, target, n, size, seed, least, percent):
    bucket = lambda w: zlib.crc32(w.encode()) % size
    s, t = (Counter(bucket(w) for text in texts for w in runs(text, n)[1]) for texts in ([t for _, t in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + size) / ((s[b] + 1) * (t_all + size)))) for b in range(size)]
    out = []
    for i, text in rows:
        ws, own = runs(text, n)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(w)] for w in own)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws) >= least))
    fit = sorted((-r[3], i is None, i or 0, r) for r in out if r[4] for i in [r[0]])
    return out, [x[3] for x in fit[: len(fit) * percent // 100]]


@pytest.mark.parametrize("n", [1, 3])
def test_target_sampling(spark, rows, docs, n):
    target = ["of Éa naïve " * 5, None, "", "x the the"]
    args = (n, 500, 7, 5, 30)
    expected, drawn = brute_sample(rows, target, *args)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    out = target_sampling.scored(docs, bench, *args).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in out) == Counter(r[:4] for r in expected)
    ranked = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[3]) for r in drawn]
    kept = target_sampling.resample(docs, bench, *args)
    assert kept.columns == docs.columns
    last = Counter(r.doc_id for r in kept.collect())
    assert set(last) == {r[0] for r in drawn} and sum(last.values()) >= len(drawn)


def test_target_sampling_of_nothing(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert target_sampling.scored(docs.limit(0), bench).count() == 0
    assert target_sampling.resample(docs.limit(0), bench).count() == 0
    assert target_sampling.scored(docs, bench).count() == docs.count()


def brute_codes(vectors, n_parts, n_entries, rounds):
    """Codes, errors and codebooks of integer vectors in order of their ids, with Python's integers."""
    cut = lambda v: [tuple(v[k * len(v) // n_parts : (k + 1) * len(v) // n_parts]) for k in range(n_parts)]
    off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    parts = [cut(v) for v in vectors]
    books = [[p[k] for p in parts[:n_entries]] for k in range(n_parts)]
    nearest = lambda: [[min(range(len(b)), key=lambda e: (off(x, b[e]), e)) for x, b in zip(p, books, strict=True)] for p in parts]
    for _ in range(rounds):
        codes = nearest()
        for k in range(n_parts):
            groups = defaultdict(list)
            for p, c in zip(parts, codes, strict=True):
                groups[c[k]].append(p[k])
            for e, own in groups.items():
                books[k][e] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    codes = nearest()
    return codes, [sum(off(x, books[k][c[k]]) for k, x in enumerate(p)) for p, c in zip(parts, codes, strict=True)], books


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "equal"])
def test_vector_codes(spark, kind):
    rng = np.random.default_rng(5)
    n = {"few": 3, "equal": 300}.get(kind, 700)
    values = {"ties": lambda: rng.integers(-2, 3, 8) / 256, "equal": lambda: np.full(8, -0.3)}.get(kind, lambda: rng.normal(size=8))
    vectors = [(i, [float(x) for x in values()], i % 3 or None) for i in range(n)]
    odd = [(1000, None, 1), (1001, [None] + [0.0] * 7, 1), (1002, [math.nan] + [0.0] * 7, 1), (1003, [0.0] * 7 + [math.inf], 1), (1004, [], 1), (1005, [0.0] * 4, 1), (1006, [0.0] * 7, 1), (1007, [1e30] + [0.0] * 7, 1)]
    repeated = [(5, vectors[min(5, n - 1)][1], 2), (None, [0.5] * 8, None)] if kind == "spread" else []
    full = [(*r, "x", 9) for r in vectors + odd + repeated]
    random.Random(1).shuffle(full)
    df = spark.createDataFrame(full, "vec_id long, embedding array<double>, label int, v string, code int").repartition(3)
    got, books = vector_codes.vector_codes(df, 4, 16, 2)
    own = sorted(vectors + repeated, key=lambda r: (r[0] is None, r[0], r[1]))
    codes, errors, expected = brute_codes([[math.floor(256 * x) for x in r[1]] for r in own], 4, 16, 2)
    assert Counter(tuple(r) for r in got.collect()) == Counter((r[0], r[2], bytes(c).hex(), e) for r, c, e in zip(own, codes, errors, strict=True))
    assert books.tolist() == [[list(x) for x in b] for b in expected]


def test_vector_codes_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1), (2, [math.nan] * 16, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.vector_codes(df)[0].count() == 0
    df.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vector_codes.op12_vector_codes(spark, str(tmp_path)).count() == 0


def test_label_errors(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=32)], [None, 1, 1, 2][i % 4]) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = vector_codes.op12_vector_codes(spark, str(tmp_path)).collect()
    by_label, label = defaultdict(int), {r[0]: r[2] for r in rows}
    for r in out:
        by_label[label[r.vec_id]] += r.error
    assert len(out) == 200 and all(r.label_error == by_label[label[r.vec_id]] for r in out)


@pytest.mark.parametrize("spread", [1, 3, 100, 20000])
def test_forest_walk(spread):
    """Whole subtrees and leaves together give what comparing everything gives, with equal entries and ties among them."""
    rng = np.random.default_rng(spread)
    for n in (1, 7, 8, 9, 100, 1000):
        vectors, entries = rng.integers(-spread, spread + 1, (n, 6)), rng.integers(-spread, spread + 1, (2, 9, 3))
        forest = vector_codes.Forest.read(vector_codes.Forest.grown(vectors, 2).stored())
        off = ((vectors.reshape(n, 2, 1, 3) - entries[None]) ** 2).sum(3)
        codes, error = forest.coded(entries)
        assert (codes == off.argmin(2)).all() and (error == off.min(2).sum(1)).all()
        counts, sums = forest.summed(entries)
        for p in range(2):
            assert counts[p].tolist() == np.bincount(codes[:, p], minlength=9).tolist()
            assert sums[p].tolist() == [vectors[codes[:, p] == e].reshape(-1, 2, 3)[:, p].sum(0).tolist() for e in range(9)]


def test_subtrees_go_whole():
    """On clustered points most are assigned by their subtree."""
    rng = np.random.default_rng(0)
    centres = rng.integers(-5000, 5000, (16, 4))
    vectors = np.repeat(centres, 200, 0) + rng.integers(-3, 4, (3200, 4))
    forest = vector_codes.Forest.grown(vectors, 1)
    singly = sum(len(at) for level, _, at, _ in forest.walked(centres[None]) if level < 0)
    assert singly < 320


def one_by_one(elements, places):
    """A signature element by element, with the early end that the level histogram allows."""
    step, mask, out = 0x9E3779B97F4A7C15, 2**64 - 1, [None] * places

    def finish(h):
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
        return h ^ (h >> 31)

    for e in elements:
        order = list(range(places))
        for rank in range(places):
            if all(x is not None and x >> 40 < rank for x in out):
                break
            x = finish((e + (rank + 1) * step) & mask)
            k = rank + (x >> 40) % (places - rank)
            order[rank], order[k] = order[k], order[rank]
            value = rank << 40 | (x & ((1 << 40) - 1))
            if out[order[rank]] is None or value < out[order[rank]]:
                out[order[rank]] = value
    return out


def test_signatures():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, k).astype(np.uint64) for k in (1, 2, 5, 40, 400, 0, 3)]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    got = superminhash.signatures(np.concatenate(sets), first, 60)
    for s, row in zip(sets, got.tolist(), strict=True):
        assert row == (one_by_one(s.tolist(), 60) if len(s) else [2**64 - 1] * 60)


def test_signatures_vary_less():
    """Estimates of small sets' similarity are unbiased, with less variance than independent minima have."""
    rng = np.random.default_rng(4)
    off, places, j = [], 64, 0.5
    for _ in range(400):
        pool = rng.integers(0, 2**63, 30).astype(np.uint64)
        a, b = superminhash.signatures(np.concatenate((pool[:22], pool[7:][:15], pool[22:])), np.array([0, 22, 45]), places)
        off.append((a == b).mean() - j)
    assert abs(np.mean(off)) < 0.01 and np.var(off) < 0.8 * j * (1 - j) / places


def brute_groups(rows, size, percent):
    sets = []
    for _, text in rows:
        ws = words((text or "").translate(LOWER))
        sets.append({tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set())
    head = list(range(len(rows)))

    def find(k):
        while head[k] != k:
            k = head[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        own = least.get(find(k))
        least[find(k)] = i if own is None else own if i is None else min(i, own)
    return [(i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("size,percent", [(5, 85), (2, 80)])
def test_near_duplicates(rows, docs, size, percent):
    expected = brute_groups(rows, size, percent)
    out = superminhash.near_duplicates(docs, size, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter(expected)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    kept = superminhash.without_near_duplicates(docs, size, percent)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _, c in expected if i == c)


def test_chains_and_families(spark):
    """Chains of copies whose ends are unlike, and a family whose members share places but don't link, keep exactly their links."""
    rng = random.Random(8)
    text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(text))]
    for i in range(1, 40):  # each a little further from the first
        at = rng.randrange(0, 190)
        text[at : at + 2] = [f"c{i}a", f"c{i}b"]
        rows.append((i, " ".join(text)))
    base = [f"f{k}" for k in range(200)]
    for i in range(100, 160):
        own = list(base)
        own[10:32] = [f"o{i}x{k}" for k in range(22)]
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = superminhash.near_duplicates(df, 5, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter(brute_groups(rows, 5, 85))


def test_near_duplicates_of_nothing(docs):
    assert superminhash.near_duplicates(docs.limit(0)).count() == 0
    blank = docs.filter(F.col("text").isNull() | (F.trim("text") == ""))
    assert all(r.kept and r.component_id == r.doc_id and r.n_shingles == 0 for r in superminhash.near_duplicates(blank).collect())


def test_long_texts_by_pieces(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["Ab", "c", "é🙂", "x" * 3000]) + rng.choice([" ", "\n", "  "]) for _ in range(3000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = superminhash._plain_hashes(data, offsets)
    monkeypatch.setattr(superminhash, "SLICE_BYTES", 1000)
    pieces = superminhash._hashed_words(data, offsets)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
    assert len(np.unique(window_hashes(whole[0], whole[1], 1)[0])) == len({w.lower() for w in text.decode().split()})
