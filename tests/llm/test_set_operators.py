"""Packing, decontamination, the Jaccard join, the classifier and the pipeline."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tallygrid.llm import decontamination, jaccard_join, packing, quality
from tallygrid.llm.components import components

from .corpus import LOWER, documents, frame, words

UPPER = {v: k for k, v in LOWER.items()}

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def test_pieces(spark, rows, docs):
    tokenizer = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    odd = [(500, "a<|EndOfText|>b c<|endoftext|>. x.. y'S. É. İx. ẞ. µM, \x0b\x85 z q. it's IT'S, 3. ª. º, á. Ⅷ.")]
    limits = packing.Limits(64, 5, 60)
    out = packing.pack_documents(frame(spark, rows + odd), limits=limits).collect()
    expected = Counter()
    for i, t in rows + odd:
        expected[i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID])] += 1
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {i for i, _ in expected}
    for (i, ids), times in expected.items():
        if sum(n for (k, _), n in expected.items() if k == i) > 1:
            continue  # rows of one id can't be told apart by it
        own = sorted(by_doc[i], key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in out) == sum(len(ids) * n for (_, ids), n in expected.items())
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert sum(r.length for r in own) <= 64 and len(own) <= 5 and sum(r.loss_tokens for r in own) <= 60
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_other_tokenizer(spark, rows):
    """A tokenizer that neither lower-cases nor splits at white space gets whole texts."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = tokenizers.Tokenizer.from_file(path)
    given = [(i, t) for i, t in rows if i is not None] + [(900, "Two  Spaces and\nCAPITALS, x.")]
    out = packing.pack_documents(frame(spark, given), tokenizer=path).groupBy("doc_id").max("doc_tokens").collect()
    expected = {}
    for i, t in given:
        expected[i] = max(expected.get(i, 0), len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1)
    assert {r[0]: r[1] for r in out} == expected


def test_dot_product_choice():
    """Without cuts, each sequence holds what a plain loop over all pieces chooses."""
    rng = np.random.default_rng(3)
    limits = packing.Limits(100, 4, 60)
    made = [packing.Piece((k,), 0, b"\0" * 4 * n, b"\1" * m + b"\0" * (n - m)) for k, (n, m) in enumerate((n, rng.integers(0, min(n, 60) + 1)) for n in rng.integers(1, 100, 200).tolist())]
    got = [sorted(p.row[0] for p in s) for s in packing.pack(iter(made), limits, cut=False, pool_size=1000)]
    left_over = {p.row[0]: np.array([len(p), 1, p.loss.count(1)], float) for p in made}
    top, seen = np.array([100, 4, 60], float), []
    while left_over:
        room, own = top.copy(), []
        while fits := {k: v @ (room / top**2) for k, v in left_over.items() if (v <= room).all()}:
            best = max(fits.values())
            k = next(k for k in fits if abs(fits[k] - best) < 1e-12)
            room -= left_over.pop(k)
            own.append(k)
        seen.append(own)
    assert sorted(k for s in got for k in s) == list(range(200))
    assert abs(len(got) - len(seen)) <= 1  # ties may be broken otherwise
    assert got[0] == sorted(seen[0])


def test_little_padding(spark, docs):
    out = packing.pack_documents(docs, limits=packing.Limits(256, 64, 256)).groupBy("sequence_id").sum("length").collect()
    lengths = [r[1] for r in out]
    padding = sum(0 if n & (n - 1) == 0 else 256 - n for n in lengths)
    assert padding <= 0.05 * sum(lengths)


def test_conversations_keep_examples_whole(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", f"turn {t} of talk {c} " * 3) for c in range(30) for t in range(4)] + [(99, 0, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = packing.pack_conversations(df, limits=packing.Limits(256, 3, 80)).collect()
    assert Counter(r.doc_id for r in out) == Counter([*range(30), 99])
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(sum(r.length for r in s) <= 256 and len(s) <= 3 and sum(r.loss_tokens for r in s) <= 80 for s in by.values())


def test_containment(spark, rows):
    items = [(1, " ".join(words(rows[0][1] or rows[2][1])[:40])), (2, "not, in any: document at all of these here"), (3, "too short"), (4, None), (1, "not in any document, either, that is here")]
    long = next(t for _, t in rows if len(words(t)) > 3000)
    middle = words(long)[1500:1530]
    items += [(5, " ".join(middle)), (6, "!! ".join(middle).translate(UPPER)), (7, " ".join(words(long)))]
    given = rows + [(800, "before " + " ".join(middle[:29]) + " after"), (801, " ".join(middle[:20]) + " other end")]
    got = decontamination.contaminated(frame(spark, given), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = Counter()
    for i, t in given:
        own = decontamination.shingles_of(t or "")
        for k, x in items:
            s = decontamination.shingles_of(x or "")
            if s and len(s & own) >= 0.8 * len(s):
                expected[i, k, len(s & own), len(s)] += 1
    assert Counter((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got) == expected
    assert any(k == 6 for _, k, *_ in expected) and any(i == 800 for i, *_ in expected)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(frame(spark, rows), none).count() == 0


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)], [find(k) for k in range(len(rows))], sets


@pytest.mark.parametrize(("size", "percent", "seed"), [(4, 85, 0), (5, 80, 1), (2, 60, 2)])
def test_components(spark, size, percent, seed):
    rows = documents(seed)
    out = jaccard_join.similar_components(frame(spark, rows), size, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter(brute_components(rows, size, percent)[0])


def test_chain_of_neighbours(spark):
    """Each text is close to the next only, over many chunks: components need links, not distances to one centre."""
    w = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(w[3 * k : 3 * k + 60])) for k in range(100)]
    out = jaccard_join.similar_components(frame(spark, rows), 3, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter(brute_components(rows, 3, 85)[0])
    assert len({r.component_id for r in out}) < 50


def test_texts_that_share_a_line(spark):
    """Many texts with one long line in common, some of them alike: groups of one shingle are large, links are few."""
    import random

    rng = random.Random(5)
    line = " ".join(f"c{k}" for k in range(30))
    rows = [(k, line + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 25)))) for k in range(1200)]
    rows += [(2000 + k, rows[k * 7][1] + (" end" if k % 2 else "")) for k in range(60)]
    rows += [(3000 + k, " ".join(f"x{rng.randrange(30)}" if rng.random() < 0.04 else f"b{j}" for j in range(80))) for k in range(150)]
    out = jaccard_join.similar_components(frame(spark, rows), 4, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter(brute_components(rows, 4, 80)[0])


def test_one_of_each_stays(spark, rows, docs):
    groups, roots, sets = brute_components(rows, 5, 80)
    kept = [(r.doc_id, r.text) for r in jaccard_join.without_copies(docs).collect()]
    assert len(kept) == len({roots[k] if sets[k] else ("none", k) for k in range(len(rows))})
    assert jaccard_join.without_copies(docs).columns == docs.columns
    assert jaccard_join.without_copies(docs.limit(0)).count() == 0


def test_component_rounds(spark):
    links = [(k, k + 1) for k in range(0, 60) if k != 30] + [(100, 100), (7, 3), (7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 if k <= 30 else 31 for k in range(61)}


def test_statistics_of_odd_texts():
    import pyarrow as pa

    from tallygrid.llm.common import flat

    x = quality.statistics(*flat(pa.array([None, "", "a", "A A A\nA A A\n", "é" * 50, "\n"])))
    assert x.shape == (6, len(quality.STATISTICS)) and np.isfinite(x).all() and not x[:2].any()


def test_isotonic_never_falls():
    at, n, positive = np.arange(6.0), np.array([5.0, 5, 5, 5, 5, 5]), np.array([0.0, 3, 2, 2, 5, 4])
    x, p = quality.isotonic(at, n, positive)
    assert (np.diff(p) >= 0).all() and (p * 1).max() <= 1


def test_quality_scores(spark, rows, docs):
    good = [(1000 + k, " ".join(f"word{chr(97 + (k * j) % 26)}{chr(97 + j % 26)} " for j in range(60))) for k in range(150)]
    bad = [(2000 + k, f"SPAM{k % 7}!! " * 60) for k in range(150)]
    labels = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(1, None), (None, 1), (1000, 1)]
    df = frame(spark, rows + good + bad)
    out = quality.score(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(out) == len(rows) + 300
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, int(r.doc_id < 2000)) for r in out if r.held_out and r.doc_id >= 1000]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    flat = quality.score(df, spark.createDataFrame([], "doc_id long, quality int")).select("score").distinct().collect()
    assert all(abs(r.score - 0.5) < 0.01 for r in flat)
    assert quality.score(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_normal_equations(spark):
    """Ridge scores from partition sums are those of one dense solve; calibrated values are the isotonic fit's."""
    rng = np.random.default_rng(0)
    d = len(quality.STATISTICS)
    x = rng.normal(size=(400, d))
    y = (x[:, 0] + 0.5 * rng.normal(size=400) > 0).astype(float)
    part = (np.arange(400) % 3 == 2).astype(int)
    df = spark.createDataFrame([(a.tolist(), float(b), int(c)) for a, b, c in zip(x, y, part)], "x array<double>, y double, fold int").repartition(5)
    model = quality.fit(df)
    own = x[part == 0]
    direct = quality.Model(own.mean(0), own.std(0))
    z = direct.features(own)
    penalty = np.full(z.shape[1], quality.RIDGE * len(own))
    penalty[-1] = 1e-9 * len(own)
    assert model.beta == pytest.approx(np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y[part == 0]), rel=1e-6, abs=1e-8)
    raw = model.raw(x[part == 1])
    k = np.minimum((raw + 0.5) * quality.N_BINS / 2, quality.N_BINS - 1).astype(int)
    n, at, positive = (np.bincount(k, v, quality.N_BINS) for v in (None, raw, y[part == 1]))
    assert model.knots == pytest.approx(quality.isotonic(at[n > 0] / n[n > 0], n[n > 0], positive[n > 0]))


def brute_pipeline(rows, items):
    """doc_id -> text after the first four stages, for rows of (doc_id, text, source); no text has boilerplate."""
    from .test_text_operators import brute_lines, brute_secrets

    kept = [(i, t) for i, t, _ in rows if (c := brute_lines(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    _, roots, sets = brute_components(kept, 5, 80)
    first = {}
    for k, (i, t) in enumerate(kept):
        key = roots[k] if sets[k] else ("none", k)
        own = (i is None, i or 0, t)
        first[key] = min(first.get(key, own), own)
    shingles = [decontamination.shingles_of(x) for x in items]
    out = Counter()
    for none, i, t in first.values():
        own = decontamination.shingles_of(t)
        if any(s and len(s & own) >= 0.8 * len(s) for s in shingles):
            continue
        for start, _, end in reversed(brute_secrets(t)):
            t = t[:start] + "[SECRET]" + t[end:]
        out[None if none else i, t] += 1
    return out


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = documents(3)
    rows = [(i, t) for i, t in rows]
    passage = "this item of the benchmark has more than a dozen words so that it counts"
    rows += [(700, "some opening words and then " + passage + " and an end of it all"), (701, "password=hunter2hunter2 and ten more ordinary words that fill this one text up well"), (None, "without any id but with " + passage + " in the middle of it all")]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        sizes.append(docs.count())
    left = {r.doc_id: r.text for r in docs.collect()}
    assert 700 not in left and left[701].startswith("[SECRET] and ten")
    own = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    from .test_text_operators import brute_boilerplate

    assert not brute_boilerplate(own)
    expected = brute_pipeline(own, [passage])
    # Of copies the one of the least id stays; two rows of one id may hold either of its texts.
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == expected
    assert sizes == sorted(sizes, reverse=True)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(left)
