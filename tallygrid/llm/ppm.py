"""Scores of texts under a byte-level PPM model (prediction by partial matching) and under word counts.

Text as the model sees it: the words with A-Z in lower case, each followed by a
space, then one line feed as the end.  Bytes are predicted from the last
``ORDER`` bytes of this running text, spaces and earlier words included; before
the first word stands a space.  (``running=False`` cuts contexts at the space
before the word instead; the query doesn't.)  The context trie is
kept as sorted tables of byte n-grams, one for each order; the escape
probability is that of method C (distinct symbols over occurrences plus
distinct symbols), and after an escape the symbols of the longer context are
excluded from the shorter one.  Below order 0 all bytes not yet seen are alike.
The model is pretrained: the trie counts all training documents, and a text's
score is its code length in log10, summed over its bytes.

1. Each chunk of documents sends its distinct words (64-bit hashes) with their
   training counts to blocks, which add them up and answer each chunk with its
   words' counts.  Nothing is sampled or pruned.
2. Its distinct n-grams go to blocks in the same way.  A block adds its n-grams
   up and passes each on, once, to the group of its context's last two bytes,
   which holds all longer contexts that end alike and so the trie above order
   1; orders 0 and 1 (65,536 n-grams at most) go to all groups.  A group
   gives each n-gram its log probability, the block answers the chunks.  The
   trie as a whole is nowhere in one place, and ``ORDER`` holds at every size.
3. Each chunk sums its n-grams' log probabilities by document.

Defined results: null and empty texts have the end alone; a null ``doc_id`` is
never held out; repeated rows each count and get a row each; with no training
documents counts are 0 and every byte is alike; symbols of equal counts have
equal probabilities; a very long text is scored whole and by one task, whose
memory grows with it (35 MB of text took some 2 GB); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import block_count, by_block, dealt, in_order
from .common import _SPACE, checkpointed, flat, keyed, lowered, slices, table, word_hashes, words

ORDER = 4
MAX_GROUPS = 1024
SPACE, END = 0x20, 0x0A
_ROW_BITS = 24  # codes have 40 bits, so code and row are sorted as one number

_SENT = "block int, chunk int, keys binary, counts binary"
_MERGED = "kind int, chunk int, block int, n long, total long, keys binary, counts binary"
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double"
_ANSWER = "kind int, chunk int, block int, n long, counts binary"
_TOTALS = "family int, block int, keys binary, counts binary"
_LOGS = "block int, keys binary, logs binary"
_WORDS, _SUMS, _GRAMS = 0, 1, 2


def is_held_out(doc_id: int | None, remainder: int = 1) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == remainder


def _parts(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(rows, "text"):
        for start in range(0, part.num_rows, 1 << _ROW_BITS):
            yield part.slice(start, 1 << _ROW_BITS)


def codes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, order: int, running: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram of order+1 bytes, row) of every byte of the texts as the model sees them; unless ``running``, words alone."""
    n = len(first) - 1
    ends = np.cumsum(lengths + 1)
    spaces = ends - 1 + np.repeat(np.arange(n), np.diff(first))
    finish = np.concatenate(([0], ends))[first[1:]] + np.arange(n)
    symbol = np.full(len(starts) + int(lengths.sum()) + n, SPACE, np.uint64)
    inside = np.ones(len(symbol), bool)
    inside[spaces] = inside[finish] = False
    symbol[inside] = data[~_SPACE[data]]
    symbol[finish] = END
    stops = finish + 1 if running else np.sort(np.concatenate((spaces, finish))) + 1
    size = np.diff(stops, prepend=0)
    at = np.arange(len(symbol)) - np.repeat(stops - size, size)
    code = symbol.copy()
    for k in range(1, order + 1):
        before = np.zeros(len(symbol), np.uint64)
        before[k:] = symbol[:-k]
        code |= np.where(at >= k, before, np.uint64(SPACE) * (at == k - 1)) << np.uint64(8 * k)
    return code, np.repeat(np.arange(n), np.diff(finish, prepend=-1))


class _Chunk:
    """A chunk's distinct words, for each token its row and word, and its distinct n-grams."""

    def __init__(self, rows: pa.RecordBatch, order: int | None = None, running: bool = False):
        self.ids = rows.column("doc_id").to_pylist()
        self.held = np.array([is_held_out(x) for x in self.ids], bool)
        hashes, row, grams, trained = [], [], [], []
        self.runs = []  # of each part: its first row, the rows of its sorted n-grams, lengths of equal n-grams
        done = 0
        for part in _parts(rows):
            data, offsets = flat(part.column("text"))
            data = lowered(data)
            starts, lengths, first = words(data, offsets)
            hashes.append(word_hashes(data, starts, lengths))
            row.append(np.repeat(np.arange(part.num_rows), np.diff(first)) + done)
            if order is not None:
                code, owner = codes(data, starts, lengths, first, order, running)
                both = np.sort(code << np.uint64(_ROW_BITS) | owner.astype(np.uint64))
                owner = (both & np.uint64((1 << _ROW_BITS) - 1)).astype(np.int64)
                code = both >> np.uint64(_ROW_BITS)
                head = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                grams.append(code[head])
                trained.append(np.add.reduceat((~self.held[owner + done]).astype(np.int64), head))
                self.runs.append((done, owner.astype(np.int32), np.diff(np.append(head, len(code)))))
            done += part.num_rows
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.row = join(row, np.int64)
        self.keys, self.word = np.unique(join(hashes, np.uint64), return_inverse=True)
        self.trained = np.bincount(self.word, ~self.held[self.row], len(self.keys)).astype(np.int64)
        self.grams, self.gram_counts, self.place = _added(join(grams, np.uint64), join(trained, np.int64))

    def sums(self, logs: np.ndarray) -> np.ndarray:
        """Sum over each row's bytes of what ``logs`` has for its n-grams."""
        out, at = np.zeros(len(self.ids)), 0
        for first, owner, size in self.runs:
            own = np.bincount(owner, np.repeat(logs[self.place[at : at + len(size)]], size))
            out[first : first + len(own)] += own
            at += len(size)
        return out


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in four bytes each, or eight where one needs them."""
    return counts.astype("<u4" if not len(counts) or counts.max() < 1 << 32 else "<u8").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u8" if n and len(data) == 8 * n else "<u4").astype(np.int64)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their totals, and each key's place among them."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, inverse, counts)
    return distinct, total, inverse


def _blocks(grams: np.ndarray, n_blocks: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the n-grams by block, and each block's run in it."""
    block = grams * np.uint64(0x9E3779B97F4A7C15) % np.uint64(n_blocks)
    order = np.argsort(block, kind="stable")
    return order, by_block(block[order])


def _merge(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    block = key[0].as_py()
    lists = [np.frombuffer(x, np.uint64) for x in sent.column("keys").to_pylist()]
    sizes = [len(x) for x in lists]
    counts = np.concatenate([_wide(x, n) for x, n in zip(sent.column("counts").to_pylist(), sizes, strict=True)])
    _, total, inverse = _added(np.concatenate(lists), counts)
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = [(_WORDS, c, block, n, 0, None, _narrow(total[inverse[a : a + n]])) for c, n, a in zip(sent.column("chunk").to_pylist(), sizes, at.tolist(), strict=False)]
    return _table(_MERGED, [*out, (_SUMS, None, block, int((total > 0).sum()), int(total.sum()), None, None)])


class Trie:
    """The context trie as sorted tables: for each order its n-grams and its contexts.

    ``pairs`` are all n-grams of two bytes with their counts; above order 1 the trie has the contexts of ``grams``.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int, pairs: tuple[np.ndarray, np.ndarray]):
        self.order, self.levels = order, []
        below = None
        for k in range(order + 1):
            source, times = (grams, counts) if k > 1 else pairs
            codes, n, _ = _added(source & np.uint64((1 << (8 * (k + 1))) - 1), times)
            contexts, first, inverse = np.unique(codes >> np.uint64(8), return_index=True, return_inverse=True)
            total, kinds = np.bincount(inverse, n, len(contexts)), np.bincount(inverse, minlength=len(contexts))
            level = {"codes": codes, "n": n.astype(float), "of": inverse, "contexts": contexts, "total": total, "kinds": kinds.astype(float)}
            if below is not None:
                # What is left of the shorter context once this context's symbols are excluded.
                suffix = np.searchsorted(below["contexts"], contexts & np.uint64((1 << (8 * (k - 1))) - 1))
                same = np.searchsorted(below["codes"], codes & np.uint64((1 << (8 * k)) - 1))
                level["left_total"] = below["total"][suffix] - np.bincount(inverse, below["n"][same], len(contexts))
                level["left_kinds"] = below["kinds"][suffix] - level["kinds"]
            self.levels.append(level)
            below = level

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each n-gram's last byte after its other bytes."""
        out = np.zeros(len(codes))
        todo = np.arange(len(codes))
        left = np.full((len(codes), 2), -1.0)  # total and kinds after exclusion; -1: nothing is excluded
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            if not len(level["codes"]):
                continue
            code = codes[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            gram = np.minimum(np.searchsorted(level["codes"], code), len(level["codes"]) - 1)
            seen = level["codes"][gram] == code
            context = code >> np.uint64(8)
            place = np.minimum(np.searchsorted(level["contexts"], context), len(level["contexts"]) - 1)
            known = level["contexts"][place] == context
            excluded = left[todo, 0] >= 0
            total = np.where(excluded, left[todo, 0], level["total"][place])
            kinds = np.where(excluded, left[todo, 1], level["kinds"][place])
            whole = np.maximum(total + kinds, 1e-300)
            out[todo[seen]] += np.log10(level["n"][gram[seen]] / whole[seen])
            escape = known & ~seen & (kinds > 0)
            out[todo[escape]] += np.log10(kinds[escape] / whole[escape])
            if k:
                missed = known & ~seen
                left[todo[missed], 0] = level["left_total"][place[missed]]
                left[todo[missed], 1] = level["left_kinds"][place[missed]]
            todo = todo[~seen]
        seen_bytes = self.levels[0]["kinds"].sum()
        if len(todo):
            out[todo] -= np.log10(256 - seen_bytes)
        return out


def pair_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The training documents' n-grams of two bytes with their counts; 65,536 at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            train = batch.filter(pa.array([not is_held_out(x) for x in batch.column("doc_id").to_pylist()], pa.bool_()))
            for part in _parts(train):
                data, offsets = flat(part.column("text"))
                data = lowered(data)
                total += np.bincount(codes(data, *words(data, offsets), 1)[0].astype(np.int64), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["code", "n"])

    rows = keyed(docs).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    return np.array([r.code for r in rows], np.uint64), np.array([r.n for r in rows], np.int64)


def score(docs: DataFrame, order: int = ORDER, max_grams: int | None = None, running: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  ``max_grams`` has no effect: the order holds at every size."""
    spark = docs.sparkSession
    rows, n_chunks = dealt(docs)
    n_blocks = block_count(n_chunks)
    n_groups = min(n_blocks, MAX_GROUPS)
    chunks = rows.groupBy("chunk")

    def gather_words(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        chunk, number = _Chunk(in_order(own)), key[0].as_py()
        block = chunk.keys % np.uint64(n_blocks)
        at = np.argsort(block, kind="stable")
        return _table(_SENT, [(b, number, chunk.keys[at[s:e]].tobytes(), _narrow(chunk.trained[at[s:e]])) for b, s, e in by_block(block[at])])

    merged = checkpointed(chunks.applyInArrow(gather_words, _SENT).groupBy("block").applyInArrow(_merge, _MERGED))
    pairs = pair_counts(docs)
    n_train = int(pairs[1][pairs[0] & np.uint64(0xFF) == END].sum())  # a text has one end
    sums = merged.filter(F.col("kind") == _SUMS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()
    distinct, tokens = sums["v"] + (n_train > 0), sums["n"] + n_train
    short = spark.sparkContext.broadcast(pairs)

    def gather_grams(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        chunk, number = _Chunk(in_order(own), order, running), key[0].as_py()
        at, blocks = _blocks(chunk.grams, n_blocks)
        return _table(_SENT, [(b, number, chunk.grams[at[s:e]].tobytes(), _narrow(chunk.gram_counts[at[s:e]])) for b, s, e in blocks])

    def add_up(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in sent.column("keys").to_pylist()]
        counts = np.concatenate([_wide(x, len(k)) for x, k in zip(sent.column("counts").to_pylist(), lists, strict=True)])
        grams, total, _ = _added(np.concatenate(lists), counts)
        at, groups = _blocks(grams >> np.uint64(8) & np.uint64(0xFFFF), n_groups)
        return _table(_TOTALS, [(g, key[0].as_py(), grams[at[s:e]].tobytes(), _narrow(total[at[s:e]])) for g, s, e in groups])

    def solve(key: tuple[pa.Scalar, ...], totals: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, np.uint64) for x in totals.column("keys").to_pylist()]
        counts = np.concatenate([_wide(x, len(k)) for x, k in zip(totals.column("counts").to_pylist(), lists, strict=True)])
        grams = np.concatenate(lists)
        trie = Trie(grams[counts > 0], counts[counts > 0], order, short.value)
        logs = np.split(trie.log10(grams), np.cumsum([len(x) for x in lists])[:-1])
        return _table(_LOGS, [(b, k.tobytes(), x.tobytes()) for b, k, x in zip(totals.column("block").to_pylist(), lists, logs, strict=True)])

    def answer(key: tuple[pa.Scalar, ...], sent: pa.Table, solved: pa.Table) -> pa.Table:
        grams = np.concatenate([np.frombuffer(x, np.uint64) for x in solved.column("keys").to_pylist()])
        logs = np.concatenate([np.frombuffer(x, np.float64) for x in solved.column("logs").to_pylist()])
        at = np.argsort(grams)
        grams, logs = grams[at], logs[at]
        lists = [np.frombuffer(x, np.uint64) for x in sent.column("keys").to_pylist()]
        found = zip(sent.column("chunk").to_pylist(), lists, strict=True)
        return _table(_ANSWER, [(_GRAMS, c, key[0].as_py(), len(x), logs[np.searchsorted(grams, x)].tobytes()) for c, x in found])

    sent = chunks.applyInArrow(gather_grams, _SENT)
    solved = sent.groupBy("block").applyInArrow(add_up, _TOTALS).groupBy("family").applyInArrow(solve, _LOGS)
    answers = sent.groupBy("block").cogroup(solved.groupBy("block")).applyInArrow(answer, _ANSWER)
    answers = answers.unionByName(merged.filter(F.col("kind") == _WORDS).select("kind", "chunk", "block", "n", "counts"))

    def finish(key: tuple[pa.Scalar, ...], own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _table(_RESULT, [])
        chunk = _Chunk(in_order(own), order, running)
        block = chunk.keys % np.uint64(n_blocks)
        at = np.argsort(block, kind="stable")
        known = {(k, b): (n, c) for k, b, n, c in zip(*(answers.column(x).to_pylist() for x in ("kind", "block", "n", "counts")), strict=True)}
        count = np.zeros(len(chunk.keys), np.int64)
        for b, s, e in by_block(block[at]):
            n, c = known[_WORDS, b]
            count[at[s:e]] = _wide(c, n)
        logs = np.zeros(len(chunk.grams))
        at, blocks = _blocks(chunk.grams, n_blocks)
        for b, s, e in blocks:
            logs[at[s:e]] = np.frombuffer(known[_GRAMS, b][1], np.float64)
        n = len(chunk.ids)
        per_doc = lambda x: np.bincount(chunk.row, x[chunk.word], n)
        n_tokens = np.bincount(chunk.row, minlength=n) + 1
        seen = per_doc((count > 0).astype(float)).astype(np.int64) + (n_train > 0)
        base = per_doc(np.log10(count + 0.5)) + np.log10(n_train + 0.5)
        columns = [pa.array(chunk.ids, pa.int64()), pa.array(chunk.held), pa.array(n_tokens), pa.array(seen), pa.array(base), pa.array(chunk.sums(logs))]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in _RESULT.split(", ")])

    out = chunks.cogroup(answers.groupBy("chunk")).applyInArrow(finish, _RESULT)
    scale = float(np.log10(tokens + 0.5 * (distinct + 1)))
    base = F.col("log_counts") - F.col("n_tokens") * F.lit(scale)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), running=True)
