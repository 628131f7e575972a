"""Vector bin packing of token pieces into fixed-length training sequences.

Every piece has a vector of demands (tokens, segments, loss-bearing tokens) and
every sequence a capacity for each.  Sequences are filled one at a time by the
dot-product heuristic: of the pieces in a pool that fit, the one whose demand
has the largest scaled dot product with the remaining capacity goes in next.
The pool is refilled from the stream after each closed sequence, so a task
holds ``POOL`` pieces and what is over of the last document, whose pieces come
in at once; nothing is shuffled.

A document longer than a sequence is cut at the sequence length.  If nothing
in the pool fits into what is left of a sequence and at least ``MIN_FILL``
tokens are free, a piece is cut to fill it (``cut=False`` never does that).
What remains at the end of a task's stream is laid out in sequences whose
lengths are powers of two, which need no padding.

Sequence ids are the task's partition in the high bits and a counter in the
low 40: unique without coordination and the same when a task runs again.

Words of one 64-bit hash count as one word when ids are looked up.

Defined results: a null text is empty; an empty document is its end id alone; repeated
rows and null ``doc_id`` are packed like any other row; a very long text is cut
into many pieces; of pieces with the same dot product the first in the pool
goes in; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import _SPACE, flat, keyed, lowered, slices, table, word_hashes

SEQUENCE = 2048
MAX_SEGMENTS = 128
END_ID = 1
POOL = 1024
MIN_FILL = 16
#: Words whose ids a worker keeps; then it starts afresh.
CACHED_WORDS = 300_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Limits:
    tokens: int = SEQUENCE
    segments: int = MAX_SEGMENTS
    loss: int = SEQUENCE


@dataclass
class Piece:
    row: tuple  # what the caller knows about the document
    start: int
    ids: bytes  # little-endian unsigned 32-bit
    loss: bytes  # a byte for each id: 1 where it bears loss

    def __len__(self) -> int:
        return len(self.loss)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.row, self.start, self.ids[: 4 * n], self.loss[:n]), Piece(self.row, self.start + n, self.ids[4 * n :], self.loss[n:])


class _Pool:
    """Pieces and their demands in columns."""

    def __init__(self, limits: Limits):
        self.scale = 1.0 / np.array([limits.tokens, limits.segments, limits.loss], float) ** 2
        self.pieces: list[Piece] = []
        self.demand = np.zeros((0, 3))

    def extend(self, pieces: list[Piece]) -> None:
        if pieces:
            self.pieces += pieces
            self.demand = np.vstack((self.demand, [(len(p), 1, p.loss.count(1)) for p in pieces]))

    def take(self, k: int) -> Piece:
        piece, last = self.pieces[k], self.pieces.pop()
        if k < len(self.pieces):
            self.pieces[k], self.demand[k] = last, self.demand[-1]
        self.demand = self.demand[:-1]
        return piece

    def best(self, left: np.ndarray) -> int:
        """The piece that fits with the largest dot product, or -1."""
        fits = (self.demand <= left).all(axis=1)
        if not fits.any():
            return -1
        return int(np.argmax(np.where(fits, self.demand @ (left * self.scale), -1.0)))


def pack(pieces: Iterable[Piece], limits: Limits = Limits(), cut: bool = True, pool_size: int = POOL) -> Iterator[list[Piece]]:
    """Sequences of pieces within all limits; every token of every piece is in exactly one."""
    pool, stream, ended = _Pool(limits), iter(pieces), False
    top = np.array([limits.tokens, limits.segments, limits.loss], float)
    while True:
        fresh: list[Piece] = []
        while not ended and len(pool.pieces) + len(fresh) < pool_size:
            piece = next(stream, None)
            if piece is None:
                ended = True
                break
            while (n := _longest(piece, limits)) < len(piece):
                head, piece = piece.cut(n)
                fresh.append(head)
            fresh.append(piece)
        pool.extend(fresh)
        if not pool.pieces:
            return
        left, sequence = top.copy(), []
        while pool.pieces:
            if (k := pool.best(left)) < 0:
                n = int(left[0])
                if not cut or n < MIN_FILL or left[1] < 1:
                    break
                whole = pool.take(int(np.argmax(pool.demand[:, 0])))
                n = min(_longest(whole, Limits(n, 1, int(left[2]))), len(whole) - 1)
                if n < MIN_FILL:
                    pool.extend([whole])
                    break
                head, rest = whole.cut(n)
                sequence.append(head)
                pool.extend([rest])
                break
            piece = pool.take(k)
            sequence.append(piece)
            left -= (len(piece), 1, piece.loss.count(1))
            if left[0] == 0:
                break
        if cut and ended and not pool.pieces and left[0] > 0:
            yield from _powers(sequence)
        else:
            yield sequence


def _longest(piece: Piece, limits: Limits) -> int:
    """Tokens at the piece's start within the limits."""
    n = min(len(piece), limits.tokens)
    if piece.loss.count(1, 0, n) > limits.loss:
        n = int(np.searchsorted(np.cumsum(np.frombuffer(piece.loss[:n], np.uint8)), limits.loss, "right"))
    return max(1, n)


def _powers(sequence: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces in sequences whose lengths are falling powers of two."""
    total = sum(map(len, sequence))
    while total:
        room, out = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            piece = sequence.pop(0)
            if len(piece) > room:
                piece, rest = piece.cut(room)
                sequence.insert(0, rest)
            out.append(piece)
            room -= len(piece)
        yield out


class Merger:
    """The byte-pair merges of a vocabulary with word ends, for many words of letters at once.

    A word is a row of ids; in each round every row's leftmost pair of least
    rank is merged, until no row has a pair of the list.  The tokenizer does
    the same word by word.
    """

    NEVER = np.int32(2**31 - 1)

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str):
        # Bytes stand for themselves where they print, and for 256 and on, in order, where not.
        printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printing]
        sign = {b: chr(b) for b in printing} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.inner = np.array([vocabulary[sign[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[sign[b] + end] for b in range(256)], np.int32)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        left, right = np.repeat(self.inner, 256), np.stack((np.tile(self.inner, 256), np.tile(self.last, 256)))
        self.bytes = np.stack([self._rank(left, r).reshape(256, 256) for r in right])

    @classmethod
    def of(cls, tokenizer: dict) -> Merger | None:
        """None for a kind of model that this doesn't cover."""
        model = tokenizer["model"]
        if model.get("type") != "BPE" or not model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, model["end_of_word_suffix"])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], self.NEVER)

    def encode(self, data: list[bytes]) -> list[bytes]:
        order = sorted(range(len(data)), key=lambda k: len(data[k]))
        out: list[bytes] = [b""] * len(data)
        for at in range(0, len(order), 4096):
            own = order[at : at + 4096]
            for k, ids in zip(own, self._merge([data[k] for k in own]), strict=True):
                out[k] = ids
        return out

    def _merge(self, data: list[bytes]) -> list[bytes]:
        sizes = np.array([len(x) for x in data])
        width = int(sizes.max())
        # One column more than needed, so that each pair has a right-hand side; -1 is no id.
        ids = np.full((len(data), width + 1), -1, np.int32)
        flat = np.frombuffer(b"".join(data), np.uint8)
        row, column = np.repeat(np.arange(len(data)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids[row, column] = self.inner[flat]
        finish = np.cumsum(sizes) - 1
        ids[np.arange(len(data)), sizes - 1] = self.last[flat[finish]]
        # Pairs of bytes have their ranks in a table, by whether the second ends the word.
        ranks = np.full((len(data), width), self.NEVER, np.int32)
        ended = np.zeros(len(flat), np.int64)
        ended[finish] = 1
        pair = np.flatnonzero(np.diff(row, append=-1) == 0)
        ranks[row[pair], column[pair]] = self.bytes[ended[pair + 1], flat[pair], flat[pair + 1]]
        todo, done, columns = np.arange(len(data)), np.full_like(ids, -1), np.arange(width + 1)
        while len(todo):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(todo)), at]
            ended = best == self.NEVER
            done[todo[ended], : ids.shape[1]] = ids[ended]
            todo, ids, ranks, at, best = (x[~ended] for x in (todo, ids, ranks, at, best))
            if not len(todo):
                break
            n = np.arange(len(todo))
            ids[n, at] = self.merged[best]
            source = columns + (columns > at[:, None])
            ids = np.where(source <= width, np.take_along_axis(ids, np.minimum(source, width), 1), -1)
            ranks = np.where(source[:, :-1] < width, np.take_along_axis(ranks, np.minimum(source[:, :-1], width - 1), 1), self.NEVER)
            ranks[n, at] = self._rank(ids[n, at], ids[n, at + 1])
            left = np.maximum(at - 1, 0)
            ranks[n, left] = np.where(at > 0, self._rank(ids[n, left], ids[n, left + 1]), ranks[n, left])
        counts = (done >= 0).sum(1)
        whole = done[done >= 0].astype("<u4").tobytes()
        ends = np.cumsum(counts) * 4
        return [whole[e - 4 * c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


# The normaliser and pre-tokenizer under which a text's ids are its words' ids in a row, whatever the case.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_words(tokenizer: dict) -> bool:
    """Whether the tokenizer lower-cases, splits at white space, and splits off a mark after a letter."""
    steps = (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first, rest = steps[0], steps[1:]
    return (
        tokenizer.get("normalizer") == _NORMALIZER
        and first.get("type") == "Split" and first.get("pattern") == {"Regex": _SPLITTER} and first.get("behavior") == "Removed" and first.get("invert") is True
        and [(s.get("type"), s.get("add_prefix_space"), s.get("use_regex")) for s in rest] == [("ByteLevel", False, False)]
        and all(t["content"].startswith("<|") and not t.get("normalized") for t in tokenizer.get("added_tokens") or [])
    )


#: Kinds of bytes between which the splitter always splits: small letters, marks but the apostrophe, digits (which stand alone); 0 for all others.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127], _KIND[39] = 2, 0
_KIND[97:123], _KIND[48:58] = 1, 3
_LETTERS_AND_MARKS = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]+)")


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of the parts of words in lower-cased texts, and the number of parts before each text."""
    kind, solid = _KIND[data], ~_SPACE[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = ~solid[:-1] | ((kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 3)))
    cut[offsets] = True
    starts = np.flatnonzero(solid & cut[:-1])
    ends = np.flatnonzero(solid & (cut[1:] | np.append(~solid[1:], True))) + 1 if len(data) else starts
    return starts, ends - starts, np.searchsorted(starts, offsets)


class WordIds:
    """Token ids of texts.  Where the tokenizer splits at words, the ids of distinct words are kept and texts are put together from them; else it takes whole texts."""

    tried = False

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            what = json.load(f)
        self.by_word = splits_at_words(what)
        self.merger = Merger.of(what) if self.by_word else None
        self._forget()

    @classmethod
    def of(cls, path: str) -> WordIds:
        """One for each worker process and file; workers outlive tasks."""
        kept = sys.modules.setdefault("_kept_word_ids", types.ModuleType("_kept_word_ids")).__dict__
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _forget(self) -> None:
        self.known: dict[int, int] = {}  # hash of a word to its place
        self.ids, self.begin, self.count = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 10_000):
            found = self.tokenizer.encode_batch_fast(texts[at : at + 10_000], add_special_tokens=False)
            out += [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]
        return out

    def _learn(self, hashes: list[int], fresh: list[bytes], small: np.ndarray) -> None:
        """Keeps the ids of words; ``small`` marks those of a-z alone."""
        found: list[bytes] = [b""] * len(fresh)
        plain, others = np.flatnonzero(small).tolist(), np.flatnonzero(~small).tolist()
        if plain and self.merger and not self.tried:  # the merger has to agree with the tokenizer before it is trusted
            self.tried = True
            sample = [fresh[k] for k in plain[:300]]
            if self._encoded([w.decode() for w in sample]) != self.merger.encode(sample):
                self.merger = None
        if not self.merger:
            plain, others = [], list(range(len(fresh)))
        texts = [fresh[k].decode() for k in others]
        if self.merger:  # letters of one or two bytes, lower-cased, merge alike; marks after them are split off
            split = [_LETTERS_AND_MARKS.fullmatch(t.lower()) if max(t) < "\u0100" else None for t in texts]
            letters = [k for k, t, m in zip(others, texts, split, strict=True) if not m and t.isalpha() and max(t) < "\u0100"]
            marked = {k: m.groups() for k, m in zip(others, split, strict=True) if m}
            stems = self.merger.encode([t.encode() for t in (*[fresh[k].decode().lower() for k in letters], *[m[0] for m in marked.values()])])
            marks = sorted({m[1] for m in marked.values()})
            marks = dict(zip(marks, self._encoded(marks), strict=True))
            for k, ids in zip((*letters, *marked), stems, strict=True):
                found[k] = ids + marks[marked[k][1]] if k in marked else ids
            others = sorted(set(others).difference(letters, marked))
            texts = [fresh[k].decode() for k in others]
        for own, ids in ((plain, self.merger.encode([fresh[k] for k in plain]) if plain else []), (others, self._encoded(texts))):
            for k, x in zip(own, ids, strict=True):
                found[k] = x
        count = np.array([len(x) // 4 for x in found], np.int64)
        self.known.update(zip(hashes, range(len(self.begin), len(self.begin) + len(fresh)), strict=True))
        self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(found), "<u4")))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        data, offsets = flat(texts)
        whole = data.tobytes()
        if not self.by_word or b"<|" in whole:  # or there may be a special token
            return self._encoded([whole[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        if len(self.known) > CACHED_WORDS:
            self._forget()
        data = lowered(data)
        starts, lengths, first = _pieces(data, offsets)
        distinct, where, inverse = np.unique(word_hashes(data, starts, lengths), return_index=True, return_inverse=True)
        numbers = distinct.tolist()
        slots = list(map(self.known.get, numbers))
        new = [k for k, slot in enumerate(slots) if slot is None]
        if new:
            at, whole = where[new], data.tobytes()
            fresh = [whole[a:b] for a, b in zip(starts[at].tolist(), (starts[at] + lengths[at]).tolist(), strict=True)]
            small = np.concatenate(([0], np.cumsum(_KIND[data] == 1)))
            self._learn([numbers[k] for k in new], fresh, small[starts[at] + lengths[at]] - small[starts[at]] == lengths[at])
            for k in new:
                slots[k] = self.known[numbers[k]]
        slot = np.array(slots, np.int64)[inverse]
        size = self.count[slot]
        ends = np.cumsum(size)
        out = self.ids[np.repeat(self.begin[slot] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = (np.concatenate(([0], ends))[first] * 4).tolist()
        raw = out.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limits: Limits = Limits(), cut: bool = True) -> DataFrame:
    """One row for each piece.  A document's first token has nothing before it to be predicted from, so it bears no loss."""
    path = tokenizer or default_tokenizer()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        ids_of, end = WordIds.of(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), ids_of.encode(part.column("text")), strict=True):
                    ids += end
                    yield Piece((doc_id, len(ids) // 4), 0, ids, b"\0" + b"\1" * (len(ids) // 4 - 1))

    return keyed(docs).mapInArrow(lambda batches: _rows(pack(pieces(batches), limits, cut)), SCHEMA)


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


SCHEMA = ", ".join(f"{name} long" for name in COLUMNS)


def _rows(sequences: Iterable[list[Piece]]) -> Iterator[pa.RecordBatch]:
    """A row for each piece; the sequences are numbered from the task's partition on."""
    base, rows = TaskContext.get().partitionId() << 40, []
    for k, sequence in enumerate(sequences):
        offset = 0
        for p in sequence:
            rows.append((p.row[0], p.start, len(p), zlib.crc32(p.ids), p.row[1], base + k, offset, p.loss.count(1)))
            offset += len(p)
        if len(rows) >= 10_000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], list(COLUMNS))


def pack_conversations(turns: DataFrame, tokenizer: str | None = None, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """Instruction data: one example a conversation, its turns in order; the tokens of ``assistant`` turns bear loss.

    Columns conv_id, turn, role, text.  Rows as of :func:`pack_documents`, with conv_id as doc_id.
    """
    from pyspark.sql import functions as F

    path = tokenizer or default_tokenizer()
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        ids_of, end = WordIds.of(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for doc_id, turns in zip(batch.column("doc_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                ids, loss = [], []
                for t, own in zip(turns, ids_of.encode(pa.array([t["text"] for t in turns], pa.string())), strict=True):
                    ids += (own, end)
                    loss.append((b"\1" if t["role"] == "assistant" else b"\0") * (len(own) // 4 + 1))
                yield Piece((doc_id, sum(map(len, loss))), 0, b"".join(ids), b"".join(loss))

    return whole.mapInArrow(lambda batches: _rows(pack(examples(batches), limits, cut)), SCHEMA)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
