"""Exact SentencePiece BPE encoding and decoding with a merge-type prefix table.

BPE has one encoding for each text, and any prefix of an encoding's pieces is the encoding of
their text. So each prefix of a segment has one last piece. An automaton over all longer pieces
lists those that end at each place; the last piece is the one that is compatible with the last piece
of the prefix before it, that is, BPE of the two together leaves the two as they are, and where
none is, the last character. The table
of last pieces is filled from left to right and the ids are read off backwards.

Segments end where no piece reaches across: after a run of white space marks and the letters
behind it, and on both sides of a character outside the vocabulary, which falls back to bytes.
Within a partition a worker remembers the short segments it met last, up to 2 * ``REMEMBERED`` (about
30 MB), and then forgets them, as an idle worker keeps its memory. It keeps the pairs of pieces that it has
tested, up to ``TESTED`` (nine bytes each when idle), which later texts need again. This changes nothing but time.
A worker comes from earlier steps: freed memory that it still holds is given back before and after.

Only identity-normalised BPE models with byte fallback are accepted.

Nulls, ties and odd inputs: a null text is empty and encodes to the end id alone; rows are
independent, so repeated rows give repeated results; an empty table gives an empty result.
Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
REMEMBERED = 75_000
TESTED = 340_000
LONGEST_REMEMBERED = 64
BATCH_BYTES = 1_000_000
BETWEEN = b"\xff"  # never in UTF-8
NONE = float("inf")


def read_model(path: str) -> tuple[tuple[str, float, int], ...]:
    """(piece, score, type) of each id."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, trained = model.normalizer_spec, model.trainer_spec
    if trained.model_type != 2 or not trained.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        raise ValueError("only identity-normalised BPE models with byte fallback and a dummy prefix are supported")
    pieces = tuple((p.piece, p.score, p.type) for p in model.pieces)
    if any(kind == 4 or kind == 1 and (MARK in piece.lstrip(MARK) or "\n" in piece[1:]) for piece, _, kind in pieces):
        raise ValueError("user-defined pieces and pieces that span words or lines are not supported")
    return pieces


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, pieces: tuple[tuple[str, float, int], ...]):
        self.ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.rank = {p: -score for p, score, kind in pieces if kind == 1}
        self.byte_ids = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.end = next(k for k, (p, _, kind) in enumerate(pieces) if p == "</s>" and kind == 3)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.automaton = ahocorasick.Automaton()
        self.whole = {p: [k] for p, k in self.ids.items() if self.merged(p) == [p]}  # others never appear in an encoding
        for p, (k,) in self.whole.items():
            if len(p) > 1:
                self.automaton.add_word(p, (k, len(p)))
        self.automaton.make_automaton()
        self.decimal = [b"%d" % k for k in range(len(pieces))]
        self.outside = re.compile("([^" + "".join(re.escape(c) for c in self.ids if len(c) == 1) + "]+)")
        self.names = [p for p, _, _ in pieces]
        self.sizes = [len(p) for p in self.names]
        self.packed = np.empty(0, np.int64), np.empty(0, bool)
        self.compatible: dict[int, bool] = {}  # by left id * number of pieces + right id
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def rest(self) -> None:
        """Forgets the segments and keeps the tested pairs in two arrays: small objects that stay would hold on to the memory of those that go."""
        self.packed = np.fromiter(self.compatible, np.int64, len(self.compatible)), np.fromiter(self.compatible.values(), bool, len(self.compatible))
        self.compatible, self.known, self.older = {}, {}, {}

    def wake(self) -> None:
        pairs, fits = self.packed
        self.compatible = dict(zip(pairs.tolist(), fits.tolist()))

    def merged(self, text: str) -> list[str]:
        """BPE by definition, for the few characters of one or two pieces: best score first, leftmost among equals."""
        parts, rank = list(text), self.rank.get
        scores = [rank(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while scores and (best := min(scores)) < NONE:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = rank(parts[k - 1] + parts[k], NONE)
            if k < len(scores):
                scores[k] = rank(parts[k] + parts[k + 1], NONE)
        return parts

    def fits(self, pair: int) -> bool:
        if len(self.compatible) > TESTED:
            self.compatible.clear()
        a, b = (self.names[k] for k in divmod(pair, len(self.names)))
        known = self.compatible[pair] = self.merged(a + b) == [a, b]
        return known

    def inside(self, text: str) -> list[int]:
        """Ids of a segment whose characters are all in the vocabulary."""
        if (known := self.whole.get(text)) is not None:
            return known
        last = [-1] * (len(text) + 1)  # the table: last pieces of the prefixes; where no longer piece fits it is the last character, looked up when asked for
        tested, n, ids = self.compatible.get, len(self.names), self.ids
        for end, (piece, size) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if before := end - size:
                if (left := last[before]) < 0:
                    left = last[before] = ids[text[before - 1]]
                pair = left * n + piece
                if (fits := tested(pair)) is None:
                    fits = self.fits(pair)
                if not fits:
                    continue
            last[end] = piece
        sizes, out, at = self.sizes, [], len(text)
        while at:
            if (piece := last[at]) < 0:
                piece = ids[text[at - 1]]
            out.append(piece)
            at -= sizes[piece]
        return out[::-1]

    def segment(self, text: str) -> list[int]:
        if self.outside.search(text) is None:
            return self.inside(text)
        out: list[int] = []
        for k, part in enumerate(self.outside.split(text)):
            if part:
                out += [self.byte_ids[b] for b in part.encode()] if k % 2 else self.inside(part)
        return out

    def remembered(self, key: str) -> bytes:
        """Ids in decimal, and their bytes, of a segment, as one object with ``BETWEEN`` between them; key: as encode() splits texts."""
        if (found := self.older.get(key)) is None:
            ids = self.segment(key if key[:1] in ("\n", MARK) else MARK + key)
            decimal = self.decimal
            found = b" ".join([decimal[i] for i in ids]) + BETWEEN + self.raw(ids)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[key] = found
        return found

    def raw(self, ids: list[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts first."""
        return self.text_of(self.raw(ids))

    @staticmethod
    def text_of(raw: bytes) -> str:
        return raw.removeprefix(b" ").decode("utf-8", "replace")

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids in decimal joined by one space, the end id last, and the text decoded from them."""
        if not text:
            return b"%d" % self.end, ""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " ":
            keys = re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
            keys = [x for key in keys for x in re.split("(?=\n)", key) if x]
        else:  # a line's end starts a segment of its own, without a mark
            keys = text.replace("\n", " \n").split(" ")
        known, make = self.known, self.remembered
        found = BETWEEN.join([known.get(key) or make(key) for key in keys]).split(BETWEEN)
        return b" ".join(found[::2]) + b" %d" % self.end, self.text_of(b"".join(found[1::2]))


def give_back() -> None:
    """Returns to the system what this process has freed, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@lru_cache(maxsize=2)
def codec(pieces: tuple[tuple[str, float, int], ...]) -> Codec:
    """One codec for each model in a worker, kept from task to task."""
    return Codec(pieces)


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space, end id last) and decoded text of each row.

    The model is read once, by the driver; its vocabulary, of fixed size, goes to the tasks.
    """
    pieces = read_model(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own = codec(pieces)
        own.wake()
        try:
            yield from encoded(batches, own.encode)
        finally:
            own.rest()
            give_back()

    def encoded(batches: Iterator[pa.RecordBatch], make: Callable[[str], tuple[bytes, str]]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids, decoded = make(text.as_py() or "")
                rows.append((doc_id.as_py(), ids.count(b" ") + 1, ids.decode(), decoded))
                size += len(ids)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")
