"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A length r belongs to the reciprocal class j with C/(j+1) < r <= C/j, and a bin of class j takes exactly j
pieces, so a class fills its bins by counting alone and every worker packs its own documents without a shuffle.
Plain harmonic bins waste up to C/(j+1) each. Documents may be cut, so a piece that would leave more than
``slack`` of its slot empty gives a part of exactly C/(j+1) to the next class and goes on with the rest; lengths
up to C/``classes`` form the last class, which is filled next-fit and cut at the end of its bin. The bins that
are still open when a worker ends are joined, cut at C, and the last of them into powers of two, which need no
padding.

Defined results: a null text is an empty one and gives the end id alone; a null id is kept; repeated rows are
packed each; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import keyed_texts, text_slices

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordTokenizer:
    """ids of a text as little-endian unsigned 32-bit integers, equal to those of Tokenizer.encode.

    The vocabulary's own pipeline treats runs between white space alone, so a run's ids are looked up after its
    first occurrence. Runs below U+0100 go straight to the model, others through the whole pipeline.
    """

    #: bytes of a lookup before it starts afresh (with what Python needs for an entry); bounds a worker's memory and
    #: never changes a result
    MEMO, ENTRY = 150 << 20, 200

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.mark = min((s[:2] for s in self.special), default="<|")
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.odd_space = re.compile("[\x1c-\x1f]").search  # white space for str.split, not for the vocabulary
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.visible = {b: chr(b) if b in kept else chr(next(spare)) for b in range(256)}
        self.runs: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.runs_size = self.parts_size = 0

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _part(self, part: str) -> bytes:
        if (out := self.parts.get(part)) is None:
            shown = part if part.isascii() else "".join(map(self.visible.__getitem__, part.encode()))
            out = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(shown))
            if self.parts_size > self.MEMO:
                self.parts.clear()
                self.parts_size = 0
            self.parts[part] = out
            self.parts_size += self.ENTRY + 4 * len(part) + len(out)
        return out

    def _run(self, run: str) -> bytes:
        if self.mark in run or not run.isprintable() or max(run) >= "Ā":
            return self._whole(run)
        return b"".join(map(self._part, self.pieces(run.lower())))

    def __call__(self, text: str) -> bytes:
        if self.odd_space(text):
            return self._whole(text)
        runs, known = text.split(), self.runs
        try:
            return b"".join([known[r] for r in runs])
        except KeyError:
            if self.runs_size > self.MEMO:
                known.clear()
                self.runs_size = 0
            for r in set(runs).difference(known):
                known[r] = self._run(r)
                self.runs_size += self.ENTRY + 4 * len(r) + len(known[r])
            return b"".join([known[r] for r in runs])


class HarmonicPacker:
    """Packs one worker's documents; emits (sequence_id, offset, document, start, length) as bins close."""

    def __init__(self, capacity: int, classes: int, slack: float, first_sequence: int, emit: Callable):
        self.capacity, self.classes, self.slack, self.emit = capacity, min(classes, capacity), slack, emit
        self.sequence = first_sequence
        self.open: dict[int, list] = {}
        self.small: list = []
        self.small_fill = 0

    def _close(self, pieces: list) -> None:
        offset = 0
        for document, start, length in pieces:
            self.emit(self.sequence, offset, document, start, length)
            offset += length
        self.sequence += 1

    def _small(self, document, start: int, length: int) -> None:
        while length:
            take = min(length, self.capacity - self.small_fill)
            self.small.append((document, start, take))
            self.small_fill += take
            start, length = start + take, length - take
            if self.small_fill == self.capacity:
                self._close(self.small)
                self.small, self.small_fill = [], 0

    def add(self, document, total: int) -> None:
        c, start = self.capacity, 0
        while total - start >= c:
            self._close([(document, start, c)])
            start += c
        while rest := total - start:
            j = c // rest
            if j >= self.classes:
                self._small(document, start, rest)
                return
            if (slot := c // j) - rest > self.slack * slot:
                j += 1
                rest = c // j
            pieces = self.open.setdefault(j, [])
            pieces.append((document, start, rest))
            start += rest
            if len(pieces) == j:
                self._close(self.open.pop(j))

    def finish(self) -> None:
        left = [p for j in sorted(self.open) for p in self.open[j]] + self.small
        self.open, self.small, self.small_fill = {}, [], 0
        need = sum(p[2] for p in left)
        at, used = 0, 0
        while need:
            size = min(self.capacity, 1 << (need.bit_length() - 1)) if need < self.capacity else self.capacity
            need -= size
            bin_ = []
            while size:
                document, start, length = left[at]
                take = min(size, length - used)
                bin_.append((document, start + used, take))
                size, used = size - take, used + take
                if used == length:
                    at, used = at + 1, 0
            self._close(bin_)


def pack(
    df: DataFrame,
    vocabulary: str | None = None,
    capacity: int = 2048,
    end_id: int = 1,
    classes: int = 32,
    slack: float = 1 / 32,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece, with its ids (little-endian unsigned 32-bit) and its place in a sequence."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    end = end_id.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer(path)
        rows: list = []
        size = 0

        def emit(sequence, offset, document, start, length):
            nonlocal size
            doc_id, ids, total = document
            rows.append((doc_id, start, length, total, sequence, offset, ids[4 * start : 4 * (start + length)]))
            size += 4 * length

        def flush():
            nonlocal size
            columns = list(zip(*rows, strict=True))
            rows.clear()
            size = 0
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in columns[:6]] + [pa.array(columns[6], pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        packer = HarmonicPacker(capacity, classes, slack, TaskContext.get().partitionId() << 32, emit)
        for batch in text_slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                packer.add((doc_id, ids, len(ids) // 4), len(ids) // 4)
                if size > 8 << 20:
                    yield flush()
        packer.finish()
        if rows:
            yield flush()

    return keyed_texts(df, id_col, text_col).mapInArrow(work, SCHEMA)
