"""Operator 13: which tokens of two tokenizers stand for each other, by inverted pair bitmaps.

Tokens of both sides are laid over a text's bytes; where tokens of both end, a group ends, and
all pairs of a group are links. Documents are dealt into blocks and every pair of ids gets one
container a block: a compressed bitmap of the block's documents that hold the pair, with the link
counts of these documents in bit planes. The containers of a pair have disjoint documents, so
their OR has the sum of their popcounts as its document count. Counts go back to the containers,
and each container hands its documents their scores.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

MARK = "▁"
RIGHT_BITS = 15  # a pair is (left id << RIGHT_BITS) + right id
DOC_BITS = 16
DENSE = 1 << (DOC_BITS - 4)  # from so many documents on a plain bitmap is the smaller one
SMALL = 256  # groups of more links are counted by distinct ids first
ENTRIES = 1 << 21  # (pair, document) entries that close a block
SLICE = 1 << 20
CONTAINER = "pair bigint, n int, bits binary, planes binary"


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable bytes of Latin-1
    stand for themselves, the others for the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Left:
    """A byte-level BPE vocabulary file. Special tokens are not matched."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_alphabet()
        written = lambda token: bytes(letters[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rank = [model["vocab"][a + b] for a, b in pairs]
        if any(x >= y for x, y in zip(rank, rank[1:])):
            raise ValueError("the merges do not come in the order of their ids")
        made = {a + b for a, b in pairs} | set(letters)
        self.bytes = {i: written(t) for t, i in model["vocab"].items() if t in made}
        self.encoding = tiktoken.Encoding("left", pat_str=pattern, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})
        self.size = max(self.bytes) + 1
        self.path, self.slow = path, None

    def encode(self, text: str) -> list[int]:
        try:
            return self.encoding.encode_ordinary(text)
        except BaseException as e:  # the pattern engine gives up on some very long runs
            if type(e).__name__ not in ("PanicException", "ValueError", "RuntimeError"):
                raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


class Right:
    """A SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        pieces = map(self.model.id_to_piece, range(self.size))
        self.bytes = {i: bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _labels(size: int, end: str) -> np.ndarray:
    """The decimal ids with ``end`` behind, up to eight bytes in a word."""
    return np.frombuffer(b"".join(f"{i}{end}".encode().ljust(8, b"\0") for i in range(size)), np.uint64)


class Aligner:
    def __init__(self, left: str, pattern: str, right: str):
        self.left, self.right = Left(left, pattern), Right(right)
        if self.right.size > 1 << RIGHT_BITS or max(self.left.size, self.right.size) > 10**7:
            raise ValueError("vocabulary too large")
        sizes = lambda side: np.array([len(side.bytes.get(i, b"")) for i in range(side.size)], np.int64)
        self.left_len, self.right_len = sizes(self.left), sizes(self.right)
        n, m = self.left.size, self.right.size
        self.text = np.concatenate([_labels(n, ","), _labels(n, "|"), _labels(m, ","), _labels(m, ";")])
        self.width = np.count_nonzero(self.text.view(np.uint8).reshape(-1, 8), axis=1)

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where the bytes of either are not those of blank + text."""
        whole = [t or "" for t in texts]
        right = self.right.encode(whole)
        left = [self.left.encode(" " + t) if t else [] for t in whole]
        for i, t in enumerate(whole):
            raw = (" " + t).encode()
            if t and not (b"".join(map(self.right.bytes.__getitem__, right[i])) == raw
                          and b"".join(map(self.left.bytes.__getitem__, left[i])) == raw):
                left[i] = right[i] = []
        return left, [r if l else [] for l, r in zip(left, right)]

    def align(self, texts: list[str | None]):
        """Per text n_a, n_b, n_groups, n_links and digest; then, sorted, the distinct keys
        (pair << DOC_BITS) + place in ``texts`` and their link counts."""
        rows = len(texts)
        left, right = self.tokens(texts)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, rows) for x in (left, right))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((left, n_a), (right, n_b)))
        if not len(a):
            zero = np.zeros(rows, np.int64)
            return zero, zero, zero, zero, [""] * rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
        # the texts follow each other in both byte counts, so no group goes over a text's end
        end_a, end_b = np.cumsum(self.left_len[a]), np.cumsum(self.right_len[b])
        both = end_b[np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)] == end_a
        ends = end_a[both]
        of_a, of_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        count_a, count_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
        first_b = np.cumsum(count_b) - count_b
        row_a = np.repeat(np.arange(rows), n_a)
        row = row_a[both]
        links = count_a * count_b
        n_groups = np.bincount(row, minlength=rows)
        n_links = np.zeros(rows, np.int64)
        np.add.at(n_links, row, links)
        keys, times = self._pairs(a, b, of_a, row_a, row, count_a, count_b, first_b, links)
        return n_a, n_b, n_groups, n_links, self._digests(a, b, of_a, of_b, count_a, count_b, n_a, n_b), keys, times

    def _pairs(self, a, b, of_a, row_a, row, count_a, count_b, first_b, links):
        key = lambda x, y, at: (((x << RIGHT_BITS) + y) << DOC_BITS) + at
        small = links[of_a] <= SMALL
        reps = np.where(small, count_b[of_a], 0)
        behind = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        keys = [key(np.repeat(a, reps), b[np.repeat(first_b[of_a], reps) + behind], np.repeat(row_a, reps))]
        times = [np.ones(len(keys[0]), np.int64)]
        first_a = np.cumsum(count_a) - count_a
        for g in np.flatnonzero(links > SMALL):
            x, n = np.unique(a[first_a[g]:first_a[g] + count_a[g]], return_counts=True)
            y, m = np.unique(b[first_b[g]:first_b[g] + count_b[g]], return_counts=True)
            keys.append(key(np.repeat(x, len(y)), np.tile(y, len(x)), row[g]))
            times.append(np.repeat(n, len(y)) * np.tile(m, len(x)))
        return summed(np.concatenate(keys), np.concatenate(times))

    def _digests(self, a, b, of_a, of_b, count_a, count_b, n_a, n_b) -> list[str]:
        n, m = self.left.size, self.right.size
        last_a, last_b = np.append(of_a[1:] != of_a[:-1], True), np.append(of_b[1:] != of_b[:-1], True)
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + (np.cumsum(count_b) - count_b)[of_a]] = a + n * last_a
        code[np.arange(len(b)) + np.cumsum(count_a)[of_b]] = 2 * n + b + m * last_b
        raw = self.text[code].view(np.uint8)
        raw = raw[raw != 0]
        upto = np.concatenate([[0], np.cumsum(self.width[code])])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        return [hashlib.sha256(raw[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(upto[:-1], upto[1:])]


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times[order], first) if len(keys) else times


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def containers(keys: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each pair of the sorted keys: pair, number of documents, their bitmap, and the
    link counts less one as bit planes over these documents (no plane where all are one)."""
    if not len(keys):
        return
    pair, doc, more = keys >> DOC_BITS, keys & ((1 << DOC_BITS) - 1), times - 1
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    n = np.diff(np.append(first, len(keys)))
    dense = n >= DENSE
    bits = _binary(np.concatenate([np.packbits(np.bincount(doc[f:f + k], minlength=1 << DOC_BITS).astype(bool), bitorder="little")
                                   for f, k in zip(first[dense], n[dense])] or [np.zeros(0, np.uint8)]),
                   np.arange(dense.sum() + 1) << (DOC_BITS - 3))
    sparse = _binary(doc[~np.repeat(dense, n)].astype("<u2").view(np.uint8), np.append(0, 2 * np.cumsum(n[~dense])))
    top, depth = np.maximum.reduceat(more, first), np.zeros(len(first), np.int64)
    while (top >> depth).any():
        depth += (top >> depth) > 0
    wide = (n + 7) // 8
    ends = np.append(0, np.cumsum(depth * wide))
    plane = np.zeros(8 * int(ends[-1]), bool)
    of = np.repeat(np.arange(len(first)), n)
    place = np.arange(len(keys)) - first[of]
    for k in range(int(depth.max(initial=0))):
        on = (more >> k) & 1 > 0
        plane[8 * (ends[of[on]] + k * wide[of[on]]) + place[on]] = True
    planes = _binary(np.packbits(plane, bitorder="little"), ends)
    for rows, drawn in ((~dense, sparse), (dense, bits)):
        whole = pa.RecordBatch.from_arrays([pa.array(pair[first[rows]]), pa.array(n[rows].astype(np.int32)), drawn,
                                            planes.filter(pa.array(rows))], ["pair", "n", "bits", "planes"])
        for at in range(0, whole.num_rows, 1 << 14):
            yield whole.slice(at, 1 << 14)


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, document and link count of every entry of the containers of a batch."""
    n = batch.column("n").to_numpy().astype(np.int64)
    dense = n >= DENSE
    raw, _ = _raw(batch.column("bits").filter(pa.array(~dense)))
    doc = np.empty(int(n.sum()), np.int64)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(doc)) - (np.cumsum(n) - n)[of]
    doc[~dense[of]] = np.frombuffer(raw.tobytes(), "<u2")
    if dense.any():
        raw, _ = _raw(batch.column("bits").filter(pa.array(dense)))
        doc[dense[of]] = np.nonzero(np.unpackbits(raw, bitorder="little").reshape(-1, 1 << DOC_BITS))[1]
    raw, ends = _raw(batch.column("planes"))
    wide = (n + 7) // 8
    depth = np.diff(ends) // np.maximum(wide, 1)
    times = np.ones(len(doc), np.int64)
    for k in range(int(depth.max(initial=0))):
        deep = np.flatnonzero(depth[of] > k)
        at = 8 * (ends[:-1][of[deep]] + k * wide[of[deep]]) + place[deep]
        times[deep] += ((raw[at >> 3] >> (at & 7)) & 1).astype(np.int64) << k
    return of, doc, times


@lru_cache(1)
def aligner(left: str, pattern: str, right: str) -> Aligner:
    return Aligner(left, pattern, right)


def align(docs: DataFrame, left: str, pattern: str, right: str, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Align every whole text under a byte-level BPE file (``left``, cut by ``pattern``) and a
    SentencePiece file (``right``): per-document rows and the containers.

    Documents: ``doc_id, block, doc, n_a, n_b, n_groups, n_links, groups_sha256``. Containers:
    ``block, pair, n, bits, planes``. Null and empty texts and those whose bytes one side does not
    give back have zeros and an empty digest. Repeated rows are documents of their own."""
    slim = docs.select(docs[id].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    added = "doc int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    names = ["doc_id", "block", *[x.split()[0] for x in f"{added}, {CONTAINER}".split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = aligner(left, pattern, right)
        block, at, waiting = TaskContext.get().partitionId() << 32, 0, []
        kinds = None

        def closed():
            keys, times = (np.concatenate(x) for x in zip(*waiting))
            order = np.argsort(keys, kind="stable")
            for c in containers(keys[order], times[order]):
                blank = [pa.nulls(c.num_rows, t) for t in kinds]
                yield pa.RecordBatch.from_arrays([blank[0], pa.array(np.full(c.num_rows, block)), *blank[2:], *c.columns], names)

        for batch in batches:
            for cut in slices(batch, 1, SLICE):
                for part in (cut.slice(i, 1 << 12) for i in range(0, cut.num_rows, 1 << 12)):
                    if at + part.num_rows > 1 << DOC_BITS or sum(len(w[0]) for w in waiting) > ENTRIES:
                        yield from closed()
                        block, at, waiting = block + 1, 0, []
                    *counts, digests, keys, times = side.align(part.column(1).to_pylist())
                    waiting.append((keys + at, times))
                    own = [part.column(0), pa.array(np.full(part.num_rows, block)), pa.array(np.arange(at, at + part.num_rows, dtype=np.int32)),
                           *map(pa.array, counts), pa.array(digests, pa.string())]
                    kinds = [c.type for c in own]
                    yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(part.num_rows, t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary())]], names)
                    at += part.num_rows
        if waiting:
            yield from closed()

    both = stored(slim.mapInArrow(run, f"doc_id {kind}, block bigint, {added}, {CONTAINER}"))
    return (both.where("pair IS NULL").select(*names[:8]),
            both.where("pair IS NOT NULL").select("block", "pair", "n", "bits", "planes"))


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, count, best``: documents that hold the pair linked, and whether no pair of the same
    left id has more."""
    counts = stored(found.groupBy("pair").agg(F.sum("n").alias("count")))
    left = F.shiftright("pair", RIGHT_BITS)
    most = counts.groupBy(left.cast("int").alias("a")).agg(F.max("count").alias("most"))
    # one row for each id of the left vocabulary
    joined = counts.join(F.broadcast(most), left.cast("int") == F.col("a"))
    return stored(joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the documents of each block; a block's containers follow each other."""
    now, best, total = None, None, None

    def closed():
        doc = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), now)), pa.array(doc.astype(np.int32)), pa.array(best[doc]),
                                           pa.array(total[doc])], ["block", "doc", "n_best", "count_sum"])

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for x, y in zip(edges[:-1], edges[1:]):
            if x == y:
                continue
            if now != int(blocks[x]):
                if now is not None:
                    yield closed()
                now, best, total = int(blocks[x]), np.zeros(1 << DOC_BITS, np.int64), np.zeros(1 << DOC_BITS, np.int64)
            part = batch.slice(x, y - x)
            for at in range(0, part.num_rows, 1 << 12):
                piece = part.slice(at, 1 << 12)
                of, doc, times = entries(piece)
                np.add.at(best, doc, times * piece.column("best").to_numpy(zero_copy_only=False)[of])
                np.add.at(total, doc, times * piece.column("count").to_numpy()[of])
    if now is not None:
        yield closed()


def scored(docs: DataFrame, found: DataFrame, counts: DataFrame) -> DataFrame:
    """The document rows with ``n_best`` (links whose pair is a best one of its left id) and
    ``count_sum`` (document counts over all links)."""
    joined = found.join(counts.hint("merge"), "pair").select("block", "n", "bits", "planes", "count", "best")
    sums = joined.repartition("block").sortWithinPartitions("block").mapInArrow(
        _scores, "block bigint, doc int, n_best bigint, count_sum bigint")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    whole = docs.join(sums.hint("merge"), ["block", "doc"], "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def cross_align(docs: DataFrame, left: str, pattern: str, right: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Alignment of every document and how usual its links are in all of ``docs``: doc_id, n_a,
    n_b, n_groups, n_links, n_best, count_sum, groups_sha256. An empty table gives no rows."""
    rows, found = align(docs, left, pattern, right, id, text)
    return scored(rows, found, pair_counts(found))
