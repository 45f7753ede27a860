"""Operator 2: SentencePiece encoding and decoding of merge-type (BPE) models.

Encoding is exact and works by backtracking. The longest vocabulary piece at a position comes
from an Aho-Corasick automaton; it is taken if it is compatible with the piece before it, that
is, if merging the two pieces' characters again by the model's scores gives these two pieces.
A sequence in which every neighbouring pair is compatible is what merging the whole text gives.
Where no piece fits, the last one is taken back and its start is marked as failed, so no
position is tried twice. No piece holds a word mark behind another character, so texts are cut
before word marks and the pieces of frequent words are remembered.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

MARK = "▁"
NEVER = float("-inf")
REMEMBERED = 1 << 18  # words and piece pairs kept by a worker
LONG_WORD = 64  # bytes; longer words are not remembered
SLICE = 1 << 19  # bytes of text encoded at once
WORDS = re.compile(f"{MARK}+[^{MARK}]*")


class Model:
    """Vocabulary, encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        plain = [i for i in range(len(self.pieces))
                 if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.hidden = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model has pieces that go on behind a word mark")
        if sp.normalize(" á　 ﬁ ") != MARK + " á　 ﬁ ".replace(" ", MARK):
            raise ValueError("only models without text normalisation are supported")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) > 1:
                self.automaton.add_word(p, (len(p) - 1, (len(p), i)))
        self.automaton.make_automaton()
        self.longest = ahocorasick.Automaton()  # with single characters: longest matches end to end
        for p, i in self.ids.items():
            self.longest.add_word(p, (len(p), i))
        self.longest.make_automaton()
        self.history = lru_cache(None)(self._history)  # a few steps for each piece
        self.single = {p: (1, i) for p, i in self.ids.items() if len(p) == 1}
        self.plain = pa.array([p.replace(MARK, " ") for p in self.pieces], pa.string())
        usual = set(plain)
        self.odd = np.array([i not in usual for i in range(len(self.pieces))])
        self.led = np.array([p.startswith(MARK) for p in self.pieces])
        self.fit: dict[int, dict[int, bool]] = defaultdict(dict)  # by left and right id
        self.fits = 0
        self.young: dict[bytes, bytes] = {}  # words and their ids, see ``known``
        self.old: dict[bytes, bytes] = {}

    def _history(self, piece: int) -> list[tuple[float, str, str]] | None:
        """How the characters of a piece merge, always the neighbours with the best joint score,
        the leftmost first: score, first and last symbol after each merge. None if they end
        as something else."""
        parts, steps = list(self.pieces[piece]), []
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1], NEVER)
                if s > best:
                    best, at = s, i
            if at < 0:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            # the vocabulary's own strings, so that no copies are kept
            steps.append((best, *(self.pieces[self.ids[p]] if p in self.ids else p for p in (parts[0], parts[-1]))))
        return steps + [(NEVER, "", "")]

    def _merges_apart(self, left: int, right: int) -> bool:
        """Merge the characters of both pieces again, in the order of merging the joint text, and
        see whether a merge across their border comes up."""
        a, b = self.history(left), self.history(right)
        if a is None or b is None:
            return False
        i = j = 0
        tail, head = self.pieces[left][-1], self.pieces[right][0]
        while True:
            across, inner, outer = self.score.get(tail + head, NEVER), a[i][0], b[j][0]
            if across > inner and across >= outer:
                return False
            if inner >= outer:
                if inner == NEVER:
                    return True
                tail = a[i][2]
                i += 1
            else:
                head = b[j][1]
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces may stand side by side; left below 0: whether the right one may
        begin. Answers are remembered and all forgotten when they get many."""
        self.fits += 1
        if self.fits > REMEMBERED * 4:
            for row in self.fit.values():
                row.clear()
            self.fits = 1
        ok = self.history(right) is not None if left < 0 else self._merges_apart(left, right)
        self.fit[left][right] = ok
        return ok

    def split(self, word: str) -> list[int]:
        """Piece ids of a word that starts with its marks; ``~i`` is the i-th character where it
        has no piece and so merges with nothing."""
        n, fit, last = len(word), self.fit, -1
        # most often the longest pieces, one behind the other, are compatible at once
        taken = [found for _, found in self.longest.iter_long(word)]
        covered = 0
        for length, piece in taken:
            ok = fit[last].get(piece)
            if not (self.compatible(last, piece) if ok is None else ok):
                break
            covered += length
            last = piece
        if covered == n:
            return [piece for _, piece in taken]
        fits: list = [[x] for x in map(self.single.get, word)]  # at a position, the longest piece last
        if [None] in fits:
            for i, found in enumerate(fits):
                found[0] = found[0] or (1, ~i)
        for end, (back, found) in self.automaton.iter(word):
            fits[end - back].append(found)
        failed = bytearray(n + 1)
        taken: list[int] = []
        begun: list[int] = []
        pos, last = 0, -1
        while pos < n:
            left, row = fits[pos], fit[last]
            while left:
                length, piece = left.pop()
                if failed[pos + length]:
                    continue
                if piece >= 0:
                    ok = row.get(piece)
                    if not (self.compatible(last, piece) if ok is None else ok):
                        continue
                taken.append(piece)
                begun.append(pos)
                last = piece if piece >= 0 else -1
                pos += length
                break
            else:
                failed[pos] = 1
                taken.pop()
                pos = begun.pop()
                last = taken[-1] if taken and taken[-1] >= 0 else -1
        return taken

    def _word(self, word: str) -> list[int]:
        ids = self.split(word)
        if min(ids) >= 0:
            return ids
        whole: list[int] = []
        for i in ids:
            if i >= 0:
                whole.append(i)
            elif self.bytes:
                whole.extend(self.bytes[b] for b in word[~i].encode())
            else:
                whole.append(self.unknown)
        return whole

    def known(self, words: list[bytes]) -> list[bytes]:
        """Ids of words in UTF-8, as the bytes of 32-bit numbers: objects of their own would take three
        times the memory. Words are remembered in two halves; a full one becomes the old one, and what
        is asked for again moves over."""
        young, old, out = self.young, self.old, []
        for w in words:
            ids = young.get(w)
            if ids is None:
                ids = old.get(w) or array("i", self._word(w.decode())).tobytes()
                if len(w) <= LONG_WORD:
                    if len(young) >= REMEMBERED // 2:
                        self.young, self.old = young, old = {}, young
                    young[w] = ids
            out.append(ids)
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text, each with the marks before it. A text gets one leading mark, as the
        library adds it."""
        return WORDS.findall(MARK + text.replace(" ", MARK)) if text else []

    def encoded(self, texts: list[str | None]) -> pa.LargeListArray:
        """Ids of each of some texts: each distinct word is encoded once, the rest is taking in Arrow."""
        found = [self.words(t or "") for t in texts]
        ends = np.cumsum([0, *map(len, found)])
        flat = pa.array(list(chain.from_iterable(found)), pa.large_string()).dictionary_encode()
        known = self.known(flat.dictionary.cast(pa.large_binary()).to_pylist())
        size = np.array([*map(len, known)], np.int64) // 4
        pieces = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]),
                                               pa.array(np.frombuffer(b"".join(known), np.int32)))
        code = flat.indices
        upto = np.concatenate([[0], np.cumsum(size[code.to_numpy()])]) if len(known) else np.zeros(1, np.int64)
        return pa.LargeListArray.from_arrays(upto[ends], pieces.take(code).flatten())

    def decoded(self, ids: pa.LargeListArray) -> list[str] | pa.Array:
        """Texts of some lists of ids without nulls. Where all ids are pieces, taking and joining in
        Arrow; a text with bytes, unknown or control ids goes id by id."""
        ends = ids.offsets.to_numpy().astype(np.int64)
        flat = ids.values.to_numpy()[ends[0]:ends[-1]]
        ends = ends - ends[0]
        said = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.plain.take(pa.array(flat)))
        texts = pc.binary_join(said, "").to_pylist()
        odd = np.concatenate([[0], np.cumsum(self.odd[flat])])
        first = np.zeros(len(texts), bool)
        filled = ends[1:] > ends[:-1]
        first[filled] = self.led[flat[ends[:-1][filled]]]
        for i in np.flatnonzero(first):
            texts[i] = texts[i][1:]
        for i in np.flatnonzero(odd[ends[1:]] > odd[ends[:-1]]):
            texts[i] = self.decode(flat[ends[i]:ends[i + 1]].tolist())
        return texts

    def text(self, ids: list[int]) -> str:
        """What ids stand for, word marks as blanks. Bytes that are no UTF-8 become U+FFFD."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i in self.hidden:
                continue
            out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(MARK, " "))
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids, without the blank that encoding puts in front."""
        text = self.text(ids)
        first = next((i for i in ids if i not in self.hidden), None)
        led = first is not None and first not in self.byte_of and self.pieces[first].startswith(MARK)
        return text[1:] if led else text


def _utf8(raw: bytes) -> str:
    """One U+FFFD for each byte that no character uses."""
    out, k = [], 0
    while k < len(raw):
        try:
            out.append(raw[k:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[k:k + e.start].decode() + "�")
            k += e.start + 1
    return "".join(out)


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def _schema(docs: DataFrame, added: list[T.StructField]) -> T.StructType:
    names = {f.name.lower() for f in added}
    return T.StructType([f for f in docs.schema.fields if f.name.lower() not in names] + added)


def encode(docs: DataFrame, model_path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """All columns of ``docs`` and ``ids`` (array of int) and, if asked for, ``decoded`` (the ids as
    text again).

    The whole text is encoded, without begin or end ids. A null or empty text gives no ids and
    an empty ``decoded``. A blank and a literal word mark decode to a blank. Columns of these two
    names in the input are replaced. Rows are independent: no shuffle, repeated rows repeat. Texts are
    encoded in slices of about half a megabyte; a longer one is a slice."""
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)][:1 + decoded]
    schema = _schema(docs, added)
    keep = [f.name for f in schema.fields[:-len(added)]]
    side = docs.select(*[docs[k] for k in keep], docs[text].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, SLICE):
                ids = m.encoded(part.column(part.num_columns - 1).to_pylist())
                columns = [*part.columns[:-1], ids.cast(pa.list_(pa.int32())), *([pa.array(m.decoded(ids), pa.string())] if decoded else [])]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *[f.name for f in added]])

    return side.mapInArrow(run, schema)


def decode(tokens: DataFrame, model_path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """All columns and ``name``, the text of the ids. Null or no ids: an empty text."""
    schema = _schema(tokens, [T.StructField(name, T.StringType(), False)])
    keep = [f.name for f in schema.fields[:-1]]
    side = tokens.select(*[tokens[k] for k in keep], tokens[ids].alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            texts = [m.decode(x or []) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*keep, name])

    return side.mapInArrow(run, schema)
