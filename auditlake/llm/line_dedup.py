"""Operator 3: removal of repeated passages by windows of lines.

A line ends at a newline or after a sentence, so a passage is found where it starts inside a
line as well. From every line on and up to every line the shortest window is taken that is
large enough to compare, so a passage of that size is covered by such windows wherever it
stands and whatever surrounds it. Windows are compared by a digest of their bytes; all but the
first place of a window are removed, and windows that overlap join to the whole passage.
"""

from __future__ import annotations

import re
from collections import namedtuple
from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import blake2b
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

LINE_END = r"(?<=\n)|(?<=[.!?] )"
ENDS = ["\n", ". ", "! ", "? "]  # what stands before a LINE_END
LAST = re.compile(rb"[\n.!?](?:(?<=\n)|(?<!\n) )")  # the same; a first character of few kinds is sought faster
STOP, BLANK = (np.isin(np.arange(256), list(chars)) for chars in (b".!?", b" \t\n\r\x0b\x0c"))  # by byte
PART = 1 << 20  # bytes of text in which lines and words are sought at once
SLICE = 500  # documents whose windows are Python objects at a time


def lines_of(text: Column) -> Column:
    """The lines with what ends them: joined they are the text."""
    return F.split(text, LINE_END)


def count_lines(text: Column) -> Column:
    """Number of ``lines_of``, without looking behind every character."""
    size = F.octet_length
    return sum([F.expr("1"), *[F.floor((size(text) - size(F.replace(text, F.lit(e), F.lit("")))) / len(e)) for e in ENDS]])


def lines_in(texts: list[bytes]) -> Iterator[tuple[bytes, list[int], list[int], list[int], list[int]]]:
    """Of each text bytes that hold it, and of its lines with words: their numbers, the words before
    each of them and behind all, and where in these bytes their words start and end."""
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) <= PART):
            size, high = size + len(texts[high]), high + 1
        part, low = texts[low:high], high
        whole = b"\n".join([*part, b""])  # an end of line behind each
        raw = np.frombuffer(whole, np.uint8)
        ended = raw == 10
        ended[1:] |= (raw[1:] == 32) & STOP[raw[:-1]]
        edges = np.flatnonzero(np.diff(~BLANK[raw], prepend=False))  # where words start and where they end
        ends, starts = np.flatnonzero(ended), edges[::2]
        upto = np.searchsorted(starts, ends)  # words up to the end of each line
        full = np.flatnonzero(np.diff(upto, prepend=0))  # the lines with words
        behind = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in part]) - 1) + 1  # the lines of each text
        begins = np.append(0, behind[:-1])
        words = np.append(0, upto)
        rows = np.searchsorted(full, begins), np.searchsorted(full, behind)
        first, last = starts[words[full]].tolist(), edges[1::2][words[full + 1] - 1].tolist()
        numbers, before, after = full + 1, words[full], words[behind]
        for a, b, line, word, total in zip(*(r.tolist() for r in rows), begins.tolist(), words[begins].tolist(), after.tolist()):
            yield whole, (numbers[a:b] - line).tolist(), [*(before[a:b] - word).tolist(), total - word], first[a:b], last[a:b]


def windows_of(text: bytes, numbers: list[int], before: list[int], starts: list[int], ends: list[int],
               min_lines: int, min_words: int, long_line: int) -> tuple[int, list[tuple]]:
    """Number of words, and start (from 1), lines, words before, words and digest of each window of
    a text given as ``lines_in`` gives it.

    For every line with words the shortest window that starts there and the shortest that ends
    there; blank lines count as no line. A window is compared without blanks at its ends."""
    found, i = [], 0
    for j, end in enumerate(ends):
        first, line, upto = i, numbers[j] + 1, before[j + 1]
        while i <= j and (n := upto - before[i]) >= min_words and (j - i + 1 >= min_lines or n >= long_line):
            i += 1
        for a in range(first, i) if i > first else range(max(0, i - 1), i):
            digest = blake2b(text[starts[a]:end], digest_size=16).digest()
            found.append((numbers[a], line - numbers[a], before[a], upto - before[a], digest))
    return before[-1], found


def windows(docs: DataFrame, text: str, min_lines: int, min_words: int, long_line: int) -> DataFrame:
    """_id, _key, total (words of the document) and the windows, one a row, the digest in two halves."""
    names = ["start", "lines", "before", "words", "hash", "half"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                totals, counts, found = [], [], []
                for lines in lines_in(part.column(2).to_pylist()):
                    total, own = windows_of(*lines, min_lines, min_words, long_line)
                    totals.append(total)
                    counts.append(len(own))
                    found += own
                at, columns = pa.array(np.repeat(np.arange(len(counts)), counts)), list(zip(*found)) or [[]] * 5
                halves = np.frombuffer(b"".join(columns[4]), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(totals, pa.int32()).take(at),
                     *[pa.array(c, pa.int32()) for c in columns[:4]], *[pa.array(halves[:, k]) for k in (0, 1)]], ["_id", "_key", "total", *names])

    slim = docs.where(F.col(text).isNotNull()).select("_id", "_key", F.col(text).cast("string").cast("binary"))
    return slim.mapInArrow(run, f"_id {dict(slim.dtypes)['_id']}, _key bigint, total int, start int, lines int, before int, words int, hash bigint, half bigint")


def union(ranges: Iterable[tuple[int, int]]) -> list[list[int]]:
    """The ranges (first, behind), joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return out


def covered(ranges: Iterable[tuple[int, int]]) -> int:
    return sum(b - a for a, b in union(ranges))


WINDOW = ["start", "lines", "before", "words", "f_id", "f_key", "f_start", "f_before", "f_total"]
Window = namedtuple("Window", WINDOW)


def objects(column: pa.Array) -> list:
    """A column as Python objects; numbers come from their buffer at once."""
    whole = pa.types.is_integer(column.type) and not column.null_count
    return column.to_numpy().tolist() if whole else column.to_pylist()


def windows_in(column: pa.ListArray) -> list[list[Window]]:
    """The windows of each row. They are read field by field, a dictionary for each costs several times that."""
    flat = list(map(Window, *map(objects, column.flatten().flatten())))
    ends = column.offsets.to_pylist()
    return [flat[a - ends[0]:b - ends[0]] for a, b in zip(ends, ends[1:])]


def behind(x: Window, start: int, before: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """Lines and words of a window that its first place in the same document does not hold itself."""
    return ((max(x.start, start + x.lines), x.start + x.lines),
            (max(x.before, before + x.words), x.before + x.words))


EDITED = "_gone array<array<int>>, _lines bigint, _words bigint"


def edited(part: pa.RecordBatch, gone: list[list[list[int]]], words: list[int]) -> pa.RecordBatch:
    lines = [sum(b - a for a, b in g) for g in gone]
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(gone, pa.list_(pa.list_(pa.int32()))),
                                       pa.array(lines, pa.int64()), pa.array(words, pa.int64())], ["_id", "_key", "_gone", "_lines", "_words"])


def gathered(later: DataFrame) -> DataFrame:
    """_id, _key, total and the windows ``w`` of each document."""
    return later.groupBy("_id", "_key").agg(F.max("total").alias("total"), F.collect_set(F.struct(*WINDOW)).alias("w"))


def same(pairs: dict[str, str]) -> Column:
    """Whether columns are equal, or both null as the ids of rows without one."""
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs.items()])


def judged(later: DataFrame, most: int) -> DataFrame:
    """One row for each document with windows ``w`` that stand elsewhere before: _id, _key, source,
    the one earlier document that it is a near copy of, or null; and others, the first places'
    other documents if there is a source.

    A near copy shares more than ``most`` percent of its words with its source, and of the source's."""
    whole = gathered(later)
    kind = dict(later.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = pa.struct([("id", batch.schema.field("_id").type), ("key", pa.int64())])
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                sources, others = [], []
                for id, key, total, w in zip(*(part.column(k).to_pylist() for k in range(3)), windows_in(part.column(3))):
                    by: dict[tuple, list[Window]] = {}
                    for x in w:
                        by.setdefault((x.f_id, x.f_key), []).append(x)
                    by.pop((id, key), None)
                    near = []
                    for d, xs in by.items():
                        if 100 * sum(x.words for x in xs) <= most * max(total, xs[0].f_total):
                            continue  # covered words are no more than these
                        own = covered((x.before, x.before + x.words) for x in xs)
                        theirs = covered((x.f_before, x.f_before + x.words) for x in xs)
                        if 100 * own > most * total and 100 * theirs > most * xs[0].f_total:
                            near.append((-own, d))
                    source = min(near, key=lambda x: (x[0], x[1][0] is None, x[1]))[1] if near else None
                    sources.append(source and dict(zip(("id", "key"), source)))
                    others.append([dict(zip(("id", "key"), d)) for d in by if d != source] if near else [])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(4)), pa.array(sources, doc), pa.array(others, pa.list_(doc))],
                    ["_id", "_key", "total", "w", "source", "others"])

    doc = f"struct<id:{kind},key:bigint>"
    return whole.mapInArrow(run, f"_id {kind}, _key bigint, total int, w {dict(whole.dtypes)['w']}, source {doc}, others array<{doc}>")


def edits(later: DataFrame, most: int) -> DataFrame:
    """_id, _key, _gone (ranges of lines that go), _lines and _words.

    A near copy keeps what it shares with its source and with other near copies of that source;
    what goes from these, since it stands in further documents or twice in one, goes from it too.
    With ``most`` of 100 there are no near copies, and every later place goes."""
    if most < 100:
        docs = stored(judged(later, most))
        copies = docs.where("source IS NOT NULL")
        kin = copies.select("_id", "_key", "source", F.explode("others").alias("o")).join(
            copies.select(F.col("_id").alias("o_id"), F.col("_key").alias("o_key"), F.col("source").alias("o_source")).hint("merge"),
            same({"o.id": "o_id", "o.key": "o_key"})).where("source = o_source")
        kin = kin.groupBy(F.col("_id").alias("k_id"), F.col("_key").alias("k_key")).agg(F.collect_list("o").alias("kin"))
        whole = docs.join(kin.hint("merge"), same({"_id": "k_id", "_key": "k_key"}), "left").select("_id", "_key", "w", "source", "kin")
    else:  # nothing shares more than all of its words
        whole = gathered(later).select("_id", "_key", "w", F.lit(None).alias("source"), F.lit(None).alias("kin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                gone, words = [], []  # of each document
                fields = [part.column(c).to_pylist() for c in ("_id", "_key", "source", "kin")]
                for id, key, source, kin, w in zip(*fields, windows_in(part.column("w"))):
                    own = (id, key)
                    kept = {(d["id"], d["key"]) for d in [source, *(kin or [])] if d}
                    lines, places, seen = [], [], {}

                    def goes(x: Window, start: int, before: int) -> None:
                        line, place = behind(x, start, before)
                        lines.append(line)
                        places.append(place)

                    for x in sorted(w, key=itemgetter(0, 1)):
                        d = (x.f_id, x.f_key)
                        if d == own:
                            goes(x, x.f_start, x.f_before)
                        elif d not in kept:
                            lines.append((x.start, x.start + x.lines))
                            places.append((x.before, x.before + x.words))
                        elif (y := seen.setdefault((d, x.f_start, x.lines), x)).start != x.start:
                            goes(x, y.start, y.before)
                    gone.append(union(lines))
                    words.append(covered(places))
                yield edited(part, gone, words)

    return whole.mapInArrow(run, f"_id {dict(later.dtypes)['_id']}, _key bigint, {EDITED}")


def dedup(docs: DataFrame, min_lines: int = 2, min_words: int = 8, long_line: int = 50, most: int = 60,
          id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, repeated passages gone from ``text``, and n_lines, removed_lines,
    removed_words.

    A passage counts with ``min_lines`` lines and ``min_words`` words, or as one line of
    ``long_line`` words. Its first place by id and line stays. A near copy of one
    earlier document (they share more than ``most`` percent of the words of both) keeps what it
    shares with it, for near-duplicate removal; from all others every repeated passage goes,
    whatever its share. With ``most`` of 100 no copy is spared: what stands before goes from all.
    Rows with the same id and text are one document and stay alike; rows without an id come last and are told
    apart by their text. Null texts pass unchanged. Columns with the names added here are replaced."""
    added = ["n_lines", "removed_lines", "removed_words"]
    columns = [c for c in docs.columns if c.lower() not in added]
    docs = docs.select(*[docs[c] for c in columns], docs[id].alias("_id"), F.xxhash64(docs[text]).alias("_key"))
    found = stored(windows(docs, text, min_lines, min_words, long_line))
    twice = found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    hits = stored(found.join(twice.select("hash").hint("merge"), "hash", "left_semi"))
    place = F.struct("_id", "_key", "start", "before", "total")
    first = hits.groupBy("hash", "half").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), place.alias("p"))).alias("f")).select(
        "hash", "half", F.col("f.p").alias("f"))
    later = hits.join(first.hint("merge"), ["hash", "half"]).where(place != F.col("f")).select(
        "_id", "_key", "total", "start", "lines", "before", "words", F.col("f._id").alias("f_id"), F.col("f._key").alias("f_key"),
        F.col("f.start").alias("f_start"), F.col("f.before").alias("f_before"), F.col("f.total").alias("f_total"))
    edit = edits(later, most).where("_lines > 0").withColumnsRenamed({"_id": "_e_id", "_key": "_e_key"})
    joined = docs.join(edit.hint("merge"), same({"_id": "_e_id", "_key": "_e_key"}), "left")
    drop = F.flatten(F.transform("_gone", lambda g: F.sequence(g[0], g[1] - 1)))
    rest = let(F.struct(lines_of(F.col(text)).alias("l"), drop.alias("d")), lambda x: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(1), F.size(x["l"])), x["d"]), lambda i: F.get(x["l"], i - 1)), ""))
    return joined.select(
        *[F.when(F.col("_gone").isNotNull(), rest).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in columns],
        count_lines(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_lines"),
        F.coalesce("_lines", F.lit(0)).cast("bigint").alias("removed_lines"),
        F.coalesce("_words", F.lit(0)).cast("bigint").alias("removed_words"))
