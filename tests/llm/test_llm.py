"""Every operator on a small table with null, empty, very long, tied and repeated rows, an empty
table and extra columns, beside a brute-force version or an exact round trip."""

import hashlib
import itertools
import math
import random
import re
import sys
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
from auditlake.llm import (chat, common, embedding_join, language_id, licenses, line_dedup, minhash, mixing, quality,
                           sentencepiece_bpe, url_filter)

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rnd = random.Random(5)


def sentence(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(r.randrange(90)) for _ in range(n))


BASE = sentence(120, 1)
TEXTS = [None, "", " \n\t ", "one", "one two", BASE, BASE, BASE.upper(), BASE.replace("alpha", "omega", 1), sentence(60, 2),
         sentence(6000, 3) + " " + "x" * 5000, "a\x00b ▁ \r\n é́ 字 👩‍👩‍👧 </s>[INST]", sentence(60, 4) + ". ", "¡¿", "12 34"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], i, "x", 7) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, BASE, "en", "a", 1, "x", 7), (40, BASE, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, component_id int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def sqlviews():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op1_mix", "op5_quality", "op6_chat", "op7_url_filter"])
def test_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cur = sqlviews().execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(dict(zip(names, r))[c] for c in columns)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == theirs


# 1
def test_mix(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and mixing.mix(empty).collect() == []
    assert {r.doc_id: r["size"] for r in rows if r.doc_id is not None} == {
        i: len(WORD.findall(t or "")) for i, t in list(enumerate(TEXTS)) + [(40, BASE)]}
    total = sum(r["size"] for r in rows)
    targets = {r.source: (r.target, r.source_size) for r in rows}
    assert math.isclose(sum(t for t, _ in targets.values()), 1.5 * total)
    assert all(t <= 2 * s + 1e-9 for t, s in targets.values())
    assert sum(r["size"] * r.copies for r in rows) <= 1.5 * total and all(0 <= r.copies <= 2 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_mix_near_target(spark):
    rows = [(i, "w " * rnd.randint(1, 40), f"s{i % 7}") for i in range(3000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = Counter()
    for r in mixed:
        taken[r.source] += r["size"] * r.copies
    for r in mixed:
        assert abs(taken[r.source] - r.target) <= 80


def test_targets_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 90)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes, (3, 1, 2), 150, 2).collect()}
    # a (3) and null (3) fill up at 20 and 180; b (1) and c (2) share 2200: c fills up at 1000
    assert got == {"a": 20.0, "b": 1200.0, "c": 1000.0, None: 180.0}


# 2
def test_sentencepiece(spark, docs, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = sentencepiece_bpe.encode(docs, MODEL).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == lib.encode(r.text or "") and r.decoded == lib.decode(lib.encode(r.text or ""))
    assert sentencepiece_bpe.encode(empty, MODEL).collect() == []
    ids = [[], None, [1, 2, 0, 264], [29000, 230, 130, 200, 264, 13], [259, 264], [2, 264, 3]]
    df = spark.createDataFrame([(i,) for i in ids], "ids array<int>")
    assert [r.text for r in sentencepiece_bpe.decode(df, MODEL).collect()] == [lib.decode(i or []) for i in ids]


def test_sentencepiece_random():
    lib, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepiece_bpe.model(MODEL)
    pieces = list(model.ids)
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 6))) if rnd.random() < .5 else "".join(
            rnd.choice("ab ▁e\n.-=1éß字\x00") for _ in range(rnd.randint(1, 60)))
        ids = model.encoded([text])[0].as_py()
        assert ids == lib.encode(text) and model.decode(ids) == lib.decode(ids) == model.decoded(model.encoded([text]))[0]


# 3
PASSAGE = "".join(f"Passage line {w} goes on with some words here.\n" for w in "one two three four five six seven eight".split())


def own_lines(seed):
    return "".join(f"{sentence(9, seed * 100 + k)}.\n" for k in range(30))


def test_sentencepiece_remembers_little(monkeypatch):
    """Remembered words take about 150 bytes each, and at most REMEMBERED are kept."""
    monkeypatch.setattr(sentencepiece_bpe, "REMEMBERED", 2000)
    model = sentencepiece_bpe.Model(MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [" ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(50)) + " \u4e2d\u00e9 x" for _ in range(100)]
    for at in (0, 50, 0):
        assert model.encoded(texts[at:at + 50]).to_pylist() == lib.encode(texts[at:at + 50])
    held = model.young | model.old
    assert 1000 <= len(held) <= 2000
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in held.items()) < 120 * len(held)


def test_line_dedup(spark, empty):
    texts = {i: own_lines(i) + (PASSAGE if i in (2, 5, 6) else "") + own_lines(i + 50) for i in range(8)}
    texts |= {20: texts[0], 21: None, 22: "", 23: "x" * 100_000, 24: own_lines(24) + "Last one. " + PASSAGE + own_lines(25)}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(None, texts[2], 1), (5, texts[5], 1)],
                               "doc_id long, text string, n_lines int")
    rows = line_dedup.dedup(df).collect()
    assert len(rows) == len(texts) + 2 and line_dedup.dedup(empty).collect() == []
    for r in rows:
        if r.doc_id in (5, 6, 24):  # repeats of the passage of document 2; what is left is the document's own
            assert len(re.findall("Passage line", r.text)) <= 4 and r.removed_lines >= 4
            assert re.sub("Passage line.*\n", "", r.text) == re.sub("Passage line.*\n", "", texts[r.doc_id])
        elif r.doc_id is not None:  # others, the first place and whole copies stay
            assert r.text == texts[r.doc_id] and r.removed_words == 0


@pytest.mark.parametrize("n, words", [(1, 60), (2, 25), (3, 20), (4, 13), (6, 9)])
def test_line_dedup_short_passages(spark, n, words):
    passage = "".join(f"{sentence(words, 9000 + 10 * n + k)}. " for k in range(n))
    texts = {i: own_lines(i) + passage + own_lines(i + 50) for i in range(12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in line_dedup.dedup(df).collect():
        assert r.text == (texts[0] if r.doc_id == 0 else texts[r.doc_id].replace(passage, ""))
        assert (r.removed_lines, r.removed_words) == ((0, 0) if r.doc_id == 0 else (n, n * words))


def test_line_dedup_reads_numbers_at_once():
    for kind in (pa.int64(), pa.string()):
        ids = [3, 4, 5] if kind == pa.int64() else ["c", "d", "e"]
        rows = [[dict(zip(line_dedup.WINDOW, (1, 2, 0, 9, i, 7, 1, 0, 9))) for i in ids], [], None]
        number = {f: pa.int32() for f in line_dedup.WINDOW} | {"f_id": kind, "f_key": pa.int64()}
        column = pa.array(rows, pa.list_(pa.struct(list(number.items()))))
        assert [[x.f_id for x in w] for w in line_dedup.windows_in(column)] == [ids, [], []]
        assert line_dedup.windows_in(column.slice(1)) == [[], []]
    assert line_dedup.objects(pa.array([1, None], pa.int64())) == [1, None]
    assert line_dedup.objects(pa.array([1, 2], pa.int32())) == [1, 2]


def test_line_dedup_inner_repeats(spark):
    line = f"{sentence(10, 77)}.\n"
    df = spark.createDataFrame([(1, own_lines(1) + line * 8 + own_lines(2))], "doc_id long, text string")
    assert line_dedup.dedup(df).first().text == own_lines(1) + line * 2 + own_lines(2)


def test_line_dedup_mostly_repeated(spark):
    parts = ["".join(f"{sentence(10, 7000 + 10 * p + k)}. " for k in range(10)) for p in range(4)]
    own = {i: "".join(f"{sentence(10, 8000 + 10 * i + k)}. " for k in range(4)) for i in range(12)}
    texts = {i: own_lines(i) + parts[i] for i in range(4)}  # first places
    texts |= {4: own[4] + parts[0], 5: parts[1] + own[5] + parts[2], 6: parts[0] + parts[1] + parts[2] + parts[3]}
    page = own_lines(70) + parts[3]
    texts |= {7: page, 8: page, 9: page.replace("alpha", "omega", 1)}  # copies of one that holds a passage
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert all(got[i] == texts[i] for i in range(4))
    assert got[4] == own[4] and got[5] == own[5] and got[6] == ""
    assert got[7] == got[8] == own_lines(70) and got[9] == texts[9].replace(parts[3], "")


def test_line_dedup_spares_no_copy(spark, tmp_path):
    """The query removes every later place: of whole copies, of near ones, and in rows without an id."""
    page = own_lines(70) + PASSAGE
    near = page.replace(PASSAGE, own_lines(71)[:40] + "\n" + PASSAGE)
    texts = {1: page, 2: page, 3: near, 4: own_lines(4) + PASSAGE, 5: PASSAGE, None: own_lines(5) + PASSAGE}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in entry.queries()["op3_line_dedup"](spark, str(tmp_path)).collect()}
    want = {1: page, 2: "", 3: own_lines(71)[:40] + "\n", 4: own_lines(4), 5: "", None: own_lines(5)}
    assert {i: r.text_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    words = lambda t: len(t.split())
    assert {i: r.removed_words for i, r in got.items()} == {i: words(t) - words(want[i]) for i, t in texts.items()}


def test_lines_join_to_the_text(spark, docs):
    df = docs.where("text is not null").select("text", F.array_join(line_dedup.lines_of(F.col("text")), "").alias("again"))
    assert df.where("text != again").count() == 0


# 4
def brute_links(rows, least):
    unit = lambda v: (s := np.array(v) / np.abs(v).max()) / np.linalg.norm(s)
    ok = [(i, unit(v), l) for i, v, l in rows
          if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    parent, links = {i: i for i, *_ in ok}, Counter()
    for k, (i, u, a) in enumerate(ok):
        for j, v, b in ok[:k]:
            if a == b and u @ v >= least:
                links[i] += 1
                links[j] += 1
                x, y = common.find(parent, i), common.find(parent, j)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], common.find(parent, i) if i in parent else i) for i, *_ in rows if i is not None}


def test_embedding_join(spark):
    g = np.random.default_rng(3)
    middle = g.normal(size=(40, 12))
    rows = [(i, (middle[i % 40] + g.normal(size=12) * .12).tolist(), i % 3) for i in range(1500)]
    rows += [(2000 + i, rows[4][1], 1) for i in range(40)] + [(3000, None, 1), (3001, [0.0] * 12, 1), (3002, [], 1),
             (3003, [float("nan")] + [1.0] * 11, 1), (3004, [None] + [1.0] * 11, 1), (3005, rows[0][1], None), (None, rows[0][1], 0),
             (3006, [float("inf")] * 12, 1), (3007, [1.0, 2.0], 1), (3008, [x * 1e-200 for x in rows[4][1]], 1)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, v string")
    got = embedding_join.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = brute_links([r for r in rows if r[0] != 3007 and r[0] is not None], 0.93) | {3007: (0, 3007)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embedding_join.near_duplicates(df.where("false")).collect() == []


def test_embedding_join_rounds(spark, monkeypatch):
    """Blocks are broadcast some at a time and compared where the others are read: no vector is shuffled for a pair."""
    for name, value in (("AT_ONCE", 1 << 12), ("BLOCK", 16), ("COLUMNS", 50), ("NODES", 20), ("key", lambda: F.size("v").cast("bigint"))):
        monkeypatch.setattr(embedding_join, name, value)  # with a key that all vectors of a length share
    g = np.random.default_rng(8)
    middle = g.normal(size=(30, 8))
    rows = [(i, np.float32(middle[i % 30] + g.normal(size=8) * .15).tolist(), "xy"[i % 2]) for i in range(600)]
    rows += [(1000 + i, rows[i][1], "x") for i in range(0, 90, 3)] + [(2000 + i, np.float32(g.normal(size=5) + 2).tolist(), "z") for i in range(60)]
    rows += [(3000, [0.0] * 7 + [1.0], "x"), (3001, [-0.0] * 7 + [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.near_duplicates(df).collect()}
    assert got == brute_links(rows, 0.93)
    slim = df.selectExpr("8 AS length", "label", "vec_id AS block", "vec_id AS cls", "1L AS n", "embedding AS v").where("vec_id < 600")
    pairs, sent = embedding_join.compared(slim, slim, {8: np.eye(8)}, 0.93, 0.15)
    assert "Exchange" not in pairs._jdf.queryExecution().toString() and pairs.count() > 500
    sent.destroy()


def test_embedding_join_repeated_ids(spark):
    # id 1 has two vectors, one beside 2 and one beside 3 and 4; id 9 alone ties 5 and 6 together
    rows = [(1, [1.0, 0, 0]), (1, [0, 1.0, 0]), (2, [1.0, .01, 0]), (3, [0, 1.0, .01]), (4, [.01, 1.0, 0]),
            (5, [0, 0, 1.0]), (9, [0, 0, 1.0]), (9, [1.0, 0, 1.0]), (6, [1.0, 0, 1.01])]
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    for sample in (20_000, 4):
        got = [(r.vec_id, r.n_links, r.component_id) for r in embedding_join.near_duplicates(df, sample=sample).collect()]
        assert sorted(got) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (5, 1, 5), (6, 1, 5), (9, 1, 5), (9, 1, 5)]


def test_embedding_join_one_dense_label(spark):
    g = np.random.default_rng(5)
    rows = [(i, (np.ones(8) + g.normal(size=8) * .01).tolist(), 1) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in embedding_join.near_duplicates(df).collect()} == {(1499, 0)}


# 5
def brute_base(text):
    words = WORD.findall(text or "")
    tri = Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i in range(len(words) - 2) if tri[tuple(words[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_quality(spark, empty):
    texts = TEXTS + ["a b c a b c a b c d", "x\n y\nx\n\nx\n", "# <b> | $5\n" * 3, "a a a a", "\x85 \xa0\x0b\x0cq"]
    df = spark.createDataFrame([(i, t, "h", 3) for i, t in enumerate(texts)] + [(5, BASE, "h", 3), (None, BASE, None, None)],
                               "doc_id long, text string, source string, n_words int")
    rows = quality.judge(df).collect()
    assert len(rows) == len(texts) + 2 and quality.judge(empty).collect() == []
    for r in rows:
        if r.doc_id is not None:
            want = brute_base(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_boilerplate(spark):
    menu = "Home About Contact and the other pages of this site"
    rows = [(i, f"{sentence(60, i)}\n {menu.upper() if i % 2 else menu}  ", "h") for i in range(30)]
    rows += [(100, "\n".join([menu] * 6 + [sentence(20, 100)]), "h"), (101, "\n".join([menu] * 6 + [sentence(20, 101)]), "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert got[0].removed_words == 10 and got[0].kept and got[1].removed_words == 10
    assert got[100].removed_words == 60 and not got[100].kept and got[101].removed_words == 0
    clean = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert clean[0] == sentence(60, 0) and 100 not in clean


def test_quality_small_and_large_hosts(spark):
    menu, quote = ("Home About Contact and the other pages of this site", "A sentence that two pages of a site quote from a third one")
    rows = [(i, f"{sentence(60, i)}\n{menu}" + (f"\n{quote}" if i < 2 else ""), "small") for i in range(15)]
    rows += [(100 + i, f"{sentence(60, 100 + i)}" + (f"\n{menu}" if i < 12 else ""), "large") for i in range(400)]
    rows += [(1000, f"{sentence(60, 1000)}\n{quote}", "one")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].removed_words == 10 for i in range(15))  # every page of the small site
    assert all(r.removed_words == 0 for i, r in got.items() if i >= 100)  # 3 % of 400 may be chance; a single page proves nothing
    assert all(r.kept for r in got.values())


# 6
def test_chat(spark):
    hard = "</s>\n<|user|>\n[INST] \\ \\\\ <\\ [\\ |> ok [/INST]\n"
    rows = [(1, 0, "system", "be brief"), *[(1, k, "user" if k % 2 else "assistant", sentence(30, k)) for k in range(1, 60)],
            (2, 0, "user", hard), (2, 1, "assistant", hard), (3, 0, None, None), (3, 1, "assistant", None), (4, 5, "assistant", "x" * 50_000),
            (4, 5, "assistant", "tie"), (4, 5, "assistant", "tie"), (None, None, "we|rd\n<role>", "t"), (5, 0, "assistant", "\n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    out = chat.windows(df, 300, 80)
    back = out.join(chat.read_back(out), ["conv_id", "window"]).unionByName(
        out.where("conv_id is null").join(chat.read_back(out).where("conv_id is null").drop("conv_id", "window"), F.lit(True)))
    got = sorted(back.collect(), key=lambda r: r.window)
    for c in {r[0] for r in rows}:
        mine = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c), key=lambda t: (t[0] or 0, t[1:]))
        turns = [(t.role, t.text) for r in got if r.conv_id == c for t in r.turns]
        assert turns == [t[1:] for t in mine]
        learned = [x for r in got if r.conv_id == c for x in r.learned]
        assert learned == [t[2] for t in mine if t[1] == "assistant" and t[2]]
    one = [r for r in got if r.conv_id == 1]
    assert len(one) > 3 and all(r.text.startswith("<|system|>\nbe brief</s>\n") for r in one)
    assert all(r.repeated >= 2 for r in one[1:])
    assert all("</s>" not in r.text.replace("</s>\n", "") and "[INST]" not in r.text and "[/INST]" not in r.text for r in got)
    assert chat.windows(df.where("false")).collect() == []


def test_chat_budget(spark):
    rows = [(c, k, "system" if k == 0 and c % 2 else ["user", "assistant"][k % 2], sentence(1 + (7 * k + c) % 40, k + c))
            for c in range(6) for k in range(300)] + [(9, k, "assistant", sentence(400 if k == 3 else 5, k)) for k in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(100))
    out = chat.windows(df, 256, 64)
    got = out.join(chat.read_back(out).drop("chars"), ["conv_id", "window"]).collect()
    long = [r for r in got if len(r.text) > 4 * 256]
    assert len(long) == 1 and long[0].conv_id == 9 and len(long[0].turns) == 1
    assert sum(len(r.turns) for r in got) == len(rows)
    # no two spans that follow one another would fit into one window, but where a block ends
    for c in range(6):
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.window)
        sizes = [sum(math.ceil((len(t.role) + len(t.text) + 10) / 4) for t in r.turns if t.role != "system") for r in mine]
        lead = sum(math.ceil((len(t.role) + len(t.text) + 10) / 4) for t in mine[0].turns if t.role == "system")
        assert all(x <= 256 - 64 - lead for x in sizes)
        first = [math.ceil((len(r.turns[0].role) + len(r.turns[0].text) + 10) / 4) for r in mine]
        short = sum(x + y <= 256 - 64 - lead for x, y in zip(sizes, first[1:]))
        assert short <= mine[-1].window // (chat.BLOCK * 256)
    counted = chat.windows(df, 256, 64, count="n").join(out.select("conv_id").distinct(), "conv_id").collect()
    assert len(counted) == len(rows) - sum(r[2] == "system" for r in rows)  # 100 of 192 tokens: a turn a window


# 7
def test_url_filter(spark):
    urls = [(i, f"http://Good.ORG/news/{i}") for i in range(60)] + [(100 + i, f"https://bad.net/spam/{i}/x?y") for i in range(60)]
    urls += [(200 + i, f"https://bad.net/fine/{i}") for i in range(60)] + [(300 + i, f"http://slug.io/{'abcdefghijklmnopqrst'[i % 20]}{'xyz'[i % 3]}") for i in range(60)]
    urls += [(900, None), (901, "no scheme"), (902, "x://"), (903, "http://h#a/b"), (904, "a://sub.example.org/es/1/2/3/4/5"), (905, "a://example.org/en/12"),
             (906, "a://notexample.org/en/12"), (907, "a://a.b://c/d"), (900, None), (None, "a://b.c/")]
    pages = spark.createDataFrame([(*u, 1) for u in urls], "page_id long, url string, host int")
    labels = spark.createDataFrame([(i, False) for i in range(60)] + [(100 + i, True) for i in range(60)] + [(200 + i, False) for i in range(60)]
                                   + [(5, None), (None, True)], "page_id long, bad boolean")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1")]
    got = {r.page_id: r for r in url_filter.judge(pages, labels, rules).collect()}
    assert url_filter.judge(pages, labels, rules).count() == len(urls)
    assert got[3].verdict == "allow" and got[3].rule == "org/" and got[3].host == "good.org" and got[3].template == "/*/*"
    assert got[105].verdict == "block" and got[105].template == "/spam/*/*" and got[105].rule is None
    assert got[205].verdict == "allow" and got[305].template == "/*"
    assert (got[900].host, got[900].path, got[900].verdict) == ("", "", "allow") and got[901].host == ""
    assert (got[903].host, got[903].path) == ("h", "") and (got[907].host, got[907].path) == ("a.b:", "//c/d")
    assert got[904].rule == "example.org/es/" and got[904].template == "/*/*/*/*/*/*" and got[905].verdict == "block"
    assert got[906].rule == "org/"
    assert url_filter.judge(pages.where("false"), labels, rules).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, labels.where("false")).collect()} == {"allow"}


def test_url_filter_sees_whole_paths(spark):
    """Branches that part at the fourth segment, and deeper."""
    urls = [(i, f"http://h.net/blog/en/archive/{'spam' if i % 2 else 'news'}/x") for i in range(400)]
    urls += [(1000 + i, f"http://d.net/a/b/c/d/e/f/g/h/{'spam' if i % 2 else 'news'}/k/{i}") for i in range(400)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 1) for i, _ in urls if i % 4 < 2], "page_id long, bad boolean")
    got = url_filter.judge(pages, labels).collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in got) and len(got) == 800
    assert {r.template for r in got} == {"/*/*/*/spam/*", "/*/*/*/news/*", "/*/*/*/*/*/*/*/*/spam/*/*", "/*/*/*/*/*/*/*/*/news/*/*"}


# 8
def test_language_id(spark, docs, empty):
    df = entry.queries()["op8_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = df.where("held_out and lang is not null").collect()
    assert len(rows) > 20 and sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].ambiguous for i in (0, 1, 2, 14))
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in got.values())
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(empty)).collect()} == {"und"}
    assert language_id.predict(empty, model).collect() == []
    one = language_id.fit(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in language_id.predict(docs, one).collect()} == {"de", "und"}


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 40])
def test_codewords(n):
    code = language_id.codewords(n)
    assert len(np.unique(code, axis=0)) == n and (code.min(0) < code.max(0)).all()


# 9
def test_suffix_automaton():
    seqs = [[rnd.randrange(1, 5) for _ in range(rnd.randint(5, 40))] for _ in range(6)]
    a = licenses.Automaton(seqs)
    for _ in range(200):
        s = [rnd.randrange(1, 6) for _ in range(60)]
        grams = {tuple(q[i:j]) for q in seqs for i in range(len(q)) for j in range(i + 1, len(q) + 1)}
        longest = [max((k for k in range(i + 2) if tuple(s[i + 1 - k:i + 1]) in grams), default=0) for i in range(len(s))]
        want = [(i + 1, n) for i, n in enumerate(longest) if n >= licenses.LEAST and (i + 1 == len(s) or longest[i + 1] != n + 1)]
        got = list(a.matches(s))
        assert [(e, n) for e, n, _ in got] == want
        for e, n, state in got:
            assert a.ends[state] == {(k, i + n) for k, q in enumerate(seqs) for i in range(len(q) - n + 1) if q[i:i + n] == s[e - n:e]}


def test_licenses(spark, docs, empty):
    mit = licenses.TEMPLATES["mit"]
    texts = ["Intro words. " + mit + " more " + mit.upper(), mit.replace("furnished", "given").replace("publish,", ""), "permission is hereby granted",
             "CC BY and cc\nby; General Public License. all rights reserved", "the and of in to this license", "cc by " * 3000, None, "",
             "Licensed under CC BY-NC 4.0. x", "cc_by ccby", mit + " " + licenses.TEMPLATES["apache"]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, mit, 1), (0, texts[0], 1)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    label = lambda i: [(s.label, s.first, s.end) for s in got[i].spans]
    n = len(licenses.words_of(mit))
    assert label(0) == [("mit", 2, 2 + n), ("mit", 3 + n, 3 + 2 * n)] and got[0].spans[0].score == 1
    assert [s.label for s in got[1].spans] == ["mit"] and .9 < got[1].spans[0].score < 1
    assert label(2) == [] and label(4) == [] and label(6) == [] and label(7) == [] and label(9) == [("cc-by", 0, 2)]
    assert label(3) == [("cc-by", 0, 2), ("cc-by", 3, 5), ("gpl", 5, 8), ("reserved", 8, 11)]
    assert len(got[5].spans) == 3000 and {s.label for s in got[8].spans} == {"cc-by", "cc-by-nc"}
    assert [s.label for s in got[10].spans] == ["apache", "mit"] and len(licenses.scan(df).collect()) == len(texts) + 2
    assert licenses.scan(empty).collect() == []


def test_license_chains_do_not_overlap():
    scanner = licenses.Scanner({"t": " ".join(f"w{i}" for i in range(20))}, {}, {})
    # 100 copies of the template, each found in two parts, the first of which covers enough alone
    matches = sorted(m for c in range(0, 10_000, 100) for m in ((c, c + 14, 0, 14), (c + 15, c + 20, 15, 20)))
    spans = sorted((a, b) for _, _, a, b, _ in scanner._chained(0, matches))
    assert spans == [(c, c + 20) for c in range(0, 10_000, 100)]


def test_license_notices(spark):
    own = {"Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit",
           "Licensed under the Apache License, Version 2.0. The code": "apache", "governed by a BSD-style license": "bsd",
           "under the GNU General Public License, version 2": "gpl-2", "Mozilla Public License": None, "the MIT campus": None,
           licenses.TEMPLATES["mpl"]: "mpl", licenses.TEMPLATES["unlicense"]: "unlicense"}
    texts = list((own | {n: label for label, ns in licenses.NOTICES.items() for n in ns}).items())
    df = spark.createDataFrame([(i, f"Some text. {t} more text") for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    for r in licenses.scan(df).collect():
        text, label = texts[r.doc_id]
        assert {s.label for s in r.spans if not s.phrase} == ({label} if label else set()), text


# 10
def brute_near(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = common.find(parent, i), common.find(parent, j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), common.find(parent, i)) for i, s in sets.items()}


def test_minhash(spark, docs, empty):
    texts = list(enumerate(TEXTS)) + [(40, BASE)]
    near = sentence(300, 77).split()
    for i in range(300):  # near copies of one text at about the limit: some linked, some not
        words = list(near)
        for _ in range(rnd.randint(0, 14)):
            words[rnd.randrange(300)] = f"z{rnd.randrange(10 ** 6)}"
        texts.append((100 + i, " ".join(words)))
    df = spark.createDataFrame([(*t, 1, "x") for t in texts] + [(None, BASE, 1, "x"), (5, BASE, 1, "x")], "doc_id long, text string, n_shingles int, bands string")
    for k, percent in ((3, 85), (5, 80)):
        rows = minhash.near_duplicates(df, k, percent).collect()
        assert len(rows) == len(texts) + 2
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
        assert got == brute_near(texts, k, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    assert minhash.near_duplicates(empty).collect() == []


def test_blocks_match_sets():
    g = np.random.default_rng(9)
    sets = [np.unique(g.integers(0, 6000, g.integers(1, 5000)).astype(np.uint64)) for _ in range(30)]
    got = minhash.similar(sets[:12], sets[12:], 30)
    for i, a in enumerate(sets[:12]):
        for j, b in enumerate(sets[12:]):
            assert got[i, j] == (100 * len(np.intersect1d(a, b)) >= 30 * len(np.union1d(a, b)))


def test_components(spark):
    for n in (1, 5, 60):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n)] + [(100 + i, 101 + i) for i in range(n)]
        parent = {}
        for u, v in edges:
            x, y = common.find(parent, u), common.find(parent, v)
            parent[max(x, y)] = min(x, y)
        got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
        assert got == {x: common.find(parent, x) for u, v in edges if u != v for x in (u, v)}


def test_components_take_few_tables(spark):
    """Few links come together in one task: a chain dealt over many takes no rounds."""
    edges = [(i, i + 1) for i in range(2000)]
    rnd.shuffle(edges)
    made = []
    token = common.WRITTEN.set(made)
    try:
        got = common.components(spark.createDataFrame(edges, "u long, v long").repartition(40)).collect()
    finally:
        common.WRITTEN.reset(token)
    assert sorted((r.node, r.component) for r in got) == [(i, 0) for i in range(2001)]
    assert len(made) <= 3


def test_components_in_rounds(spark, monkeypatch):
    """More links than a task takes: rounds of joins give the same."""
    monkeypatch.setattr(common, "_forest", lambda batches: batches)
    monkeypatch.setattr(common, "NODES", 9)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(30)] + [(300 + i, 300) for i in range(30)]
    edges = [(max(e), min(e)) for e in edges] * 2
    rnd.shuffle(edges)
    got = common.components(spark.createDataFrame(edges, "u long, v long").repartition(11)).collect()
    want = {**{i: 0 for i in range(61)}, **{200 + i: 200 for i in range(30)}, **{300 + i: 300 for i in range(30)}}
    assert sorted((r.node, r.component) for r in got) == sorted({**want}.items())


def test_trees_begin_anew(monkeypatch):
    monkeypatch.setattr(common, "NODES", 3)
    pairs = [(i, i + 1) for i in range(20)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs[k:k + 2])], ["u", "v"]) for k in range(0, 20, 2)]
    out = list(common._forest(iter(batches)))
    parent = {}
    for u, v in ((u, v) for b in out for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
        x, y = common.find(parent, u), common.find(parent, v)
        parent[max(x, y)] = min(x, y)
    assert len(out) > 1 and all(b.num_rows <= 6 for b in out)
    assert {common.find(parent, x) for x in range(21)} == {0}


def test_running_sum(spark):
    rows = [(["a", "a", "a", "b", None][i % 5], rnd.randrange(1000), i, rnd.randrange(9)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, o int, i int, v long")
    got = {r.i: r.s for r in common.running_sum(df, ["g"], ["o", "i"], "v", "s").collect()}
    assert got == {i: sum(r[3] for r in rows if r[0] == g and (r[1], r[2]) <= (o, i)) for g, o, i, _ in rows}


# pipeline: each stage against what its operator promises, on the given documents
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(common.stored(stage(spark, seen[-1], SF)))
        assert seen[-1].columns == docs.columns
    good, lines, near, mixed = ({r.doc_id: r for r in d.collect()} for d in seen[1:])
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, t in texts.items():
        n = brute_base(t)
        assert i not in good if n[0] < 50 or 2 * n[4] > n[0] else i in good
    assert set(lines) == set(good)
    want = brute_near([(i, r.text) for i, r in lines.items()], 5, 80)
    assert set(near) == {i for i, (_, c) in want.items() if i == c}
    counts = Counter(r.doc_id for r in seen[4].collect())
    assert set(counts) <= set(near) and max(counts.values()) <= 2
    assert counts == Counter({r.doc_id: r.copies for r in mixing.mix(seen[3]).collect() if r.copies})
    rows = corpus_pipeline.STAGES[-1][1](spark, seen[4], SF).collect()
    assert sum(counts.values()) == len(rows)
    assert all(r.ids == lib.encode(mixed[r.doc_id].text or "") for r in rows)


def test_pipeline_edges(spark, docs, empty):
    import corpus_pipeline

    for df in (docs.drop("ids", "component_id"), empty.drop("ids", "component_id")):
        for name, stage in corpus_pipeline.STAGES:
            df = common.stored(stage(spark, df, SF))
    assert df.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]


def test_pipeline_rows_without_an_id_of_their_own(spark):
    import corpus_pipeline

    rows = [(1, sentence(80, 1))] * 4 + [(None, sentence(80, 2))] * 3 + [(2, sentence(80, 3)), (2, sentence(80, 4)), (None, sentence(80, 5))]
    df = spark.createDataFrame([(i, t, "a" if k % 2 else None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    near = common.stored(corpus_pipeline.near_duplicates(spark, df, SF))
    assert Counter(r.text for r in near.collect()) == Counter({t for _, t in rows})
    for docs, n in ((near, 5), (df, 10)):
        lazy = corpus_pipeline.mixture(spark, docs, SF)
        corpus_pipeline.near_duplicates(spark, df, SF)  # another stage leaves a result not yet written alone
        assert 1.5 * 80 * n - 80 < sum(len(r.text.split()) for r in lazy.collect()) <= 1.5 * 80 * n


def test_line_dedup_equal_rows(spark):
    df = spark.createDataFrame([(1, own_lines(1))] * 60 + [(2, own_lines(2) + PASSAGE), (3, PASSAGE + own_lines(3))], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert got == {1: own_lines(1), 2: own_lines(2) + PASSAGE, 3: own_lines(3)}


def test_line_dedup_windows_are_slim(spark):
    texts = ["", "a", "a\n", "\n\n", "Is it? Yes.  No.\nx. \n", ". ! ? .\n. ", "ä. ö\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "_id bigint, text string").withColumn("_key", F.col("_id"))
    found = line_dedup.windows(docs, "text", 1, 1, 1)
    assert "binary" not in dict(found.dtypes).values() and found.count() == found.distinct().count() == 13  # lines with words
    for r in docs.select("text", line_dedup.count_lines(F.col("text")).alias("n"), F.size(line_dedup.lines_of(F.col("text"))).alias("m")).collect():
        assert r.n == r.m == len(re.split(line_dedup.LINE_END, r.text))
        assert r.n == 1 + len(list(line_dedup.LAST.finditer(r.text.encode())))


def test_lines_of_many_texts(monkeypatch):
    """Lines and words of many texts are sought at once, with parts that end anywhere between texts."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab .!?\n\té\x0b\x1c") for _ in range(rnd.randrange(60))).encode() for _ in range(300)] + [b"", b" ", b"a. "]
    for part in (1, 70, 1 << 20):
        monkeypatch.setattr(line_dedup, "PART", part)
        for t, (whole, numbers, before, starts, ends) in zip(texts, line_dedup.lines_in(texts), strict=True):
            cuts = [0, *(m.end() for m in line_dedup.LAST.finditer(t)), len(t)]
            lines = [(k, t[a:b].split(), t[a:b].strip()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]), 1) if t[a:b].split()]
            assert numbers == [k for k, _, _ in lines] and [whole[a:b] for a, b in zip(starts, ends)] == [s for _, _, s in lines]
            assert before == [0, *itertools.accumulate(len(w) for _, w, _ in lines)]
