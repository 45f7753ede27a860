"""Lexical search, toxicity and token alignment beside brute force, held-out rows and both
tokenizers' own libraries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from auditlake.llm import common, lexical_search, token_alignment, toxicity

SF = "/root/testdata/sf0.001"
LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "  \n\t ", "one", "One ONE óne", "a\x00b", "▁mark", "<s></s><unk><|endoftext|><0x41>", "é́ 字 👩‍👩‍👧 한국어 ไทย",
       "x" * 3000, "=" * 700 + " " * 900 + "\n" * 40, "1234567890 " * 50, "don't we'll I'M", "a b" * 400, " ﻿�", "one"]


def rows(texts):
    return [(i, t, "item", "x", 1, "7", 2) for i, t in enumerate(texts)] + [(3, texts[3], None, None, None, None, None), (None, "one óne", None, None, 5, "k", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(ODD), "doc_id long, text string, item string, id string, rank int, score string, block int")


# ---- op11

def ranked(docs, items, k):
    """The contract, one document and item at a time."""
    words = [re.findall(common.TERM, (t or "").translate(LOWER)) for _, t in docs]
    n, total = sum(map(bool, words)), sum(map(len, words))
    held = Counter(w for ws in words for w in set(ws))
    out = []
    for item, t in items:
        found = []
        for (doc, _), ws in zip(docs, words):
            tf, score = Counter(ws), 0
            for w in set(re.findall(common.TERM, (t or "").translate(LOWER))):
                if tf[w]:
                    m = 50 + 50 * len(ws) * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * held[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 14, 100])
def test_search(spark, docs, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Ä", "ß1"]
    more = [(100 + i, " ".join(r.choices(words, k=r.randrange(1, 90)))) for i in range(300)]
    texts = [(x[0], x[1]) for x in rows(ODD)] + more + more[:4]
    items = [(i, " ".join(r.choices(words, k=12))) for i in range(5)] + [(7, None), (8, " .,"), (9, "one"), (None, "W1 w1"), (5, "x" * 3000 + " w3")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (3, 500):
        got = lexical_search.search(table, asked, k=k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == ranked(texts, items, k)
    assert lexical_search.search(docs, asked.where("false")).count() == 0
    assert lexical_search.search(docs.where("false"), asked).count() == 0
    assert {r.doc_id for r in lexical_search.search(docs, asked.where("item_id = 9")).collect()} == {4, 5, 16, None}


def test_search_exact_tiles():
    """Many columns of greatest weights: the products stay whole numbers."""
    words = [f"t{i}".encode() for i in range(5000)]
    block = lexical_search.Block([words], words, {lexical_search.COUNTED: 10**9, lexical_search.TERMS: 10**10} | {i: i % 7 for i in range(5000)})
    text = " ".join(w.decode() for w in words for _ in range(1 + len(w) % 3))
    tf = [1 + len(w) % 3 for w in words]
    m = 50 + 50 * sum(tf) * 10**9 // 10**10
    assert block.scores([text, None])[:, 0].tolist() == [sum(int(w) * (10**9 * f // (1000 * f + 20 * m)) for w, f in zip(block.weight, tf)), 0]


def test_search_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()["op11_search"](spark, SF)
    columns = sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(
        con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()['op11_search']})").fetchall())


# ---- op12

def test_words_and_features():
    texts = ["One two, one", None, "", "é-字", "x", "one\x00two"]
    hashes, of = toxicity.words(pa.array(["skipped", *texts], pa.string()).slice(1))
    assert of.tolist() == [0, 0, 0, 3, 3, 4, 5, 5]
    assert hashes[0] == hashes[2] == hashes[6] and hashes[1] == hashes[7] and len(set(hashes.tolist())) == 5
    found, rows = toxicity.features(hashes, of)
    assert Counter(rows.tolist()) == {0: 6, 3: 3, 4: 1, 5: 3}
    assert toxicity.words(pa.array([], pa.string()))[0].size == toxicity.words(pa.array([None, ""], pa.string()))[0].size == 0


def test_toxicity(spark):
    r = random.Random(8)
    plain, bad = [f"w{i}" for i in range(400)], ["vile", "rotten"]
    rows = []
    for i in range(900):
        toxic = i % 6 == 0
        words = r.choices(plain, k=r.choice([5, 40, 300]))
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad)
        rows.append((i, " ".join(words), int(toxic), 3.5, "x"))
    rows += [(None, "vile", None, None, None), (2000, None, 1, None, None), (2001, "", 0, None, None), (2002, "\n .", None, None, None),
             (2003, " ".join(plain * 300), 0, None, None), (2004, " ".join(plain * 300) + " Rotten!", None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double, at string")
    known = table.where("toxic IS NOT NULL").select("doc_id", "toxic")
    taught = known.where("doc_id % 3 != 1").unionByName(spark.createDataFrame([(5, None), (None, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(table, taught)
    got = toxicity.score(table, model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    by = {x.doc_id: x.predicted for x in got}
    held = [x for x in rows[:900] if x[0] % 3 == 1]
    assert sum(by[x[0]] == x[2] for x in held) >= 0.98 * len(held)
    assert by[None] == by[2004] == 1 and by[2000] == by[2001] == by[2002] == by[2003] == 0
    assert len(model.at) < 4000
    again = toxicity.fit(table, taught)
    assert np.array_equal(again.at, model.at) and np.allclose(again.weight, model.weight)
    none = toxicity.fit(table, taught.where("false"))
    assert len(none.at) == 0 and {x.score for x in toxicity.score(table, none).collect()} == {0.5}
    assert toxicity.score(table.where("false"), model).count() == 0


def test_toxicity_sample_and_shards(spark, monkeypatch):
    labels = spark.range(5000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    n = toxicity.sample(labels, "doc_id", "toxic", rows=1000).count()
    assert 800 < n < 1200 and toxicity.sample(labels, "doc_id", "toxic", rows=9000).count() == 5000
    monkeypatch.setattr(toxicity, "SHARD", 100)
    docs = spark.range(600).selectExpr("id AS doc_id", "concat_ws(' ', 'a', id % 9, 'b', CASE WHEN id % 4 = 0 THEN 'vile' ELSE 'fine' END) AS text")
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 AS int) AS toxic"))
    assert {(x.doc_id % 4 == 0) == bool(x.predicted) for x in toxicity.score(docs, model).collect()} == {True}


def test_toxicity_query(spark):
    got = entry.queries()["op12_toxicity"](spark, SF).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got) and len(got) == len({x.doc_id for x in got})


# ---- op13

def groups_of(text, left, right, letters):
    if not text:
        return [], [], []
    raw = (" " + text).encode()
    a = left.encode(" " + text, add_special_tokens=False).ids
    b = right.encode(text)
    size_a = [bytes(letters[c] for c in left.id_to_token(i)) for i in a]
    size_b = [bytes([int(right.id_to_piece(i)[1:-1], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(size_a) == raw == b"".join(size_b):
        return [], [], []
    groups, i, j, x, y, ga, gb = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            x += len(size_a[i])
            ga.append(a[i])
            i += 1
        else:
            y += len(size_b[j])
            gb.append(b[j])
            j += 1
        if x == y:
            groups.append((ga, gb))
            ga, gb = [], []
    return a, b, groups


def brute(texts):
    left = Tokenizer.from_file(LEFT)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    letters = token_alignment.byte_alphabet()
    found = [groups_of(t, left, right, letters) for _, t in texts]
    links = [[(p, q) for ga, gb in g for p in ga for q in gb] for _, _, g in found]
    count = Counter(pair for one in links for pair in set(one))
    most = defaultdict(int)
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    digest = lambda g: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else ""
    return sorted(((doc, len(a), len(b), len(g), len(one), sum(count[p] == most[p[0]] for p in one), sum(count[p] for p in one), digest(g))
                   for (doc, _), (a, b, g), one in zip(texts, found, links)), key=repr)


@pytest.mark.parametrize("entries,small", [(1 << 21, 256), (200, 1)])
def test_alignment(spark, docs, monkeypatch, entries, small):
    monkeypatch.setattr(token_alignment, "ENTRIES", entries)
    monkeypatch.setattr(token_alignment, "SMALL", small)
    r = random.Random(2)
    more = [(100 + i, t) for i, t in enumerate(x for (x,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect())]
    more += [(300 + i, "".join(r.choices("aé 字Z9.\n▁=x ", k=r.randrange(60)))) for i in range(60)]
    texts = [(x[0], x[1]) for x in rows(ODD)] + more
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = token_alignment.cross_align(table, LEFT, public_tokenizers.PATTERN, RIGHT)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(texts)
    assert token_alignment.cross_align(table.where("false"), LEFT, public_tokenizers.PATTERN, RIGHT).count() == 0


def test_containers_round_trip():
    r = np.random.default_rng(4)
    wanted = {}
    for pair, n in ((5, 1), (9, 3), (11, 4095), (12, 4096), (40, 60000), (41, 17)):
        for doc in r.choice(1 << 16, n, replace=False).tolist():
            wanted[pair, doc] = int(r.integers(1, 70)) if pair in (9, 12, 41) else 1
    keys = np.array(sorted((p << 16) + d for p, d in wanted), np.int64)
    times = np.array([wanted[k >> 16, k & 65535] for k in keys.tolist()], np.int64)
    got = {}
    for batch in token_alignment.containers(keys, times):
        of, doc, n = token_alignment.entries(batch)
        for i, d, k in zip(of.tolist(), doc.tolist(), n.tolist()):
            got[batch.column("pair")[i].as_py(), d] = k
        assert batch.column("n").to_pylist() == np.bincount(of).tolist()
        assert max(map(len, batch.column("bits").to_pylist())) <= 8192
    assert got == wanted
