"""Named queries: each operator over its whole table, and their DuckDB SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, embedding_join, language_id, lexical_search, licenses, line_dedup, minhash, mixing, quality,
               sentencepiece_bpe, token_alignment, toxicity, url_filter)
from .common import load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = sentencepiece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return tokens.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                         F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                         F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, shingle=3, percent=85)


@query
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# running sums, water-filling over sources and the cut at the budget, all in one statement
ORACLES["op1_mix"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5('mix' || coalesce(doc_id::VARCHAR, '')) AS turn FROM documents),
q AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
             sum(source_size) OVER z - source_size AS f, sum(weight) OVER z - weight AS fw FROM w
      WINDOW z AS (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (total * 150 / 100 - f * 2)::DOUBLE / (weights - fw)::DOUBLE AS level FROM f),
m AS (SELECT *, min(CASE WHEN weight * level < source_size * 2 THEN fw END) OVER () AS open FROM l),
n AS (SELECT *, min(CASE WHEN fw = open THEN level END) OVER () AS final FROM m),
t AS (SELECT source, source_size, CASE WHEN open IS NULL OR fw < open THEN source_size::DOUBLE * 2
                                       ELSE least(source_size::DOUBLE * 2, weight * final) END AS target FROM n),
p AS (SELECT q.doc_id, q.size, q.turn, k, (k * source_size + upto)::DOUBLE / target AS finish
      FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) v(k) WHERE size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS spent FROM p),
x AS (SELECT doc_id, turn, size, count(*) AS copies FROM c WHERE spent <= (SELECT sum(size) * 1.5 FROM d) GROUP BY ALL)
SELECT q.doc_id, q.size::BIGINT AS size, source_size, target, (q.size * coalesce(copies, 0))::BIGINT AS taken
FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source LEFT JOIN x ON q.doc_id = x.doc_id AND q.size = x.size"""


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


ORACLES["op5_quality"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM d),
h AS (SELECT doc_id, i, a || ' ' || lead(a, 1) OVER z || ' ' || lead(a, 2) OVER z AS tri FROM g WINDOW z AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM h WHERE tri IS NOT NULL),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) v(j) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS x FROM d),
m AS (SELECT doc_id, source, t, x, array_to_string(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS line,
             len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
u AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup FROM m GROUP BY doc_id),
a AS (SELECT source, line, count(DISTINCT t) AS n FROM m GROUP BY source, line
      HAVING count(DISTINCT t) >= 3),
v AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source),
b AS (SELECT a.source, a.line FROM a JOIN v ON a.source IS NOT DISTINCT FROM v.source
      WHERE 100.0 * n > 2 * docs AND (100.0 * n - 2 * docs) * (100.0 * n - 2 * docs) > 11.0 * 2 * 98 * docs),
k AS (SELECT m.doc_id, sum(words) AS lost FROM m JOIN b ON m.source IS NOT DISTINCT FROM b.source AND m.line = b.line GROUP BY m.doc_id),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, len(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
             (len(t) - len(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS removed_words
      FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN u ON d.doc_id = u.doc_id LEFT JOIN k ON d.doc_id = k.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * removed_words <= 50 * n_words AS kept FROM f"""


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # no stage for near copies follows, so none is spared
    done = line_dedup.dedup(load(spark, sf_dir, "documents").select("doc_id", "text"), most=100)
    return done.select("doc_id", "n_lines", "removed_lines", "removed_words", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def op4_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(load(spark, sf_dir, "embeddings"))


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", extra), (-7, 1, "assistant", extra)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.windows(turns.unionByName(own), budget=512, history=128))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = back.select("conv_id", F.struct("window", said.alias("said"), F.array_join("learned", "").alias("learned")).alias("w"),
                        F.size("turns").alias("n"), "chars")
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                         F.sort_array(F.collect_list("w")).alias("w"))
    joined = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    return whole.select("conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"),
                        F.length(joined("learned")).cast("bigint").alias("loss_chars"),
                        F.sha2(joined("learned"), 256).alias("loss_sha256"), "formatted_chars")


ORACLES["op6_chat"] = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
c AS (SELECT *, 10 + len(regexp_replace(role, '([<\[\\|])', '\1\1', 'g')) + len(regexp_replace(text, '([<\[\\])', '\1\1', 'g')) AS chars,
             dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
p AS (SELECT *, ceil(chars / 4)::BIGINT AS tokens, i = 1 AND role = 'system' AS sys FROM c),
b AS (SELECT *, sum(tokens) OVER w AS upto, sum(tokens) OVER w - tokens AS before, CASE WHEN sys THEN 0 ELSE tokens END AS cost,
             greatest(512 - 128 - max(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY c), 0) AS room, sum(tokens) OVER (PARTITION BY c) AS total
      FROM p WINDOW w AS (PARTITION BY c ORDER BY i)),
r AS (SELECT c, i, before, before AS span, cost AS used FROM b WHERE i = 1
      UNION ALL
      SELECT b.c, b.i, b.before, CASE WHEN o THEN b.before ELSE span END, CASE WHEN o THEN cost ELSE used + cost END
      FROM (SELECT b.*, r.span, r.used, b.before // (32 * 512) <> r.before // (32 * 512) OR (used > 0 AND used + cost > room) AS o
            FROM r JOIN b ON b.c = r.c AND b.i = r.i + 1) b),
n AS (SELECT b.*, span, max(upto) OVER (PARTITION BY b.c, span) AS next FROM b JOIN r ON b.c = r.c AND b.i = r.i),
s AS (SELECT c, count(DISTINCT span) - 1 AS more FROM n GROUP BY c),
g AS (SELECT n.*, chars * (1 + (NOT sys AND next - before <= 128 AND next < total)::INT + (CASE WHEN sys THEN more ELSE 0 END)) AS written
      FROM n JOIN s ON n.c = s.c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY upto)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY upto) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(written)::BIGINT AS formatted_chars FROM g GROUP BY conv_id"""

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    # the last number of a path is the document that the page shows
    shown = pages.select("page_id", F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]{1,18})[^/]*$", 1).try_cast("bigint").alias("doc_id"))
    marks = load(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge(pages, shown.join(marks, "doc_id"), RULES).select("page_id", "host", "path", "rule", "verdict", "template")


def _tree_sql(levels: int = 4) -> str:
    """The levels of the template tree, written out; deeper than the given paths, which have two."""
    sql = [r"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
v AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS s FROM u),
m AS (SELECT page_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM (SELECT page_id, try_cast(regexp_extract(path, '/([0-9]{1,18})[^/]*$', 1) AS BIGINT) AS doc_id FROM u) x
      JOIN labels USING (doc_id) WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY page_id),
c AS (SELECT host, s, count(*) AS pages, count(bad) AS labels, coalesce(sum(bad), 0)::BIGINT AS bad FROM v LEFT JOIN m USING (page_id) GROUP BY ALL),
x0 AS (SELECT *, s AS t FROM c)"""]
    n = 0
    wild = lambda k: f"x.t[1:{k}] || ['*'] || x.t[{k + 2}:]"
    for k in range(levels):
        sql.append(f"""f{n} AS (SELECT host, t[1:{k + 1}] AS key, t[1:{k}] AS above, sum(pages) AS own FROM x{n} WHERE len(t) > {k} GROUP BY ALL),
g{n} AS (SELECT *, count(*) OVER w AS kinds, sum(own) OVER w AS total FROM f{n} WINDOW w AS (PARTITION BY host, above)),
x{n + 1} AS (SELECT x.* REPLACE (CASE WHEN g.kinds > {url_filter.SIBLINGS} AND 100 * g.own * g.kinds < {url_filter.RARE} * g.total THEN {wild(k)} ELSE x.t END AS t)
      FROM x{n} x LEFT JOIN g{n} g ON x.host = g.host AND x.t[1:{k + 1}] = g.key)""")
        n += 1
    for k in reversed(range(levels)):
        sql.append(f"""f{n} AS (SELECT host, t[1:{k + 1}] AS key, t[1:{k}] AS above, sum(labels) AS l, sum(bad) AS b FROM x{n} WHERE len(t) > {k} GROUP BY ALL),
g{n} AS (SELECT *, sum(l) OVER w AS al, sum(b) OVER w AS ab FROM f{n} WINDOW w AS (PARTITION BY host, above)),
x{n + 1} AS (SELECT x.* REPLACE (CASE WHEN ((b * al - l * ab) * (b * al - l * ab))::DOUBLE <= {url_filter.Z2} * (l * ab * (al - ab))::DOUBLE THEN {wild(k)} ELSE x.t END AS t)
      FROM x{n} x LEFT JOIN g{n} g ON x.host = g.host AND x.t[1:{k + 1}] = g.key)""")
        n += 1
    pull = url_filter.PULL
    sql.append(f"""y AS (SELECT *, sum(labels) OVER (PARTITION BY host, t) AS al, sum(bad) OVER (PARTITION BY host, t) AS ab,
             sum(labels) OVER (PARTITION BY host) AS hl, sum(bad) OVER (PARTITION BY host) AS hb,
             (sum(bad) OVER () + 1)::DOUBLE / (sum(labels) OVER () + 2)::DOUBLE AS base FROM x{n}),
z AS (SELECT *, (ab + {pull} * ((hb + {pull} * base) / (hl + {pull}))) / (al + {pull}) AS rate, '/' || array_to_string(t, '/') AS template FROM y),
q AS (SELECT v.page_id, v.host, v.path, rate, template, CASE
      {' '.join(f"WHEN (v.host = '{h}' OR ends_with(v.host, '.{h}')) AND starts_with(v.path, '{p}') THEN '{verdict} {h}{p}'"
                for verdict, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))} END AS hit
      FROM v JOIN z ON v.host = z.host AND v.s = z.s)
SELECT page_id, host, path, string_split(hit, ' ')[2] AS rule,
       coalesce(string_split(hit, ' ')[1], CASE WHEN rate > {url_filter.WORST} THEN 'block' ELSE 'allow' END) AS verdict, template FROM q""")
    return ",\n".join(sql)


ORACLES["op7_url_filter"] = _tree_sql()


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.fit(docs.where(~held))
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(load(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["phrase"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first"])
    return found.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("spans")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))


@query
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), k=50)


ORACLES["op11_search"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
p AS (SELECT doc_id, len(w) AS own, unnest(w) AS term FROM d),
t AS (SELECT doc_id, own, term, count(*) AS tf FROM p GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
x AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
                                  * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * own * n) // l))))::BIGINT AS score
      FROM i JOIN t USING (term) JOIN f USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM x WHERE score > 0)
SELECT item_id, place::INT AS rank, doc_id, score FROM r WHERE place <= 50"""


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load(spark, sf_dir, "labels")
    held = lambda id: F.coalesce(F.crc32(F.col(id).cast("string")) % 3 == 1, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held("doc_id")), label="toxic")
    return toxicity.score(docs, model, limit=0.7).select("doc_id", held("doc_id").alias("held_out"), "score", "predicted")


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.cross_align(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                       public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
