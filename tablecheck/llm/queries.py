"""One registered query per operator, over whole tables, and the SQL that DuckDB runs beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.collocations import collocations
from tablecheck.llm.common import materialise, words_in
from tablecheck.llm.curriculum import curriculum
from tablecheck.llm.decontaminate import contamination
from tablecheck.llm.exact_dedup import exact_duplicates
from tablecheck.llm.fill_middle import fill_in_middle, restored
from tablecheck.llm.katz import katz_scores
from tablecheck.llm.language_crf import held_out_column, learn_languages, predict_languages
from tablecheck.llm.minhash import near_duplicates
from tablecheck.llm.nearest import nearest_neighbours
from tablecheck.llm.sentencepiece_backend import encode_documents
from tablecheck.llm.shuffle_shards import uniform_shards
from tablecheck.llm.token_files import read_token_files, write_token_files
from tablecheck.llm.url_filter import judge_urls, rule_table
from tablecheck.sources.storage import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""


@query("op2_exact_duplicates", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), digest=True)


#: The rules of the query; the operator takes any table of them.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
OP3_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(verdict, rule, h, p) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
                                  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
j AS (SELECT u.*, (SELECT rule FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(rule) DESC, length(h) DESC LIMIT 1) AS rule FROM u)
SELECT page_id, host, path, j.rule AS rule, coalesce(r.verdict, 'allow') AS verdict FROM j LEFT JOIN r ON j.rule = r.rule
"""


@query("op3_url_rules", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT none, src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY none, src) - 1 AS place FROM d GROUP BY none, src),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS lim FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
               / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
             row_number() OVER o AS r
      FROM w WINDOW o AS (ORDER BY lim / weight, place)),
f AS (SELECT * FROM l WHERE level <= lim / weight ORDER BY r LIMIT 1),
t AS (SELECT l.none, l.src, l.source_size, l.place, CASE WHEN f.r IS NULL OR l.r < f.r THEN l.lim::DOUBLE ELSE f.level * l.weight END AS target FROM l LEFT JOIN f ON true),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place,
         coalesce(sum(d.size) OVER (PARTITION BY d.none, d.src ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + d.size / 2 AS middle
  FROM d JOIN t ON d.none = t.none AND d.src = t.src),
c AS (SELECT *, (middle <= target)::BIGINT + (middle + source_size <= target)::BIGINT + (middle + 2 * source_size <= target)::BIGINT AS copies,
             CASE WHEN target > 0 THEN middle / target ELSE 0.0 END AS u FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target, size * copies AS taken, copies,
       CASE WHEN copies > 0 THEN round(CASE place % 3
         WHEN 0 THEN least(1.0, 2 * u / (1.5 + sqrt(greatest(0.0, 2.25 - 2 * u))))
         WHEN 2 THEN least(1.0, 2 * u / (0.5 + sqrt(greatest(0.0, 0.25 + 2 * u))))
         ELSE CASE WHEN u >= 0.5 THEN 0.5 + least(0.5, 2 * (u - 0.5) / (1.5 + sqrt(greatest(0.0, 2.25 - 4 * (u - 0.5)))))
                   ELSE least(0.5, 2 * u / (0.5 + sqrt(greatest(0.0, 0.25 + 4 * u)))) END END, 9) END AS first_position
FROM c
"""


@query("op4_curriculum", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In training order of the first copies; documents that the mix leaves out come last."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in(F.col("text")).alias("words"))
    mixed = curriculum(materialise(docs, "sizes"), size_col="words")
    mixed = mixed.withColumn("first_position", F.round(F.get("positions", F.lit(0)), 9)).drop("positions")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position").orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


@query("op8_uniform_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts are exchanged; size and checksum are those of the text that arrives in the shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sharded = uniform_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 40, payload=["doc_id", "text"])
    sharded = sharded.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "law", "shard", "slot")
    return sharded.withColumn("grown_shard", F.lit(None).cast("int"))


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


@query("op1_languages")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = predict_languages(docs, learn_languages(docs))
    return predicted.select("doc_id", held_out_column().alias("held_out"), "lang_pred", "score")


OP9_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op9_near_duplicates", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"))


OP7_SQL = r"""
WITH
d AS (SELECT doc_id, list_reduce(list_concat([4294967295::BIGINT], list_transform(split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS crc,
        list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS ws FROM documents),
t AS (SELECT doc_id, xor(crc, 4294967295::BIGINT) % 7 = 2 AS held_out, unnest(ws) AS w, unnest(list_prepend('', ws[:-2])) AS h FROM d),
u AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM u),
b AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY h, w),
r AS (SELECT c AS r, count(*) AS n FROM b GROUP BY c),
k AS (SELECT i AS r, coalesce((SELECT n FROM r WHERE r.r = i), 0)::DOUBLE AS a, coalesce((SELECT n FROM r WHERE r.r = i + 1), 0)::DOUBLE AS z,
             coalesce((SELECT n FROM r WHERE r.r = 1), 0)::DOUBLE AS one, coalesce((SELECT n FROM r WHERE r.r = 6), 0)::DOUBLE AS six FROM range(1, 6) x(i)),
g AS (SELECT r, CASE WHEN one > 0 AND a > 0 AND 6 * six / one < 1 THEN ((r + 1) * z / (r * a) - 6 * six / one) / (1 - 6 * six / one) ELSE 0 END AS d FROM k),
f AS (SELECT r, CASE WHEN d > 0 AND d < 1 THEN d ELSE (r - 0.5::DOUBLE) / r END AS d FROM g),
p AS (SELECT b.h, sum(b.c)::DOUBLE AS total, coalesce(sum(b.c * (1 - f.d)), 0) AS taken, sum(u.c + 1)::DOUBLE AS mass FROM b JOIN u USING (w) LEFT JOIN f ON f.r = b.c GROUP BY b.h),
a AS (SELECT h, CASE WHEN taken > 0 THEN total ELSE total + 1 END AS den, total, taken, mass FROM p),
s AS (SELECT t.doc_id, t.held_out, u.c AS c, log10((coalesce(u.c, 0) + 1)::DOUBLE / (n.n + n.v + 1)) AS base,
             CASE WHEN b.c IS NOT NULL THEN log10(b.c * coalesce(f.d, 1) / a.den)
                  WHEN a.h IS NOT NULL THEN log10((1 - (a.total - a.taken) / a.den) / (1 - a.mass / (n.n + n.v + 1))) + log10((coalesce(u.c, 0) + 1)::DOUBLE / (n.n + n.v + 1))
                  ELSE log10((coalesce(u.c, 0) + 1)::DOUBLE / (n.n + n.v + 1)) END AS lp, n.n AS train_tokens
      FROM t CROSS JOIN n LEFT JOIN u ON u.w = t.w LEFT JOIN b ON b.h = t.h AND b.w = t.w LEFT JOIN f ON f.r = b.c LEFT JOIN a ON a.h = t.h)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, train_tokens, round(sum(base), 6) AS base_score, round(sum(lp), 6) AS score FROM s GROUP BY ALL
"""


@query("op7_katz_scores", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = katz_scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    return scores.withColumns({"base_score": F.round("base_score", 6), "score": F.round("score", 6)})


OP11_SQL = r"""
WITH
w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT item_id, least(10, len(ws)) AS k, unnest(list_transform(range(1, greatest(len(ws) - 10, 0) + 2), lambda s: array_to_string(ws[s:s + 9], ' '))) AS phrase FROM b WHERE len(ws) > 0),
k AS (SELECT DISTINCT k FROM i),
p AS (SELECT r, k, unnest(range(1, len(ws) - k + 2)) AS s, ws FROM w, k WHERE len(ws) >= k),
o AS (SELECT p.r, p.s, p.k, i.item_id FROM p JOIN i ON i.k = p.k AND i.phrase = array_to_string(p.ws[p.s:p.s + p.k - 1], ' ')),
h AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT DISTINCT r, unnest(range(s, s + k)) AS place FROM o) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM o WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query("op11_contamination", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("item_ids").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
e AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256
FROM c
"""


@query("op12_fill_in_middle", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    again = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH
p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda s: ws[s:s + k - 1])) AS g FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, g, count(*)::HUGEINT AS f FROM g GROUP BY lang, k, g),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
x AS (SELECT lang, g, max(f) AS most FROM (SELECT lang, g[1:2] AS g, f FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3] AS g, f FROM c WHERE k = 3) GROUP BY lang, g),
s AS (SELECT c.lang, c.g, c.f AS a, j, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f) // (l.f * r.f) AS score
      FROM c, (VALUES (1), (2)) v(j) JOIN f l ON l.lang = c.lang AND l.g = c.g[1:j] JOIN f r ON r.lang = c.lang AND r.g = c.g[j + 1:] WHERE j < c.k),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
k AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN x ON x.lang = b.lang AND x.g = b.g WHERE x.most IS NULL OR 100 * x.most < 50 * b.a)
SELECT lang, row_number() OVER o AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM k JOIN n USING (lang) WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
