"""One query per operator over its whole table, and the pipeline's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorepix.llm import (decontamination, fill_middle, jaccard, language, lexical, line_dedup, packing, quality, sharding,
                          token_counts, token_files, topk, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_pattern_packing")
def pattern_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), 4096)


#: Characters of a section; longer lines are cut, inside words as well, so that tokens reach over section bounds.
LONGEST_SECTION = 200


@query("op4_section_token_counts")
def section_token_counts(spark, folder):
    return token_counts.section_token_counts(table(spark, folder, "documents"), longest=LONGEST_SECTION)


@query("op5_token_files")
def token_id_files(spark, folder):
    manifest = token_files.write_token_files(table(spark, folder, "documents"))
    return token_files.read_token_files(manifest, with_ids=False)


@query("op1_hypergeometric_sharding")
def hypergeometric_sharding(spark, folder):
    dealt = sharding.shuffle_into_shards(table(spark, folder, "documents"), 40)
    text = F.coalesce(F.col("text"), F.lit(""))
    return dealt.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_pivot_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5""")
def pivot_top_k(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


@query("op6_language_naive_bayes")
def language_naive_bayes(spark, folder):
    return language.identify(table(spark, folder, "documents"))


@query("op7_line_chain_quality")
def line_chain_quality(spark, folder):
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_spaced_seed_decontamination", r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
  FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
bw AS (SELECT item_id, len(w) AS m, unnest(w) AS word, unnest(range(len(w))) AS item_pos FROM b),
hit AS MATERIALIZED (SELECT doc_id, item_id, n, m, pos, pos - item_pos AS shift FROM dw JOIN bw USING (word)),
line AS (SELECT doc_id, item_id, shift FROM hit GROUP BY doc_id, item_id, shift HAVING count(*) >= any_value(CASE WHEN m < 12 THEN m ELSE 10 END)),
near AS MATERIALIZED (SELECT hit.* FROM hit JOIN line USING (doc_id, item_id, shift)),
starts AS (
  SELECT DISTINCT doc_id, item_id, shift, pos - back AS s
  FROM near, (SELECT unnest(range(12)) AS back)
  WHERE back < m AND pos - back >= greatest(0, shift) AND pos - back <= least(n - least(m, 12), m - least(m, 12) + shift)),
leak AS (
  SELECT doc_id, item_id, s, least(any_value(m), 12) AS width, count(*) AS equal_words
  FROM starts JOIN near USING (doc_id, item_id, shift)
  WHERE pos BETWEEN s AND s + least(m, 12) - 1
  GROUP BY doc_id, item_id, shift, s HAVING count(*) >= CASE WHEN any_value(m) < 12 THEN any_value(m) ELSE 10 END)
SELECT doc_id, item_id, CAST(min(s) AS INTEGER) AS first_word, CAST(max(s + width) AS INTEGER) AS last_word,
       CAST(max(equal_words) AS INTEGER) AS best
FROM leak GROUP BY doc_id, item_id""")
def spaced_seed_decontamination(spark, folder):
    return decontamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_line_dedup")
def deletion_neighbourhood_lines(spark, folder):
    return line_dedup.without_repeated_lines(table(spark, folder, "documents"), ["doc_id", "text"])


@query("op9_ngram_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inverted AS (SELECT g, doc_id FROM s QUALIFY count(*) OVER (PARTITION BY g) > 1),
overlap AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM inverted a JOIN inverted b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT x, y FROM overlap JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION
  SELECT both_ways.y, reach.r FROM reach JOIN both_ways ON both_ways.x = reach.v),
same AS (
  SELECT doc_id, count(*) OVER (PARTITION BY list_sort(list(g))) AS n_copies FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, coalesce(same.n_copies, 1) AS n_copies
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN same USING (doc_id)
JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) c ON c.v = d.doc_id""")
def ngram_jaccard_join(spark, folder):
    return jaccard.similar_documents(table(spark, folder, "documents"))


@query("op9_ngram_jaccard_links", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inverted AS (SELECT g, doc_id FROM s QUALIFY count(*) OVER (PARTITION BY g) > 1),
overlap AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM inverted a JOIN inverted b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT x, y FROM overlap JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION
  SELECT both_ways.y, reach.r FROM reach JOIN both_ways ON both_ways.x = reach.v),
same AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY g) AS class_id, count(*) OVER (PARTITION BY g) AS n_copies
  FROM (SELECT doc_id, list_sort(list(g)) AS g FROM s GROUP BY doc_id)),
links AS (
  SELECT x AS doc_id, count(DISTINCT b.class_id) AS n_links
  FROM both_ways JOIN same a ON a.doc_id = x JOIN same b ON b.doc_id = y WHERE a.class_id <> b.class_id GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(same.class_id, d.doc_id) AS class_id, c.component_id,
       coalesce(same.n_copies, 1) AS n_copies, coalesce(links.n_links, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN same USING (doc_id) LEFT JOIN links USING (doc_id)
JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) c ON c.v = d.doc_id""")
def ngram_jaccard_links(spark, folder):
    return jaccard.linked_documents(table(spark, folder, "documents"))


@query("op11_swar_fill_middle", """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS s FROM documents),
h AS (
  SELECT *, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3,
         CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""")
def swar_fill_middle(spark, folder):
    made = fill_middle.transform(table(spark, folder, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(fill_middle.restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


@query("op12_dual_tree_search", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
f AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
t AS MATERIALIZED (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM f WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term),
s AS (
  SELECT item_id, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total))))) AS BIGINT) AS score
  FROM t JOIN q USING (term) JOIN v USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20""")
def dual_tree_search(spark, folder):
    return lexical.ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_content_archive", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> kept THEN kept END AS refers_to
FROM r""")
def content_archive(spark, folder):
    return warc.record_facts(warc.read_archive(spark, warc.write_archive(table(spark, folder, "pages"))))
