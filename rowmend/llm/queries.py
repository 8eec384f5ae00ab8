"""The registered queries of the operators, and their SQL where SQL can express them.

`held_out` is null where doc_id is: such a row belongs to no third, is never learnt from, and gets its result like any other.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmend.llm import binary, html, jaccard, langid, neardup, packing, pieces, quality, ranked, spelling, topk, toxicity, urlfilter
from rowmend.llm.common import fold, shared_dir


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the public tokenizers; ROWMEND_TOKENIZERS names another folder."""
    folder = os.environ.get("ROWMEND_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_crc(df: DataFrame, column: str, out: str) -> DataFrame:
    """`df` with the crc32 and the number of the ids in a binary column of unsigned 32-bit integers."""
    return df.withColumn(out, F.crc32(column)).withColumn("n_ids", (F.octet_length(column) / 4).cast("long"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(points, points.where("vec_id % 20 = 0"), 20)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold() != 1).select("doc_id", "toxic")
    lexicon = toxicity.fit(docs, labels)
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    decoded = pieces.decode(pieces.encode(docs, path), path)
    out = with_crc(decoded, "ids", "ids_crc32")
    return out.select("doc_id", F.col("n_ids").alias("n_pieces"), "ids_crc32", F.length("text").cast("long").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    out = with_crc(packing.pack(docs, tokenizer_file("word_bpe_49k.json")), "ids", "ids_crc32")
    return out.select("doc_id", "start", F.col("n_ids").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op6_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    binary.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    out = with_crc(binary.read_tokens(spark, path), "ids", "ids_crc32")
    return out.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def language_model(docs: DataFrame) -> dict[str, bytes]:
    return langid.fit(docs.where(fold() != 1).select("doc_id", "text", "lang"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def quality_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most quality.FIT_ROWS texts labelled as of good quality, by hash of the id, without the held-out third."""
    good = labels.where(F.col("quality") == 1).where(fold() != 1).select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(quality.FIT_ROWS)
    return docs.select("doc_id", "text").join(F.broadcast(good), "doc_id").select("text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.resample(docs, quality_target(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold() == 1).alias("held_out"), "n_grams", "log_weight", "key", "selected")


#: The rules that every URL is judged by before the patterns.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urlfilter.host_rules(spark, URL_RULES).unionByName(urlfilter.rules(spark, urlfilter.PATTERNS, tier=1))
    out = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    rule = F.when(F.col("tier") == 0, F.expr("substring(pattern, 3)"))
    return out.select("page_id", "host", "path", rule.alias("rule"), "verdict", F.when(F.col("tier") == 1, F.col("pattern")).alias("pattern"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(table(spark, sf_dir, "documents"), every=97, longer=5).where("n >= 3")
    return spelling.variants(counts).select("word", "form", "root", "n", "n_near", "form_n")


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


QUERIES = {f.__name__: f for f in (op1_topk, op2_toxicity, op3_pieces, op4_packing, op5_jaccard, op6_binary, op7_langid, op8_html, op9_neardup, op10_quality, op11_urls, op12_spelling, op13_ranked)}

_OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""

_SETS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
l AS (
  SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
"""
_OP5 = _SETS + """
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id AND r.c < l.b)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CAST(least(doc_id, (SELECT min(c) FROM r WHERE r.id = n.doc_id)) AS BIGINT) AS component_id FROM n
"""


def _pattern_sql(pattern: str) -> str:
    """The regular expression of a pattern, for SQL."""
    body = re.escape(pattern.strip("|")).replace(r"\^", "(?:[^0-9A-Za-z_.%-]|\\z)").replace(r"\*", ".*").replace(r"\-", "-").replace(r"\#", "#")
    return "(?s)" + (r"^//(?:[^/?#]*\.)?" if pattern.startswith("||") else "") + body + (r"\z" if pattern.endswith("|") else "")


_PATTERNS = ", ".join(f"('{p}', '{v}', '{_pattern_sql(p)}')" for v, ps in urlfilter.PATTERNS.items() for p in ps)
_OP11 = f"""
WITH r AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
a AS (SELECT DISTINCT url, '//' || host || regexp_extract(rest, '(?s)^[^/?#]*(.*)', 1) AS address FROM u WHERE strpos(url, '://') > 0),
m AS (SELECT url, arg_min(v.pattern, (-length(v.pattern), v.verdict <> 'allow', v.pattern)) AS pattern, arg_min(v.verdict, (-length(v.pattern), v.verdict <> 'allow', v.pattern)) AS verdict
  FROM a JOIN (VALUES {_PATTERNS}) v(pattern, verdict, regex) ON regexp_matches(address, regex) GROUP BY url),
f AS (SELECT page_id, host, path, u.url, CASE WHEN host_is(host, 'example.net') AND path LIKE '/en/%' THEN 'example.net/en/' WHEN host_is(host, 'example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN host_is(host, 'org') AND path LIKE '/fr/%' THEN 'org/fr/' WHEN host_is(host, 'net') AND path LIKE '/%' THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, coalesce(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END, m.verdict, 'allow') AS verdict, CASE WHEN rule IS NULL THEN m.pattern END AS pattern
FROM f LEFT JOIN m ON m.url = f.url
"""
_OP11 = re.sub(r"host_is\(host, '([a-z.]+)'\)", r"(host = '\1' OR host LIKE '%.\1')", _OP11)

_TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '{_TERM_SQL}') AS w FROM documents),
n AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM n),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '{_TERM_SQL}')) AS term FROM benchmark),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * max(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term),
s AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // l))))) AS BIGINT) AS score
  FROM i JOIN t USING (term) JOIN f USING (term) JOIN n USING (r), c GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN n USING (r) WHERE score > 0) WHERE rank <= 50
"""

ORACLE_SQL = {"op1_topk": _OP1, "op5_jaccard": _OP5, "op11_urls": _OP11, "op13_ranked": _OP13}
