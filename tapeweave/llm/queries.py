"""Registered queries of the training-data operators and the SQL counterparts of those that SQL can state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.llm.collocations import mine_phrases
from tapeweave.llm.embeddings import link_vectors
from tapeweave.llm.langid import fit_languages, identify_languages
from tapeweave.llm.media import encode_streams, stream_features
from tapeweave.llm.lm import score_texts
from tapeweave.llm.minhash import duplicate_classes
from tapeweave.llm.mixing import mix_sources
from tapeweave.llm.pii import KINDS, find_personal, fit_tagger
from tapeweave.llm.pieces import encode_pieces
from tapeweave.llm.spelling import group_spellings
from tapeweave.llm.tokenbin import read_tokens, write_tokens
from tapeweave.llm.toxicity import fit_toxicity, score_toxicity
from tapeweave.llm.urls import filter_urls
from tapeweave.session import materialize, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(of: str, n: int) -> Column:
    """The fold of a row: CRC-32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(of).cast("string"), F.lit("")).cast("binary")) % n


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder("doc_id", 3) == 1
    model = fit_languages(docs, ~held_out)
    return identify_languages(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files/{uuid.uuid4().hex}"
    files = write_tokens(_table(spark, sf_dir, "documents"), folder, tokenizer_file("word_bpe_49k.json"))
    return read_tokens(files, folder)


def op5_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return stream_features(materialize(encode_streams(docs)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 3) == 1
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return score_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(_table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_piece_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    segmented = encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"))
    return segmented.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "nbest", "round_trip")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "listed")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(_table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal(docs, fit_tagger(docs))
    own = F.filter("personal", lambda s: s["base"])
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    kinds = F.transform(own, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined("personal").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_near_vectors": op2_near_vectors,
    "op3_language_id": op3_language_id,
    "op4_token_files": op4_token_files,
    "op5_transport_streams": op5_transport_streams,
    "op6_toxicity": op6_toxicity,
    "op7_lm_score": op7_lm_score,
    "op8_piece_segments": op8_piece_segments,
    "op9_url_filter": op9_url_filter,
    "op10_source_mix": op10_source_mix,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_personal_data": op13_personal_data,
}

# Sizes, targets and the truncation at the total, with plain windows.
_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER w AS r, sum(source_size) OVER ()::BIGINT AS total,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM sources WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST)
), first_open AS (
  SELECT min(r) AS r0, arg_min(level, r) AS level0 FROM ranked WHERE weight * level < 3 * source_size
), targets AS (
  SELECT source, source_size, total, CASE WHEN r >= r0 THEN weight * level0 ELSE (3 * source_size)::DOUBLE END AS target
  FROM ranked, first_open
), ended AS (
  SELECT s.*, t.source_size, t.target, t.total,
         sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS e
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, (copy * source_size + e) / target AS finish FROM ended, (SELECT unnest([0, 1, 2])::BIGINT AS copy) WHERE size > 0
), counted AS (
  SELECT doc_id, source, count(*)::BIGINT AS copies FROM (
    SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM copies
  ) WHERE upto <= total GROUP BY doc_id, source
)
SELECT e.doc_id, e.size, e.source_size, e.target, (e.size * coalesce(c.copies, 0))::BIGINT AS taken, e.source,
       coalesce(c.copies, 0)::BIGINT AS copies
FROM ended e LEFT JOIN counted c ON e.doc_id IS NOT DISTINCT FROM c.doc_id AND e.source IS NOT DISTINCT FROM c.source
"""

# Rules by the longest that fits, then the block list of host labels.
_URL_SQL = r"""
WITH rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), parts AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), judged AS (
  SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p
  JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, j.rule, l.listed,
       coalesce(j.verdict, CASE WHEN l.listed THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, list_has_any(string_split(host, '.'),
        ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS listed FROM parts) l
JOIN parts p USING (page_id)
LEFT JOIN judged j ON p.host = j.host AND p.path = j.path
"""

# Phrases as joined words; wide integers for the products.
_PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), found AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM lists
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM found GROUP BY ALL
), c AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.cut, c.w[1] AS head, array_to_string(c.w[2:], ' ') AS tail FROM c, (SELECT 1 AS cut) x
  UNION ALL SELECT c.lang, c.k, c.phrase, c.a, 2, c.w[1] || ' ' || c.w[2], c.w[3] FROM c WHERE c.k = 3
), scored AS (
  SELECT cuts.*, l.a AS l, r.a AS r, ((1000000::HUGEINT * cuts.a * cuts.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = cuts.head JOIN f r ON r.lang = cuts.lang AND r.phrase = cuts.tail
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), held AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3
  ) GROUP BY ALL
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN held h ON h.lang = s.lang AND h.phrase = s.phrase
  WHERE h.longer IS NULL OR s.k = 3 OR 100 * h.longer < 50 * s.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       (SELECT sum(f.a) FROM f WHERE f.k = 1 AND f.lang = k.lang)::BIGINT AS n, score
FROM kept k QUALIFY rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op9_url_filter": _URL_SQL,
    "op10_source_mix": _MIX_SQL,
    "op11_phrase_collocations": _PHRASE_SQL,
}
