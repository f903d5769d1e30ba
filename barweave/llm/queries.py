"""The registered query of every operator, with production parameters over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hardneg, html, langid, lm, merkle, minhash, pii, quality, secrets, simhash, wordpiece
from .common import read, shared_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "n_links")


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(read(spark, sf_dir, "documents"))


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in two batches, and what the first one brought is not scanned again in the second."""
    docs = read(spark, sf_dir, "documents")
    second = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    ledger = secrets.Ledger(spark, f"{shared_folder(spark)}/secrets-ledger-{uuid.uuid4().hex[:8]}")
    return secrets.digested(secrets.history([docs.where(~second), docs.where(second)], ledger))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.learn_and_score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_identify(read(spark, sf_dir, "documents"))


@query
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_with_next(read(spark, sf_dir, "documents"))


@query
def op7_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(read(spark, sf_dir, "documents"))


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; n_chars of every seventh or so (by a hash of its id) is tampered with."""
    docs = read(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(1)).otherwise(0)
    return merkle.proofs(docs, {"n_chars": F.col("n_chars") + tampered})


@query
def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.learn_and_score(read(spark, sf_dir, "documents"))


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode({name}::VARCHAR))::VARCHAR || ':' || {name}::VARCHAR, '-')"


# crc32 of a decimal number, bit by bit, as the engine has none.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT)"""

ORACLE_SQL["op12_merkle"] = f"""WITH RECURSIVE
l AS (SELECT doc_id, lang, sha256({' || '.join(_field(c) for c in merkle.FIELDS)}) AS leaf,
  sha256({' || '.join(_field('(n_chars + 1)' if c == 'n_chars' else c) for c in merkle.FIELDS)}) AS other, coalesce({_CRC} % 7 = 0, false) AS changed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
low AS (SELECT lang, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL SELECT lang, level, pos, digest, count(*) OVER (PARTITION BY lang) FROM (SELECT lang, level + 1 AS level, pos // 2 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM low WHERE n > 1 GROUP BY lang, level, pos // 2)),
subs AS (SELECT lang, digest AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM low WHERE n = 1),
high AS (SELECT 0 AS level, place AS pos, subroot AS digest, count(*) OVER () AS n FROM subs
  UNION ALL SELECT level, pos, digest, count(*) OVER () FROM (SELECT level + 1 AS level, pos // 2 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM high WHERE n > 1 GROUP BY level, pos // 2)),
links AS (SELECT lang, level, pos, digest, n FROM low WHERE n > 1 UNION ALL SELECT s.lang, s.height + h.level, h.pos, h.digest, h.n FROM high h, subs s WHERE h.n > 1),
path AS (SELECT a.leaf, a.lang, a.pos, k.level, CASE WHEN k.level < s.height THEN a.pos >> k.level ELSE s.place >> (k.level - s.height) END AS own
  FROM leaves a JOIN subs s ON a.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT DISTINCT lang, level FROM links) k ON k.lang IS NOT DISTINCT FROM a.lang),
beside AS (SELECT p.lang, p.pos, p.level, p.own % 2 AS odd, coalesce(b.digest, '') AS digest FROM path p LEFT JOIN links b ON b.lang IS NOT DISTINCT FROM p.lang AND b.level = p.level AND b.pos = xor(p.own, 1)),
proof AS (SELECT lang, pos, sha256(string_agg(digest, '' ORDER BY level)) AS proof_sha256 FROM beside GROUP BY lang, pos),
fold AS (SELECT lang, pos, 0 AS level, CASE WHEN changed THEN other ELSE leaf END AS h FROM leaves
  UNION ALL SELECT f.lang, f.pos, f.level + 1, sha256(CASE WHEN b.odd = 1 THEN b.digest || f.h ELSE f.h || b.digest END) FROM fold f JOIN beside b ON b.lang IS NOT DISTINCT FROM f.lang AND b.pos = f.pos AND b.level = f.level),
ends AS (SELECT lang, pos, arg_max(h, level) AS folded_root FROM fold GROUP BY lang, pos),
root AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT a.doc_id, a.leaf, s.subroot, r.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM leaves a JOIN subs s ON a.lang IS NOT DISTINCT FROM s.lang JOIN ends e ON e.lang IS NOT DISTINCT FROM a.lang AND e.pos = a.pos
LEFT JOIN proof p ON p.lang IS NOT DISTINCT FROM a.lang AND p.pos = a.pos, root r"""


@query
def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector is an anchor; the label of every seventh is moved on by one first."""
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE_SQL["op11_hardneg"] = """WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a, e b WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id))::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10"""
