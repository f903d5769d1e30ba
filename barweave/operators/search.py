"""Search over text tables: keyword scores and BM25, as aggregations over exploded tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of Latin letters, digits and underscores in lower case, and single CJK characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def keyword_score(rows: DataFrame, fields: dict[str, tuple[list[str], float]]) -> DataFrame:
    """``score``: for each field and word of it that occurs, the field's weight."""
    hits = [F.lower(F.coalesce(F.col(f), F.lit(""))).contains(w.lower()).cast("double") * weight for f, (words, weight) in fields.items() for w in words]
    return rows.withColumn("score", sum(hits, F.lit(0.0)))


#: A token.
TOKEN = r"[a-z0-9_]+|[\x{4e00}-\x{9fff}]"


def _times(found: Column, word: str) -> Column:
    return F.size(F.filter(found, lambda t: t == word))


def bm25(rows: DataFrame, key: str, text: str, query: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``key, score`` of the rows that hold some word of the query.

    Tokens are never laid out as rows or shuffled; what is shuffled is one row of totals. The
    texts are read for the totals and again for the scores.
    """
    words = sorted(set(query))
    # One pass over a text gives its length and the words of the query in it; all its other tokens end there. As a generated
    # row, it is not worked out again for a filter on it.
    kept = lambda found: F.struct(F.size(found).alias("n"), F.filter(found, lambda t: t.isin(words)).alias("hits"))
    seen = rows.select(F.col(key), F.inline(F.transform(F.array(tokens(F.col(text))), kept))).where("n > 0")
    counts = F.array(*(F.struct(F.lit(w).alias("token"), _times(F.col("hits"), w).alias("tf")) for w in words))
    slim = seen.select(key, "n", counts.alias("c"))
    totals = slim.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col("c")[i]["tf"] > 0).alias(f"df{i}") for i in range(len(words))))
    joined = slim.join(F.broadcast(totals))  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col("c")[i]["tf"], F.col(f"df{i}")
        score = score + F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return joined.where(F.exists("c", lambda c: c["tf"] > 0)).select(key, score.alias("score"))


def top(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` best rows by score, ties by key."""
    return scored.orderBy(F.desc("score"), key).limit(max(1, k))
