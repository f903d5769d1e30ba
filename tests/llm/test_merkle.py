import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from barweave.llm import merkle, queries

DATA = "/root/testdata/sf0.001"
NAMES = "doc_id long, source string, lang string, n_chars long, text string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, n_more=0):
    def one(k, v):
        v = v + n_more if k == "n_chars" and v is not None else v
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return sha(*(one(k, row[k]) for k in FIELDS))


def pairs(level):
    return [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]


def tree(level):
    out = [level]
    while len(out[-1]) > 1:
        out.append(pairs(out[-1]))
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for k in langs:
        groups[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {k: tree([leaf(r) for r in groups[k]]) for k in langs}
    top = tree([trees[k][-1][0] for k in langs])
    out = []
    for place, k in enumerate(langs):
        for i, r in enumerate(groups[k]):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h, side = leaf(r, int(bad)), ""
            for at, levels in ((i, trees[k]), (place, top)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    h = sha(other, h) if at & 1 else sha(h, other)
                    side += other
                    at >>= 1
            out.append((r["doc_id"], leaf(r), trees[k][-1][0], top[-1][0], sha(side), h, h == top[-1][0]))
    return sorted(out, key=str)


def run(docs):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(1)).otherwise(0)
    got = merkle.proofs(docs, {"n_chars": F.col("n_chars") + tampered}).collect()
    return sorted((tuple(r) for r in got), key=str)


def rows_of(n, langs):
    return [{"doc_id": i * 7 % n, "source": None if i % 5 == 0 else f"s{i % 3}", "lang": langs[i % len(langs)], "n_chars": None if i % 11 == 0 else i, "text": f"t {i} \u00e9" if i % 13 else None} for i in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (2, ["en"]), (3, [None]), (64, ["en"]), (65, ["en"]), (129, ["en", "en", "de"]), (700, ["en"] * 6 + ["de", None, "fr"]), (4200, ["en"] * 60 + ["x"]), (1300, [f"l{i}" for i in range(650)])])
def test_proofs_by_hand(spark, n, langs):
    rows = rows_of(n, langs)
    got = run(spark.createDataFrame([tuple(r[k] for k in FIELDS) for r in rows], NAMES))
    assert got == brute(rows)
    if n > 100:
        assert {v[-1] for v in got} == {True, False}


def test_null_and_repeated_ids_and_rows_and_long_texts(spark):
    rows = [{"doc_id": d, "source": "s", "lang": g, "n_chars": c, "text": t} for d, g, c, t in
            [(None, "en", 1, "a"), (None, "en", 1, "a"), (None, None, None, None), (5, "en", 1, ""), (5, "en", 2, ""), (5, "en", 1, ""), (8, "\u00ff", 3, "word " * 200_000), (9, "", 3, "b"), (14, "z", None, "c")]]
    docs = spark.createDataFrame([tuple(r[k] for k in FIELDS) for r in rows], NAMES)
    docs = docs.selectExpr("*", "'x' as leaf", "1 as at", "2 as tree", "3 as row_", "4 as n", "5 as digest", "6 as id_")
    assert run(docs) == brute(rows)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], NAMES)) == []


def test_a_climb_of_more_rows_than_the_usual_limit(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        rows = rows_of(300, ["en"])
        assert run(spark.createDataFrame([tuple(r[k] for k in FIELDS) for r in rows], NAMES)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["op12_merkle"])
    names = [d[0] for d in cursor.description]
    df = queries.QUERIES["op12_merkle"](spark, DATA)
    assert names == df.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(cursor.fetchall(), key=str)
