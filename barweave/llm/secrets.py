"""Secrets in versioned texts: a ledger of scanned blobs, so that each content is scanned once for each rule.

Every version of every path is addressed by the digest of its content. Pairs of blob and rule version
that the ledger does not have yet are scanned, once for each blob, and added to it; the findings are joined
back to all paths that hold the blob. The ledger is a Parquet table in a folder that driver and executors
share, and outlives the session where that folder does. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _path, left_joined, whole_text, written
from .spans import count_kind, listed, matches, of_kind

BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rule:
    """A pattern in Java's syntax; a new version makes every blob unseen for it."""

    name: str
    pattern: str
    likely: Callable[[Column], Column]
    valid: Callable[[Column], Column] | None = None
    version: int = 1


_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
RULES = (
    Rule("assign", _ASSIGN, lambda t: t.rlike(_ASSIGN), lambda f: F.length(F.regexp_extract(f, _ASSIGN, 1)) >= 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}+", lambda t: t.contains("AKIA")),
    Rule("hex", r"[0-9a-f]{24,}+", lambda t: t.rlike(r"[0-9a-f]{24}")),
    # Beyond the base: forms that services publish for their own keys.
    # A private key as far as its end line, or its first line where there is none.
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\s-]*?-----END [A-Z ]{0,20}PRIVATE KEY-----)?", lambda t: t.contains("PRIVATE KEY-----")),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+", lambda t: t.contains("eyJ")),
    Rule("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|[rs]k_live_[A-Za-z0-9]{16,}+|glpat-[A-Za-z0-9_-]{20,}+)", lambda t: t.rlike("gh[pousr]_|xox[abprs]-|k_live_|glpat-")),
)


def rule_table(spark, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int")


def blobs(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``path, blob``: the content address of every version; null counts as empty."""
    return versions.select(F.col(id_col).alias("path"), F.sha2(whole_text(text_col), 256).alias("blob"))


def unseen(spark, addressed: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, path, todo``: one path for each blob that some rule version has not scanned, and those rules."""
    first = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        return first.withColumn("todo", F.array(*(F.lit(r.name) for r in rules)))
    # The rules are few, by construction: this is a row for each rule and blob, not a pairing of data.
    due = first.withColumn("due", F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules)))).select("blob", "path", "due.*")
    return due.join(ledger, ["blob", "rule", "version"], "left_anti").groupBy("blob").agg(F.first("path").alias("path"), F.collect_set("rule").alias("todo"))


def scan(versions: DataFrame, due: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``blob, rule, version, spans``: a row for each blob and rule that was due, found or not."""
    text = F.col("text")
    whole = versions.select(F.col(id_col).alias("path"), whole_text(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))
    same = (F.col("w.blob") == F.col("u.blob")) & F.col("w.path").eqNullSafe(F.col("u.path"))
    one = whole.alias("w").join(due.alias("u"), same).select("u.blob", "u.todo", "w.text")
    asked = [F.array_contains("todo", r.name) for r in rules]
    spans = [F.when(a, of_kind(matches(text, r.pattern, r.likely(text)), r.name, i, r.valid)) for i, (r, a) in enumerate(zip(rules, asked, strict=True))]
    found = one.select("blob", F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), s.alias("spans")) for r, s in zip(rules, spans, strict=True))).alias("each"))
    # A path that repeats with the same content is scanned as often as it repeats; one row stays.
    each = found.select("blob", F.inline(F.filter("each", lambda e: e["spans"].isNotNull()))).withColumn("spans", F.transform("spans", lambda s: s.dropFields("found")))
    return each.dropDuplicates(["blob", "rule", "version"])


@dataclass(frozen=True)
class Ledger:
    """The stored ledger: ``blob, rule, version, spans``, a part of the folder for each arrival that was scanned.

    Beside it, in ``folder``-versions, is what each path held in each arrival: ``path, blob``, its whole history. A part that is
    written again (a run that is repeated after it broke off) takes the place of the old one.
    """

    spark: SparkSession
    folder: str

    def _read(self, folder: str) -> DataFrame | None:
        fs, path = _path(self.spark, folder)
        if not fs.exists(path) or not fs.listStatus(path):
            return None
        return self.spark.read.option("recursiveFileLookup", "true").parquet(folder)

    def load(self) -> DataFrame | None:
        """All parts; None before the first."""
        return self._read(self.folder)

    def add(self, scanned: DataFrame, arrival: str) -> None:
        scanned.write.mode("overwrite").parquet(f"{self.folder}/arrival-{arrival}")

    def versions(self) -> DataFrame | None:
        """``path, blob`` of every arrival; None before the first."""
        return self._read(f"{self.folder}-versions")

    def address(self, addressed: DataFrame, arrival: str) -> DataFrame:
        """Add what the paths of an arrival hold, and read it again."""
        where = f"{self.folder}-versions/arrival-{arrival}"
        addressed.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(addressed.schema).parquet(where)


def take_in(versions: DataFrame, ledger: Ledger, arrival: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan the blobs of ``versions`` that the ledger lacks for a rule version, and add what was found; returns ``path, blob`` of each row."""
    addressed = ledger.address(blobs(versions, id_col, text_col), arrival)
    due = unseen(ledger.spark, addressed, ledger.load(), rules)
    ledger.add(scan(versions, due, rules, id_col, text_col), arrival)
    return addressed


def _joined_back(addressed: DataFrame, known: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    now = known.join(F.broadcast(rule_table(addressed.sparkSession, rules)), ["rule", "version"])
    by_blob = now.where("size(spans) > 0").groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    none = F.array().cast(by_blob.schema["spans"].dataType)
    return left_joined(addressed, by_blob, "blob").select(F.col("path").alias("doc_id"), "blob", F.coalesce("spans", none).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``doc_id, blob, spans`` for every row of ``versions``, and the ledger with what was scanned now.

    ``ledger`` (``blob, rule, version, spans``) holds what earlier runs found; blobs that it has for a
    rule version are not scanned for it again. Spans are sorted by start, then rule. Null and empty texts
    share one blob without secrets; very long texts are scanned whole; repeated rows and shared contents each
    get their spans; other columns are not looked at; an empty table gives an empty result and an unchanged ledger.
    """
    spark = versions.sparkSession
    addressed = written(blobs(versions, id_col, text_col), "blobs")
    new = written(scan(versions, unseen(spark, addressed, ledger, rules), rules, id_col, text_col), "scanned")
    known = new if ledger is None else ledger.unionByName(new)
    return _joined_back(addressed, known, rules), known


def history(arrivals: list[DataFrame], ledger: Ledger, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, blob, spans`` for every row of all ``arrivals``, which are taken in one after another.

    An arrival is a batch of versions; of each, only what neither the ledger nor an earlier arrival had is
    scanned. The rest is as in :func:`findings`.
    """
    every = None
    for i, versions in enumerate(arrivals):
        addressed = take_in(versions, ledger, f"{i:06d}", rules, id_col, text_col)
        every = addressed if every is None else every.unionByName(addressed)
    return _joined_back(every, ledger.load(), rules)


def digested(found: DataFrame) -> DataFrame:
    """Counts of the base spans by kind, the digest of their list, and the list of all spans of ``found`` (``doc_id, spans``)."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def digests(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """:func:`digested` of the findings in ``versions``."""
    return digested(findings(versions, ledger)[0])
