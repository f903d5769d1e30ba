"""Personal data by fixed patterns, and by contexts learned from what those find; built-in functions only.

Bootstrapping: the spans of the fixed patterns are the seeds, and what is shaped like an identifier but
accepted by no fixed pattern is a candidate. The words around both are lexical patterns: up to three words
before, up to three after, one on either side, and the second word before whatever stands between. Patterns
and the values that stand in them are a graph, which is scored in rounds: a pattern's confidence in a kind
is the share of good values among all values that stand in it (of any kind, candidates included), and a
value is good if it is a seed or if the patterns of its places say so. A pattern counts from ``SEEDS``
values on, needs the lower bound of its confidence above ``CONFIDENCE``, and must hold in both halves
that values are dealt into, so what one half suggests the other has to bear out; it counts against a kind
where the upper bound is below. A candidate listens to the longest pattern around it that is decided either way,
so "order number" is heard before "number". Rounds end when no value is new; good values only grow in
number, so they do end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, whole_text, written
from .spans import clear_of, count_kind, listed, masked, matches, of_kind

KINDS = ("email", "ip", "card", "phone")
#: Runs are entered only at their start (or where the last match ended) and never given back, so that no text takes quadratic time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What may be an identifier that no fixed pattern accepts, up to its last letter or digit: a run with an @, or at least six digits.
#: Between digits may stand the marks of cards and phones. WHOLE also goes over single blanks, unless ten digits in a row
#: stand before one, which are a value by themselves; UNBROKEN is the same number up to its first blank.
RUN = r"A-Za-z0-9_.%+-"
MAIL = rf"(?<![{RUN}@])[{RUN}]++@[_.-]*+[A-Za-z0-9]++(?:[_.-]++[A-Za-z0-9]++)*+(?![{RUN}]*+@)"
BLANK = r"(?<![0-9]{10})[)-]?\x20[(-]?(?=[0-9]++(?!\.?[A-Za-z_@]))"
NUMBER = r"(?<![A-Za-z0-9_@+])(?<![A-Za-z0-9_@][.-])(?=(?:[\x20().+-]{{0,3}}+[0-9]){{6}})\+?(?:\((?=[0-9]{{1,5}}\)))?[0-9](?:(?:{blank}[().-]{{1,3}}+(?=[0-9]))?[0-9])*+(?!\.?[A-Za-z_@])"
WHOLE, UNBROKEN = f"{MAIL}|{NUMBER.format(blank=BLANK + '|')}", NUMBER.format(blank="")
#: Values that a pattern needs; the confidence that patterns and values need, and how far (in standard errors) patterns must be above it.
SEEDS, CONFIDENCE, ERRORS = 5, 0.5, 0.84
#: Rows of learned values that are broadcast at most.
BROADCAST = 50_000
#: Between a word and its neighbour or a value stand so many marks or blanks at most.
MARKS = 4


def luhn(found: Column) -> Column:
    digits = F.reverse(F.regexp_replace(found, "[^0-9]", ""))

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _n_digits(found: Column) -> Column:
    return F.length(F.regexp_replace(found, "[^0-9]", ""))


def base_spans(text: Column, around: bool = False) -> Column:
    """Sorted spans of the fixed patterns."""
    byte = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    found = (
        of_kind(matches(text, EMAIL, text.contains("@"), around), "email", 0, None, around),
        of_kind(matches(text, IP, text.rlike(IP), around), "ip", 1, lambda f: f.rlike(rf"^{byte}(?:\.{byte}){{3}}$"), around),
        of_kind(matches(text, CARD, text.rlike(CARD), around), "card", 2, lambda f: _n_digits(f).between(14, 19) & luhn(f), around),
        of_kind(matches(text, PHONE, text.contains("+"), around), "phone", 3, lambda f: _n_digits(f).between(10, 15), around),
    )
    return F.array_sort(F.concat(*found))


def _contexts(before: Column, after: Column) -> Column:
    """``array<struct<rank, context>>``: the patterns around a value, the longest first.

    Words are runs of letters, lower-cased; ``_`` stands for the value and ``*`` for any one word.
    """
    gap = rf"[^\p{{L}}\p{{N}}]{{1,{MARKS}}}"
    end = rf"[^\p{{L}}\p{{N}}]{{0,{MARKS}}}"
    left = rf"(?<![\p{{L}}\p{{N}}])(?:(?:(\p{{L}}+){gap})?(\p{{L}}+){gap})?(\p{{L}}+){end}$"
    right = rf"^{end}(\p{{L}}++)(?![\p{{L}}\p{{N}}])(?:{gap}(\p{{L}}++)(?![\p{{L}}\p{{N}}])(?:{gap}(\p{{L}}++)(?![\p{{L}}\p{{N}}]))?)?"
    w3, w2, w1 = (F.lower(F.regexp_extract(before, left, i)) for i in (1, 2, 3))
    a1, a2, a3 = (F.lower(F.regexp_extract(after, right, i)) for i in (1, 2, 3))
    value, any_word = F.lit("_"), F.lit("*")
    sides = (
        ((w3, w2, w1), (w3, w2, w1, value)),
        ((a1, a2, a3), (value, a1, a2, a3)),
        ((w1, a1), (w1, value, a1)),
        ((w2, w1), (w2, w1, value)),
        ((a1, a2), (value, a1, a2)),
        ((w2, w1), (w2, any_word, value)),
        ((w1,), (w1, value)),
        ((a1,), (value, a1)),
    )
    made = []
    for rank, (needed, words) in enumerate(sides):
        there = F.lit(True)
        for word in needed:
            there = there & (word != "")
        made.append(F.when(there, F.struct(F.lit(rank).alias("rank"), F.concat_ws(" ", *words).alias("context"))))
    return F.filter(F.array(*made), lambda c: c.isNotNull())


def _shape(found: Column) -> Column:
    """The kind that a candidate looks like; null: none."""
    return (
        F.when(found.rlike(r"^[^@]+@[^@]+$"), "email")
        .when(found.rlike(r"^[0-9]+(?:\.[0-9]+){3,}$"), "ip")
        .when(found.rlike(r"^\+?\(?[0-9][0-9\x20().-]*[0-9]$"), F.when(_n_digits(found).between(7, 13), "phone").when(_n_digits(found) >= 14, "card"))
    )


def _value(kind: Column, found: Column) -> Column:
    """What makes spans of a kind the same value: of cards and phones the digits."""
    return F.when(kind.isin("card", "phone"), F.regexp_replace(found, "[^0-9]", "")).otherwise(F.lower(found))


def _scan(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text_key, base, others``: a number of each row, its fixed spans and its candidates."""
    text = whole_text()
    found = [matches(text, p, text.rlike(likely), True) for p, likely in ((WHOLE, "[0-9]|@"), (UNBROKEN, "[0-9]"))]
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), base_spans(text, True).alias("base"), found[0].alias("whole"), found[1].alias("unbroken"))

    def marked(spans: Column, n: int) -> Column:
        shaped = F.filter(spans, lambda c: _shape(c["found"]).isNotNull())
        return F.transform(clear_of(shaped, F.col("base")), lambda c: c.withField("n", F.lit(n)))

    # What is found both ways counts once, and of two readings of one place only the longer counts for a pattern.
    less = clear_of(F.col("unbroken"), F.col("whole"), same=True)
    others = F.concat(marked(F.col("whole"), 1), marked(less, 0))
    return rows.select("doc_id", "text_key", "base", others.alias("others")).withColumn("row", F.monotonically_increasing_id())


def _bound(good: Column, n: Column, side: int) -> Column:
    """Wilson's lower (``side`` -1) or upper (1) bound of a share of which ``good`` in ``n`` were seen."""
    p, z2 = good / n, ERRORS * ERRORS
    return (p + z2 / (2 * n) + side * ERRORS * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def learn(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns (``context, kind, confidence, good``) and discovered values (``kind, value, score``).

    ``scanned`` is what :func:`_scan` gives. Copies of a place (same value, same words around it) count as
    one row, so a text that is repeated often is no hot key.
    """
    made = []
    seed = scanned.select(F.explode("base").alias("s")).select("s.kind", "s.found", "s.before", "s.after", F.lit(1).alias("seed"), F.lit(1).alias("n"))
    other = scanned.select(F.explode("others").alias("s")).select(_shape(F.col("s.found")).alias("kind"), "s.found", "s.before", "s.after", F.lit(0).alias("seed"), "s.n")
    places = seed.unionByName(other).select("kind", _value(F.col("kind"), F.col("found")).alias("value"), "seed", "n", _contexts(F.col("before"), F.col("after")).alias("contexts"))
    places = places.groupBy("kind", "value", "seed", "contexts").agg(F.sum("n").alias("n")).withColumn("place", F.monotonically_increasing_id())
    made.append(places := written(places, "places"))
    half = F.pmod(F.xxhash64("kind", "value"), F.lit(2))
    known = places.where("n > 0").select("kind", "value", F.explode("contexts.context").alias("context")).distinct()
    made.append(known := written(known, "known"))
    totals = known.groupBy("context").agg(F.count(F.lit(1)).alias("values"), F.sum(half).alias("values_1")).where(F.col("values") >= SEEDS)
    made.append(totals := written(totals, "totals"))
    around = places.where("seed = 0").select("place", "kind", "value", "n", F.explode("contexts").alias("c")).select("place", "kind", "value", "n", "c.*")
    made.append(heard := written(around.join(totals, "context"), "heard"))
    made.append(seeds := written(places.where("seed = 1").select("kind", "value").distinct(), "seeds"))
    good, n_good = seeds, seeds.count()
    while True:
        hits = known.join(good, ["kind", "value"]).groupBy("context", "kind").agg(F.count(F.lit(1)).alias("good"), F.sum(half).alias("good_1"))
        made.append(hits := written(hits.join(totals, "context"), "hits"))
        said = heard.join(hits.drop("values", "values_1"), ["context", "kind"], "left").na.fill(0, ["good", "good_1"])
        decided = said.withColumn("holds", _holds()).where(F.col("holds") | (_bound(F.col("good"), F.col("values"), 1) < CONFIDENCE))
        # The place of a candidate listens to the first of its patterns that is decided.
        each = decided.groupBy("place", "kind", "value", "n").agg(F.min_by(F.when(F.col("holds"), F.col("good") / F.col("values")).otherwise(0.0), "rank").alias("confidence"))
        weight = F.greatest("n", F.lit(1))
        new = each.groupBy("kind", "value").agg((F.sum(weight * F.col("confidence")) / F.sum(weight)).alias("score")).where(F.col("score") >= CONFIDENCE)
        made.append(new := written(new, "discovered"))
        made.append(good := written(seeds.unionByName(new.select("kind", "value")).distinct(), "good"))
        n_before, n_good = n_good, good.count()
        if n_good == n_before:
            break
    patterns = written(hits.where(_holds()).select("context", "kind", (F.col("good") / F.col("values")).alias("confidence"), "good"), "patterns")
    # A candidate that is a seed elsewhere, with other marks, is as good as that.
    again = places.where("seed = 0").select("kind", "value").distinct().join(seeds, ["kind", "value"]).withColumn("score", F.lit(1.0))
    found = written(new.unionByName(again).groupBy("kind", "value").agg(F.max("score").alias("score")), "discovered")
    for df in made:
        drop_written(scanned.sparkSession, df)
    return patterns, found


def _holds() -> Column:
    """Whether a pattern (``good`` of ``values``, and of the second half ``good_1`` of ``values_1``) stands for a kind."""
    good, values, good_1, values_1 = (F.col(c) for c in ("good", "values", "good_1", "values_1"))
    halves = ((good - good_1, values - values_1), (good_1, values_1))
    out = (good >= SEEDS) & (_bound(good, values, -1) >= CONFIDENCE)
    for g, v in halves:
        out = out & (g > 0) & (g >= CONFIDENCE * v)
    return out


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, base, spans`` for every row of ``docs``.

    ``base`` and ``spans`` are sorted arrays of ``start, kind_no, kind, end, found``: the fixed patterns'
    spans, and those together with the discovered ones. Discovered spans overlap no base span; of two that
    overlap each other one may lie within the other, and then only the longer stays. Null and empty texts
    have none; very long ones are searched whole; repeated rows have the same ones each; other columns are
    not looked at; an empty table gives an empty result. Without seeds nothing is learned.
    """
    scanned = written(_scan(docs), "scanned")
    _, new = learn(scanned)
    slim = F.transform("base", lambda s: s.dropFields("before", "after"))
    rows = scanned.select("row", "doc_id", "text_key", slim.alias("base"))
    n_new = new.count()
    if not n_new:
        return rows.select("doc_id", "text_key", "base", F.col("base").alias("spans"))
    candidates = scanned.select("row", F.explode("others").alias("s")).select("row", "s.*", _shape(F.col("s.found")).alias("kind")).withColumn("value", _value(F.col("kind"), F.col("found")))
    hit = candidates.join(new.hint("broadcast" if n_new <= BROADCAST else "shuffle_merge"), ["kind", "value"])
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    earlier = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = hit.withColumn("reach", F.max("end").over(earlier)).where("reach is null or end > reach")
    more = outer.groupBy("row").agg(F.collect_list(F.struct("start", number.alias("kind_no"), "kind", "end", "found")).alias("more"))
    both = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(more.schema["more"].dataType))))
    return rows.join(more, "row", "left").select("doc_id", "text_key", "base", both.alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the fixed spans by kind, the digest of their list, and the list of all spans."""
    counts = [count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return find(docs).select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets, and n_chars to match.

    Null and empty texts stay as they are, and very long ones are masked whole. Repeated rows are all kept.
    Other columns stay as they are, whatever their names; an empty table stays empty.
    """
    found = find(docs).where("size(spans) > 0").select("doc_id", "text_key", "spans").dropDuplicates(["doc_id", "text_key"])
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.col("doc_id").alias("id"), F.xxhash64(whole_text()).alias("key"))
    here = keyed.join(found, keyed["id"].eqNullSafe(found["doc_id"]) & (keyed["key"] == found["text_key"]), "left")
    old = F.col("d")["text"]
    text = F.when(F.col("spans").isNull(), old).otherwise(masked(old, F.col("spans"), lambda k: F.concat(F.lit("<"), F.upper(k), F.lit(">"))))
    out = here.select(text.alias("new"), "d")
    columns = []
    for c in docs.columns:
        was = F.col("d")[c]
        if c == "n_chars":
            was = F.when(F.col("new").isNull(), was).otherwise(F.length("new")).cast(docs.schema[c].dataType)
        columns.append((F.col("new") if c == "text" else was).alias(c))
    return out.select(columns)
