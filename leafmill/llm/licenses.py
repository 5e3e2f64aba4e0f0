"""License scans: ordered signature rules over whole texts, gated by keywords.

A rule has a tier, a keyword, a pattern, a label and a confidence (license_rules). A pattern can't match without each word
of its keyword, so a text is searched for these words first and only rules whose words occur run. Each match is a detection,
an interval of characters. A detection is suppressed by one that it lies in, if that one's tier is earlier, or the same and
its interval longer (of equal intervals, the earlier rule's stays); so "apache license" gives way to "apache license,
version 2.0". Intervals that only overlap both stay.

Besides, base phrases are counted by words: a place is a word index where a phrase's words stand consecutively. Base labels
always stay.

Matching is expressions on one row. Detections then are rows of few numbers, which go to their document's partition and are
gone through there in order, once, with the furthest end of each tier so far: the work grows with the number of matches.

Defined cases: a null text counts as empty, without words or labels; a text without detections has empty labels and score
0; repeated rows and ties each keep their row; "unknown" counts only where no other detection stays. Only the named columns
are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafmill.llm.common import ascii_lower
from leafmill.llm.license_rules import TIERS, rules

# A word of the contract, in lower-cased text and in any text (where A-Z are words, too).
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

def _keywords() -> list[str]:
    return list(dict.fromkeys(r[2] for r in rules()))


def live_keywords(text: Column) -> Column:
    """array of the places (in _keywords) of keywords whose words all occur in a lower-cased text."""
    table = F.array(*[F.struct(F.lit(i).alias("place"), F.array(*[F.lit(w) for w in reversed(k.split())]).alias("words"), F.lit(k.startswith("cc by")).alias("code")) for i, k in enumerate(_keywords())])
    # Two letters stand in many words; those of Creative Commons codes are followed by "by".
    found = F.filter(table, lambda k: F.forall(k["words"], lambda w: F.contains(text, w)) & (~k["code"] | text.rlike(r"cc[\s-]+by")))
    return F.transform(found, lambda k: k["place"])


def matches(text: Column, keywords: Column) -> Column:
    """All matches in a lower-cased text of the rules with these keywords: array of (rank, k, gap, length).

    k numbers a rule's matches; gap is how many characters lie between a match and the one before it (or the text's start).
    """
    places = {k: i for i, k in enumerate(_keywords())}
    table = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(places[r[2]]).alias("place"), F.lit(r[3]).alias("rx")) for i, r in enumerate(rules())])
    live = F.filter(table, lambda r: F.array_contains(keywords, r["place"]))

    def of(r: Column) -> Column:
        # What is found and what lies between are made once each: a lambda's variable stands for them.
        found = F.array(F.regexp_extract_all(text, r["rx"], F.lit(0)))
        pairs = lambda f: F.zip_with(F.slice(F.split(text, r["rx"], -1), F.lit(1), F.size(f)), f, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("length")))
        spans = F.flatten(F.transform(found, lambda f: F.when(F.size(f) > 0, pairs(f)).otherwise(F.array().cast("array<struct<gap:int,length:int>>"))))
        return F.transform(spans, lambda s, k: F.struct(r["rank"].alias("rank"), k.alias("k"), s["gap"].alias("gap"), s["length"].alias("length")))

    return F.flatten(F.transform(live, of))


def resolve(rows: DataFrame, row: str = "row") -> DataFrame:
    """rows of matches (row, rank, k, gap, length; rank null for a text without any) with start, end, label, confidence and kept."""
    table = rules()
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("rank"))
    rows = rows.repartition(F.col(row))
    end = F.sum(F.col("gap") + F.col("length")).over(W.partitionBy(row, "rank").orderBy("k"))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).withColumn("tier", of([r[0] for r in table]))
    # By start, longer ones and earlier rules first: what contains a detection stands before it.
    before = W.partitionBy(row).orderBy("start", F.desc("end"), "rank").rowsBetween(W.unboundedPreceding, -1)
    furthest = [F.max(F.when(F.col("tier") <= t, F.col("end"))).over(before).alias(f"to{t}") for t in range(1, len(TIERS) + 1)]
    rows = rows.select("*", *furthest)
    inside = F.get(F.array(*[F.col(f"to{t}") for t in range(1, len(TIERS) + 1)]), F.col("tier") - 1) >= F.col("end")
    kept = F.col("rank").isNotNull() & ~F.coalesce(inside, F.lit(False))
    return rows.withColumns({"kept": kept, "label": of([r[1] for r in table]), "confidence": of([r[4] for r in table])}).drop(*[f"to{t}" for t in range(1, len(TIERS) + 1)])


def base_places(text: Column) -> Column:
    """array of (start, label) of all base phrases in a lower-cased text; starts count words from 0."""
    words = F.regexp_extract_all(text, F.lit(LOWER_WORD), F.lit(0))
    out = []
    for phrase, label in BASE.items():
        parts = phrase.split(" ")

        def here(w: Column, parts=parts, label=label) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - len(parts), F.lit(0))), lambda i: (F.get(w, i + len(parts) - 1) == parts[-1]) & F.array_join(F.slice(w, i + 1, len(parts)), " ").eqNullSafe(F.lit(" ".join(parts))))
            return F.transform(F.filter(starts, lambda i: i.isNotNull()), lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

        out.append(here)
    # The words are made once: a lambda's variable stands for them.
    return F.flatten(F.transform(F.array(words), lambda w: F.concat(*[f(w) for f in out])))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gated: bool = True) -> DataFrame:
    """id_col, row (a number of each row's own), n_words, base (places), found (matches) of each row's whole text. Without gates, all rules run on all texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("t")).select(id_col, F.monotonically_increasing_id().alias("row"), "t", F.lower("t").alias("gate"))
    rows = rows.withColumn("keywords", live_keywords(F.col("gate")) if gated else F.sequence(F.lit(0), F.lit(len(_keywords()) - 1)))
    based = F.lit(False)
    for phrase in BASE:
        here = F.lit(True)
        for word in phrase.split(" "):
            here = here & F.contains("gate", F.lit(word))
        based = based | here
    rows = rows.withColumn("based", based)
    rows = rows.select(id_col, "row", F.regexp_count("t", F.lit(ANY_WORD)).cast("long").alias("n_words"), F.when((F.size("keywords") > 0) | F.col("based"), ascii_lower(F.col("t"))).alias("t"), "based", "keywords")
    return rows.select(id_col, "row", "n_words", F.when(F.col("based"), base_places(F.col("t"))).alias("base"), F.when(F.size("keywords") > 0, matches(F.col("t"), F.col("keywords"))).alias("found"))


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gated: bool = True) -> DataFrame:
    """id_col, start, end (characters), label, confidence, rank (the rule), kept of each detection."""
    found = scan(docs, id_col=id_col, text_col=text_col, gated=gated).select(id_col, "row", F.explode("found").alias("m")).select(id_col, "row", "m.*")
    return resolve(found).select(id_col, "start", "end", "label", "confidence", "rank", "kept")


def scan_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score (the surest detection's confidence; base places count as 0.7)."""
    rows = scan(docs, id_col=id_col, text_col=text_col)
    starts = F.transform("base", lambda p: p["start"])
    base = F.coalesce(F.array_sort(F.array_distinct(F.transform("base", lambda p: p["label"]))), F.array().cast("array<string>"))
    whole = [id_col, "row", "n_words", "n_base", "first_word", "last_word", "base"]
    rows = rows.select(id_col, "row", "n_words", F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), base.alias("base"), "found")
    # What is made of a text's places is made before its matches become rows, so that no row carries the places.
    rows = rows.select(*whole, F.explode_outer("found").alias("m"))
    named = F.col("kept") & (F.col("label") != "unknown")
    of_row = resolve(rows.select(*whole, "m.*")).groupBy(*whole).agg(
        F.collect_set(F.when(named, F.col("label"))).alias("named"), F.max(F.when(named, F.col("confidence"))).alias("sure"), F.count_if(named).alias("n_named"),
        F.max(F.when(F.col("kept") & ~named, F.col("confidence"))).alias("vague"), F.count_if(F.col("kept") & ~named).alias("n_vague"),
    )
    vague = (F.col("n_named") == 0) & (F.col("n_vague") > 0)
    mine = F.when(vague, F.array(F.lit("unknown"))).otherwise(F.col("named"))
    score = F.greatest(F.coalesce(F.when(vague, F.col("vague")).otherwise(F.col("sure")), F.lit(0.0)), F.when(F.size("base") > 0, 0.7).otherwise(0.0))
    return of_row.select(
        id_col,
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", mine)), ",").alias("labels"),
        score.alias("score"),
        F.when(vague, F.col("n_vague")).otherwise(F.col("n_named")).alias("n_detections"),
    )
