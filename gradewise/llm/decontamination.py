"""Benchmark decontamination by template canonicalisation (DataFrame functions
only).

A text becomes a row of tokens in which numbers, units behind numbers and names
are typed placeholders and every other word is lower-cased; punctuation only
tells where sentences start. All windows of ``WINDOW`` tokens of all documents
are hashed and joined to the windows of the benchmark items. Matches are
grouped by (document, item, diagonal). Inside a group every changed slot of the item
must be filled alike wherever its value occurs (the same number of the item is
always the same number of the document); of other groups only the windows without a
changed slot count. A document contains an item when the windows of its groups cover
enough of it, or when a run of ``RUN`` tokens is copied, whatever share of the item
that is. Windows of few literal words match on their raw tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradewise.llm import common

WINDOW = 8
MIN_LITERALS = 4      # words that are no placeholders, for a window to count
MIN_COVER = 0.3
RUN = 13              # tokens in a row that are a copy whatever their share
BROADCAST_BYTES = 64 << 20

# Tokens, sentence marks and units.
WORD, NUMBER = r"\p{L}+", r"\p{N}+(?:[.,]\p{N}+)*"
MARKS = [".", "!", "?", ":", ";", "\n"]
SIGNS = ["%", "$", "€", "£"]
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "sec", "min", "h", "hr", "hours",
         "minutes", "seconds", "days", "weeks", "months", "years", "miles", "feet", "inches", "dollars", "euros", "cents",
         "percent", "degrees", "meters", "metres", "liters", "litres", "grams", "pounds", "ounces"]
# Placeholders and the mark before a sentence's first word: characters for private use, blank in texts.
NUM, UNIT, NAME, START = "\ue000", "\ue001", "\ue002", "\ue003"
KINDS = [NUM, UNIT, NAME]
# What stands between tokens.
_GAP = rf"[^\p{{L}}\p{{N}}.!?:;\n{NUM}{UNIT}{NAME}{START}]*"


def tokens(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``text``) plus, token by token, ``low`` (lower case) and
    ``canon`` (lower case or a placeholder). Tokens are runs of letters, numbers and signs;
    a unit is a sign, or a unit's name behind a number; a name is a capitalised word
    (a capital and then letters that are none) that starts no sentence. Whole texts are
    rewritten by patterns, one after another; no token is looked at on its own."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\u0130"), F.lit("I"))  # its lower case is two characters
    for c in (*KINDS, START):
        text = F.replace(text, F.lit(c), F.lit(" "))
    low = F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}|{NUMBER}|[{''.join(SIGNS)}]"), F.lit(0))
    t = F.regexp_replace(text, NUMBER, NUM)
    t = F.regexp_replace(t, f"[{''.join(SIGNS)}]", UNIT)
    t = F.regexp_replace(t, rf"(?iu){NUM}({_GAP})(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\p{{L}})", f"{NUM}$1{UNIT}")
    t = F.regexp_replace(t, rf"(^|[.!?:;\n])({_GAP})(?=\p{{L}})", f"$1$2{START}")
    t = F.regexp_replace(t, rf"[\p{{Lu}}\p{{Lt}}](?<![\p{{L}}{START}].)[^\P{{L}}\p{{Lu}}\p{{Lt}}]++(?!\p{{L}})", NAME)
    canon = F.regexp_extract_all(F.lower(t), F.lit(rf"{WORD}|[{''.join(KINDS)}]"), F.lit(0))
    return rows.withColumn("low", low).withColumn("canon", canon)


def _windows(rows: DataFrame, sizes: list[int], min_literals: int) -> DataFrame:
    """``rows`` (from ``tokens``) once for every window of every size: ``len``,
    ``pos``, ``few`` (under ``min_literals`` literals) and the key ``h``, a hash of the
    canonical tokens, or of the lower-cased ones in windows of few literals."""
    def places(n):
        last = F.size("canon") - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda p: F.struct(F.lit(n).alias("len"), p.alias("pos")))) \
            .otherwise(F.array().cast("array<struct<len:int,pos:int>>"))
    if len(sizes) == 1:  # the usual case: plain numbers instead of pairs
        last = F.size("canon") - sizes[0]
        at = rows.select("*", F.lit(sizes[0]).alias("len"), F.explode(
            F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))).alias("pos"))
    else:
        at = rows.select("*", F.explode(F.flatten(F.array(*[places(n) for n in sizes]))).alias("__at")).select(
            "*", "__at.len", "__at.pos").drop("__at")
    words = F.array_join(cut("canon"), "")
    literal = words
    for c in KINDS:
        literal = F.replace(literal, F.lit(c), F.lit(""))
    few = F.col("len") - (F.length(words) - F.length(literal)) < min_literals
    return at.withColumn("few", few).withColumn("h", F.xxhash64(F.when(F.col("few"), cut("low")).otherwise(cut("canon"))))


def cut(c: str) -> Column:
    """The window's part of a token array."""
    return F.slice(c, F.col("pos") + 1, F.col("len"))


def leaked(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, min_cover: float = MIN_COVER,
           min_literals: int = MIN_LITERALS, run: int = RUN) -> DataFrame:
    """(row id, doc_id, tkey, item_id, windows, item_windows, cover,
    first_token, new_slots): one row per document and item that it contains.

    ``windows`` and ``item_windows`` count all windows of the item; an item counts as
    found by its share of them, by its share of those with ``min_literals``, or by a
    run. ``new_slots`` counts slots whose value differs from the item's: 0 means a
    verbatim copy, more a copy with other parameters. Null and empty texts and
    items match nothing; an item shorter than ``size`` is one window of its own
    length; repeated rows give repeated results (``row_id`` tells them apart);
    null doc_ids pass; other columns are ignored; an empty table on either side
    gives an empty result. Every text is tokenised once, for windows of all lengths."""
    spark = docs.sparkSession
    own = tokens(benchmark.where("text is not null").select("item_id", "text")).where(F.size("canon") > 0)
    short = [r.n for r in own.select(F.size("canon").alias("n")).where(F.col("n") < size).distinct().collect()]  # under ``size`` numbers
    sizes = sorted({*short, size})
    whole = F.col("len") == F.least(F.size("canon"), F.lit(size))
    items = common.written(
        _windows(own, sizes, min_literals).where(whole).select(
            "item_id", F.col("pos").alias("item_pos"), "len", "h", F.col("few").alias("item_few"),
            cut("canon").alias("item_canon"), cut("low").alias("item_low")).distinct(), "leak-windows")
    words = F.array_join(F.concat("item_canon", "item_low"), " ")
    n, bytes_ = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(words) + 200), F.lit(0))).first()
    if not n:
        return spark.createDataFrame(
            [], "row_id long, doc_id long, tkey long, item_id long, windows int, item_windows long, cover double, "
                "first_token int, new_slots long")
    literal = F.countDistinct(F.when(~F.col("item_few"), F.col("item_pos")))
    per_item = items.groupBy("item_id").agg(F.countDistinct("item_pos").alias("item_windows"), literal.alias("item_literal"))
    rows = tokens(docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
                  .withColumn("row_id", F.monotonically_increasing_id())).drop("text")
    # items of checked size are broadcast; larger ones meet the windows by shuffling their keys
    mine = items.withColumnRenamed("len", "item_len")
    mine = F.broadcast(mine) if bytes_ <= BROADCAST_BYTES else mine
    at = _windows(rows, sizes, min_literals).select("row_id", "doc_id", "tkey", "pos", "len", "h", cut("canon").alias("canon"), cut("low").alias("low"))
    # joined on the key alone: arrays are cut and compared for hits only (as a range, since an
    # equality would become part of the key)
    equal = (F.col("canon") <= F.col("item_canon")) & (F.col("canon") >= F.col("item_canon"))
    few_equal = ~F.col("item_few") | ((F.col("low") <= F.col("item_low")) & (F.col("low") >= F.col("item_low")))
    met = at.join(mine, "h").where(equal & few_equal)
    slots = F.filter(F.arrays_zip("item_canon", "item_low", "low"),
                     lambda s: s["item_canon"].isin(KINDS) & (s["item_low"] != s["low"]))
    changed = F.transform(slots, lambda s: F.struct(s["item_canon"].alias("kind"), s["item_low"].alias("was"), s["low"].alias("now")))
    # a group has a window for each place of the item at most
    groups = (met.withColumn("changed", changed)
              .groupBy("row_id", "doc_id", "tkey", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
              .agg(F.collect_set(F.struct("item_pos", "item_few", "len", (F.size("changed") == 0).alias("same"))).alias("met"),
                   F.array_distinct(F.flatten(F.collect_set("changed"))).alias("slots")))
    filled = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["was"])))
    groups = groups.withColumn("alike", F.size(filled) == F.size("slots"))
    groups = groups.withColumn("met", F.array_sort(F.filter("met", lambda w: F.col("alike") | w["same"]))).where(F.size("met") > 0)
    # places less their number are equal in a run; its tokens are its windows and the rest of the last one
    places = F.transform("met", lambda w: w["item_pos"])
    starts = F.transform(places, lambda p, i: p - i)
    longest = F.array_max(F.transform(F.array_distinct(starts), lambda a: F.size(F.filter(starts, lambda b: a == b))))
    found = (groups.select("row_id", "doc_id", "tkey", "item_id", places.alias("places"),
                           F.transform(F.filter("met", lambda w: ~w["item_few"]), lambda w: w["item_pos"]).alias("literal"),
                           (F.element_at("met", 1)["item_pos"] + F.col("diagonal")).alias("first_token"),
                           F.when(F.col("alike"), F.size("slots")).otherwise(0).alias("new_slots"),
                           (longest + F.element_at("met", 1)["len"] - 1).alias("run"))
             .groupBy("row_id", "doc_id", "tkey", "item_id")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("windows"),
                  F.size(F.array_distinct(F.flatten(F.collect_set("literal")))).alias("literal"),
                  F.min("first_token").alias("first_token"), F.sum("new_slots").alias("new_slots"), F.max("run").alias("run")))
    return (found.join(per_item, "item_id").withColumn("cover", F.col("windows") / F.col("item_windows"))
            .where((F.col("cover") >= min_cover) | (F.col("run") >= run)
                   | F.coalesce(F.try_divide("literal", "item_literal") >= min_cover, F.lit(False)))
            .select("row_id", "doc_id", "tkey", "item_id", "windows", "item_windows", "cover", "first_token", "new_slots"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item, whole or
    in part, verbatim or with other parameters."""
    return _without(docs, leaked(docs, benchmark, **options))


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    bad = found.select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__key"]), "left_anti")


def op6_template_decontamination(spark, sf_dir: str) -> DataFrame:
    found = leaked(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("windows").cast("long").alias("windows"), "item_windows",
                        F.round("cover", 6).alias("cover"), F.col("first_token").cast("long").alias("first_token"),
                        F.col("new_slots").cast("long").alias("new_slots"))
