"""Near-duplicate documents by word shingles.

1. Documents with the same word sequence, or with the same single shingle (one
   word repeated), form one class; everything after works on classes, so exact
   copies, however many, cost one class.
2. Fast similarity sketching: in round i every shingle is hashed to a bin and a
   value, the bin keeps its least i + value; after T rounds, round T + j hashes
   everything into bin j, so that every coordinate fills. Coordinates agree with
   the probability of the sets' Jaccard similarity.
3. 32 bands of 4 coordinates give buckets; a pair at similarity 0.75 shares
   no bucket with probability (1 - 0.75**4)**32, about 5e-6.
4. Exact verification on full shingle sets. Only shingles that occur in two or
   more classes that share buckets can be common to a pair, so sets are kept
   without the others; a class with fewer than the threshold's share of its shingles left has no
   partner at all (an exact bound, not a cap).
5. Buckets are searched by pivots, not by all pairs: members are ranked by the
   share of their shingles that occur elsewhere; in a round the next pivots (1,
   then 8, 64, ...) meet the members behind them that are still in another
   component and can reach the threshold by the shingles that they share with
   other components, each pair in the first band that it shares. A pair that the parity
   bits of its sets (``_parity``) tell apart is not made: an odd cell in which two sets differ
   holds a shingle of one of them only, so that differing bits bound what they can have in
   common. It is exact, and leaves few of the near misses of a large group. Rounds end when every
   pair of a bucket was met or lies in one component: no link between
   different components is lost, and inside a group of mutual copies the first
   pivots link everything.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradewise.llm import common
from gradewise.llm.common import released
from gradewise.llm.components import connected_components
from gradewise.llm.words import gram_hashes, lowered, mix, word_hashes

SHINGLE = 5
COORDINATES, ROWS = 128, 4
FIRST_BANDS, WIDER = 4, 8
BLOCK_SHINGLES = 400_000
PARITY_WORDS = 16  # of 64 cells


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes: of k words, or of all words when fewer."""
    return _shingles_of(word_hashes(lowered(text)), k)


def _shingles_of(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    return np.unique(gram_hashes(h, k if len(h) >= k else len(h))) if len(h) else h


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """(sets, t) sketch of non-empty sets of distinct 64-bit hashes."""
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, np.uint64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * t):
        x = mix(every ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        place = (x % np.uint64(t)).astype(np.int64) if i < t else np.int64(i - t)
        value = (np.uint64(i) << np.uint64(55)) | (x >> np.uint64(9))
        np.minimum.at(out, owner * t + place, value)
        open_ = (out.reshape(-1, t) == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.any():
            break
        if not open_.all():
            keep = open_[owner]
            every, owner = every[keep], owner[keep]
    return out.reshape(-1, t)


def band_values(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) bucket keys: a hash of the band's coordinates and number."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    key = np.arange(t // rows, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        key = mix(key + parts[:, :, r])
    return key.view(np.int64)


SKETCHED = "doc_id long, tkey long, cls binary, n long, bands array<long>"


def _sketch_batches(batches):
    """One row per document: class key of its word sequence (a digest of its word
    hashes; null without words), shingle count and bands. A set of one shingle belongs to
    its first words: one word repeated any number of times is one class."""
    import pyarrow as pa
    import xxhash
    for batch in released(batches):
        ids, keys, texts = (c for c in batch.columns)
        at = 0
        while at < batch.num_rows:
            cls, sets, total, first = [], [], 0, at
            while at < batch.num_rows and total < BLOCK_SHINGLES:
                words = word_hashes(lowered(texts[at].as_py()))
                sets.append(_shingles_of(words))
                own = words[:SHINGLE] if len(sets[-1]) == 1 else words
                cls.append(xxhash.xxh3_128_digest(own.tobytes()) if len(words) else None)
                total += len(sets[-1])
                at += 1
            some = [i for i, s in enumerate(sets) if len(s)]
            bands = [None] * len(sets)
            if some:
                for i, b in zip(some, band_values(sketches([sets[i] for i in some]))):
                    bands[i] = b
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, at - first), keys.slice(first, at - first), pa.array(cls, pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "tkey", "cls", "n", "bands"])


def _set_batches(batches):
    import pyarrow as pa
    for batch in released(batches):
        nodes, texts = batch.columns
        for at in range(0, batch.num_rows, 64):
            sets = [shingles(t) for t in texts.slice(at, 64).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [nodes.slice(at, 64), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["node", "shingles"])


def _parity(s: str) -> Column:
    """For grouped shingles ``s``: words of one bit a cell, set where an odd number of shingles falls."""
    bit = F.expr(f"shiftleft(1L, CAST({s} & 63 AS INT))")
    word = F.shiftright(F.col(s), 6).bitwiseAND(F.lit(PARITY_WORDS - 1))
    return F.array(*[F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))) for k in range(PARITY_WORDS)])


def _differing(a: str, b: str) -> Column:
    """How many parity bits of two sets differ: their symmetric difference is no smaller."""
    return functools.reduce(Column.__add__, [
        F.bit_count(F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))) for k in range(PARITY_WORDS)])


def _shared_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(node, n, c, shared, parity) of the classes in ``members`` that can have a
    partner: shared are its shingles that occur in another of these classes."""
    reps = members.select("node").distinct().join(classes, "node").select("node", "n", "rep.*")
    one = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    texts = (one.alias("d").join(reps.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))
                                 & (F.col("d.tkey") == F.col("r.tkey")))
             .select("r.node", "d.text"))
    # a repeated row brings its class twice; both rows are the same set
    single = texts.groupBy("node").agg(F.first("text").alias("text")) if docs_repeat(docs) else texts
    sets = common.written(single.mapInArrow(_set_batches, "node long, shingles array<long>"), "dup-sets")
    rows = sets.select("node", F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("k")).where("k > 1").select("s")
    kept = rows.join(often, "s").groupBy("node").agg(F.collect_list("s").alias("shared"), _parity("s").alias("parity"))
    return kept.join(members.select("node", "n").distinct(), "node").select(
        "node", "n", F.size("shared").cast("long").alias("c"), "shared", "parity").where(f"100 * c >= {percent} * n")


def docs_repeat(docs: DataFrame) -> bool:
    """Whether some (doc_id, text) row occurs more than once."""
    return not (docs.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").isEmpty())


def _reach(sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(node, comp, c): c counts the shingles that a class of another component
    has too, a bound on what any link out of the component can have in common.
    Classes that cannot reach the threshold with it are left out."""
    rows = sets.select("node", "n", F.explode("shared").alias("s")).join(comps, "node")
    spread = rows.groupBy("s").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most")
    return (rows.join(spread.select("s"), "s").groupBy("node", "comp", "n").agg(F.count("*").alias("c"))
            .where(f"100 * c >= {percent} * n").select("node", "comp", "c"))


def _pairs(ranked: DataFrame, reach: DataFrame, bands: DataFrame, low: int, high: int, percent: int) -> DataFrame:
    """Pairs (a, b) between the pivots of ranks low..high-1 of each bucket and
    the members behind them, in other components and within reach by counts and parity.
    A pair belongs to the first band that both share, so it appears once."""
    now = ranked.where(F.col("last") > low).drop("c").join(reach, "node")
    both = now.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
    now = now.join(both.where("least <> most").select("bucket"), "bucket").join(bands, "node")
    pivot = now.where((F.col("rank") >= low) & (F.col("rank") < high)).select(
        "bucket", F.col("rank").alias("p_rank"), F.col("node").alias("p"), F.col("n").alias("p_n"),
        F.col("c").alias("p_c"), F.col("comp").alias("p_comp"), F.col("bands").alias("p_bands"),
        F.col("whole").alias("p_whole"), F.col("parity").alias("p_parity"))
    # twice what both can have in common
    twice = F.col("whole") + F.col("p_whole") - _differing("parity", "p_parity")
    earlier = F.arrays_overlap(F.slice("bands", 1, F.col("band")), F.slice("p_bands", 1, F.col("band")))
    met = now.where(F.col("rank") > low).join(pivot, "bucket").where(
        (F.col("rank") > F.col("p_rank")) & (F.col("comp") != F.col("p_comp"))
        & ((100 + percent) * F.least("c", "p_c") >= percent * (F.col("n") + F.col("p_n")))
        & ((100 + percent) * twice >= 2 * percent * (F.col("n") + F.col("p_n"))) & ~earlier)
    return met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * common >= percent * union on their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("shared").alias("as"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("shared").alias("bs"))
    common_ = F.size(F.array_intersect("as", "bs"))
    return (pairs.join(left, "a").join(right, "b")
            .where((100 + percent) * common_ >= percent * (F.col("an") + F.col("bn"))).select("a", "b"))


def link_classes(docs: DataFrame, classes: DataFrame, percent: int = 75) -> tuple[DataFrame, DataFrame | None]:
    """(node, comp) of the classes that have links, and the links found (a
    subset of all links with the same components); see the module's steps."""
    buckets = classes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    several = buckets.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    members = common.written(buckets.join(several, "bucket"), "dup-members")
    sets = common.written(_shared_sets(docs, classes, members, percent), "dup-shared")
    able = members.join(sets.select("node", "c"), "node")
    order = Window.partitionBy("bucket").orderBy((F.col("n") - F.col("c")) / F.col("n"), "node")
    size = Window.partitionBy("bucket")
    ranked = common.written(
        able.select("bucket", "band", "node", "n", "c", (F.row_number().over(order) - 1).alias("rank"),
                    (F.count("*").over(size) - 1).alias("last")).where("last > 0"), "dup-ranked")
    most = ranked.agg(F.max("last")).first()[0] or 0
    parity = sets.select("node", F.col("c").alias("whole"), "parity")
    bands = common.written(classes.select("node", "bands").join(ranked.select("node").distinct(), "node").join(parity, "node"),
                           "dup-bands")
    comps = common.written(bands.select("node", F.col("node").alias("comp")), "dup-comps")
    # the first pivots meet in a few bands first, so that what links there is not met again
    few = F.col("band") < FIRST_BANDS
    rounds, low, width = [(0, 1, few), (0, 1, ~few)], 1, WIDER
    while low < most:
        rounds.append((low, low + width, F.lit(True)))
        low, width = low + width, width * WIDER
    links, reach = None, ranked.select("node", F.col("node").alias("comp"), "c").distinct()
    for low, high, some in rounds if most else []:
        common.sweep(docs.sparkSession)
        if links is not None:
            reach = common.written(_reach(sets, comps, percent), "dup-reach")
            if low and reach.isEmpty():
                break
        pairs = _pairs(ranked.where(some), reach, bands, low, high, percent)
        found = common.written(_verified(pairs, sets, percent), "dup-links")
        common.sweep(docs.sparkSession)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            # components of components: links between labels, then one step back
            label = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
            over = found.join(label, "a").join(label.toDF("b", "cb"), "b").select(
                F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
            merged = connected_components(over).toDF("comp", "top")
            comps = common.written(comps.join(merged, "comp", "left").select(
                "node", F.coalesce("top", "comp").alias("comp")), "dup-comps")
    return comps, links


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    component_id is the smallest doc_id that can be reached over links
    (Jaccard similarity of at least ``percent`` / 100 on distinct 5-word
    shingles); a document without words (null, empty, blank) has no shingles and
    links with nothing. Repeated rows and rows of one id share their component;
    a null id stands behind all others (null component only when a group has
    no id at all, and such rows are not kept unless that is so). Columns
    besides doc_id and text are ignored; an empty table gives an empty result."""
    return _labelled(docs, percent).drop("tkey")


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    docs = docs.select("doc_id", "text")
    rows = common.written(
        docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(_sketch_batches, SKETCHED), "dup-rows")
    classes = common.written(
        rows.where("cls is not null").groupBy("cls").agg(
            F.min(F.struct("doc_id", "tkey")).alias("rep"), F.min("doc_id").alias("first_id"),
            F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "dup-classes")
    comps, _ = link_classes(docs, classes, percent)
    named = classes.select("node", "cls", "first_id").join(comps, "node", "left").withColumn(
        "comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_class = named.join(least, "comp").select("cls", "component_id")
    return (rows.select("doc_id", "tkey", "cls", F.col("n").alias("n_shingles")).join(of_class, "cls", "left")
            .withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
            .select("doc_id", "tkey", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each group: the one whose id is the
    component's, once. A document without words is alone in its group. Rows are
    told apart by id and text; all columns stay as they came."""
    keep = _labelled(docs, percent).where("kept").select(F.col("doc_id").alias("__id"), F.col("tkey").alias("__key")).distinct()
    mine = docs.join(keep, docs["doc_id"].eqNullSafe(keep["__id"]) & (F.xxhash64(docs["text"]) == keep["__key"]), "left_semi")
    return mine.dropDuplicates(["doc_id", "text"]) if docs_repeat(docs) else mine


def op4_sketch_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
