"""Merkle manifest of a dataset, with nested-interval labels.

Every document is a leaf; the leaves of a language, by id, form a tree whose
nodes hash runs of eight, and the languages' roots form one more tree. A node is
labelled with the interval [lo, hi) of leaf ranks that it covers, so trees need no
pointers: an ancestor is a node whose interval contains the own one, the top of a
tree is the node whose interval is the whole tree, and the siblings of a node are
what is left of the parent's interval, before and behind, without the own one.

Nodes of a level have intervals of one width, which cuts the ranks into buckets:
ancestors are attached level by level, from the top, by a join on (tree, bucket)
with the containment as its condition. A path (the siblings' digests, level by
level) is handed down, so the leaves meet an eighth as many rows with paths, in
buckets of eight leaves, whatever the size of a language.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradewise.llm import common

FAN = 8
PATH = "array<struct<left string, right string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**replaced: Column) -> Column:
    return digest(*[field(replaced.get(c, F.col(c))) for c in FIELDS])


def tampered(doc_id: Column) -> Column:
    """Whether a document counts as tampered with: 3 divides the crc32 of its id (null: never)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


class Tree(NamedTuple):
    """``leaves``: tree, lo, hi, n, digest and other columns; ``levels``: per level from 1
    tree, lo, hi, n, digest, kids (lo, hi, digest of the run); ``tops``: tree, digest. ``n`` is
    the number of leaves of the tree."""

    leaves: DataFrame
    levels: list[DataFrame]
    tops: DataFrame


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with lo (rank in the tree by ``order``, nulls first), hi = lo + 1 and n.

    Rows are dealt by ranges of (tree, order), equal ones by a number, and written, each
    with a running number; a tree's ranks then follow from the counts per part, a small
    table. So a tree that holds most rows is spread over all parts."""
    spark = rows.sparkSession
    rows = rows.withColumn("__tie", F.monotonically_increasing_id())
    by = ["tree", *order, "__tie"]
    dealt = common.written(
        rows.repartitionByRange(common.shuffle_partitions(spark), *by).sortWithinPartitions(*by).drop("__tie")
        .withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "merkle-ranked")
    parts = dealt.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__count"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("tree", "__part", "__first", F.sum("__count").over(tree).alias("n"),
                           F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__before"))
    lo = F.col("__at") - F.col("__first") + F.col("__before")
    return (dealt.join(offsets, ["tree", "__part"]).withColumn("lo", lo).withColumn("hi", lo + 1)
            .drop("__at", "__part", "__first", "__before"))


def build(rows: DataFrame, order: list[str]) -> Tree:
    """Trees over ``rows`` (tree, digest and other columns), all at once, level by level:
    a level is written, and the next one reads an eighth of it."""
    leaves = common.written(ranked(rows, order), "merkle-leaves")
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels, below, width = [], leaves, 1
    while width < largest:
        run = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))  # at most FAN nodes
        nodes = below.where(F.col("n") > width).groupBy("tree", "n", F.floor(F.col("lo") / (width * FAN)).alias("bucket")).agg(
            run.alias("kids"))
        below = common.written(nodes.select(
            "tree", F.element_at("kids", 1)["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "n",
            F.sha2(F.array_join(F.col("kids.digest"), ""), 256).alias("digest"), "kids"), "merkle-level")
        levels.append(below)
        width *= FAN
    whole = F.col("hi") - F.col("lo") == F.col("n")
    tops = leaves.where(whole).select("tree", "digest")
    for nodes in levels:
        tops = tops.unionByName(nodes.where(whole).select("tree", "digest"))
    return Tree(leaves, levels, tops)


def paths(tree: Tree, above: DataFrame | None = None) -> DataFrame:
    """The leaves with ``path``: per level from the own one to the top, the digests of the
    siblings before and behind; and with ``top``, the digest of their tree, handed down
    likewise. ``above``: tree, path beyond a tree's top."""
    whole = F.col("hi") - F.col("lo") == F.col("n")
    parents = None
    for at in range(len(tree.levels), -1, -1):
        nodes = tree.levels[at - 1] if at else tree.leaves
        tops = nodes.where(whole).withColumn("top", F.col("digest"))
        tops = tops.withColumn("path", F.array().cast(PATH)) if above is None else tops.join(above, "tree")
        if parents is None:
            parents = tops
            continue
        width = FAN ** (at + 1)
        inner = nodes.where(~whole).withColumn("__bucket", F.floor(F.col("lo") / width))
        outer = parents.select(F.col("tree").alias("__tree"), F.floor(F.col("lo") / width).alias("__of"),
                               F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("kids").alias("__kids"),
                               F.col("path").alias("__path"), "top")
        within = (F.col("__lo") <= F.col("lo")) & (F.col("hi") <= F.col("__hi"))
        met = inner.join(outer, (F.col("tree") == F.col("__tree")) & (F.col("__bucket") == F.col("__of")) & within)

        def beside(which):
            return F.array_join(F.transform(F.filter("__kids", which), lambda k: k["digest"]), "")
        step = F.struct(beside(lambda k: k["hi"] <= F.col("lo")).alias("left"),
                        beside(lambda k: k["lo"] >= F.col("hi")).alias("right"))
        met = met.withColumn("path", F.concat(F.array(step), "__path"))
        parents = met.select(*nodes.columns, "top", "path").unionByName(tops)
    return parents


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a path, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its path."""
    return F.aggregate(path, start, lambda at, s: digest(s["left"], at, s["right"]))


class Manifest(NamedTuple):
    """``languages``: the documents' trees, ``tree`` being ``-`` for a null language, else ``=`` and the
    language; ``all``: the tree over their tops; ``root``: its digest (None for an empty table)."""

    languages: Tree
    all: Tree
    root: str | None


def manifest(docs: DataFrame) -> Manifest:
    """Merkle trees of ``docs`` in the shared folder.

    Leaves ascend by doc_id (null first), those of one id by digest; equal rows are leaves of
    their own. Null values, empty and long texts are hashed as they are; other columns are ignored,
    whatever their names."""
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))  # sorts null first, then by bytes
    rows = docs.select(tree.alias("tree"), "doc_id", leaf_digest().alias("digest"), F.when(
        tampered(F.col("doc_id")), leaf_digest(text=F.translate("text", _UPPER, _LOWER))).alias("changed"))
    languages = build(common.written(rows, "merkle-digests"), ["doc_id", "digest"])
    tops = languages.tops.select(F.lit("").alias("tree"), F.col("tree").alias("language"), "digest")
    whole = build(common.written(tops, "merkle-tops"), ["language"])
    top = whole.tops.first()  # one row: the dataset's root
    return Manifest(languages, whole, top.digest if top else None)


def nodes(m: Manifest) -> DataFrame:
    """The manifest as a table: language (null for nodes above the languages), level, lo, hi, digest. Nodes of a
    language: its ``tree``."""
    out = None
    for tree, name in ((m.languages, F.col("tree")), (m.all, F.lit(None).cast("string"))):
        for level, table in enumerate([tree.leaves, *tree.levels]):
            part = table.select(name.alias("tree"), F.lit(level).alias("level"), "lo", "hi", "digest")
            out = part if out is None else out.unionByName(part)
    return out


OUT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
       "verified boolean")


def proofs(m: Manifest) -> DataFrame:
    """Per document its digest, its language's and the dataset's root, the digest of its proof, and the
    root that its (for some documents tampered) text gives with the siblings of the manifest."""
    spark = m.languages.leaves.sparkSession
    if m.root is None:
        return spark.createDataFrame([], OUT)
    above = paths(m.all).select(F.col("language").alias("tree"), "path")
    d = paths(m.languages, above).select(
        "doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(m.root).alias("root"),
        path_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root"))
    return d.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_interval_manifest(spark, sf_dir: str) -> DataFrame:
    return proofs(manifest(common.documents(spark, sf_dir)))


def _sql(levels: int, tops: int) -> str:
    """The query in DuckDB, written from the definition, for up to 8**levels documents a language and 8**tops languages."""
    f = [f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in FIELDS]
    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    changed = " || ".join(f[:4] + [f[4].replace("text", low)])
    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), "
           "lambda c: ord(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), "
           "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))")
    q = [f"d0 AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256({' || '.join(f)}) AS d, "
         f"CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN sha256({changed}) END AS ch FROM documents)",
         "a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS no, "
         "count(*) OVER (PARTITION BY g) AS n FROM d0)"]

    def tree(t, depth):
        for k in range(depth):
            q.append(f"{t}s{k} AS (SELECT x.g, x.no, coalesce(string_agg(y.d, '' ORDER BY y.no) FILTER (WHERE y.no < x.no), '') AS l, "
                     f"coalesce(string_agg(y.d, '' ORDER BY y.no) FILTER (WHERE y.no > x.no), '') AS r FROM {t}{k} x JOIN {t}{k} y "
                     f"ON x.g = y.g AND x.no // 8 = y.no // 8 GROUP BY x.g, x.no)")
            q.append(f"{t}{k + 1} AS (SELECT g, no // 8 AS no, any_value(n) AS n, CASE WHEN any_value(n) > {8 ** k} "
                     f"THEN sha256(string_agg(d, '' ORDER BY no)) ELSE any_value(d) END AS d FROM {t}{k} GROUP BY g, no // 8)")

    def climb(t, depth, first, leaf_no):
        for k in range(depth):
            here = f"{t}f{k}"
            q.append(f"{here} AS (SELECT p.* REPLACE (p.proof || CASE WHEN p.{leaf_no[1]} > {8 ** k} THEN s.l || s.r ELSE '' END AS proof, "
                     f"CASE WHEN p.{leaf_no[1]} > {8 ** k} THEN sha256(s.l || p.fold || s.r) ELSE p.fold END AS fold) FROM {first} p "
                     f"JOIN {t}s{k} s ON s.g = p.{leaf_no[2]} AND s.no = p.{leaf_no[0]} // {8 ** k})")
            first = here
        return first
    tree("a", levels)
    q.append(f"b0 AS (SELECT '' AS g, g AS lang, row_number() OVER (ORDER BY g) - 1 AS no, count(*) OVER () AS n, d FROM a{levels})")
    tree("b", tops)
    q.append("start AS (SELECT a.doc_id, a.g, a.no, a.n, a.d AS leaf, coalesce(a.ch, a.d) AS fold, '' AS proof, b.g AS bg, b.no AS bno, "
             "b.n AS bn, b.d AS subroot FROM a0 a JOIN b0 b ON b.lang = a.g)")
    last = climb("b", tops, climb("a", levels, "start", ("no", "n", "g")), ("bno", "bn", "bg"))
    return ("WITH " + ", ".join(q) + f" SELECT f.doc_id, f.leaf, f.subroot, t.d AS root, sha256(f.proof) AS proof_sha256, "
            f"f.fold AS folded_root, f.fold = t.d AS verified FROM {last} f, b{tops} t")


OP13_SQL = _sql(6, 2)
