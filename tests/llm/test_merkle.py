"""Trees, proofs and tampering against a plain recursive version; the SQL on the small table."""

import hashlib
import random
import zlib

from gradewise.llm import common, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lo long, tree string, digest int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """(top, per leaf the list of (left, right) digests)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
        for k, i in enumerate(at):
            run, j = runs[i // 8], i % 8
            steps[k].append((run[:j], run[j + 1:]))
        at, nodes = [i // 8 for i in at], [h(*run) for run in runs]
    return nodes[0], steps


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subroots, inner = [], []
    for lang in langs:
        mine = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        top, steps = climb([leaf(r, r[1]) for r in mine])
        subroots.append(top)
        inner.append((mine, steps))
    if not langs:
        return []
    root, outer = climb(subroots)
    out = []
    for (mine, steps), sub, up in zip(inner, subroots, outer):
        for r, own in zip(mine, steps):
            path = own + up
            proof = h(*[d for left, right in path for d in left + right])
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            at = leaf(r, lowered(r[1]) if bad else r[1])
            for left, right in path:
                at = h(*left, at, *right)
            out.append((r[0], leaf(r, r[1]), sub, root, proof, at, at == root))
    return out


def some(n, langs, seed=0):
    rnd = random.Random(seed)
    return [(i * 7 - 50, rnd.choice(["Some Text ", "no capitals ", "É only ", ""]) + str(i % 40), rnd.choice(langs), rnd.choice(["s", None, "é"]),
             rnd.choice([None, i])) for i in range(n)]


def same(x):
    return sorted(map(repr, x))


def check(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, 5, "clash", 1) for r in rows], SCHEMA).repartition(partitions)
    got = [tuple(r) for r in merkle.proofs(merkle.manifest(df)).collect()]
    assert same(got) == same(plain(rows))
    return got


def test_many_languages_and_depths(spark):
    rows = some(700, ["en"] * 9 + ["de", None, "é"]) + [(1, "Lone", "zz", None, None)]
    rows += [(2, "x" * 300_000 + "Y", "en", "s", 1), (2, None, "en", "s", 1), (None, "No Id", "en", None, None), (None, None, None, None, None)]
    rows += [(3, "Again", "en", "s", 2)] * 30  # equal rows
    got = check(spark, rows)
    assert 0 < sum(r[6] for r in got) < len(got)


def test_more_languages_than_a_run(spark):
    check(spark, some(60, [f"l{i}" for i in range(20)] + ["", None], 3), 1)


def test_run_sizes(spark):
    for n in (1, 2, 8, 9, 64, 65):
        check(spark, some(n, ["en"], n), 2)


def test_empty_table(spark):
    assert check(spark, []) == []


def test_tampering_is_found_and_intervals_nest(spark):
    rows = some(200, ["en", "de"], 5)
    df = spark.createDataFrame([(*r, 5, "clash", 1) for r in rows], SCHEMA)
    m = merkle.manifest(df)
    for r in merkle.proofs(m).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0 or text == lowered(text))
    nodes = merkle.nodes(m).collect()
    for tree in ("=en", "=de"):
        mine = [n for n in nodes if n.tree == tree]
        for k in range(max(n.level for n in mine)):
            for n in (n for n in mine if n.level == k):
                assert sum(p.lo <= n.lo and n.hi <= p.hi for p in mine if p.level == k + 1) == 1


def test_sql(spark, sf_small):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_small}/documents.parquet'")
    want = con.execute(merkle.OP13_SQL).fetchall()
    q = merkle.op13_interval_manifest(spark, sf_small)
    assert q.columns == [c[0] for c in con.description]
    got = [tuple(r) for r in q.collect()]
    assert same(got) == same(want)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in common.documents(spark, sf_small).collect()]
    assert same(got) == same(plain(rows))
