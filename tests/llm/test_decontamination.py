"""Template decontamination against plain Python."""

import random

import regex

from gradewise.llm import decontamination as dc

DOC = "doc_id long, text string, item_id int, h string, raw int"
ITEM = "item_id long, text string, pos int"


TOKEN = r"\p{L}+|\p{N}+(?:[.,]\p{N}+)*|[.!?:;\n%$€£]"


def plain_tokens(text):
    all_ = regex.findall(TOKEN, text or "")
    raw, canon = [], []
    for i, w in enumerate(all_):
        if w in dc.MARKS:
            continue
        before = all_[i - 1] if i else None
        low = w.lower()
        if regex.match(r"\p{N}", w):
            c = "<num>"
        elif w in dc.SIGNS or low in dc.UNITS and before and regex.match(r"\p{N}", before):
            c = "<unit>"
        elif w != low and len(w) > 1 and w[1:] == low[1:] and before is not None and before not in dc.MARKS:
            c = "<name>"
        else:
            c = low
        raw.append(w)
        canon.append(c)
    return raw, canon


def test_tokens_against_plain(spark):
    rnd = random.Random(1)
    parts = ["Anna", "berta", "USA", "McX", "ÉTÉ", "Été", "ß", "5", "3.5", "1,000.25", "km", "KM", "Euros", "m", "%", "$", ".", "!", ":", "\n", " ", "-", ",",
             "(", "\ue000", "\ue003", "x", "X", "Ab", "５", "東京", "Ñandú", "ﬁ", "2nd", "..", "é"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", " "]) for _ in range(rnd.randrange(40))) for _ in range(400)] + [None, "", "A", "İstanbul Ankara"]
    rows = dc.tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).collect()
    shown = dict(zip(dc.KINDS, ["<num>", "<unit>", "<name>"]))
    for r in rows:
        raw, canon = plain_tokens((texts[r.i] or "").replace("İ", "I"))
        assert ([w.lower() for w in raw], canon) == (r.low, [shown.get(c, c) for c in r.canon]), texts[r.i]


def plain(docs, items):
    out = []
    wins = {}
    for item, text, *_ in items:
        raw, canon = plain_tokens(text)
        n = min(dc.WINDOW, len(canon))
        for p in range(len(canon) - n + 1 if n else 0):
            if sum(not c.startswith("<") for c in canon[p:p + n]) >= dc.MIN_LITERALS:
                wins.setdefault(item, {})[p] = (tuple(canon[p:p + n]), raw[p:p + n])
    for doc, text, *_ in docs:
        raw, canon = plain_tokens(text)
        for item, ws in wins.items():
            groups = {}
            for p, (t, w_raw) in ws.items():
                for q in range(len(canon) - len(t) + 1):
                    if tuple(canon[q:q + len(t)]) == t:
                        places, slots, first = groups.setdefault(q - p, (set(), set(), []))
                        places.add(p)
                        first.append(q)
                        slots.update((c, a.lower(), b.lower()) for c, a, b in zip(t, w_raw, raw[q:q + len(t)])
                                     if c.startswith("<"))
            good = [g for g in groups.values() if len({s[:2] for s in g[1]}) == len(g[1])]
            n = len(set().union(*(g[0] for g in good))) if good else 0
            if good and n / len(ws) >= dc.MIN_COVER:
                out.append((doc, item, n, len(ws), round(n / len(ws), 6), min(min(g[2]) for g in good),
                            sum(1 for g in good for s in g[1] if s[1] != s[2])))
    return sorted(out, key=str)


def found(spark, docs, items):
    got = dc.leaked(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    return sorted(((r.doc_id, r.item_id, r.windows, r.item_windows, round(r.cover, 6), r.first_token, r.new_slots)
                   for r in got), key=str)


ITEMS = [
    (1, "Anna buys 3 apples and 5 pears. How much does Anna pay when 3 apples cost 2 euros and a pear costs 40 cents?", 0),
    (2, "The train to Berlin leaves at 12:30 and travels 250 km in 2.5 hours; what is its mean speed?", 0),
    (3, "short item of five words", 0), (4, None, 0), (5, "", 0), (6, "12 13 14 15 16 17 18 19 20", 0),
    (1, "Anna buys 3 apples and 5 pears. How much does Anna pay when 3 apples cost 2 euros and a pear costs 40 cents?", 0)]


def test_against_plain(spark):
    a, b = ITEMS[0][1], ITEMS[1][1]
    other = a.replace("Anna", "Berta").replace("3 apples", "7 apples").replace("40", "95")
    docs = [(i, t, 0, "x", 1) for i, t in enumerate([
        a, "Intro words. " + a + "\nand more text follows here", a.upper(), a.lower(), other,
        a.replace("Anna pay", "Berta pay"),  # one name filled in two ways
        "x " + b.replace("250 km", "99 miles") + " y", b.replace("its mean speed", "the price"), None, "", "!!!",
        "a short item of five words indeed", "12 13 14 15 16 17 18 19 20 21", "nothing of the kind " * 50,
        a + " " + other, " ".join(a.split()[::-1])])]
    docs += [docs[1], docs[1], (None, "so " + b, 0, "x", 1)]
    rnd = random.Random(6)
    for i in range(20):
        words = (a + " " + b).split()
        for _ in range(rnd.randrange(12)):
            words[rnd.randrange(len(words))] = rnd.choice(["Clara", "8", "km", "word", "."])
        docs.append((100 + i, " ".join(words), 0, "x", 1))
    got = found(spark, docs, ITEMS)
    assert got == plain_leaks(docs, ITEMS)
    hit = {(r[0], r[1]): r[6] for r in got}
    assert {(r[0], r[1]) for r in plain(docs, ITEMS)} <= set(hit)  # nothing of the template rule is lost
    assert hit[0, 1] == 0 and hit[4, 1] > 0 and hit[6, 2] > 0 and (11, 3) in hit and (13, 1) not in hit and (12, 6) in hit
    left = dc.drop_leaked(spark.createDataFrame(docs, DOC), spark.createDataFrame(ITEMS, ITEM)).collect()
    assert sorted((r.doc_id, r.text, r.raw) for r in left) == sorted(
        (d[0], d[1], 1) for d in docs if d[0] not in {r[0] for r in got}) if None not in {r.doc_id for r in left} else False


def test_empty(spark):
    assert found(spark, [], ITEMS) == [] == found(spark, [(1, "a b c d e f g h", 0, "", 0)], [])
    docs = spark.createDataFrame([(1, "a b c", 0, "", 0)], DOC)
    assert dc.drop_leaked(docs, spark.createDataFrame([], ITEM)).count() == 1


def test_shuffle_path_agrees(spark, monkeypatch):
    docs = [(i, "lead " * i + ITEMS[i % 2][1], 0, "", 0) for i in range(8)]
    both = found(spark, docs, ITEMS)
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 0)
    assert found(spark, docs, ITEMS) == both and len(both) == 8


def plain_leaks(docs, items):
    out = []
    for item in {i[0] for i in items if i[1]}:
        raw, canon = plain_tokens(next(i[1] for i in items if i[0] == item))
        low, n = [r.lower() for r in raw], min(dc.WINDOW, len(raw))
        if not n:
            continue
        many = [sum(not c.startswith("<") for c in canon[p:p + n]) >= dc.MIN_LITERALS for p in range(len(raw) - n + 1)]
        for doc, text, *_ in docs:
            d_raw, d_canon = plain_tokens(text)
            d_low = [r.lower() for r in d_raw]
            good, new, first, run = set(), 0, [], 0
            for diagonal in range(-len(raw), len(d_raw)):
                met, slots = {}, set()
                for p in range(len(many)):
                    q = p + diagonal
                    if q < 0 or d_canon[q:q + n] != canon[p:p + n] or not (many[p] or d_low[q:q + n] == low[p:p + n]):
                        continue
                    now = {(c, a, b) for c, a, b in zip(canon[p:p + n], low[p:p + n], d_low[q:q + n]) if a != b}
                    met[p] = not now
                    slots |= now
                if len({s[:2] for s in slots}) == len(slots):
                    new += len(slots)
                else:
                    met = {p: same for p, same in met.items() if same}
                for p in met:
                    first.append(p + diagonal)
                    length = next(k for k in range(1, len(many) + 1) if p + k not in met)
                    run = max(run, length + n - 1)
                good |= set(met)
            literal = sum(many) and sum(many[p] for p in good) / sum(many)
            if good and (len(good) / len(many) >= dc.MIN_COVER or literal >= dc.MIN_COVER or run >= dc.RUN):
                out.append((doc, item, len(good), len(many), round(len(good) / len(many), 6), min(first), new))
    return sorted(out, key=str)


def test_verbatim_copies(spark):
    a, b = ITEMS[0][1], ITEMS[1][1]
    long = " ".join(f"{w}{i}x" for i, w in enumerate(["term"] * 59)).translate(str.maketrans("0123456789", "abcdefghij"))
    twice = ("Yesterday Anna gave 3 books to her teacher before the school closed its old doors and 3 friends of Anna "
             "were waiting outside with her younger brother for a ride home")
    items = ITEMS + [(7, "What is 3 + 4?", 0), (8, long, 0), (9, twice, 0)]
    words = long.split()
    docs = [(i, t, 0, "x", 1) for i, t in enumerate([
        a, b, "12 13 14 15 16 17 18 19 20", "see 12 13 14 15 16 17 18 19 20 21", "12 13 14 15 99 17 18 19 20", "he asked: what is 3 + 4?", "what is 3 + 5?",
        "so " + " ".join(words[20:33]) + " so", "so " + " ".join(words[20:32]) + " so", " ".join(words[30:52]),
        twice.replace("gave 3", "gave 7"), twice.replace("of Anna", "of Berta"), twice.replace("3", "8"),
        twice.replace("gave 3", "gave 7").replace("and 3", "and 9"), a.replace("Anna pay", "Berta pay"), None, "", a[:60] + " " + a])]
    docs += [docs[2], (None, "so " + b, 0, "x", 1)]
    rnd = random.Random(8)
    for i in range(20):
        mixed = (a + " " + twice).split()
        for _ in range(rnd.randrange(12)):
            mixed[rnd.randrange(len(mixed))] = rnd.choice(["Clara", "8", "km", "word", "."])
        docs.append((100 + i, " ".join(mixed), 0, "x", 1))
    d, b_ = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    got = sorted(((r.doc_id, r.item_id, r.windows, r.item_windows, round(r.cover, 6), r.first_token, r.new_slots)
                  for r in dc.leaked(d, b_).collect()), key=str)
    assert got == plain_leaks(docs, items)
    hit = {(r[0], r[1]) for r in got}
    assert {(2, 6), (3, 6), (5, 7), (7, 8), (9, 8), (10, 9), (11, 9), (12, 9), (13, 9), (14, 1)} <= hit
    assert not {(4, 6), (6, 7), (8, 8)} & hit
    assert {r.doc_id for r in dc.drop_leaked(d, b_).collect()} == {x[0] for x in docs} - {r[0] for r in got}
    assert {r[:2] for r in plain(docs, items)} <= hit  # nothing of the template rule is lost
    assert dc.leaked(d, spark.createDataFrame([], ITEM)).isEmpty() and dc.leaked(d.limit(0), b_).isEmpty()
