"""Licence scan against a plain search of every text."""

import random
import re

from gradewise.llm import licenses as lic

SCHEMA = "doc_id long, text string, row int, label string, base int"


def plain_words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(text):
    words = plain_words(text)
    starts, base, labels, score = [], set(), set(), 0.0
    for label, phrase in lic.PHRASES:
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        starts += here
        if here:
            base.add(label)
            score = 1.0
    stand = []
    pairs = [set(zip(plain_words(t), plain_words(t)[1:])) for _, t in lic.TEMPLATES]
    for (label, t), mine in zip(lic.TEMPLATES, pairs):
        t = plain_words(t)
        own = list(zip(t, t[1:]))
        telling = {j for (other, _), has in zip(lic.TEMPLATES, pairs) if other != label and 2 * sum(p in has for p in own) >= len(own)
                   for j, p in enumerate(own) if p not in has}
        hits = {}
        for i in range(len(words) - 1):
            for j in range(len(own)):
                if (words[i], words[i + 1]) == own[j]:
                    hits.setdefault(i - j, set()).add(j)
        for d in hits:
            seen = set().union(*(hits.get(d + e, set()) for e in range(-lic.SLACK, lic.SLACK + 1)))
            if len(seen) / len(own) >= lic.MIN_COVER and telling <= seen:
                stand.append((len(seen) / len(own), len(own), label, d))
    for c, n, label, d in stand:
        if not any(b > (c, n, label) and b[2] != label and b[3] <= d + n and d <= b[3] + b[1] for b in
                   [(*x[:3], x[3]) for x in stand] if b[:3] > (c, n, label)):
            labels.add(label)
            score = max(score, c)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), round(score, 9))


def scanned(spark, rows):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
                   for r in lic.scan(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_against_plain(spark):
    rnd = random.Random(3)
    filler = ["the", "of", "license", "software", "under", "cc", "by", "public", "general", "été", "and"]
    rows = [(i, t, 1, "x", 0) for i, t in enumerate([
        None, "", "  ", "cc", "CC-BY", "cc by cc by", "Copyright. All rights reserved.", "general public license " * 40,
        *[t for _, t in lic.TEMPLATES], *[t.upper() for _, t in lic.TEMPLATES],
        *[" ".join(w for k, w in enumerate(t.split()) if k != 4) for _, t in lic.TEMPLATES],
        "éxcc by", "cc_by", "ALL RIGHTS\nRESERVED", "all rights not reserved"])]
    for i in range(60):
        words = [rnd.choice(filler) for _ in range(rnd.randrange(200))]
        if rnd.random() < 0.5:
            words[5:5] = rnd.choice(lic.TEMPLATES)[1].split()
        rows.append((1000 + i, " ".join(words), 1, "x", 0))
    rows += [rows[9], rows[9], (None, "cc by", 1, "x", 0), (None, None, 1, "x", 0)]
    assert scanned(spark, rows) == sorted(((r[0], *plain(r[1])) for r in rows), key=str)
    assert scanned(spark, []) == []


def test_long_templates_are_cut(spark):
    long = " ".join(f"w{i}" for i in range(150))
    df = spark.createDataFrame([(1, "x y " + long, 1, "x", 0)], SCHEMA)
    (r,) = lic.scan(df, templates=[("long", long)]).collect()
    assert (r.labels, r.score, r.base_labels) == ("long", 1.0, "")


HAND = {  # text -> labels that a reader would give (base phrases included)
    "Licensed under CC BY 4.0": "cc-by",
    "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
    "Licensed under CC BY-NC 4.0 by the author": "cc-by,cc-by-nc",
    "licensed under cc by-nc-nd 4.0": "cc-by,cc-by-nc-nd",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "cc-by-nc-nd",
    "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
    "You can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "gpl,lgpl",
    "Licensed under the Apache License, Version 2.0 (the License)": "apache-2.0",
    "Released under the MIT License": "mit", "All rights reserved": "reserved",
    "Creative people in common attribute 4 works to an international licence": "", "Released under the moon": "",
    "licensed under a permit of the city": "",
}


def test_labels_written_by_hand(spark):
    rows = [(i, "Some words before. " + t + " Some words behind.", 0, "", 0) for i, t in enumerate(HAND)]
    got = {r.doc_id: r.labels for r in lic.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {t: got[i] for i, t in enumerate(HAND)} == HAND


def test_every_template_is_its_own(spark):
    rows = [(i, t, 0, "", 0) for i, (_, t) in enumerate(lic.TEMPLATES)]
    got = {r.doc_id: set(r.labels.split(",")) for r in lic.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    base = {"cc-by", "gpl"}  # phrases inside longer templates
    for i, (label, _) in enumerate(lic.TEMPLATES):
        assert label in got[i] and got[i] - {label} <= base, (label, got[i])
