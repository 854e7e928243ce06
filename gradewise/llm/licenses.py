"""Licence scans by diagonal voting.

Every run of two words of every text is hashed and joined to the places of the
same run in the templates. A hit votes for the diagonal (word number in the
text less word number in the template) on which a copied passage lies. Votes
are gathered per (text, template, diagonal) as a bit mask of the template places
seen; neighbouring diagonals, which an inserted or lost word brings about, are
merged. Spans are verified by their masks, which say what word pairs of the template the
text really has: a span stands if it covers enough of the template and every pair
that tells this template from its neighbours (templates of other labels that share
half of its pairs); of standing spans that overlap, only the best one counts. A phrase
is a short template that must be covered wholly on one diagonal; it always counts.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gradewise.llm import common
from gradewise.llm.words import ascii_words, folded, gram_hashes, word_hashes

K = 2
SLACK = 2            # diagonals this near are one span
MIN_COVER = 0.6
PIECE_WORDS = 60     # longer templates are cut: a mask has 63 places
_COUNT = -0x6B1D5A3C2F4E7081  # "hash" of the row that carries a text's word count

# Phrases of the contract and passages of public licence texts.
PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the "
                   "License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def template_places(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(h, template, place, label, base, grams): one row per run of K words of
    each template. Its size is that of the template list, not of any table."""
    rows, number = [], 0
    for base, group in ((True, phrases), (False, templates)):
        for label, text in group:
            words = ascii_words(text)
            for at in range(0, len(words), PIECE_WORDS):
                h = _pairs_of(words[at:at + PIECE_WORDS])
                must = 0 if base else telling_places(label, h, templates)
                rows += [(v, number, i, label, base, len(h), must) for i, v in enumerate(h)]
                number += 1
    rows.append((_COUNT, -1, 0, None, False, 0, 0))
    return spark.createDataFrame(rows, "h long, template int, place int, label string, base boolean, grams int, must long")


def _pairs_of(words: list[bytes]) -> list[int]:
    return gram_hashes(word_hashes(b" ".join(words)), K).view(np.int64).tolist()


def telling_places(label: str, pairs: list[int], templates=TEMPLATES) -> int:
    """Mask of the places whose word pair a neighbour lacks: a template of another
    label that has at least half of these pairs."""
    must = 0
    for other, text in templates:
        has = set(_pairs_of(ascii_words(text)))
        if other != label and 2 * sum(p in has for p in pairs) >= len(pairs):
            must |= sum(1 << i for i, p in enumerate(pairs) if p not in has)
    return must


def _grams(batches):
    """All runs of K words of each row: (row, word number, hash), and one row
    that carries the id and the number of words. ``row`` is unique: the task
    and the row's number in it, and all rows of one text come from one task."""
    import pyarrow as pa
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        ids, texts = batch.columns
        for first in range(0, batch.num_rows, 128):
            rows, places, hashes, doc = [], [], [], []
            for doc_id, text in zip(ids.slice(first, 128).to_pylist(), texts.slice(first, 128).to_pylist()):
                words = word_hashes(folded(text))
                h = gram_hashes(words, K).view(np.int64)
                rows.append(np.full(len(h) + 1, row, np.int64))
                places.append(np.append(np.arange(len(h)), len(words)).astype(np.int32))
                hashes.append(np.append(h, _COUNT))
                doc.append(doc_id)
                row += 1
            ends = np.cumsum([len(r) for r in rows]) - 1
            values = np.zeros(ends[-1] + 1, np.int64)
            values[ends] = [0 if d is None else d for d in doc]
            missing = np.ones(len(values), bool)
            missing[ends] = [d is None for d in doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(rows)), pa.array(np.concatenate(places)), pa.array(np.concatenate(hashes)),
                 pa.array(values, mask=missing)], ["row", "pos", "h", "doc_id"])


def votes(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per (text, template, diagonal): mask of the template places hit;
    and one per text (template -1) with its id and number of words."""
    places = template_places(docs.sparkSession, phrases, templates)  # a fixed list: broadcast
    grams = docs.select("doc_id", "text").mapInArrow(_grams, "row long, pos int, h long, doc_id long")
    return (grams.join(F.broadcast(places), "h").withColumn("diagonal", F.col("pos") - F.col("place"))
            .repartition("row").groupBy("row", "template", "diagonal")
            .agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"), F.max("doc_id").alias("doc_id"),
                 F.first("label").alias("label"), F.first("base").alias("base"), F.first("grams").alias("grams"),
                 F.first("must").alias("must")))


def spans(found: DataFrame, slack: int = SLACK, min_cover: float = MIN_COVER) -> DataFrame:
    """``votes`` with ``place`` (a phrase stands here), ``cover`` (share of the
    template on this diagonal and its neighbours; null on a text's own row)
    and ``stands`` (the merged span is a verified copy of the template, and no better
    one of another label overlaps it)."""
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-slack, slack)
    d = found.withColumn("merged", F.bit_or("mask").over(near))
    d = (d.withColumn("cover", F.when(F.col("template") >= 0, F.bit_count("merged") / F.col("grams")))
         .withColumn("place", F.col("base") & (F.bit_count("mask") == F.col("grams")))
         .withColumn("verified", ~F.col("base") & (F.col("cover") >= min_cover)
                     & (F.col("merged").bitwiseAND(F.col("must")) == F.col("must"))))
    # spans that overlap start within the length of a piece, so a frame holds a bounded number of them
    reach = PIECE_WORDS + slack
    around = Window.partitionBy("row").orderBy("diagonal").rangeBetween(-reach, reach)
    own = F.struct("cover", "grams", "label")
    rivals = F.collect_set(F.when(F.col("verified"), F.struct(own.alias("rank"), "diagonal"))).over(around)
    beaten = F.exists("rivals", lambda r: (
        (r["rank"]["label"] != F.col("label")) & (r["rank"] > own)
        & (r["diagonal"] <= F.col("diagonal") + F.col("grams")) & (F.col("diagonal") <= r["diagonal"] + r["rank"]["grams"])))
    return (d.withColumn("rivals", rivals).withColumn("stands", F.col("verified") & ~beaten)
            .drop("merged", "verified", "rivals", "must"))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per input row: number of words, places of the phrases, labels
    and score (1 with a phrase, else the best cover of a copied passage, 0
    without one).

    Null and empty texts have no words; repeated rows give repeated results;
    null ids stay null; other columns are ignored; an empty table gives an
    empty result."""
    s = spans(votes(docs, phrases, templates))
    start = F.when(F.col("place"), F.col("diagonal").cast("long"))

    def joined(c):
        return F.array_join(F.array_sort(F.collect_set(c)), ",")
    return s.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(F.col("template") == -1, F.col("diagonal"))).cast("long").alias("n_words"),
        F.count_if("place").alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        joined(F.when(F.col("place"), F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("place") | F.col("stands"), F.col("label"))).alias("labels"),
        F.max(F.when(F.col("place"), 1.0).when(F.col("stands"), F.col("cover")).otherwise(0.0)).alias("score"),
    ).drop("row")


def op8_diagonal_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
