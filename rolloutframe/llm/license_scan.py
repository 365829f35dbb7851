"""License scans by diagonal voting.

Every rolling k-word hash of a text joins the positions of the same hash in the license templates, and a match counts
only where the k words themselves are the template's. A match votes for a diagonal (text position less template
position). Votes are counted for each text, template and diagonal; diagonals of one template that lie at most ``slack``
words apart, in neighbouring places, merge into one candidate span; a span of more words than a place may have is cut
into stretches that do not exceed it; and the span is verified: the distinct template k-grams whose words stand in it
must cover at least ``share`` of the template. A phrase is a template whose k-grams must all vote on one diagonal, which
is an exact occurrence.

The template side of the join is broadcast up to MOST_TEMPLATE_GRAMS rows, so the k-grams of the texts never shuffle,
only votes do; a larger one is joined by a shuffle.

Edge cases: null and empty texts have 0 words and no label; texts with fewer than k words have no k-gram; repeated rows
of one id and text count apart, as every row gets a key of its own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import bounded_batches
from ._text import GOLDEN, LOWER, U64, mix64, range_hashes, slices, spans

# words are runs of digits, ASCII letters and everything beyond ASCII
NOT_WORD = np.ones(256, bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    NOT_WORD[list(_r)] = False
K = 3
MOST_TEMPLATE_GRAMS = 20_000

# Phrases with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Opening sentences of public license texts, as templates for near matches.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "cc-by": "this work is licensed under the creative commons attribution license",
    "cc-by-sa": "this work is licensed under the creative commons attribution sharealike license",
    "cc-by-nc": "this work is licensed under the creative commons attribution noncommercial license",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "all-rights-reserved": "all rights reserved",
}


def kgrams(data: np.ndarray, offsets: np.ndarray):
    """(text, first word, hash, first byte, end of each K-gram; words of each text) of a slice, A-Z lower-cased."""
    starts, ends, doc = spans(data, offsets, NOT_WORD)
    words = range_hashes(LOWER[data], starts, ends)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    n = max(0, len(words) - K + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(n, U64)
        for j in range(K):
            h = mix64(h * U64(31) + words[j : j + n] + GOLDEN)
    same = doc[:n] == doc[K - 1 :] if n else np.zeros(0, bool)
    pos = np.arange(n) - (np.cumsum(count) - count)[doc[:n]]
    return doc[:n][same], pos[same], h[same], starts[:n][same], ends[K - 1 :][same], count


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The words of byte ranges, A-Z lower-cased, with one blank in between."""
    low = np.where(NOT_WORD[data], np.uint8(32), LOWER[data]).tobytes()
    return [" ".join(x for x in low[a:b].decode().split(" ") if x) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, share: float = 0.7, slack: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, id, n_words, label, exact, first, last (words from 0), score: one row for each text, without a label, and
    one for each place. A place with ``exact`` is an occurrence of a phrase, the others verified near matches of templates.
    """
    spark = docs.sparkSession
    rows, size = [], {}
    for kind, table in (("phrase", phrases), ("template", templates)):
        for n, (a, b) in enumerate(table.items()):
            text, label = (a, b) if kind == "phrase" else (b, a)
            words = text.split()
            if len(words) < K:
                raise ValueError(f"{text!r} has fewer than {K} words")
            size[kind, n] = len(words) - K + 1
            raw = np.frombuffer(text.encode(), np.uint8)
            _, pos, h, first, last, _ = kgrams(raw, np.array([0, len(raw)]))
            rows += [(kind == "phrase", n, label, i, len(words) - K + 1, x, g) for i, x, g in zip(pos.tolist(), h.view(np.int64).tolist(), spelled(raw, first, last), strict=True)]
    t = spark.createDataFrame(rows, "exact boolean, template int, label string, at int, grams int, h long, gram string")
    known = np.unique(np.array([r[5] for r in rows], np.int64))
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def grams(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2)):
                doc, pos, h, first, last, count = kgrams(data, offsets)
                signed = h.view(np.int64)
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, signed), len(known) - 1)] == signed)
                words = np.full(len(doc), len(hit), np.int64)
                words[hit] = np.arange(len(hit))
                words = pa.array([*spelled(data, first[hit], last[hit]), None], pa.string()).take(pa.array(words))
                # the row at -1 stands for the text itself, so that one pass serves texts with and without hits
                own = pa.concat_arrays([pa.array(np.arange(hi - lo)), pa.array(doc)])
                part = batch.slice(lo, hi - lo)
                n = pa.concat_arrays([pa.array(count), pa.nulls(len(doc), pa.int64())])
                at = np.concatenate([np.full(hi - lo, -1, np.int32), pos.astype(np.int32)])
                hashes = pa.concat_arrays([pa.nulls(hi - lo, pa.int64()), pa.array(signed)])
                words = pa.concat_arrays([pa.nulls(hi - lo, pa.string()), words])
                ids = pa.concat_arrays([part.column(1), pa.nulls(len(doc), part.column(1).type)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), ids, n, pa.array(at), hashes, words], names=["_row", "_id", "n_words", "pos", "h", "gram"])

    d = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    every = d.mapInArrow(grams, f"_row long, _id {kind}, n_words long, pos int, h long, gram string")
    hits = every.join(F.broadcast(t) if len(rows) <= MOST_TEMPLATE_GRAMS else t, ["h", "gram"], "left").where("pos < 0 or at is not null")
    votes = hits.groupBy("_row", "exact", "template", "label", "grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("_id", True).alias("_id"), F.max("n_words").alias("n_words"))
    # neighbouring diagonals of one template merge; a phrase's stay apart. All kinds of rows go through one plan, so the
    # texts are read once.
    order = Window.partitionBy("_row", "exact", "template").orderBy("diagonal")
    gap = F.coalesce((F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > slack)).cast("int"), F.lit(0))
    bands = votes.withColumn("gap", gap).withColumn("band", F.sum("gap").over(order))
    # a band of more words than a place may span is taken apart into its hits; every stretch of that many words is
    # verified, and of the stretches that begin in one such length of the band the best is a place
    most = 2 * (F.col("grams") + slack)
    whole_band = Window.partitionBy("_row", "exact", "template", "band")
    begin = F.min("first").over(whole_band)
    bands = bands.withColumn("begin", begin).withColumn("long", F.coalesce(~F.col("exact") & (F.max("last").over(whole_band) - begin > most), F.lit(False)))
    one = F.array(F.struct(F.col("first").alias("pos"), F.lit(None).cast("int").alias("at")))
    each = F.transform("ats", lambda x: F.struct((F.col("diagonal") + x).cast("int").alias("pos"), x.alias("at")))
    hit = bands.withColumn("hit", F.explode(F.when(F.col("long"), each).otherwise(one))).select("*", "hit.pos", "hit.at")
    # the frame is ``most`` words, which differs between templates, so positions count in units of it
    ahead = whole_band.orderBy(F.col("pos") / (most + 0.5)).rangeBetween(0, 1)
    hit = hit.withColumn("near", F.collect_set("at").over(ahead)).withColumn("upto", F.max("pos").over(ahead))
    hit = hit.withColumn("cell", F.when(F.col("long"), F.floor((F.col("pos") - F.col("begin")) / (most + 1))))
    best = F.max(F.struct(F.size("near").alias("n"), (-F.col("pos")).alias("back"), "near", "upto")).alias("best")
    short = F.when(~F.col("long"), F.col("ats"))
    places = hit.groupBy("_row", "exact", "template", "label", "grams", "band", "cell").agg(F.array_distinct(F.flatten(F.collect_list(short))).alias("ats"), F.min("first").alias("first"), F.max("last").alias("last"), best, F.first("_id", True).alias("_id"), F.max("n_words").alias("n_words"))
    cut = lambda name, c: F.when(F.col("cell").isNotNull(), c).otherwise(F.col(name)).alias(name)
    places = places.select("_row", "_id", "exact", "template", "label", "grams", "n_words", cut("ats", F.col("best.near")), cut("first", -F.col("best.back")), cut("last", F.col("best.upto")))
    places = places.withColumn("score", F.when(F.col("template").isNotNull(), F.size("ats") / F.col("grams")))
    whole = F.col("exact") & (F.col("score") == 1)
    near = ~F.col("exact") & (F.col("score") >= share) & (F.col("last") - F.col("first") <= most)
    places = places.where(F.col("template").isNull() | whole | near)
    word = lambda c: F.when(F.col("template").isNotNull(), c.cast("long"))
    return places.select("_row", F.col("_id").alias(id_col), "n_words", "label", "exact", word(F.col("first")).alias("first"), word(F.col("last") + K - 1).alias("last"), "score")


def license_labels(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``."""
    places = license_scan(docs, id_col=id_col, **options).withColumnRenamed(id_col, "_id")
    labels = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    own = F.when(F.col("exact"), F.col("label"))
    begin = F.when(F.col("exact"), F.col("first"))
    found = places.groupBy("_row").agg(F.first("_id", True).alias(id_col), F.max("n_words").alias("n_words"), F.count(own).alias("n_base"), F.min(begin).alias("first_word"), F.max(begin).alias("last_word"), labels(own).alias("base_labels"), labels("label").alias("labels"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    return found.drop("_row")
