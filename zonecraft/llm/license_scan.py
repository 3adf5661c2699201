"""Licence scan with a positional index of rare licence words, on array functions alone.

Templates are short word sequences: names of licences and passages of notices and licence texts.
The index has, for every template, its words of highest inverse document frequency among the
templates, with their places.  A file looks up those of its words that the index has; a posting
at place p of a template and place i of the file says that the template would start at i - p, and
postings that agree on the start are intersected.  A template is found where enough of its weight
agrees and every mandatory key phrase of its licence stands word by word in the file."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecraft.llm.rows import column, free_name, unpacked, whole

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of texts with A-Z lower-cased
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before that

# The phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Passages of notices and licence texts: (label, passage, mandatory key phrases).
NOTICES = [
    ("gpl-3.0", "gnu general public license version 3", ["version 3"]),
    ("gpl-2.0", "gnu general public license version 2", ["version 2"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public"]),
    ("agpl", "gnu affero general public license", ["affero general public"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software", "redistribute it"]),
    ("apache-2.0", "apache license version 2 0", ["apache license version 2 0"]),
    ("apache-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["except in compliance with the license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products"]),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee"]),
    ("mpl-2.0", "mozilla public license version 2 0", ["mozilla public license"]),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license", ["subject to the terms of the mozilla public license"]),
    ("epl", "eclipse public license", ["eclipse public license"]),
    ("boost-1.0", "boost software license version 1 0", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0-1.0", "creative commons cc0 1 0 universal", ["cc0 1 0"]),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", ["attribution 4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]
RARE_WORDS, LEAST_SHARE = 6, 0.8


def words_of(passage: str) -> list[str]:
    return re.findall(WORD, passage)


class Index:
    """Templates, and the postings (template, place, weight) of every rare word.

    Weights are inverse document frequencies in thousandths, so sums are exact.  A phrase or mandatory
    key phrase is a template of its own that must be found whole, anchored at its rarest word."""

    def __init__(self, phrases=None, notices=None, rare: int = RARE_WORDS):
        phrases, notices = BASE if phrases is None else phrases, NOTICES if notices is None else notices
        self.notices = notices
        bodies = [words_of(p) for p in phrases] + [words_of(p) for _, p, _ in notices]
        frequency = {}
        for body in bodies:
            for w in set(body):
                frequency[w] = frequency.get(w, 0) + 1
        self.weight = {w: round(1000 * math.log(1 + len(bodies) / n)) for w, n in frequency.items()}
        rank = lambda w: (-self.weight.get(w, 0), w)
        self.whole: list[list[str]] = []  # templates found word by word
        self.labels = list(phrases.values())
        self.base = len(phrases)
        self.postings: list[tuple[str, int, int, int]] = []
        keys = [words_of(k) for _, _, ks in notices for k in ks]
        for body in [words_of(p) for p in phrases] + keys:
            if body not in self.whole or len(self.whole) < self.base:
                anchor = min(body, key=rank)
                self.postings.append((anchor, len(self.whole), body.index(anchor), 0))
                self.whole.append(body)
        self.full = []
        for i, (_, passage, _) in enumerate(notices):
            body = words_of(passage)
            chosen = set(sorted(set(body), key=rank)[:rare])
            places = [j for j, w in enumerate(body) if w in chosen]
            self.full.append(sum(self.weight[body[j]] for j in places))
            self.postings += [(body[j], len(self.whole) + i, j, self.weight[body[j]]) for j in places]
        self.rare_words = sorted({w for w, *_ in self.postings})

    def key_ids(self, notice: int) -> list[int]:
        return [self.whole.index(words_of(k)) for k in self.notices[notice][2]]

    def column(self) -> Column:
        """The index as a constant: word -> postings."""
        entries = []
        for w in self.rare_words:
            own = [F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(v).alias("v")) for x, t, p, v in self.postings if x == w]
            entries += [F.lit(w), F.array(*own)]
        return F.create_map(*entries)


def scanned(docs: DataFrame, text_col: str = "text", index: Index | None = None, least: float = LEAST_SHARE) -> DataFrame:
    """`docs` with its columns and the struct `__scan`: n_words, places (of base phrases: label, start, n_words),
    passages (of notices: label, start, share) and score, the largest share (1 for a base phrase); if `docs`
    has that column, the name gets underscores behind it.

    A row is worked on its own, so nothing is shuffled, and nulls, repeated rows and any other columns
    do not matter; texts without a rare word, empty and null texts have no places and score 0.  Starts
    count words from 0.  A notice is found where its rare words that agree on a start have at least
    `least` of its weight and all its key phrases stand in the text; overlapping and repeated places
    are all returned, in the order of their starts."""
    index = index or Index()
    text = F.coalesce(F.col("__text").cast("string"), F.lit(""))
    anchors = r"(?i)(?<![0-9a-zA-Z\x{80}-\x{10FFFF}])(?:" + "|".join(index.rare_words) + r")(?![0-9a-zA-Z\x{80}-\x{10FFFF}])"
    none = F.array().cast("array<string>")
    x = docs.select(whole(docs, text_col).alias("__row"), column(text_col).alias("__text")).withColumn("__n", F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long"))
    # only texts with a rare word are split, as only they can hold a template
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    x = x.withColumn("__words", F.when(text.rlike(anchors), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))).otherwise(none))
    hits = F.filter(F.transform(F.col("__words"), lambda w, i: F.when(w.isin(*index.rare_words), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    x = x.withColumn("__hits", hits)
    table = index.column()
    agree = F.flatten(F.transform(F.col("__hits"), lambda h: F.transform(F.element_at(table, h.w), lambda p: F.struct(p.t.alias("t"), (h.i - p.p).alias("at"), p.v.alias("v")))))
    x = x.withColumn("__agree", F.when(F.size("__hits") > 0, agree))
    bodies = F.array(*[F.array(*map(F.lit, body)) for body in index.whole])
    sizes = F.array(*[F.lit(len(body)) for body in index.whole])
    verified = F.filter(F.col("__agree"), lambda a: (a.t < len(index.whole)) & (a["at"] >= 0)
                        & (F.slice(F.col("__words"), F.greatest(a["at"], F.lit(0)) + 1, F.coalesce(F.get(sizes, a.t), F.lit(0))) == F.get(bodies, a.t)))
    x = x.withColumn("__whole", F.coalesce(verified, F.array().cast("array<struct<t:int,at:int,v:int>>")))
    x = x.withColumn("__keys", F.array_distinct(F.transform("__whole", lambda a: a.t)))
    # starts of a notice with their agreeing weight: one walk over the sorted postings
    first = len(index.whole)
    votes = F.array_sort(F.transform(F.filter(F.col("__agree"), lambda a: a.t >= first), lambda a: F.struct(a.t.alias("t"), a["at"].alias("at"), a.v.alias("v"))))
    x = x.withColumn("__votes", F.coalesce(votes, F.array().cast("array<struct<t:int,at:int,v:int>>")))
    full = F.array(*map(F.lit, index.full))
    key_ids = F.array(*[F.array(*map(F.lit, index.key_ids(i))) for i in range(len(index.notices))])
    runs = F.transform(F.col("__votes"), lambda a, i: F.when(
        F.coalesce((F.get(F.col("__votes"), i - 1).t != a.t) | (F.get(F.col("__votes"), i - 1)["at"] != a["at"]), F.lit(True)), F.struct(a.t.alias("t"), a["at"].alias("at"), i.alias("from"))))
    x = x.withColumn("__runs", F.filter(runs, lambda r: r.isNotNull()))
    upto = lambda i: F.coalesce(F.get(F.col("__runs"), i + 1)["from"], F.size("__votes"))
    weighed = F.transform(F.col("__runs"), lambda r, i: F.struct(
        r.t.alias("t"), r["at"].alias("at"), F.aggregate(F.slice(F.col("__votes"), r["from"] + 1, upto(i) - r["from"]), F.lit(0), lambda s, a: s + a.v).alias("v")))
    labels = F.array(*[F.lit(label) for label, _, _ in index.notices])
    found = F.filter(weighed, lambda r: (r.v >= least * F.get(full, r.t - first)) & (F.size(F.array_except(F.get(key_ids, r.t - first), F.col("__keys"))) == 0))
    passages = F.transform(found, lambda r: F.struct(F.get(labels, r.t - first).alias("label"), r["at"].cast("long").alias("start"), (r.v / F.get(full, r.t - first)).alias("share")))
    x = x.withColumn("__passages", F.array_sort(F.coalesce(passages, F.array().cast("array<struct<label:string,start:bigint,share:double>>")), lambda a, b: F.coalesce(
        F.nullif(F.signum(a.start - b.start).cast("int"), F.lit(0)), F.when(a.label < b.label, -1).when(a.label > b.label, 1).otherwise(0))))
    base_labels = F.array(*map(F.lit, index.labels))
    places = F.transform(F.filter("__whole", lambda a: a.t < index.base), lambda a: F.struct(a["at"].cast("long").alias("start"), F.get(base_labels, a.t).alias("label"), F.get(sizes, a.t).alias("n_words")))
    x = x.withColumn("__places", F.array_sort(places))
    score = F.greatest(F.when(F.size("__places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("__passages", lambda p: p.share)), F.lit(0.0)))
    scan = F.struct(F.col("__n").alias("n_words"), F.col("__places").alias("places"), F.col("__passages").alias("passages"), score.alias("score"))
    return x.select(*unpacked(docs, "__row", **{text_col: F.col("__text")}), scan.alias(free_name("__scan", docs.columns)))
