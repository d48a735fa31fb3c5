"""Licence scan: sparse TF-IDF cosine of lines and whole files to templates, then inheritance by directory.

Everything is a DataFrame operation.  A line, and a file as a whole, is compared
with every template; a line at or above the threshold is a header and licenses its
file, a file is a licence file if its name says so or if nearly all of it is
licence text, and a file without its own licence takes that of the nearest
directory above it that holds a licence file.

Only text with a signature word of some template can reach the threshold: the
words outside a template's signature carry too little of its length (by the
Cauchy-Schwarz inequality), so that other lines are dropped unseen without losing
a match.

Nulls and odd rows: a null text holds no licence; a row without path gets none and
inherits none; an empty path component is kept as it is; rows that repeat a path
each get that path's result; equal scores go to the smaller licence id, and
directories with several licence files to the best score, then the smaller path;
other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.session import stored

# Licence identifiers and the sentences by which works declare them.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Words that carry no weight.
STOP_WORDS = (
    "a all an and any are as at be by can do for from has have in into is it no not of on or that the this to under was were what when which will with"
).split()

TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_NAME = "^(licen[cs]e|copying|notice)([.-].*)?$"
THRESHOLD = 0.7
FILE_THRESHOLD = 0.3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def weights(templates=None):
    """(template rows (number, licence, term, weight / length), idf of known terms, idf of others)."""
    templates = TEMPLATES if templates is None else templates
    lower = str.maketrans(_UPPER, _LOWER)
    counts = [Counter(t for t in re.findall(TERM, text.translate(lower)) if t not in STOP_WORDS) for _, text in templates]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for number, ((licence, _), c) in enumerate(zip(templates, counts, strict=True)):
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(number, licence, t, n * idf[t] / length) for t, n in sorted(c.items())]
    return rows, idf, math.log(1 + len(templates)) + 1


def signature(rows, threshold: float) -> list[str]:
    """Terms of which any text at the threshold has one at least."""
    by_template: dict[int, list] = {}
    for number, _, term, weight in rows:
        by_template.setdefault(number, []).append((weight, term))
    chosen = set()
    for terms_of in by_template.values():
        rest = 1.0
        for weight, term in sorted(terms_of, key=lambda x: (-x[0], x[1])):
            if rest <= (threshold - 1e-6) ** 2:
                break
            chosen.add(term)
            rest -= weight * weight
    return sorted(chosen)


def matches(segments: DataFrame, keys: list[str], least: float, templates=None) -> DataFrame:
    """keys, licence and score of the best template of every segment (column ``terms``) that shares a term with one.

    Segments that cannot score ``least`` are left out before their terms are counted: their length is that of
    the known terms and of as many different others, at the least.
    """
    rows, idf, other = weights(templates)
    licences = sorted({(number, licence) for number, licence, _, _ in rows})
    shares = {(number, term): share for number, _, term, share in rows}
    order = sorted(idf)
    place = F.create_map(*[F.lit(x) for i, t in enumerate(order) for x in (t, i + 1)])
    weight = F.array(*[F.lit(idf[t]) for t in order])
    columns = [F.array(*[F.lit(idf[t] * shares.get((number, t), 0.0)) for t in order]) for number, _ in licences]

    # every step binds its value in a list of one or none, so that nothing is computed twice
    def vector(known: Column) -> Column:
        tf = F.transform(F.array_distinct(known), lambda t: F.struct(place[t].alias("at"), F.size(F.filter(known, lambda x: x == t)).alias("n")))
        return F.struct(tf.alias("tf"), (F.size("terms") - F.size(known)).alias("others"))

    def products(v: Column) -> Column:
        total = lambda value: F.aggregate(v["tf"], F.lit(0.0), lambda acc, x: acc + value(x))
        square = total(lambda x: F.pow(x["n"] * F.element_at(weight, x["at"]), F.lit(2.0)))
        dots = F.array(*[total(lambda x, c=c: x["n"] * F.element_at(c, x["at"])) for c in columns])
        return F.struct(square.alias("square"), dots.alias("dots"), v["others"].alias("others"))

    # each repeat of a term raises its square by twice the number before it, and one
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("sum"))

    def grown(acc: Column, term: Column) -> Column:
        n = F.when(acc["last"] == term, acc["n"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(term.alias("last"), n.alias("n"), (acc["sum"] + 2 * n - 1).alias("sum"))

    def measured(v: Column) -> Column:
        rest = F.sort_array(F.filter("terms", lambda t: ~t.isin(order)))
        squares = F.aggregate(rest, start, grown, lambda acc: acc["sum"])
        return F.struct(F.sqrt(v["square"] + other * other * squares).alias("length"), v["dots"].alias("dots"))

    named = F.array(*[F.lit(licence) for _, licence in licences])

    def best(v: Column) -> Column:
        score = lambda dot, licence: F.struct((-F.round(dot / v["length"], 9)).alias("lost"), licence.alias("licence"), dot.alias("dot"))
        return F.array_min(F.filter(F.zip_with(v["dots"], named, score), lambda x: x["dot"] > 0))

    able = lambda v: F.array_max(v["dots"]) >= (least - 1e-6) * F.sqrt(v["square"] + other * other * v["others"])
    known = F.filter(F.array(F.filter("terms", lambda t: t.isin(order))), lambda k: F.size(k) > 0)
    vectors = F.filter(F.transform(F.transform(known, vector), products), able)
    found = segments.select(*keys, F.inline(F.transform(F.transform(vectors, measured), best)))
    return found.select(*keys, "licence", (-F.col("lost")).alias("score"))


def scan(files: DataFrame, templates=None, threshold: float = THRESHOLD, file_threshold: float = FILE_THRESHOLD) -> DataFrame:
    """path, licence, how it was found (header, file, inherited or null) and the directory it came from."""
    files = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    rows, _, _ = weights(templates)
    words = signature(rows, min(threshold, file_threshold))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    # no term reaches over a line's end, so the terms of the lines are those of the file
    signed = lambda x: F.exists(x["terms"], lambda t: t.isin(words))
    numbered = lambda t, i: F.struct(i.alias("line"), t.alias("terms"))
    split = F.transform(F.array(F.transform(F.split("text", "\n"), terms)), lambda t: F.struct(t.alias("all"), F.filter(F.transform(t, numbered), signed).alias("some")))
    likely = F.filter(split, lambda x: (F.size(x["some"]) > 0) | name.rlike(LICENCE_NAME))
    whole = lambda x: F.array(F.struct(F.lit(-1).alias("line"), F.flatten(x["all"]).alias("terms")))
    some = files.where("path IS NOT NULL AND text IS NOT NULL")
    pieces = some.select("path", F.inline(F.flatten(F.transform(likely, lambda x: F.concat(whole(x), x["some"])))))
    found = matches(pieces, ["path", "line"], min(threshold, file_threshold / 2), templates)
    declares = F.col("line").eqNullSafe(-1) & (
        (F.col("score") >= file_threshold) | (name.rlike(LICENCE_NAME) & (F.col("score") >= file_threshold / 2))
    )
    good = found.where(((F.col("line") >= 0) & (F.col("score") >= threshold)) | declares)
    good = stored(good.withColumn("how", F.when(F.col("line") >= 0, "header").otherwise("file")), "licences")
    rank = F.struct(-F.col("score"), "licence")
    own = good.groupBy("path").agg(F.min_by(F.struct("licence", "how"), F.struct(F.when(F.col("how") == "header", 0).otherwise(1), rank)).alias("own"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    folders = (
        good.where("how = 'file'")
        .groupBy(folder.alias("folder"))
        .agg(F.min_by("licence", F.struct(-F.col("score"), "path")).alias("folder_licence"))
    )
    names = files.select("path").groupBy("path").agg(F.count(F.lit(1)).alias("times"))
    lacking = names.join(own, "path", "left_anti").where("path IS NOT NULL")
    parts = F.split("path", "/")
    above = F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth")
    steps = lacking.select("path", parts.alias("parts"), above).select("path", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("folder"))
    inherited = steps.join(folders, "folder").groupBy("path").agg(F.max_by(F.struct("folder_licence", "folder"), "depth").alias("up"))
    out = names.join(own, "path", "left").join(inherited, "path", "left")
    return out.select(
        "path",
        F.coalesce("own.licence", "up.folder_licence").alias("licence"),
        F.coalesce("own.how", F.when(F.col("up").isNotNull(), "inherited")).alias("how"),
        F.coalesce(F.when(F.col("own").isNotNull(), folder), F.col("up.folder")).alias("folder"),
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"),
    )
