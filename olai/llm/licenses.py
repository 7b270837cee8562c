"""Licence scan: TF-IDF cosine of headers and licence files to templates, and inheritance along paths (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from olai.llm.common import ascii_lower, materialise

#: A line that may be part of a licence notice.
NOTICE = r"(?i)licen[sc]e|copyright|all rights reserved|public domain|permission is hereby|redistribution and use|without warranty"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Notices in the usual wording, some for each licence.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License Apache License Version 2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software redistribute it under the terms of the GNU General Public License version 3"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "Proprietary": ("Copyright. All rights reserved.",),
}


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def match_passages(passages: DataFrame, templates: Mapping[str, Sequence[str]], weights_from: DataFrame | None = None) -> DataFrame:
    """The nearest template of each distinct ``passage``, an array of terms, with its cosine: ``passage, licence, cosine``.

    Weights are ``tf * (ln((1 + N) / (1 + df)) + 1)`` with the counts of
    ``weights_from`` (rows ``passage, copies``; by default of ``passages``),
    copies included. Ties go to the first name.
    """
    counted = weights_from if weights_from is not None else passages
    total = counted.agg(F.sum("copies").alias("N"))
    df = counted.select("copies", F.explode(F.array_distinct("passage")).alias("term")).groupBy("term").agg(F.sum("copies").alias("df"))
    idf = F.log((1 + F.col("N")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    spark = passages.sparkSession
    fixed = spark.createDataFrame([(name, k, text) for name, texts in templates.items() for k, text in enumerate(texts)], "licence string, k int, text string")
    vocabulary = fixed.select("licence", "k", F.explode(_terms(F.col("text"))).alias("term")).groupBy("licence", "k", "term").agg(F.count(F.lit(1)).alias("tf"))
    # N is one row.
    known = vocabulary.join(df, "term", "left").join(F.broadcast(total)).select("licence", "k", "term", (F.col("tf") * idf).alias("tw"))
    length = known.groupBy("licence", "k").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    known = known.join(length, ["licence", "k"])

    own = passages.select(F.array_join("passage", " ").alias("key"), F.explode("passage").alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    own = own.join(df, "term", "left").join(F.broadcast(total)).select("key", "term", (F.col("tf") * idf).alias("w"))
    norm = own.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    # The templates are a fixed few rows.
    dots = own.join(F.broadcast(known), "term").groupBy("key", "licence", "k").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.first("tn").alias("tn"))
    best = dots.join(norm, "key").groupBy("key", "licence").agg(F.round(F.max(F.col("dot") / (F.col("n") * F.col("tn"))), 6).alias("cosine"))
    first = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("licence")))
    return best.groupBy("key").agg(first.alias("b")).select("key", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", licence_file: str = r"(?i)(^|/)(LICEN[SC]E|COPYING|NOTICE)[^/]*$", templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = 0.6) -> DataFrame:
    """Licence of every file, from its own notices or from the nearest directory above.

    Passages are the lines of a whole text that look like a notice, and the
    whole of a file whose path matches ``licence_file``. A file's own licence
    is that of its passage of highest cosine, if at least ``threshold``. A
    licence file also stands for its directory (ties: the higher cosine, then
    the first name); a file without a licence of its own takes that of the
    nearest ancestor directory that has one, the root ``''`` last. Term
    counts are those of all passages of the corpus; equal passages are
    aggregated before they meet templates, and directories before they meet
    their ancestors, so neither a common notice nor a large directory makes
    more work.

    Returns one row per input row: ``doc_id, path, licence, cosine, inherited,
    inherited_from, effective``. Null texts have no passages; a null path is in
    the root and is no licence file; repeated rows have the same result; an
    empty table gives an empty result; other columns are ignored.
    """
    text, path = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("path"), F.lit(""))
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    is_file = F.rlike(path, F.lit(licence_file))
    notice = F.when(F.rlike(text, F.lit(NOTICE)), F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(NOTICE)))).otherwise(F.array().cast("array<string>"))
    passages = F.when(is_file, F.concat(notice, F.array(text))).otherwise(notice)
    terms = F.filter(F.transform(passages, _terms), lambda x: F.size(x) > 0)
    slash = F.length(path) - F.locate("/", F.reverse(path))
    folder = F.when(F.contains(path, F.lit("/")), F.substring(path, F.lit(1), slash)).otherwise("")
    known = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", is_file.alias("is_file"), folder.alias("folder"), F.array_distinct(terms).alias("passages"))
    known = materialise(known, "licence-passages")

    each = known.select("row", F.explode("passages").alias("passage"))
    distinct = materialise(each.groupBy("passage").agg(F.count(F.lit(1)).alias("copies")), "distinct-passages")
    matched = match_passages(distinct, templates).where(F.col("cosine") >= threshold)
    own = each.select("row", F.array_join("passage", " ").alias("key")).join(matched, "key")
    own = own.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("licence"))).alias("b")).select("row", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))
    # By a shuffle at every size: files with a notice grow with the corpus.
    judged = materialise(known.drop("passages").join(own.hint("merge"), "row", "left"), "licence-files")

    held = judged.where("is_file AND licence IS NOT NULL").groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("licence"))).alias("b")).select(F.col("folder").alias("above"), F.col("b.licence").alias("inherited"))
    folders = judged.select("folder").distinct()
    parts = F.split("folder", "/")
    above = F.concat(F.array(F.lit("")), F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    chain = folders.select("folder", F.posexplode(above).alias("depth", "above")).join(held, "above")
    nearest = chain.groupBy("folder").agg(F.max(F.struct("depth", "inherited", "above")).alias("b")).select("folder", "b.inherited", F.col("b.above").alias("inherited_from"))
    out = judged.join(nearest.hint("merge"), "folder", "left")
    return out.select("doc_id", "path", "licence", "cosine", *[F.when(F.col("licence").isNull(), F.col(c)).alias(c) for c in ("inherited", "inherited_from")], F.coalesce("licence", "inherited").alias("effective"))
