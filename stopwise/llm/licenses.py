"""License scans: TF-IDF cosine to license notices, then inheritance from the nearest directory that
has a license file; DataFrame functions only.

Units are compared with notices and full license texts: every line of a text that holds a marker word
and every paragraph with one (headers, also hard-wrapped ones), and the whole text of a document with
such a line, with full texts only (a license file). An SPDX identifier names its license by itself. Vectors are sparse:
a unit's terms meet the terms of the notices in a join whose right side is bounded by the notices
themselves. Term weights are term frequency times log(documents / documents with the term),
counted over all documents; a term of a unit that no notice has counts with the greatest weight, so
foreign text lowers the cosine.

A document's own license is that of its best header. Files whose whole text reaches
``FILE_SIMILARITY``, or that are named like a license file and hold a header, license their
directory. Every directory takes the license of its nearest ancestor (itself first) by a join of
the ancestors' paths with the licensed directories; documents without a license of their own
take that of their directory. Paths are joined once per distinct directory.

Defined cases: null and empty texts have no header; a null path is the root directory; equal
similarities fall to the first license by name, and directories with several license files to the
most similar, then the smallest doc_id; rows that repeat a doc_id are documents of their own; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm.common import body, stored, table

HEADER_SIMILARITY = 0.6
FILE_SIMILARITY = 0.6

#: The full texts (license, text), as they are distributed; they ship with this package.
TEXTS = tuple(
    (f.name.removesuffix(".txt"), f.read_text("utf-8"))
    for f in sorted(files(__package__).joinpath("texts").iterdir(), key=lambda f: f.name)
    if f.name.endswith(".txt")
)
if not TEXTS:
    raise FileNotFoundError("the full license texts are not in the package")

#: License identifiers and notices as they are publicly written.
NOTICES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License.",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation.",
    ),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files.",
    ),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted.",
    ),
    *[
        (
            f"{short}-{number}",
            "This program is free software; you can redistribute it and/or modify it under the terms "
            f"of the GNU {name} Public License as published by the Free Software Foundation; either "
            f"version {version} of the License, or (at your option) any later version.",
        )
        for short, name, number, version in (
            ("GPL", "General", "2.0", "2"), ("GPL", "General", "3.0", "3"), ("LGPL", "Library General", "2.0", "2"),
            ("LGPL", "Lesser General", "2.1", "2.1"), ("LGPL", "Lesser General", "3.0", "3"),
            ("AGPL", "Affero General", "3.0", "3"),
        )
    ],
    *TEXTS,
)

#: Notices from this one on are full texts; only they decide what is a license file by its text.
FIRST_TEXT = len(NOTICES) - len(TEXTS)

#: An SPDX expression, as it is written.
SPDX = r"(?i)spdx-license-identifier:[ \t]*\(?([a-z0-9][a-z0-9.+-]*(?:[ \t]+(?:or|and|with)[ \t]+[a-z0-9.+-]+)*)"
#: Between two paragraphs: a line without a letter or digit.
GAP = r"(?:\r\n|\r|\n)[^\p{L}\p{N}\r\n]*(?:\r\n|\r|\n)"

#: A line without any of these is no header.
MARKER = r"(?i)licen[sc]|copyright|copyleft|redistribut|permission|public domain|spdx|creative commons"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"


def terms(text: Column) -> Column:
    """Lower-case words and numbers, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def notice_terms(spark: SparkSession) -> DataFrame:
    """notice, license, term, tf: bounded by NOTICES."""
    notices = spark.createDataFrame(
        [(i, name, text) for i, (name, text) in enumerate(NOTICES)],
        "notice int, license string, notice_text string",
    )
    return (
        notices.select("notice", "license", F.explode(terms(F.col("notice_text"))).alias("term"))
        .groupBy("notice", "license", "term")
        .agg(F.count("*").alias("notice_tf"))
    )


def weights(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term and its weight, for the terms of the notices, and n_docs; counted over all documents."""
    own = docs.select(F.explode(F.array_distinct(terms(body()))).alias("term"))
    seen = own.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("n_docs"))
    return (
        vocabulary.join(seen, "term", "left")
        .join(F.broadcast(total), F.lit(True))
        .select("term", "n_docs", F.log((F.col("n_docs") + 2) / (F.coalesce("df", F.lit(0)) + 1)).alias("idf"))
    )


def _units(files: DataFrame) -> DataFrame:
    """row, unit (0 the whole text, its lines from 1, its paragraphs from -1 downwards), term: of texts
    with a marker."""
    marked = files.where(F.col("text").rlike(MARKER))
    lines = marked.select("row", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "line"))
    headers = lines.where(F.col("line").rlike(MARKER)).select(
        "row", (F.col("at") + 1).alias("unit"), F.explode(terms(F.col("line"))).alias("term")
    )
    blocks = marked.select("row", F.posexplode(F.split("text", GAP)).alias("at", "block"))
    # A paragraph of one line is that line.
    blocks = blocks.where(F.col("block").rlike(MARKER) & F.trim("block").rlike(r"[\r\n]")).select(
        "row", (-F.col("at") - 1).alias("unit"), F.explode(terms(F.col("block"))).alias("term")
    )
    whole = marked.select("row", F.lit(0).alias("unit"), F.explode(terms(F.col("text"))).alias("term"))
    return headers.unionByName(blocks).unionByName(whole)


def similarities(files: DataFrame, docs: DataFrame) -> DataFrame:
    """row, unit, license, similarity: the best notice of each unit."""
    spark = docs.sparkSession
    notices = notice_terms(spark)
    idf = stored(weights(docs, notices.select("term").distinct()), "idf")
    vectors = notices.join(idf, "term").withColumn("w", F.col("notice_tf") * F.col("idf"))
    norms = vectors.groupBy("notice").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("notice_norm"))
    vectors = stored(
        vectors.join(norms, "notice").select("term", "notice", "license", "w", "notice_norm"), "notices"
    )
    counts = (
        _units(files).groupBy("row", "unit", "term").agg(F.count("*").alias("tf"))
        .join(F.broadcast(idf), "term", "left")
    )
    # Of the terms of all units only those of notices go on; the others add to the norm.
    most = F.log(F.first("n_docs") + 2)
    most = idf.agg(most.alias("most"))
    counts = counts.join(F.broadcast(most), F.lit(True)).withColumn(
        "u", F.col("tf") * F.coalesce("idf", "most")
    )
    counts = stored(counts.select("row", "unit", "term", "u", "idf"), "unit-terms")
    length = counts.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("norm"))
    dots = (
        counts.where("idf is not null")
        .join(F.broadcast(vectors), "term")
        .where((F.col("unit") != 0) | (F.col("notice") >= FIRST_TEXT))
        .groupBy("row", "unit", "notice", "license", "notice_norm")
        .agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    )
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("notice_norm")), 9)
    best = F.min(F.struct((-cosine).alias("cost"), "license"))
    return (
        dots.join(length, ["row", "unit"])
        .groupBy("row", "unit")
        .agg(best.alias("best"))
        .select("row", "unit", F.col("best.license").alias("license"), (-F.col("best.cost")).alias("similarity"))
    )


def directory(path: Column) -> Column:
    """The directory of a path, without slash at either end; the root is empty."""
    clean = F.regexp_replace(F.coalesce(path, F.lit("")), "^/+|/+$", "")
    return F.regexp_replace(clean, "/*[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """Structs (depth, folder) of a directory, its ancestors and the root."""
    parts = F.filter(F.split(folder, "/+"), lambda x: x != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")),
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, path, license, origin (header, file, directory or null), similarity, from_doc.

    ``docs`` has doc_id, path and text.
    """
    files = stored(
        docs.select(F.col("doc_id").cast("long"), F.coalesce("path", F.lit("")).alias("path"), body().alias("text"))
        .where(F.col("text").rlike(MARKER))
        .withColumn("row", F.monotonically_increasing_id()),
        "marked",
    )
    found = stored(similarities(files, docs), "similar")
    better = F.min(F.struct((-F.col("similarity")).alias("cost"), "license"))
    named = files.select("row", F.regexp_extract("text", SPDX, 1).alias("license"), F.lit(1.0).alias("similarity"))
    header = (
        found.where((F.col("unit") != 0) & (F.col("similarity") >= HEADER_SIMILARITY))
        .join(named.where("license <> ''").select("row"), "row", "left_anti")
        .select("row", "license", "similarity")
        .unionByName(named.where("license <> ''"))
        .groupBy("row").agg(better.alias("h"))
    )
    whole = found.where((F.col("unit") == 0) & (F.col("similarity") >= FILE_SIMILARITY))
    own = (
        files.drop("text")
        .join(header, "row", "left")
        .join(whole.select("row", "license", "similarity"), "row", "left")
        .withColumn("is_file", F.col("license").isNotNull() | F.col("path").rlike(FILE_NAME))
        .select(
            "doc_id", "path", "is_file",
            F.coalesce("license", "h.license").alias("license"),
            F.coalesce("similarity", -F.col("h.cost")).alias("similarity"),
        )
        .where("license is not null")
    )
    own = stored(own, "licensed")
    # One license per directory, then the nearest above every directory that occurs.
    order = F.struct((-F.col("similarity")).alias("cost"), F.col("doc_id").isNull(), "doc_id", "license")
    licensed = (
        own.where("is_file")
        .groupBy(directory(F.col("path")).alias("above"))
        .agg(F.min(order).alias("f"))
        .select("above", F.col("f.license").alias("d_license"), F.col("f.doc_id").alias("d_doc"),
                (-F.col("f.cost")).alias("d_similarity"))
    )
    everything = docs.select(F.col("doc_id").cast("long"), F.coalesce("path", F.lit("")).alias("path"))
    everything = everything.withColumn("folder", directory(F.col("path")))
    nearest = (
        everything.select("folder").distinct()
        .select("folder", F.explode(ancestors(F.col("folder"))).alias("a"))
        .select("folder", "a.depth", "a.above")
        .join(licensed, "above")
        .groupBy("folder")
        .agg(F.max(F.struct("depth", "d_license", "d_similarity", "d_doc")).alias("n"))
        .select("folder", "n.d_license", "n.d_similarity", "n.d_doc")
    )
    by_id = own.groupBy(F.col("doc_id").alias("own_id"), F.col("path").alias("own_path")).agg(
        F.min(F.struct((-F.col("similarity")).alias("cost"), "license", "is_file")).alias("o")
    )
    mine = everything["doc_id"].eqNullSafe(by_id["own_id"]) & (everything["path"] == by_id["own_path"])
    has = F.col("o").isNotNull()
    return (
        everything.join(by_id, mine, "left")
        .join(nearest, "folder", "left")
        .select(
            "doc_id",
            "path",
            F.when(has, F.col("o.license")).otherwise(F.col("d_license")).alias("license"),
            F.when(has & F.col("o.is_file"), "file").when(has, "header")
            .when(F.col("d_license").isNotNull(), "directory").alias("origin"),
            F.when(has, -F.col("o.cost")).otherwise(F.col("d_similarity")).alias("similarity"),
            F.when(has, F.col("doc_id")).otherwise(F.col("d_doc")).alias("from_doc"),
        )
    )


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", path.alias("path"), "text"))
