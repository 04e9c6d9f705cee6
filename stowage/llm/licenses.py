"""License texts in documents: MinHash bands over text windows, then exact containment. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import whole_text
from stowage.session import cut_lineage

SHINGLE = 5
#: A window is WINDOW words and starts at every word: it holds two shingles, and each shingle lies in two windows.
WINDOW = 6
#: Bands of one MinHash. A window that shares one of its two shingles with a template window agrees with it in a band
#: with probability 1/2 at least; a lone shared shingle is missed by both of its windows with probability 4 ** -BANDS at most.
BANDS = 10
CONTAINMENT = 0.8
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"

# Public license notices and opening paragraphs.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
                     "conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    # Cut so short that another version or kind of the license holds less than CONTAINMENT of them.
    ("GPL-2.0", "GNU General Public License, version 2."),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "GNU General Public License, version 3."),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
                     "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "Licensed under the Creative Commons CC0 1.0 Universal License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def _creative_commons() -> list[tuple[str, str]]:
    """Short and long notices of the six Creative Commons licenses in all their versions."""
    out = []
    for version, kind in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"), ("1.0", "Generic")):
        none = "NoDerivatives" if version == "4.0" else "NoDerivs"
        for parts in (("BY",), ("BY", "SA"), ("BY", "NC"), ("BY", "ND"), ("BY", "NC", "SA"), ("BY", "NC", "ND")):
            if version == "1.0" and parts == ("BY", "NC", "ND"):
                title = "NoDerivs-NonCommercial"  # its title has the other order
            else:
                title = "-".join({"SA": "ShareAlike", "NC": "NonCommercial", "ND": none}[p] for p in parts[1:])
            full = f"Attribution-{title}" if title else "Attribution"
            name = f"CC-{'-'.join(parts)}-{version}"
            out.append((name, f"Licensed under CC {'-'.join(parts)} {version}."))
            out.append((name, f"Licensed under a Creative Commons {full} {version} {kind} License."))
            out.append((name, f"Licensed under the Creative Commons {full} {version} {kind} License."))
    return out


TEMPLATES += _creative_commons()


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, A-Z lowered."""
    return F.split(F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))), " ")


def windows(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, at, s0, s1) of the shingle hashes in each window; the last window repeats its only shingle.

    Hashes are made inside the row: an array that stays beside an exploded one is copied into every row of it.
    """
    shingle = ", ".join(f"get(words, i + {k})" for k in range(SHINGLE))
    hashed = texts.select(*keys, words(F.col("text")).alias("words")).select(*keys, F.expr(
        f"if(size(words) < {SHINGLE}, array(), transform(sequence(0, size(words) - {SHINGLE}), i -> xxhash64({shingle})))").alias("h"))
    pairs = F.arrays_zip(F.col("h").alias("s0"), F.slice("h", 2, F.size("h")).alias("s1"))
    return hashed.select(*keys, F.posexplode(pairs).alias("at", "w")).select(
        *keys, "at", F.col("w.s0").alias("s0"), F.coalesce("w.s1", "w.s0").alias("s1"))


SHINGLES = ["s0", "s1"]


def _least(band: int) -> Column:
    """MinHash of a window: hashes under a mask of the band stand for a permutation."""
    mask = F.lit(0x9E3779B97F4A7C15 * (band + 1) % (1 << 63)).cast("bigint")
    return F.least(*[F.xxhash64(F.col(s).bitwiseXOR(mask)) for s in SHINGLES])


def _is_one_of(value: Column, known: list[int]) -> Column:
    """Membership in a fixed list; a table of the 12 low bits, 32 to a number, rules out nearly all values before the list
    is asked."""
    table = [0] * 128
    for v in known:
        table[(v >> 5) & 127] |= 1 << (v & 31)
    word = F.get(F.expr(f"array({','.join(f'{t}L' for t in table)})"), F.shiftright(value, 5).bitwiseAND(F.lit(127).cast("bigint")).cast("int"))
    return (F.getbit(word, value.bitwiseAND(F.lit(31).cast("bigint")).cast("int")) == 1) & value.isin(known)


def licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and license found: doc_id, license, containment, n_shingles, first_word, last_word.

    A license is found when a document holds at least ``containment`` of the distinct 5-word shingles of one of its
    templates; the best template counts, then the longer one, then the first listed. ``first_word`` and ``last_word`` bound the words of
    its shingles, from 0, the end exclusive. Null, empty and shorter texts hold nothing; templates below 5 words match
    nothing. Rows are taken one by one, so repeated rows and null ids give rows of their own.

    The templates are a parameter of bounded size. Texts are read once and never shuffled: only windows that meet a
    template in a band, or hold one of its shingles, go on.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(i, name, body) for i, (name, body) in enumerate(templates)], "template int, license string, text string")
    # Every place of a template, as documents may cut it anywhere.
    pieces = windows(known, ["template", "license"])
    bands = pieces.select("template", *[_least(b).alias(f"b{b}") for b in range(BANDS)]).collect()
    each = pieces.select("template", "license", F.col("s0").alias("shingle")).distinct().collect()
    narrow = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", whole_text(text).alias("text"))
    met = [_is_one_of(_least(b), sorted({r[f"b{b}"] for r in bands}) or [0]) for b in range(BANDS)]
    shingles = sorted({r.shingle for r in each}) or [0]
    in_band = reduce(Column.__or__, met)
    held = reduce(Column.__or__, [_is_one_of(F.col(s), shingles) for s in SHINGLES])
    # The test of all bands makes one method too long for the JVM to compile if it is fused with its neighbours; below this
    # limit Spark cuts it into short ones. The setting holds for this one job.
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, "8000")
    try:
        kept = cut_lineage(windows(narrow, ["uid", "doc_id"]).filter(in_band | held).withColumn("in_band", in_band), "windows")
    finally:
        spark.conf.set(METHOD_LIMIT, before)
    band_table = spark.createDataFrame([(b, r[f"b{b}"], r.template) for r in bands for b in range(BANDS)], "band int, least bigint, template int").distinct()
    candidates = (
        kept.filter("in_band").select("uid", F.posexplode(F.array(*[_least(b) for b in range(BANDS)])).alias("band", "least"))
        .join(F.broadcast(band_table), ["band", "least"]).select("uid", "template").distinct()
    )
    sizes = {}
    for r in each:
        sizes[r.template] = sizes.get(r.template, 0) + 1
    shingle_table = spark.createDataFrame([(r.shingle, r.template, r.license, sizes[r.template]) for r in each], "shingle bigint, template int, license string, total int")
    hits = (
        kept.select("uid", "doc_id", "at", F.col("s0").alias("shingle"))  # every shingle is the first of one window
        .join(F.broadcast(shingle_table), "shingle")
        .groupBy("uid", "doc_id", "template", "license", "total")
        .agg(F.count_distinct("shingle").alias("n_shingles"), F.min("at").alias("first_word"), (F.max("at") + SHINGLE).alias("last_word"))
    )
    checked = hits.join(candidates, ["uid", "template"]).withColumn("containment", F.col("n_shingles") / F.col("total")).filter(F.col("containment") >= containment)
    best = F.max_by(F.struct("containment", "n_shingles", "first_word", "last_word"), F.struct("containment", "n_shingles", -F.col("template")))
    return checked.groupBy("uid", "doc_id", "license").agg(best.alias("b")).select("doc_id", "license", "b.*")
