"""Licence scans, in DataFrame functions only.

Documents are cut into overlapping windows of word shingles. MinHash bands of the
windows retrieve templates of about their size; of those, the exact share of the
template's shingles that the window holds verifies a match.

The band settings follow from the sizes. A template of t shingles is looked for in
windows of w >= t shingles, where w is a power of two, every w/4 shingles and w/4
longer; some window then holds any stretch of w shingles whole. If it holds the
share c of the template, their Jaccard similarity is at least c*t / (1.25*w + (1-c)*t),
which bounds the chance that no band of one MinHash value agrees.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

SHINGLE = 5
#: Notices looked for by default. Texts that public licences ask to be used.
TEMPLATES = (
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0 International."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("mit-line", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column) -> Column:
    """Hashes of the runs of five words; a text of fewer words has none."""
    def at(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(SHINGLE)]))
    hashed = F.transform(words(text), lambda x: F.xxhash64(x))
    return F.transform(F.array(hashed), lambda w: F.when(F.size(w) >= SHINGLE, at(w)).otherwise(F.array().cast("array<bigint>")))[0]


@dataclass(frozen=True)
class Bands:
    """How templates of one window width are looked for: windows of `length` shingles every `step`, `masks` MinHash values."""

    width: int
    length: int
    step: int
    masks: tuple[int, ...]

    @classmethod
    def plan(cls, width: int, smallest: int, contained: float, missed: float) -> Bands:
        """Settings for templates of `smallest` to `width` shingles, missing a match with probability `missed` at most."""
        step = max(1, width // 4)
        length = width + (step if width > 1 else 0)
        similarity = contained * smallest / (length + (1 - contained) * smallest) if width > 1 else 1.0
        n = 1 if similarity >= 1 else math.ceil(math.log(missed) / math.log(1 - similarity))
        masks = tuple(int.from_bytes((k * 0x9E3779B97F4A7C15 % 2**64).to_bytes(8, "big"), "big", signed=True) for k in range(1, n + 1))
        return cls(width, length, step, masks)


def minimum(hashes: Column, mask: int) -> Column:
    """A MinHash value: the least hash under an exclusive or, which permutes them."""
    return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(mask))))


def constants(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows that are at hand, as one constant of the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in schema.split(', '))}>>")))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> list[tuple[str, list[int]]]:
    """(name, distinct shingles) of each template; the templates are given, so this is small."""
    rows = constants(spark, [{"name": n, "text": t} for n, t in templates], "name string, text string").select("name", F.array_distinct(shingles(F.col("text"))).alias("s")).collect()
    out = [(r.name, sorted(r.s)) for r in rows if r.s]
    if sum(len(s) for _, s in out) > 1_000_000:
        raise ValueError("templates of more than a million shingles are not broadcast")
    return out


def scan(df: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, contained: float = 0.8, missed: float = 1e-4) -> DataFrame:
    """One row for each document and template found: doc_id, template, containment, first_word, last_word.

    A template is found if a window of the document holds at least `contained` of its
    distinct shingles of five words; words are lower-case runs of letters and digits,
    counted from 0. Of several such windows the best is reported, of equal ones the
    first. A template of fewer than five words has no shingle and is not looked for.

    Null, empty and short texts match nothing. Repeated rows give repeated rows, and a
    null doc_id stays null. Other columns are ignored. An empty table gives no rows.

    A band agrees only where its least hash is a template's, so documents that hold
    none of those values are left at once; that loses no agreement. Nothing shuffles
    but the best window of each document and template.
    """
    spark = df.sparkSession
    known = template_table(spark, templates)
    groups: dict[int, list[tuple[str, list[int]]]] = {}
    for name, s in known:
        groups.setdefault(1 << (len(s) - 1).bit_length(), []).append((name, s))
    plans = {w: Bands.plan(w, min(len(s) for _, s in found), contained, missed) for w, found in groups.items()}
    sign = lambda x: x - 2**64 if x >= 2**63 else x
    probes, bands = {w: set() for w in plans}, []
    for w, found in groups.items():
        for name, s in found:
            for k, mask in enumerate(plans[w].masks):
                low = min(sign((h ^ mask) % 2**64) for h in s)
                probes[w].add(sign((low ^ mask) % 2**64))
                bands.append({"width": w, "band": k, "low": low, "template": name})
    if not bands:
        return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("template"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("last_word")).limit(0)
    # Bounded by the templates (checked above), so both are broadcast.
    band_table = F.broadcast(constants(spark, bands, "width int, band int, low bigint, template string"))
    template_shingles = F.broadcast(constants(spark, [{"template": n, "wanted": s} for n, s in known], "template string, wanted array<bigint>"))

    def probe(width: int | None = None) -> Column:
        return F.array(*[F.lit(p) for p in sorted(set().union(*(v for w, v in probes.items() if width in (None, w))))])

    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), shingles(F.col("text")).alias("s"))
    near = docs.filter(F.arrays_overlap("s", probe())).withColumn("row", F.monotonically_increasing_id())
    near = materialize(near, "licences")
    found = None
    for w, plan in sorted(plans.items()):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("s") - plan.length + plan.step), F.lit(plan.step))
        cut = F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice(F.col("s"), i, F.lit(plan.length)).alias("window")))  # noqa: B023
        own = probe(w)
        windows = near.filter(F.arrays_overlap("s", own)).select("row", F.inline(F.filter(cut, lambda x: F.arrays_overlap(x.getField("window"), own))))  # noqa: B023
        values = F.array(*[F.struct(F.lit(k).alias("band"), minimum(F.col("window"), m).alias("low")) for k, m in enumerate(plan.masks)])
        hits = windows.select("row", "start", "window", F.explode(values).alias("v")).join(band_table.filter(F.col("width") == w), (F.col("v.band") == F.col("band")) & (F.col("v.low") == F.col("low")))
        hits = hits.select("row", "start", "window", "template").join(template_shingles, "template")
        share = F.size(F.array_intersect("window", "wanted")) / F.size("wanted")
        part = hits.select("row", "template", share.alias("containment"), (F.col("start") - 1).cast("long").alias("first_word"), (F.col("start") + F.size("window") + (SHINGLE - 3)).cast("long").alias("last_word"))
        part = part.filter(F.col("containment") >= contained)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("row", "template").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("at"), "last_word")).alias("m"))
    return near.select("row", "doc_id").join(best, "row").select("doc_id", "template", F.col("m.containment").alias("containment"), (-F.col("m.at")).alias("first_word"), F.col("m.last_word").alias("last_word"))
