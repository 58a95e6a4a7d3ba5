"""Licence scan: word bigrams of passages against those of licence templates, in DataFrame operations only.

Passages are a text's lines and its blocks of lines between blank ones. A passage and a
template are compared by the Dice coefficient of their sets of word bigrams after
normalisation (A-Z to lower case, anything but a-z and 0-9 one space). Size bounds
prune first: with sets of a and b bigrams a coefficient of t needs at least
t * (a + b) / 2 in common, so b must lie within a * t / (2 - t) and a * (2 - t) / t (for a
passage as a whole, then for each template it meets), and at least t / (2 - t) of a
passage's own bigrams must occur in some template.

Defined cases: null and empty texts and texts without a passage of two words have no
licence; rows with the same id share their findings; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices that licences prescribe or that are in common use.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0-short": "Licensed under the Apache License 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT-short": "Licensed under the MIT License.",
    "MIT-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
LEAST_DICE = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbours."""
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def _pairs(text: str) -> set[str]:
    lowered = text.translate(str.maketrans(_UPPER, _LOWER))
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in lowered).split()
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the value as a column that later filters read: behind a generator it is not computed again in each of them."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def scan(df: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage and template that match: id_col, kind, passage (number), license, dice. templates are a parameter of a few hundred at most."""
    known = {k: p for k, v in (templates or TEMPLATES).items() if (p := _pairs(v))}
    every = sorted(set().union(*known.values()))
    share = least / (2 - least)
    low, high = min(map(len, known.values())) * share, max(map(len, known.values())) / share
    text = F.col(text_col).cast("string")
    units = F.concat(
        F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.lit("line").alias("kind"), i.alias("at"), x.alias("text"))),
        F.filter(F.transform(F.split(text, r"\n[\x20\t\r]*\n"), lambda x, i: F.struct(F.lit("block").alias("kind"), i.alias("at"), x.alias("text"))), lambda u: F.contains(u["text"], F.lit("\n"))),
    )
    rows = df.select(F.col(id_col).alias("_id"), F.explode(units).alias("_u")).select("_id", "_u.kind", "_u.at", F.col("_u.text").alias("_t"))
    rows = _once(rows, "_t", normalised(F.col("_t")))
    gaps = F.length("_t") - F.length(F.translate("_t", " ", ""))  # one less than the words
    rows = _once(rows.where(gaps >= F.lit(low)), "_w", F.split("_t", " ")).drop("_t")
    # Distinct words are at most one more than distinct bigrams.
    rows = rows.where(F.size(F.array_distinct("_w")) <= F.lit(high + 1))
    rows = _once(rows, "_b", bigrams(F.col("_w"))).drop("_w").where(F.size("_b").between(low, high))
    rows = rows.where(F.size(F.filter("_b", lambda b: b.isin(every))) >= F.size("_b") * F.lit(share))
    spark = df.sparkSession
    of = spark.createDataFrame([(b, k, len(p)) for k, p in known.items() for b in sorted(p)], "_g string, license string, _size int")
    fits = F.col("_size").between(F.col("_n") * F.lit(share), F.col("_n") / F.lit(share))  # the templates that a passage of its size can be
    hits = rows.select("_id", "kind", "at", F.size("_b").alias("_n"), F.explode("_b").alias("_w"))
    hits = hits.join(F.broadcast(of), (F.col("_w") == F.col("_g")) & fits)
    hits = hits.groupBy("_id", "kind", "at", "license").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"), F.first("_size").alias("_s"))
    dice = 2 * F.col("_c") / (F.col("_n") + F.col("_s"))
    return hits.where(dice >= least).select(F.col("_id").alias(id_col), "kind", F.col("at").alias("passage"), "license", dice.alias("dice"))


def licenses(df: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, licenses (sorted, joined by commas), passages (that match), best_dice."""
    found = scan(df, templates, least, id_col, text_col).groupBy(F.col(id_col).alias("_id")).agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count_distinct("kind", "passage").alias("passages"), F.max("dice").alias("best_dice")
    )
    out = df.select(id_col).join(found, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return out.select(id_col, F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("passages", F.lit(0)).cast("long").alias("passages"), F.round(F.coalesce("best_dice", F.lit(0.0)), 9).alias("best_dice"))
