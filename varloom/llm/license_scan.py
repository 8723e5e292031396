"""Licence scans with a positional index of rare licence words.

The index has the words of licence paragraphs with their positions, weighted by inverse document frequency over the paragraphs: a map of
words to postings, in a table of hash buckets. Of each text, the occurrences of the highest-IDF words are looked up; each posting votes
for (paragraph, place of the word in the text minus its place in the paragraph), so that the words of a paragraph that stand as they do
there meet in one vote. A paragraph is reported if the best vote has enough of its weight and one of its mandatory phrases stands, word
by word, where the vote places it.

All of it is done within the row, by array functions: no shuffle, and no text meets another.

Edge cases: a null or empty text has no words and no labels, score 0; repeated rows are scanned one by one; an empty table gives
an empty result; the score is the best verified paragraph's share of its weight, 1 for a base phrase.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: The paragraphs of licences and of their notices (label, paragraph, mandatory phrases of it, of which one must stand in
#: the text at its place). Paragraphs, not whole licences: between them files have names, years, bullets and comment signs.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0", ("apache org licenses",)),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache org licenses LICENSE-2.0", ("apache org licenses",)),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("specific language governing permissions", "without warranties or conditions")),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", ("permission is hereby granted", "deal in the software without restriction")),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted",)),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("substantial portions of the software",)),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ("purpose and noninfringement", "other dealings in the software")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee",)),
    ("bsd", "Released under the BSD License", ("bsd license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ("redistributions of source code",)),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("redistributions in binary form",)),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse or promote products",)),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES", ("particular purpose are disclaimed", "exemplary or consequential damages")),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("held liable for any damages",)),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ("redistribute it freely",)),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software",)),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("compiled binary for any purpose",)),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software", ("accompanying documentation covered by this license",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu general public license",)),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program.", ("gnu general public license",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("affero general public license",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at", ("copy of the mpl",)),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", ("eclipse public license",)),
    ("cc-by", "Licensed under CC BY 4.0", ("cc by",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc", "This work is licensed under a Creative Commons Attribution International License", ("creative commons",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("reserved", "All rights reserved", ("all rights reserved",)),
)

#: A word is looked up if it is in at most so many of the paragraphs; a vote counts from this share of a paragraph's weight.
RARE_IN, MIN_SHARE = 4, 0.5
#: Buckets of the table of postings.
BUCKETS = 512
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def index(notices=NOTICES, rare_in: int = RARE_IN) -> tuple[list[tuple[str, int, int, int]], list[int]]:
    """Postings (word, notice, position, weight) of the rare words, weights in thousandths; and each notice's total weight."""
    texts = [words_of(n[1]) for n in notices]
    found_in = Counter(w for t in texts for w in set(t))
    weight = {w: round(1000 * math.log((len(texts) + 1) / n)) for w, n in found_in.items() if n <= rare_in}
    postings = [(w, k, i, weight[w]) for k, t in enumerate(texts) for i, w in enumerate(t) if w in weight]
    total = [sum(p[3] for p in postings if p[1] == k) for k in range(len(texts))]
    return postings, total


def lowered(text: Column) -> Column:
    """A-Z lower-cased. Other letters may be too, which changes no word that is compared: only the Kelvin sign becomes an ASCII letter."""
    return F.when(F.contains(text, F.lit("K")), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def phrase_at(words: Column, phrase: str, i: Column) -> Column:
    out = None
    for k, w in enumerate(phrase.split()):
        same = F.get(words, i + k) == w
        out = same if out is None else out & same
    return F.coalesce(out, F.lit(False))


def phrases(notices=NOTICES) -> list[list[tuple[int, str]]]:
    """For each paragraph its mandatory phrases, the words joined by spaces, each with its place in the paragraph."""
    out = []
    for _, text, wanted in notices:
        words, own = words_of(text), []
        for p in wanted:
            n = len(p.split())
            own += [(i, p) for i in range(len(words) - n + 1) if " ".join(words[i : i + n]) == p]
        out.append(own)
    return out


def literal(value, schema: str) -> Column:
    """A nested constant, folded once."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def scan(docs: DataFrame, notices=NOTICES, rare_in: int = RARE_IN, min_share: float = MIN_SHARE, text_col: str = "text") -> DataFrame:
    """docs with n_words, base_places (array of struct<label, word>), base_labels, labels (arrays) and score."""
    postings, total = index(notices, rare_in)
    rare = sorted({p[0] for p in postings})
    words = F.col("_ls_words")
    table = [[] for _ in range(BUCKETS)]
    for w, k, i, x in postings:
        table[zlib.crc32(w.encode()) % BUCKETS].append({"w": w, "k": k, "i": i, "x": x})
    table = literal(table, "array<array<struct<w:string,k:int,i:int,x:int>>>")
    first_words = sorted({p.split()[0] for p, _ in BASE})
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(sorted({*rare, *first_words})))
    base = F.filter("_ls_at", lambda i: F.get(words, i).isin(first_words))
    base = F.flatten(F.transform(base, lambda i: F.filter(F.array(*[F.when(phrase_at(words, p, i), F.struct(F.lit(label).alias("label"), i.alias("word"))) for p, label in BASE]), lambda x: x.isNotNull())))
    bucket = lambda w: F.get(table, (F.crc32(F.encode(w, "UTF-8")) % BUCKETS).cast("int"))
    votes = F.flatten(F.transform("_ls_at", lambda i: F.transform(F.filter(bucket(F.get(words, i)), lambda p: p["w"] == F.get(words, i)), lambda p: F.struct(p["k"].alias("k"), (i - p["i"]).alias("off"), p["x"].alias("x")))))
    none = F.struct(F.lit(-1).alias("k"), F.lit(0).alias("off"), F.lit(0).alias("x"), F.array().cast("array<struct<k:int,off:int,x:int>>").alias("out"))
    closed = lambda a: F.concat(a["out"], F.array(F.struct(a["k"].alias("k"), a["off"].alias("off"), a["x"].alias("x"))))
    totals = literal(total, "array<int>")
    enough = lambda a: (a["k"] >= 0) & (a["x"] >= F.ceil(F.get(totals, F.greatest(a["k"], F.lit(0))) * F.lit(min_share)))

    def step(a: Column, v: Column) -> Column:
        same = (a["k"] == v["k"]) & (a["off"] == v["off"])
        return F.struct(v["k"].alias("k"), v["off"].alias("off"), F.when(same, a["x"] + v["x"]).otherwise(v["x"]).alias("x"), F.when(~same & enough(a), closed(a)).otherwise(a["out"]).alias("out"))

    best = F.aggregate(F.sort_array("_ls_votes"), none, step, lambda a: F.when(enough(a), closed(a)).otherwise(a["out"]))
    wanted = literal([[{"i": i, "n": len(p.split()), "p": p} for i, p in own] for own in phrases(notices)], "array<array<struct<i:int,n:int,p:string>>>")
    stands = lambda b, p: (b["off"] + p["i"] >= 0) & (F.array_join(F.slice(words, F.greatest(b["off"] + p["i"] + 1, F.lit(1)), p["n"]), " ") == p["p"])
    found = F.filter("_ls_best", lambda b: F.exists(F.get(wanted, b["k"]), lambda p: stands(b, p)))
    labels = literal([n[0] for n in notices], "array<string>")
    share = F.array_max(F.transform("_ls_found", lambda b: b["x"].cast("double") / F.get(totals, b["k"])))
    return (
        docs.withColumn("_ls_words", F.array_remove(F.split(lowered(F.coalesce(F.col(text_col), F.lit(""))), GAP, -1), ""))
        .withColumn("_ls_at", F.when(F.size(words) > 0, places).otherwise(F.array().cast("array<int>")))
        .withColumns({"n_words": F.size(words).cast("long"), "base_places": base, "_ls_votes": votes})
        .withColumn("_ls_best", best)
        .withColumn("_ls_found", found)
        .withColumn("base_labels", F.array_sort(F.array_distinct(F.transform("base_places", lambda p: p["label"]))))
        .withColumn("labels", F.array_sort(F.array_union("base_labels", F.transform("_ls_found", lambda b: F.get(labels, b["k"])))))
        .withColumn("score", F.when(F.size("base_places") > 0, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0))))
        .drop("_ls_words", "_ls_at", "_ls_votes", "_ls_best", "_ls_found")
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    at = F.transform("base_places", lambda p: p["word"])
    return docs.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score"
    )


def sql() -> str:
    """The same by joins: words with their places, postings and notices as inline tables."""
    postings, total = index()
    rows = lambda xs: ", ".join(xs)
    base_cases = " OR ".join("(p.label = '{}' AND {})".format(label, " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(p.split()))) for p, label in BASE)
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents
), places AS (
  SELECT rid, ws, i, ws[i + 1] AS w FROM (SELECT rid, ws, unnest(range(len(ws))) AS i FROM docs)
), phrases(label) AS (VALUES {rows(f"('{label}')" for _, label in BASE)}
), base AS (
  SELECT rid, i, p.label FROM places, phrases p WHERE {base_cases}
), postings(w, k, pos, x) AS (VALUES {rows(f"('{w}', {k}, {i}, {x})" for w, k, i, x in postings)}
), totals(k, label, total) AS (VALUES {rows(f"({k}, '{n[0]}', {t})" for k, (n, t) in enumerate(zip(NOTICES, total)))}
), mandatory(k, pos, n, phrase) AS (VALUES {rows(f"({k}, {i}, {len(p.split())}, '{p}')" for k, own in enumerate(phrases()) for i, p in own)}
), votes AS (
  SELECT rid, k, i - pos AS off, sum(x) AS x FROM places JOIN postings USING (w) GROUP BY rid, k, i - pos
), found AS (
  SELECT v.rid, t.label, CAST(v.x AS DOUBLE) / t.total AS share FROM votes v JOIN totals t USING (k) JOIN docs d USING (rid)
  WHERE v.x >= ceil(t.total * {MIN_SHARE}) AND EXISTS (SELECT 1 FROM mandatory m WHERE m.k = v.k AND v.off + m.pos >= 0 AND array_to_string(d.ws[v.off + m.pos + 1 : v.off + m.pos + m.n], ' ') = m.phrase)
), based AS (
  SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS bl FROM base GROUP BY rid
), labelled AS (
  SELECT rid, list_sort(list(DISTINCT label)) AS ls FROM (SELECT rid, label FROM base UNION SELECT rid, label FROM found) GROUP BY rid
), shares AS (SELECT rid, max(share) AS share FROM found GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base,
  CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(b.bl, ','), '') AS base_labels, coalesce(array_to_string(l.ls, ','), '') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(s.share, 0.0::DOUBLE) END AS score
FROM docs d LEFT JOIN based b USING (rid) LEFT JOIN labelled l USING (rid) LEFT JOIN shares s USING (rid)
"""


SQL = sql()
