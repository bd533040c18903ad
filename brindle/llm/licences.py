"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from directories.

Texts are cut into sentences; those with a licence cue are compared to the sentences of the
templates by the cosine of their TF-IDF vectors (idf over the templates' sentences; a word no
template has weighs as one seen nowhere). A document's licence is that of its best sentence at
``threshold`` or above, found as ``header``; where such sentences make up ``file_share`` of the
document's words, it is a licence file (``file``), and its directory has that licence. A document
without its own gets that of the nearest directory above it that has one (``inherited``).

Whole documents and paragraphs (lines joined, up to one without letters or digits) are compared to whole licence texts
and notices besides. A document that is one at ``WHOLE`` or above, or of whose words such paragraphs make up ``file_share``, is a
licence file too; one with only some such paragraphs has a header.

Everything is joins and aggregations of DataFrames: sentences are scored once each however many
documents hold them, tables by sentence or directory are broadcast only after a look at their rows and bytes, and what
is shuffled is ids, words of cue sentences and of documents with a cue, and paths, never texts.

Null and empty texts have no sentences and can only inherit; a null path neither gives nor
inherits. Of equal scores the licence first in the alphabet wins; of several files in one
directory the best, then the first in the alphabet. Rows that repeat give a row each.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import Counter, defaultdict
from importlib import resources
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.store import shared_folder, small, stored

THRESHOLD, FILE_SHARE, WHOLE = 0.6, 0.5, 0.9
#: Words that a text about licences holds, as a pattern for SQL and as plain words, equal in what they take.
CUE = r"(?i)licen[sc]e|copyright|permission|warrant|redistribut|public domain"
CUES = ["license", "licence", "copyright", "permission", "warrant", "redistribut", "public domain"]
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"

# Names of public licences and sentences of their notices.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


AFFERO = "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge."


def whole_texts() -> dict[str, list[str]]:
    """Each licence's whole text, and the notices and paragraphs that stand for it in a file's head."""
    folder = resources.files("brindle.llm") / "licence_texts"
    texts = {f.name.removesuffix(".txt"): [f.read_text(encoding="utf-8")] for f in folder.iterdir() if f.name.endswith(".txt")}
    texts["AGPL-3.0"] = [texts["GPL-3.0"][0].replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL") + AFFERO]  # near enough to the text to tell it from the GPL's
    rest = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details."
    for name, title in (("GPL-2.0", "GNU General Public License"), ("GPL-3.0", "GNU General Public License"), ("AGPL-3.0", "GNU Affero General Public License")):
        first = TEMPLATES[name][1]
        got = f"You should have received a copy of the {title} along with this program. If not, see <https://www.gnu.org/licenses/>."
        texts[name] += [first, " ".join((first, rest.format(title), got))]
    texts["Apache-2.0"].append(" ".join((TEMPLATES["Apache-2.0"][1], "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", TEMPLATES["Apache-2.0"][2], "See the License for the specific language governing permissions and limitations under the License.")))
    texts["MPL-2.0"].append(TEMPLATES["MPL-2.0"][0] + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")
    for name in ("MIT", "ISC"):
        texts[name].append(next(p for p in texts[name][0].split("\n\n") if p.startswith("Permission")))
    return texts


def template_vectors(templates: dict[str, list[str]] = TEMPLATES) -> tuple[list[tuple[str, str, str, float]], dict[str, float], float]:
    """(template, licence, word, weight) of unit-length vectors; idf of each word; idf of other words."""
    texts = [(f"{name}#{i}", name, Counter(re.findall(TOKEN, t.lower()))) for name, own in sorted(templates.items()) for i, t in enumerate(own)]
    df = Counter(w for *_, c in texts for w in c)
    idf = lambda n: math.log((1 + len(texts)) / (1 + n)) + 1
    rows = []
    for key, name, counts in texts:
        norm = math.sqrt(sum((c * idf(df[w])) ** 2 for w, c in counts.items()))
        rows += [(key, name, w, c * idf(df[w]) / norm) for w, c in sorted(counts.items())]
    return rows, {w: idf(n) for w, n in df.items()}, idf(0)


def sentences(text: Column) -> Column:
    """A text's lines, cut further after . ! ? ; where white space follows."""
    return F.transform(F.split(F.regexp_replace(text, r"([.!?;])\s+", "$1\n"), "\n"), F.trim)


def table_of(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table of constants, as one literal that is read by column name."""
    names = [c.split()[0] for c in schema.split(",")]
    said = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    fields = schema.replace(" ", ":")
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(said), f"array<struct<{fields}>>")))


def cued(text: str | Column) -> Column:
    """Whether a text holds one of CUES in whatever case; plain searches, which take a fraction of a pattern's time on texts without any."""
    lower = F.lower(text)
    return functools.reduce(Column.__or__, [F.contains(lower, F.lit(c)) for c in CUES])


def fewest_words(vectors: list[tuple[str, str, str, float]], cosine: float) -> int:
    """Distinct words that a text must have at least to come to ``cosine`` with any of the templates.

    By Cauchy and Schwarz a cosine is at most the root of the squared weights of those of the template's
    words that the text has; so many of its heaviest words are needed, whatever else the text holds.
    """
    own = defaultdict(list)
    for template, _, _, weight in vectors:
        own[template].append(weight * weight)
    least = (cosine - 1e-6) ** 2  # cosines are rounded to six places
    needed = [next((n for n, held in enumerate(accumulate(sorted(weights, reverse=True)), 1) if held >= least), len(weights)) for weights in own.values()]
    return min(needed)


def score_sentences(found: DataFrame) -> DataFrame:
    """sentence, words, licence, cosine for each distinct ``sentence``."""
    spark = found.sparkSession
    rows, idf, other = template_vectors()
    vectors = F.broadcast(table_of(spark, rows, "template string,licence string,word string,weight double"))
    known = F.broadcast(table_of(spark, sorted(idf.items()), "word string,idf double"))
    words = found.select("sentence").distinct().select("sentence", F.explode(F.regexp_extract_all(F.lower("sentence"), F.lit(TOKEN), 0)).alias("word"))
    tf = words.groupBy("sentence", "word").agg(F.count("*").alias("tf")).join(known, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norms = tf.groupBy("sentence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("words"))
    dots = tf.join(vectors, "word").groupBy("sentence", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    best = dots.join(norms, "sentence").select("sentence", "words", "licence", cosine.alias("cosine"))
    return best.groupBy("sentence", "words").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "licence")).alias("b")).select("sentence", "words", "b.licence", (-F.col("b.minus")).alias("cosine"))


def score_whole(docs: DataFrame, sizes: DataFrame, file_share: float) -> DataFrame:
    """text_hash, whole_licence, whole_score, whole_file of the texts of which all or a paragraph is a licence's text or notice.

    ``sizes`` (text_hash, doc_words) has the words of each text with a cue. A text of one paragraph is one unit, as it would score alike twice;
    units with fewer distinct words than any template asks for are left out before their words are rows.
    """
    spark = docs.sparkSession
    rows, idf, other = template_vectors(whole_texts())
    vectors = F.broadcast(table_of(spark, rows, "template string,licence string,word string,weight double"))
    known = F.broadcast(table_of(spark, sorted(idf.items()), "word string,idf double"))
    parts = F.split("text", r"\n[^A-Za-z0-9\n]*\n")
    units = F.when(F.size(parts) > 1, F.concat(F.array("text"), F.filter(parts, cued))).otherwise(F.array("text"))
    bodies = docs.filter(cued("text")).select(F.xxhash64("text").alias("text_hash"), F.posexplode(units).alias("unit", "body"))
    words = bodies.select("text_hash", "unit", F.regexp_extract_all(F.lower("body"), F.lit(TOKEN), 0).alias("all")).filter(F.size(F.array_distinct("all")) >= fewest_words(rows, WHOLE))
    words = words.select("text_hash", "unit", F.size("all").alias("words"), F.explode("all").alias("word"))
    unit = ["text_hash", "unit", "words"]
    # Of a text on several rows all words count as often, which leaves cosines as they are.
    tf = words.groupBy(*unit, "word").agg(F.count("*").alias("tf")).join(known, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norms = tf.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(vectors, "word").groupBy(*unit, "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    close = dots.join(norms, unit).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("cosine") >= WHOLE)
    best = stored(close.groupBy(*unit).agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "licence")).alias("b")))
    held = sizes.join(small(best.select("text_hash").distinct()), "text_hash", "left_semi").distinct()
    # The whole text's licence before a paragraph's.
    found = best.groupBy("text_hash").agg(F.min(F.struct((F.col("unit") > 0).alias("part"), "b")).alias("f"), F.sum(F.when(F.col("unit") > 0, F.col("words")).otherwise(0)).alias("held")).join(held, "text_hash")
    return found.select("text_hash", F.col("f.b.licence").alias("whole_licence"), (-F.col("f.b.minus")).alias("whole_score"), (~F.col("f.part") | (F.col("held") >= file_share * F.col("doc_words"))).alias("whole_file"))


def directory(path: str | Column) -> Column:
    """The path up to its last slash, without it; null at the top."""
    return F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))


def above(directory_col: str) -> Column:
    """A directory and all above it, nearest first."""
    parts = F.split(directory_col, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """doc_id, path, licence, origin (header, file, inherited or none), score, n_sentences (licence sentences) of each row of ``docs`` (doc_id, text, path)."""
    shared_folder(docs.sparkSession)
    has = F.coalesce(cued("text"), F.lit(False))
    slim = stored(docs.select(
        "doc_id", "path", F.xxhash64("text").alias("text_hash"), directory("path").alias("dir"),
        F.when(has, F.size(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 0))).alias("doc_words"),
        F.when(has, F.filter(sentences(F.col("text")), cued)).alias("cues"),
    ))
    cues = slim.filter("cues is not null").select("doc_id", "text_hash", "doc_words", F.explode("cues").alias("sentence"))
    scored = stored(score_sentences(cues).filter(F.col("cosine") >= threshold))
    hits = cues.join(small(scored), "sentence").select("doc_id", "text_hash", "sentence", "doc_words", "words", "licence", "cosine").distinct()
    own = hits.groupBy("doc_id", "text_hash").agg(
        F.min(F.struct((-F.col("cosine")).alias("minus"), "licence")).alias("b"),
        (F.sum("words") >= file_share * F.max("doc_words")).alias("is_file"),
        F.count("*").alias("n_sentences"),
    )
    own = stored(own.select("doc_id", "text_hash", F.col("b.licence").alias("own_licence"), (-F.col("b.minus")).alias("own_score"), "is_file", "n_sentences"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & a["text_hash"].eqNullSafe(b["text_hash"])
    sizes = slim.filter("doc_words is not null").select("text_hash", "doc_words")
    marked = slim.join(own, same(slim, own), "left").select(slim["doc_id"], slim["text_hash"], slim["path"], slim["dir"], "own_licence", "own_score", "is_file", "n_sentences")
    marked = marked.join(small(stored(score_whole(docs, sizes, file_share))), "text_hash", "left")
    whole = F.col("whole_licence").isNotNull() & (F.col("whole_file") | F.col("own_licence").isNull())
    pick = lambda a, b: F.when(whole, F.col(a)).otherwise(F.col(b)).alias(b)
    marked = marked.select("doc_id", "path", "dir", pick("whole_licence", "own_licence"), pick("whole_score", "own_score"), F.coalesce(F.col("whole_file") | F.coalesce("is_file", F.lit(False)), "is_file").alias("is_file"), "n_sentences")
    files = marked.filter("is_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("minus"), F.col("own_licence").alias("licence"))).alias("f"))
    dirs = slim.filter("dir is not null").select("dir").distinct().select("dir", F.posexplode(above("dir")).alias("steps", "up"))
    givers = stored(files.select(F.col("dir").alias("up"), F.col("f.licence").alias("dir_licence"), (-F.col("f.minus")).alias("dir_score")))
    nearest = dirs.join(small(givers), "up").groupBy("dir").agg(F.min(F.struct("steps", "dir_licence", "dir_score")).alias("n")).select("dir", "n.dir_licence", "n.dir_score")
    nearest = stored(nearest)
    full = marked.join(small(nearest), "dir", "left")
    origin = F.when(F.col("is_file"), "file").when(F.col("own_licence").isNotNull(), "header").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none")
    return full.select("doc_id", "path", F.coalesce("own_licence", "dir_licence", F.lit("")).alias("licence"), origin.alias("origin"), F.coalesce("own_score", "dir_score", F.lit(0.0)).alias("score"), F.coalesce("n_sentences", F.lit(0)).cast("long").alias("n_sentences"))


def by_source(docs: DataFrame) -> DataFrame:
    """The documents' scan; they carry no paths, so paths of three levels are made: source, thousand and hundred of the id.

    Every tenth document stands in its thousand's directory, every hundredth (50, 150, ..) in its source's, so licence files are found on all levels.
    """
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    thousand = F.when(F.col("doc_id") % 100 != 50, part(1000))
    hundred = F.when(F.col("doc_id") % 10 != 0, part(100))
    path = F.concat_ws("/", "source", thousand, hundred, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.select("doc_id", "text", path.alias("path")))
