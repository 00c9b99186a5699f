"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits of the lower-cased text; shingles are runs of 5 words (all words if there are fewer).
A template of m shingles is sought in windows of m + s shingles that begin every s = ceil(m / 4) shingles, so each run of m
shingles lies within a window. A window's MinHash values are the least of PERMUTATIONS keyed hashes of its shingles, each
a band of one row. A window that holds 0.8 of a template's shingles has a Jaccard similarity of at least 0.8 / 1.45 = 0.55
with it and shares no band with a chance of 0.45 ** 16 = 3e-6; an exact copy (0.8) with 7e-12. A found pair counts if the
window holds at least 80 % of the template's distinct shingles.

Templates are a table (license, template), short notices and whole license texts. Texts that have none of its shingles are
left out by a semi join of all shingles, windows that have none of a length's templates' by an overlap, as both can share
no band; bands are then joined. The sides made of templates are broadcast where these have SMALL shingles at most, which
the driver counts, and shuffled else. It also holds the distinct lengths of templates. All of it is DataFrame functions.

A very long text is one array of shingles, 8 bytes a word, and its windows are rows. Null and empty texts have no words and
match nothing. Of equal windows the first counts. Null ids are ids of their own. Repeated rows of one id count as one text each and give one row with
their best. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

WORDS, PERMUTATIONS, CONTAINMENT, SMALL = 5, 16, 0.8, 100_000
# Short public notices by which licenses are named in texts, and whole public license texts.
TEMPLATES = {
    "mit": "Released under the MIT License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution.""",
}


def _words(text) -> F.Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _shingles(words) -> F.Column:
    n = F.size(words)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n - (WORDS - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, WORDS)))).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles) -> F.Column:
    def least(p: int) -> F.Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(p))))

    return F.array(*[least(p) for p in range(PERMUTATIONS)])


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, template string")


def scan(docs: DataFrame, templates: DataFrame | None = None, id_col="doc_id", text_col="text", containment: float = CONTAINMENT) -> DataFrame:
    """Rows doc_id, license, containment, shingle: the best window of each document and template, and its first shingle's number."""
    spark: SparkSession = docs.sparkSession
    known = template_table(spark) if templates is None else templates
    known = known.select("license", _shingles(_words(F.col("template"))).alias("t")).where(F.size("t") > 0)
    known = known.select("license", F.size("t").alias("tm"), F.array_distinct("t").alias("t"), _bands(F.col("t")).alias("b"))
    count = known.agg(F.sum(F.size("t"))).first()[0] or 0
    side = F.broadcast if count <= SMALL else lambda x: x  # each table below has at most PERMUTATIONS * 9 bytes a shingle
    lengths = known.select("tm", F.explode("t").alias("x")).groupBy("tm").agg(F.collect_set("x").alias("every"))
    sizes = [r.tm for r in known.select("tm").distinct().orderBy("tm").collect()]
    sizes = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(-(-m // 4)).alias("step")) for m in sizes])
    bands = known.select("license", "tm", "t", F.posexplode("b").alias("tp", "tvalue"))

    # explode() of one value keeps the optimiser from putting its expression in place of each use, inside lambdas too.
    once = lambda c: F.explode(F.array(c))
    shingled = docs.select(F.col(id_col).alias("doc_id"), once(_words(F.col(text_col))).alias("words")).select("doc_id", once(_shingles(F.col("words"))).alias("s"))
    named = shingled.select("doc_id", F.explode("s").alias("x")).join(side(known.select(F.explode("t").alias("x")).distinct()), "x", "left_semi").select(F.col("doc_id").alias("named")).distinct()
    few = docs.join(named, F.col(id_col).eqNullSafe(F.col("named")), "left_semi")
    x = few.select(F.col(id_col).alias("doc_id"), once(_words(F.col(text_col))).alias("words")).select("doc_id", once(_shingles(F.col("words"))).alias("s"))
    x = x.select("doc_id", "s", F.explode(sizes).alias("k")).select("doc_id", "s", "k.m", "k.step")
    x = x.join(side(lengths), F.col("m") == F.col("tm")).drop("tm").where(F.arrays_overlap("s", "every"))
    x = x.select("doc_id", "s", "m", "step", "every", F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.col("step"))).alias("shingle"))
    x = x.select("doc_id", "m", "shingle", "every", once(F.slice("s", F.col("shingle") + 1, F.col("m") + F.col("step"))).alias("w"))
    x = x.where(F.arrays_overlap("w", "every")).select("doc_id", "m", "shingle", "w", F.posexplode(_bands(F.col("w"))).alias("p", "value"))
    found = x.join(side(bands), (F.col("m") == F.col("tm")) & (F.col("p") == F.col("tp")) & (F.col("value") == F.col("tvalue")))
    share = F.size(F.array_intersect("w", "t")) / F.size("t")
    found = found.select("doc_id", "license", share.alias("containment"), "shingle").where(F.col("containment") >= containment)
    best = found.groupBy("doc_id", "license").agg(F.min(F.struct((-F.col("containment")).alias("c"), "shingle")).alias("b"))
    return best.select("doc_id", "license", (-F.col("b.c")).alias("containment"), F.col("b.shingle").cast("long").alias("shingle"))


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
_SPLIT = r"list_filter(string_split(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_RUNS = "CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')) END"
ORACLE = f"""
WITH tw AS (SELECT license, {_SPLIT.format("template")} AS ws FROM (VALUES {_VALUES}) AS v(license, template)),
ts AS (SELECT license, {_RUNS} AS t FROM tw),
t AS (SELECT license, t, len(t) AS m, ceil(len(t) / 4.0)::BIGINT AS step FROM ts),
dw AS (SELECT doc_id, {_SPLIT.format("text")} AS ws FROM documents),
d AS (SELECT doc_id, {_RUNS} AS s FROM dw),
near AS (SELECT doc_id, license, s, t, m, step FROM d JOIN t ON len(list_intersect(s, t)) >= 0.8 * len(list_distinct(t))),
win AS (SELECT doc_id, license, t, unnest(range(0, len(s), step)) AS shingle, s, m, step FROM near),
c AS (SELECT doc_id, license, shingle, len(list_intersect(list_distinct(s[shingle + 1:shingle + m + step]), list_distinct(t)))::DOUBLE / len(list_distinct(t)) AS containment FROM win),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, shingle) AS r FROM c WHERE containment >= 0.8)
SELECT doc_id, license, containment, shingle FROM r WHERE r = 1
"""
