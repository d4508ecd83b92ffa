"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along directories.

Everything here is DataFrame functions. A file's segments are its sentences and lines,
its paragraphs, its header (the comment lines it begins with) and, for a licence file,
the whole text. Each is compared with every template: weights are (1 + ln tf) times
ln((N + 1) / (df + 1)) + 1, with df counted over all files; terms of no template weigh
as terms of no file. A file's own licence is its best segment's, of those with a cosine
of at least ``THRESHOLD``; a reservation of rights counts only where no licence is
found, and SPDX lines of known ids, whatever their case, count before all: an expression keeps its OR and AND, and
loses brackets, exceptions and -only or -or-later; several lines are joined by AND. A file without one takes the licence of the
licence file in the nearest directory above it: directories, not files, are joined with
their ancestors, and files then join their directory.

A segment can only reach the threshold if it holds one of a template's heaviest terms:
without them the rest of the template is too short for any cosine of that size. Files
and segments without any such term are left out at once; that changes no result. What
is left is cut into terms, once for all files of equal text, counted, and joined with
the templates' terms, a broadcast of a fixed size. Only the templates' document
frequencies reach the driver, a row a term. Of other files only paths are shuffled.

Edge cases: a null or empty text has no segments and no licence; a null path inherits
nothing. A very long text is a row a term and segment like any other. Rows that repeat
are judged row by row. Of templates that tie the greater licence name counts; of two
licence files in one directory the one with the better match, then the greater name.
Empty tables give empty results. Other columns are passed through, over those of the
result's names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm.common import cut, stored

THRESHOLD = 0.7
RESERVED = "Proprietary"

# ---- Fixed values: licence ids, and the texts, headers and notices by which they are known.

_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution."
)
_BSD_3 = f"{_BSD_2} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. "
    "You should have received a copy of the {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_GNU_TERMS = "is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU = [
    ("GPL-2.0", "GNU General Public License", "2", "2, June 1991"), ("GPL-3.0", "GNU General Public License", "3", "3, 29 June 2007"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "3, 29 June 2007"), ("AGPL-3.0", "GNU Affero General Public License", "3", "3, 19 November 2007"),
]
_NAMES = [
    ("MIT", "the MIT License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("Apache-2.0", "the Apache 2.0 license"), ("GPL-2.0", "the GNU GPL v2"), ("GPL-3.0", "the GNU GPL v3"), ("LGPL-2.1", "the GNU LGPL v2.1"),
    ("LGPL-3.0", "the GNU LGPL v3"), ("AGPL-3.0", "the GNU AGPL v3"), ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "the BSD 3-Clause License"), ("MPL-2.0", "the Mozilla Public License 2.0"),
    ("ISC", "the ISC License"), ("EPL-2.0", "the Eclipse Public License 2.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-4.0", "a Creative Commons Attribution 4.0 International License"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
]
TEMPLATES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
     "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
     "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
     "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", f"{_BSD_2} {_AS_IS}"), ("BSD-2-Clause", _BSD_2), ("BSD-3-Clause", f"{_BSD_3} {_AS_IS}"), ("BSD-3-Clause", _BSD_3),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to "
     "use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must "
     "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly "
     "marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
     "binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
     "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"), ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    *((i, f"This program {_GNU_TERMS.format(name, v)} {_GNU_WARRANTY.format(name)}") for i, name, v, _ in _GNU), *((i, f"This program {_GNU_TERMS.format(name, v)}") for i, name, v, _ in _GNU),
    *((i, f"{name.upper()} Version {title}") for i, name, _, title in _GNU), *((i, f"This work is licensed under the {name}, version {v}.") for i, name, v, _ in _GNU),
    *((i, f"{verb} under {name}.") for i, name in _NAMES for verb in ("Licensed", "Released")),
    ("Apache-2.0 OR MIT", "Licensed under either of the Apache License, Version 2.0 or the MIT license at your option."),
    (RESERVED, "All rights reserved."),
]
SPDX_IDS = (
    "0BSD AFL-3.0 AGPL-1.0 AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 "
    "CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL "
    "NCSA ODbL-1.0 OFL-1.1 OSL-3.0 OpenSSL PostgreSQL Python-2.0 UPL-1.0 Unlicense Vim W3C WTFPL X11 ZPL-2.1 Zlib"
).split()
# ---- End of fixed values.

LICENCE_FILE = "(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"
COMMENT = "^[ \\t\\r]*(#|//|/[*]|[*]|--|;|%|<!--|\"\"\"|'''|$)"
_ID = f"(?:{'|'.join(sorted((re.escape(i) for i in SPDX_IDS), key=lambda i: (-len(i), i)))})(?:-only|-or-later|[+])?"
_UNIT = f"[(]*[ \\t]*{_ID}(?:[ \\t]+WITH[ \\t]+[A-Za-z0-9.-]+)?[ \\t]*[)]*"
#: An SPDX line of known ids, whatever the case; what follows an id must not be of its kind.
SPDX = f"(?i)SPDX-License-Identifier:[ \\t]*({_UNIT}(?:[ \\t]+(?:OR|AND)[ \\t]+{_UNIT})*)(?:[^A-Za-z0-9.+-]|$)"
#: What an expression says besides ids, in the order in which it is taken away.
_TIDY = [("[ \\t]+WITH[ \\t]+[A-Za-z0-9.-]+", ""), ("[()]", " "), ("-only|-or-later|[+]", ""), ("[ \\t]+", " "), ("^ | $", "")]
_NOT_TERM = "[^a-z0-9]+"
_SENTENCE = "([.!?])[ \\t\\r\\n]+([A-Z])"
_PARAGRAPH = "\\n[ \\t\\r]*\\n"


def terms(text: str) -> Counter:
    return Counter(re.findall(r"[a-z0-9]+", text.lower()))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), _NOT_TERM), ""))


class Weights:
    """What the templates' terms weigh over all files, and which of them a match must have."""

    def __init__(self, files: DataFrame, templates: list[tuple[str, str]], threshold: float):
        counts = [terms(text) for _, text in templates]
        vocabulary = sorted(set().union(*counts))
        known = F.array(*map(F.lit, vocabulary))
        seen = files.select(F.explode(F.array_union(F.array_intersect(_terms(F.coalesce("text", F.lit(""))), known), F.array(F.lit("")))).alias("t"))
        df = {r["t"]: r["count"] for r in seen.groupBy("t").count().collect()}
        n = df.get("", 0)
        self.idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
        self.unknown = math.log(n + 1) + 1
        self.templates, self.needed = [], set()
        for tf in counts:
            w = {t: (1 + math.log(k)) * self.idf[t] for t, k in tf.items()}
            room = total = sum(x * x for x in w.values())
            self.templates.append({t: x / math.sqrt(total) for t, x in w.items()})
            for t in sorted(w, key=w.get, reverse=True):
                if room < (threshold - 1e-6) ** 2 * total:
                    break
                self.needed.add(t)
                room -= w[t] ** 2

    def postings(self, spark: SparkSession) -> DataFrame:
        """t, idf, of: the templates that have it, and their share."""
        of: dict[str, list[str]] = {t: [] for t in self.idf}
        for i, w in enumerate(self.templates):
            for t, x in w.items():
                of[t].append(f"named_struct('ix', {i}, 'm', {x!r}D)")
        rows = ", ".join(f"('{t}', {self.idf[t]!r}D, array({', '.join(of[t])}))" for t in of)
        return spark.sql(f"SELECT * FROM VALUES {rows} AS v(t, idf, of)")


def _segments(text: Column, licence_file: Column) -> Column:
    lines = F.split(text, "\n")
    code = F.filter(F.transform(lines, lambda s, i: F.when(~s.rlike(COMMENT), i)), lambda i: i.isNotNull())
    header = F.array_join(F.slice(lines, 1, F.coalesce(F.array_min(code), F.size(lines))), " ")
    every = [F.split(F.regexp_replace(text, _SENTENCE, "$1\n$2"), "\n"), F.split(text, _PARAGRAPH), F.array(header), F.when(licence_file, F.array(text)).otherwise(F.array().cast("array<string>"))]
    return F.array_distinct(F.concat(*every))


_KEY = ["k1", "k2", "is_licence_file"]


def _matches(files: DataFrame, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """files(k1, k2, is_licence_file, text), a row a different text -> those keys, own: struct<rank, score, license>, n_segments."""
    w = Weights(files, templates, threshold)
    needed = F.array(*map(F.lit, sorted(w.needed)))
    holds = lambda c: F.arrays_overlap(_terms(c), needed)
    gated = files.where(holds(F.col("text"))).select(*_KEY, F.filter(_segments(F.col("text"), F.col("is_licence_file")), holds).alias("segments"))
    one = stored(gated.groupBy(*_KEY).agg(F.first("segments").alias("segments")))
    parted = one.select(*_KEY, F.posexplode("segments").alias("segment", "s"))
    counted = parted.select(*_KEY, "segment", F.explode(F.split(F.lower("s"), _NOT_TERM)).alias("t")).where("t <> ''").groupBy(*_KEY, "segment", "t").agg(F.count("*").alias("tf"))
    weighed = counted.join(F.broadcast(w.postings(files.sparkSession)), "t", "left").withColumn("x", (1 + F.log("tf")) * F.coalesce("idf", F.lit(w.unknown)))
    # The segment's own square sum goes with the products, as a template of number -1.
    none = F.array().cast("array<struct<ix:int,m:double>>")
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("ix"), (F.col("x") * F.col("x")).alias("m"))), F.transform(F.coalesce("of", none), lambda p: F.struct(p["ix"].alias("ix"), (p["m"] * F.col("x")).alias("m"))))
    sums = weighed.select(*_KEY, "segment", F.explode(parts).alias("p")).groupBy(*_KEY, "segment", "p.ix").agg(F.sum("p.m").alias("m"))
    norm = F.sqrt(F.max(F.when(F.col("ix") < 0, F.col("m"))))
    dots = F.collect_list(F.when(F.col("ix") >= 0, F.struct("ix", "m")))
    judged = sums.groupBy(*_KEY, "segment").agg(norm.alias("norm"), dots.alias("dots"))
    names = F.array(*(F.struct(F.lit(int(name != RESERVED)).alias("rank"), F.lit(name).alias("license")) for name, _ in templates))
    scored = F.transform("dots", lambda d: F.struct(F.get(names, d["ix"])["rank"].alias("rank"), F.round(d["m"] / F.col("norm"), 6).alias("score"), F.get(names, d["ix"])["license"].alias("license")))
    best = judged.select(*_KEY, F.array_max(F.filter(scored, lambda x: x["score"] >= threshold)).alias("b")).where("b is not null")
    return best.groupBy(*_KEY).agg(F.max("b").alias("own"), F.count("*").alias("n_segments"))


def _stated(text: Column) -> Column:
    """The ids of a text's SPDX lines, each line's joined by its OR and AND, different lines' by AND; empty if there is none."""
    names = F.create_map(*(F.lit(x) for i in SPDX_IDS for x in (i.lower(), i)))

    def tidy(e: Column) -> Column:
        for old, new in _TIDY:
            e = F.regexp_replace(e, f"(?i){old}", new)
        return F.array_join(F.transform(F.split(e, " "), lambda w: F.coalesce(F.element_at(names, F.lower(w)), F.upper(w))), " ")

    return F.array_join(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), tidy)), " AND ")


def _directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files(…, path, text) -> its other columns, path, n_segments, own_license, license, inherited_from."""
    kept = [files[c] for c in files.columns if c not in ("path", "text", "n_segments", "own_license", "license", "inherited_from")]
    text = F.coalesce(files["text"], F.lit(""))
    licence_file = F.coalesce(F.element_at(F.split(files["path"], "/"), -1).rlike(LICENCE_FILE), F.lit(False))
    named = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("id"), text).alias("k2"), licence_file.alias("is_licence_file")]
    found = stored(_matches(files.select(*named, text.alias("text")), templates, threshold))
    spdx = F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier:")), _stated(text))
    rows = files.select(F.struct(F.lit(True).alias("_"), *kept).alias("_row"), files["path"], *named, spdx.alias("_spdx")).join(found, _KEY, "left")
    stated = F.struct(F.lit(2).alias("rank"), F.lit(1.0).alias("score"), F.col("_spdx").alias("license"))
    judged = cut(rows.select("_row", "path", "is_licence_file", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.when(F.col("_spdx") != "", stated).otherwise(F.col("own")).alias("own"), _directory(F.col("path")).alias("dir")))
    held = judged.where("is_licence_file and own is not null and dir is not null").groupBy(F.col("dir").alias("ancestor")).agg(F.max("own").alias("held"))
    parts = F.split("dir", "/")
    above = (
        judged.where("own is null and dir is not null").select("dir").distinct()
        .select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
        .select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/").alias("ancestor"))
    )
    nearest = cut(above.join(held, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", F.col("held.license").alias("license"))).alias("n")))
    out = judged.join(nearest.select("dir", F.col("n.license").alias("_license"), F.col("n.ancestor").alias("_from")), "dir", "left")
    return out.select(
        "_row.*", "path", "n_segments", F.col("own.license").alias("own_license"),
        F.coalesce("own.license", "_license").alias("license"), F.when(F.col("own").isNull(), F.col("_from")).alias("inherited_from"),
    ).drop("_")


def oracle(files_sql: str, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB's version of ``scan`` over a query of (doc_id, path, text): every segment against every template."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    tidy = "e"
    for old, new in _TIDY:
        tidy = f"regexp_replace({tidy}, {q('(?i)' + old)}, {q(new)}, 'g')"
    names = "map([" + ", ".join(q(i.lower()) for i in SPDX_IDS) + "], [" + ", ".join(map(q, SPDX_IDS)) + "])"
    lines = f"list_transform(regexp_extract_all(text, {q(SPDX)}, 1), lambda e: array_to_string(list_transform(string_split({tidy}, ' '), lambda w: coalesce({names}[lower(w)], upper(w))), ' '))"
    stated = f"CASE WHEN contains(lower(text), 'spdx-license-identifier:') THEN (SELECT coalesce(string_agg(x, ' AND ' ORDER BY i), '') FROM (SELECT x, min(i) AS i FROM (SELECT unnest({lines}) AS x, generate_subscripts({lines}, 1) AS i) GROUP BY x)) ELSE '' END"
    rows = ", ".join(f"({i}, {int(name != RESERVED)}, {q(name)}, {q(t)}, {k})" for i, (name, text) in enumerate(templates) for t, k in terms(text).items())
    return f"""
WITH files AS MATERIALIZED (SELECT doc_id, path, coalesce(text, '') AS text, coalesce(regexp_matches(regexp_extract(path, '[^/]*$'), {q(LICENCE_FILE)}), false) AS is_licence_file FROM ({files_sql})),
template_terms(ix, rank, license, t, tf) AS (VALUES {rows}),
counted AS (SELECT count(*) AS n FROM files),
seen AS (SELECT t, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(text), '{_NOT_TERM}'))) AS t FROM files) GROUP BY t),
weight AS MATERIALIZED (SELECT t, ln((n + 1.0::DOUBLE) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT t FROM template_terms) CROSS JOIN counted LEFT JOIN seen USING (t)),
shares AS MATERIALIZED (SELECT ix, rank, license, t, w / sqrt(sum(w * w) OVER (PARTITION BY ix)) AS m FROM (SELECT ix, rank, license, t, (1 + ln(tf::DOUBLE)) * idf AS w FROM template_terms JOIN weight USING (t))),
lined AS (SELECT *, string_split(text, chr(10)) AS lines FROM files),
headed AS (SELECT doc_id, text, is_licence_file, array_to_string(lines[1:coalesce(list_min([i FOR i IN range(1, len(lines) + 1) IF NOT regexp_matches(lines[i], {q(COMMENT)})]) - 1, len(lines))], ' ') AS header FROM lined),
segments AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, s FROM (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '{_SENTENCE}', '\\1\n\\2', 'g'), chr(10))) AS s FROM files
  UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '{_PARAGRAPH}')) FROM files
  UNION ALL SELECT doc_id, header FROM headed UNION ALL SELECT doc_id, text FROM headed WHERE is_licence_file))),
term AS MATERIALIZED (SELECT k, doc_id, t, (1 + ln(count(*)::DOUBLE)) AS tf FROM (SELECT k, doc_id, unnest(regexp_split_to_array(lower(s), '{_NOT_TERM}')) AS t FROM segments) WHERE t <> '' GROUP BY ALL),
normed AS (SELECT k, doc_id, sqrt(sum((tf * coalesce(idf, ln(n + 1.0::DOUBLE) + 1)) ** 2)) AS norm FROM term CROSS JOIN counted LEFT JOIN weight USING (t) GROUP BY k, doc_id),
dots AS (SELECT k, ix, rank, license, sum(tf * idf * m) AS dot FROM term JOIN weight USING (t) JOIN shares USING (t) GROUP BY ALL),
scored AS (SELECT doc_id, k, {{'rank': rank, 'score': round(dot / norm, 6), 'license': license}} AS b FROM normed JOIN dots USING (k)),
best AS (SELECT doc_id, k, max(b) AS b FROM scored WHERE b.score >= {threshold} GROUP BY ALL),
own AS (SELECT doc_id, max(b) AS own, count(*) AS n_segments FROM best GROUP BY doc_id),
judged AS MATERIALIZED (SELECT f.doc_id, f.path, CASE WHEN contains(path, '/') THEN regexp_replace(f.path, '/[^/]*$', '') END AS dir, is_licence_file, coalesce(n_segments, 0) AS n_segments,
  CASE WHEN stated <> '' THEN {{'rank': 2, 'score': 1.0::DOUBLE, 'license': stated}} ELSE own END AS own
  FROM (SELECT *, {stated} AS stated FROM files) f LEFT JOIN own USING (doc_id)),
held AS (SELECT dir AS ancestor, max(own) AS held FROM judged WHERE is_licence_file AND own IS NOT NULL GROUP BY dir),
nearest AS (
  SELECT doc_id, ancestor, held, row_number() OVER (PARTITION BY doc_id ORDER BY length(ancestor) DESC) AS r
  FROM judged JOIN held ON dir = ancestor OR starts_with(dir, ancestor || '/') WHERE own IS NULL)
SELECT j.doc_id, j.path, j.n_segments, j.own.license AS own_license, coalesce(j.own.license, n.held.license) AS license,
  CASE WHEN j.own IS NULL THEN n.ancestor END AS inherited_from
FROM judged j LEFT JOIN nearest n ON j.doc_id = n.doc_id AND n.r = 1"""
