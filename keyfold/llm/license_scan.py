"""Licence scan: TF-IDF cosine to templates, then inheritance from directories. DataFrame functions only.

A text is compared with templates by the cosine of sparse TF-IDF vectors: as a
whole, line by line, and, so that neighbouring words dilute nothing and line
breaks do not matter, in sliding windows of a template's size and a third more
around every anchor word. A file's own licence is that of its best match at or
above ``threshold``. The families of licences among the templates are the
documents of the inverse document frequency; a word that none has gets the largest.
A match also holds all deciding words of its template (names, versions,
modifiers) and none of the modifiers that stand for a sibling licence, the word
after a window included: a text with "NC" is not CC BY, "LGPL 2.1" not LGPL 2.
A lower rank wins first: SPDX tags (taken as stated, score 1), titles of
licence files, then grants and whole texts, then wording that several licences share, last "All
rights reserved." (``LicenseRef-Proprietary``), which open licences contain too.

Every template has an anchor word; texts and lines without any are dropped
before any vector is made, and windows are made around anchors only.

A file named as a licence file gives its licence to its directory. Each
directory takes the licence of its nearest ancestor that has one, itself first:
directories, not files, are expanded to their ancestors and joined by path; a
file without a licence of its own takes its directory's.

Edge cases: a null or empty text has no licence of its own; ties between
templates of a rank go to the smaller name; several licence files in one directory: the
best score, then the smaller name; a null path lies in the root directory;
repeated rows are scanned one by one; an empty table gives an empty table;
extra columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import cut

#: SPDX identifiers, and the titles by which licence files state them.
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: Phrases by which headers, notices and licence files grant a licence.
GRANTS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License version 3"),
    ("ISC", "for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Whole licence texts, compared with whole files and lines.
WHOLE = [
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]
#: Wording that licences with more clauses contain too.
SHARED = [("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted")]
LAST = [("LicenseRef-Proprietary", "All rights reserved.")]
#: Short and long forms of licences that differ in a few words only.
_MODS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GNU = [("GPL", "", "1"), ("GPL", "", "2"), ("GPL", "", "3"), ("LGPL", "Library", "2"), ("LGPL", "Lesser", "2.1"), ("LGPL", "Lesser", "3"), ("AGPL", "Affero", "3")]
_id = lambda name, version: f"{name}-{version if '.' in version else version + '.0'}"
SIBLINGS = [
    *[(f"CC-{m}-{v}", form) for m, words in _MODS.items() for v in ("1.0", "2.0", "2.5", "3.0", "4.0") for form in (f"CC {m} {v}", f"Creative Commons {words} {v}")],
    *[(_id(x, v), form) for x, mod, v in _GNU for form in (f"GNU {mod} General Public License version {v}", f"GNU {mod} General Public License v{v}", f"{x} version {v}", f"{x} {v}", f"{x} v{v}", f"{x}v{v}", f"version {v} of the GNU {mod} General Public License", f"GNU {mod} General Public License as published by the Free Software Foundation; either version {v} of the License")],
    ("Apache-2.0", "Apache 2.0"),
    ("Apache-2.0", "Apache License v2.0"),
    ("Apache-1.1", "Apache Software License Version 1.1"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BSL-1.0", "Boost Software License Version 1.0"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("EPL-1.0", "Eclipse Public License v 1.0"),
    ("EPL-2.0", "Eclipse Public License v 2.0"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
]
TITLES += [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("MIT-0", "MIT No Attribution"),
]
GRANTS += SIBLINGS
TEMPLATES = TITLES + GRANTS + WHOLE + SHARED + LAST
RANK = {text: rank for rank, group in enumerate((TITLES, GRANTS + WHOLE, SHARED, LAST)) for _, text in group}
#: Every template has one of these words; the first one of a template is its anchor.
ANCHORS = "gnu gpl lgpl agpl gplv1 gplv2 gplv3 lgplv2 lgplv3 agplv3 apache mozilla eclipse boost commons cc0 cc unencumbered advertising endorse redistribution fee granted bsd license attribution reserved".split()
#: Words without which a match does not count, if the template has them.
NEEDED = {*ANCHORS, "general", "mit", "universal", "attribution", "by", "clause", "style", "no", "organization", "sublicense", "provided", "all", "rights", "january", "february", "june", "november"}
#: Words that tell siblings of a family apart: a match has those of its template and no others.
DECIDING = {
    "GPL": "lesser library affero 1 2 3 v1 v2 v3".split(),
    "CC": "nc noncommercial commercial sa sharealike alike nd noderivatives noderivs derivatives 1 2 3 4 5".split(),
    "Apache": "1 2 v1 v2".split(),
    "MPL": "1 2".split(),
    "EPL": "1 2".split(),
    "BSD": "neither endorse advertising".split(),
}
LICENCE_FILE = "(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
WORD = "[\\p{L}\\p{N}]+"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+-]+)*)"
THRESHOLD = 0.7
#: Templates of more words are compared with whole texts and lines only.
WINDOW = 40
#: Parts into which the files of one directory are split when they are joined to its licence.
SALTS = 32


def _family(name: str) -> str:
    return re.sub("^[LA]GPL", "GPL", re.split("[-0-9]", name)[0])


class Matcher:
    """TF-IDF vectors of templates, and the column expression that scores a text by them."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        bags = [Counter(self.tokens(text)) for _, text in templates]
        families = [{w for b, (n, _) in zip(bags, templates) if _family(n) == f for w in b} for f in sorted({_family(n) for n, _ in templates})]
        df = Counter(w for f in families for w in f)
        self.most = math.log(1 + len(families)) + 1
        self.idf = {w: math.log((1 + len(families)) / (1 + n)) + 1 for w, n in sorted(df.items())}
        self.templates: dict[tuple, tuple] = {}
        for b, (name, text) in zip(bags, templates):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in b.items()))
            anchor = next(w for w in ANCHORS if w in b)
            need = [anchor, *sorted(w for w in b if w in NEEDED and w != anchor)]
            # The numbered clauses of whole texts and the dates of titles are no versions.
            deciding = [w for w in DECIDING.get(_family(name), []) if b.total() <= WINDOW or not w.isdigit()]
            need += [w for w in deciding if w in b and w not in need]
            ban = [w for w in deciding if w not in b]
            short = b.total() <= WINDOW
            sizes = [b.total(), b.total() + b.total() // 3 + 1] if short else []
            weights = {w: n * self.idf[w] ** 2 / norm for w, n in sorted(b.items())}
            # Templates with the same words are one.
            key = (name, *sorted(b.items()))
            rank = min(RANK.get(text, 1), self.templates[key][1] if key in self.templates else 9)
            self.templates[key] = (name, rank, need, ban, sizes, weights)
        self.reach = max(s for t in self.templates.values() for s in t[4]) - 1
        self.anchors = sorted({t[2][0] for t in self.templates.values()})

    @staticmethod
    def tokens(text: str) -> list[str]:
        return re.findall(r"[^\W_]+", text.lower().replace("licenc", "licens"))

    def cosine(self, text: str) -> tuple[float, str | None]:
        """The same in Python: (cosine of the best match, licence), (0, None) if no match reaches the threshold."""
        if tag := re.search(SPDX, text):
            return 1.0, tag[1]
        words = self.tokens(text)
        wholes = [words, *map(self.tokens, re.split("\r?\n", text))]
        nears = [words[max(0, i - self.reach) : max(0, i - self.reach) + 2 * self.reach + 2] for i, w in enumerate(words) if w in self.anchors]
        found = []
        for name, rank, need, ban, sizes, weights in self.templates.values():
            for c, wide in [(c, c) for c in wholes] + [(near[s : s + n], near[s : s + n + 1]) for near in nears for n in sizes for s in range(len(near) - n + 1)]:
                if set(need) <= set(c) and not set(ban) & set(wide):
                    norm = math.sqrt(sum((n * self.idf.get(w, self.most)) ** 2 for w, n in Counter(c).items()))
                    score = round(sum(weights.get(w, 0.0) for w in c) / norm, 9)
                    if score >= self.threshold:
                        found.append((rank, -score, name))
        return (-min(found)[1], min(found)[2]) if found else (0.0, None)

    def best_line(self, text: Column) -> Column:
        """struct(score, licence) of the best match, null if none reaches the threshold."""
        lower = F.regexp_replace(F.lower(text), "licenc", "licens")
        must = "(?<![\\p{L}\\p{N}])(?:" + "|".join(self.anchors) + ")(?![\\p{L}\\p{N}])"
        literal = lambda words: F.array(*[F.lit(w) for w in words]).cast("array<string>")
        table = lambda d: F.create_map(*[F.lit(x) for wx in d.items() for x in wx])
        anchors, idf = literal(self.anchors), table(self.idf)
        weight = lambda w: F.coalesce(F.element_at(idf, w), F.lit(self.most))
        split = lambda line: F.regexp_extract_all(line, F.lit(WORD), F.lit(0))
        templates = F.array(*[
            F.struct(F.lit(name).alias("licence"), F.lit(rank).alias("rank"), literal(need).alias("need"), literal(ban).alias("ban"), F.array(*[F.lit(n) for n in sizes]).cast("array<int>").alias("sizes"), table(weights).alias("weights"))
            for name, rank, need, ban, sizes, weights in self.templates.values()
        ])

        def norm(words: Column) -> Column:
            """Length of the vector, over its sorted words run by run."""
            start = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
            close = lambda s: s["sum"] + F.pow(s["n"] * weight(s["w"]), F.lit(2.0))
            step = lambda s, w: F.when(s["w"] == w, F.struct(s["w"].alias("w"), (s["n"] + 1.0).alias("n"), s["sum"].alias("sum"))).otherwise(F.struct(w.alias("w"), F.lit(1.0).alias("n"), close(s).alias("sum")))
            return F.aggregate(F.array_sort(words), start, step, lambda s: F.sqrt(close(s)))

        def holds(words: Column, t: Column) -> Column:
            return F.forall(t["need"], lambda w: F.array_contains(words, w))

        def rated(words: Column, t: Column) -> Column:
            dot = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(F.element_at(t["weights"], w), F.lit(0.0)))
            return F.struct(t["rank"].alias("rank"), (-F.round(dot / norm(words), 9)).alias("cost"), t["licence"].alias("licence"))

        def best(candidates: Column, t: Column) -> Column:
            fit = F.filter(candidates, lambda c: holds(c["words"], t) & ~F.arrays_overlap(c["wide"], t["ban"]))
            return F.array_min(F.filter(F.transform(fit, lambda c: rated(c["words"], t)), lambda r: -r["cost"] >= self.threshold))

        def windows(near: Column, t: Column) -> Column:
            starts = lambda n: F.when(F.size(near) >= n, F.sequence(F.lit(1), F.size(near) - n + 1)).otherwise(F.array().cast("array<int>"))
            return F.flatten(F.transform(t["sizes"], lambda n: F.transform(starts(n), lambda i: F.struct(F.slice(near, i, n).alias("words"), F.slice(near, i, n + 1).alias("wide")))))

        def scored(words: Column) -> Column:
            wholes = F.concat(F.array(words), F.transform(F.filter(F.split(lower, "\r?\n"), lambda line: line.rlike(must)), split))
            places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(anchors, w), i + 1)), lambda i: i.isNotNull())
            first = lambda i: F.greatest(i - self.reach, F.lit(1))
            nears = F.array_distinct(F.transform(places, lambda i: F.slice(words, first(i), F.lit(2 * self.reach + 2))))
            each = lambda units, make: F.flatten(F.transform(units, lambda u: F.transform(F.filter(templates, lambda t: holds(u, t)), lambda t: best(make(u, t), t))))
            return F.array_min(F.concat(each(wholes, lambda u, t: F.array(F.struct(u.alias("words"), u.alias("wide")))), each(nears, windows)))

        # Through arrays of one, so that the words and the best match are worked out once.
        found = F.transform(F.transform(F.array(split(lower)), scored), lambda b: F.when(b.isNotNull(), F.struct((-b["cost"]).alias("score"), b["licence"].alias("licence"))))
        tag = F.regexp_extract(text, SPDX, 1)
        stems = sorted({w for a in self.anchors for w in ([a] if a != "license" else ["licens", "licenc"])})
        some = reduce(or_, [F.lower(text).contains(w) for w in stems])
        return F.when(F.lower(text).contains("spdx-license-identifier") & (tag != ""), F.struct(F.lit(1.0).alias("score"), tag.alias("licence"))).when(some & lower.rlike(must), F.get(found, F.lit(0)))


def scan(files: DataFrame, path: str = "path", matcher: Matcher | None = None) -> DataFrame:
    """doc_id, path, own_licence, own_score, licence, origin ("own", the giving directory, or null) of every row."""
    matcher = matcher or Matcher()
    full = F.coalesce(F.col(path).cast("string"), F.lit(""))
    rows = files.select(F.col("doc_id"), full.alias("path"), matcher.best_line(F.col("text")).alias("own"))
    rows = cut(rows.select("doc_id", "path", "own", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE).alias("gives")))
    given = rows.where("gives and own is not null").groupBy("dir").agg(F.min(F.struct((-F.col("own.score")).alias("cost"), F.col("own.licence").alias("licence"))).alias("best")).select(F.col("dir").alias("above"), F.col("best.licence").alias("licence"))
    # Ancestors of a directory, each with its depth: itself, and every prefix before a slash.
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    root = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above")))
    dirs = rows.select("dir").distinct().select("dir", F.inline(F.concat(root, above)))
    nearest = dirs.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "licence")).alias("near"))
    # A directory may hold any share of the files: they meet its licence in SALTS parts.
    part = F.pmod(F.xxhash64("doc_id", "path"), F.lit(SALTS))
    shares = rows.select(F.col("dir").alias("__dir"), part.alias("__part")).distinct().join(nearest, F.col("__dir") == F.col("dir")).drop("dir")
    out = rows.join(shares, (F.col("dir") == F.col("__dir")) & (part == F.col("__part")), "left")
    return out.select("doc_id", "path", F.col("own.licence").alias("own_licence"), F.col("own.score").alias("own_score"), F.coalesce("own.licence", "near.licence").alias("licence"), F.when(F.col("own").isNotNull(), F.lit("own")).otherwise(F.col("near.above")).alias("origin"))


def file_path() -> Column:
    """A tree over ``documents``: directories of 1000 ids, source, language, then of 200 ids. A tenth of the files in each
    source are licence files of their leaf, a tenth of the language, a tenth of the source; a fiftieth, of the 1000 ids."""
    div = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    top, source, lang, leaf = div(1000), F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), div(200)
    turn, notice = F.floor(F.col("doc_id") / 20) % 50, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))
    return (
        F.when(turn == 49, F.concat_ws("/", top, notice))
        .when(turn % 10 == 6, F.concat_ws("/", top, source, notice))
        .when(turn % 10 == 3, F.concat_ws("/", top, source, lang, notice))
        .when(turn % 10 == 0, F.concat_ws("/", top, source, lang, leaf, notice))
        .otherwise(F.concat_ws("/", top, source, lang, leaf, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    )
