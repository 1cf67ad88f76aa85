"""Licence scans: sparse TF-IDF cosine of statements to templates, then inheritance along directories.

A statement is a line of a file, or a paragraph however its lines are wrapped, that speaks of a licence or copyright, or
the whole text of a licence file. Its terms
and the templates' are weighed by inverse document frequency over the templates, a term of no template as the rarest;
the best template above a threshold names the licence. A file without one inherits from its nearest ancestor directory
that declares one: by a licence file, or else by most headers of its own files. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The texts of short licences, whole.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
#: SPDX identifiers with their whole texts, the titles of long ones, and the words of their usual short notices.
TEMPLATES = [
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_NAMES + _BSD_END),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal public domain dedication"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
TERM = r"[a-z0-9]+(?:[.+-]+[a-z0-9]+)*"
#: What makes a line a statement.
STATEMENT = r"(?i)\b(licen[cs]e[ds]?|licensing|copyright|spdx|public domain|permission (is hereby|to use)|redistribution and use|redistribute it)\b"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)(\.[a-z]+)?$"
#: What stands between paragraphs.
PARAGRAPH = r"\n[ \t\r]*\n"
THRESHOLD = 0.6


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def weights(spark) -> tuple[DataFrame, float]:
    """(template, licence, term, w) with unit length for each template, and the weight of a term of none."""
    rows = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(TEMPLATES)], "template int, licence string, t string")
    tf = rows.select("template", "licence", F.explode(terms(F.col("t"))).alias("term")).groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", (F.log((F.lit(len(TEMPLATES) + 1)) / (F.col("df") + 1)) + 1).alias("idf"))
    w = tf.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))
    return w.select("template", "licence", "term", "idf", (F.col("w") / length).alias("w")), math.log(len(TEMPLATES) + 1) + 1


def scan(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, path, licence, origin (file, header, inherited or none), declared_in, cosine.

    Of several statements of a file the one of the highest cosine counts, then the first licence by name; of a
    directory's licences that of a licence file, then the one most files state, then the first by name. A null path
    belongs to no directory; null and empty texts state nothing. Rows that repeat id, path and text share their
    result and count once in a directory. An empty table gives no rows; columns but id, text and those of ``path``
    are not read.
    """
    files = df.select(F.col(id_col).alias("id"), path.alias("path"), F.col(text_col).alias("text"))
    key = F.struct("id", "path", F.xxhash64("text").alias("t"))
    name = F.regexp_extract("path", r"[^/]*$", 0)
    files = files.withColumn("key", key).withColumn("whole", F.coalesce(name.rlike(LICENCE_FILE), F.lit(False)))
    spoken = F.filter(F.concat(F.split("text", "\n", -1), F.filter(F.split("text", PARAGRAPH, -1), lambda x: x.contains("\n"))), lambda x: x.rlike(STATEMENT))
    lines = F.when(F.col("whole"), F.concat(F.array("text"), spoken)).otherwise(spoken)
    said = files.filter(F.col("whole") | F.col("text").rlike(STATEMENT)).select("key", "whole", F.posexplode(lines).alias("n", "line")).dropDuplicates(["key", "n"])
    found = said.select("key", "whole", "n", F.explode(terms(F.col("line"))).alias("term")).groupBy("key", "whole", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    known, rarest = weights(df.sparkSession)
    known = F.broadcast(known)  # the terms of TEMPLATES, whatever the input
    idf = F.broadcast(known.select("term", "idf").distinct())
    long = found.join(idf, "term", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(rarest)))
    norms = long.groupBy("key", "n").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = long.join(known.select("term", "template", "licence", "w"), "term").groupBy("key", "whole", "n", "template", "licence").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    best = dots.join(norms, ["key", "n"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("cosine") >= THRESHOLD)
    best = best.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence", "whole")).alias("b"))
    best = materialize(best.select("key", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), F.col("b.whole").alias("by_file")))

    folder = lambda p: F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*$", ""))
    declared = best.select(folder(F.col("key.path")).alias("folder"), "licence", "by_file").filter("folder is not null")
    declared = declared.groupBy("folder", "licence").agg(F.max("by_file").alias("f"), F.count(F.lit(1)).alias("n"))
    declared = declared.groupBy("folder").agg(F.min(F.struct((~F.col("f")).alias("f"), (-F.col("n")).alias("n"), "licence")).alias("b"))
    declared = declared.select(F.col("folder").alias("declared_in"), F.col("b.licence").alias("from_folder"))
    places = files.select("id", "path", "key").withColumn("folder", folder(F.col("path")))
    depth = lambda p: F.size(F.split(p, "/", -1))
    above = places.select("folder").filter("folder is not null").distinct()
    above = above.withColumn("k", F.explode(F.sequence(F.lit(1), depth(F.col("folder")))))
    above = above.withColumn("declared_in", F.expr("array_join(slice(split(folder, '/', -1), 1, k), '/')"))
    nearest = above.join(declared, "declared_in").groupBy("folder").agg(F.max_by(F.struct("declared_in", "from_folder"), "k").alias("near"))
    out = places.join(best, "key", "left").join(nearest, "folder", "left")
    own = F.col("licence").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.coalesce("licence", "near.from_folder").alias("licence"),
        F.when(own & F.col("by_file"), "file").when(own, "header").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("near.declared_in")).alias("declared_in"),
        "cosine",
    )


def _sql() -> str:
    """The same in DuckDB SQL over ``documents``, laid out in paths, some of which are licence files."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quoted(n)}, {quoted(t)})" for k, (n, t) in enumerate(TEMPLATES))
    folder = "regexp_replace(path, '/[^/]*$', '')"
    speaks = f"lambda x: regexp_matches(x, '{STATEMENT}')"
    return f"""
WITH t(template, licence, t) AS (VALUES {values}),
tok AS (SELECT template, licence, unnest(regexp_extract_all(lower(t), '{TERM}')) AS term FROM t),
tf AS (SELECT template, licence, term, count(*) AS tf FROM tok GROUP BY ALL),
idf AS (SELECT term, ln({len(TEMPLATES) + 1} / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term),
w AS (SELECT template, licence, term, tf * idf / sqrt(sum((tf * idf) ^ 2) OVER (PARTITION BY template)) AS w FROM tf JOIN idf USING (term)),
paths AS (SELECT doc_id, concat_ws('/', source, 'part' || (doc_id // 2000), CASE WHEN coalesce(n_chars, 0) >= 600 THEN 'set' || (doc_id // 100) END,
          CASE WHEN doc_id % 97 = 5 THEN 'LICENSE' ELSE 'doc' || doc_id || '.txt' END) AS path, coalesce(doc_id % 97 = 5, false) AS whole FROM documents),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS line
          FROM (SELECT doc_id, list_concat(CASE WHEN whole THEN [text] ELSE [] END, list_filter(list_concat(string_split(text, chr(10)),
                list_filter(regexp_split_to_array(text, '{PARAGRAPH}'), lambda x: contains(x, chr(10)))), {speaks})) AS ls FROM documents JOIN paths USING (doc_id))),
dtok AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM lines) GROUP BY ALL),
v AS (SELECT doc_id, n, term, tf * coalesce(idf, ln({len(TEMPLATES) + 1}) + 1) AS v FROM dtok LEFT JOIN idf USING (term)),
norms AS (SELECT doc_id, n, sqrt(sum(v * v)) AS norm FROM v GROUP BY ALL),
dots AS (SELECT doc_id, n, licence, template, sum(v * w) AS dot FROM v JOIN w USING (term) GROUP BY ALL),
best AS (SELECT doc_id, licence, cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) AS r
         FROM (SELECT doc_id, licence, round(dot / norm, 6) AS cosine FROM dots JOIN norms USING (doc_id, n)) WHERE cosine >= {THRESHOLD}) WHERE r = 1),
stated AS (SELECT {folder} AS folder, licence, bool_or(whole) AS f, count(*) AS n FROM best JOIN paths USING (doc_id) GROUP BY ALL),
declared AS (SELECT folder AS declared_in, licence AS from_folder FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY f DESC, n DESC, licence) AS r FROM stated) WHERE r = 1),
near AS (SELECT folder, declared_in, from_folder FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY length(declared_in) DESC) AS r
         FROM (SELECT DISTINCT {folder} AS folder FROM paths) JOIN declared ON folder = declared_in OR starts_with(folder, declared_in || '/')) WHERE r = 1)
SELECT p.doc_id, p.path, coalesce(b.licence, n.from_folder, 'none') AS licence,
  CASE WHEN b.licence IS NOT NULL THEN CASE WHEN whole THEN 'file' ELSE 'header' END WHEN n.folder IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN b.licence IS NULL THEN coalesce(n.declared_in, '') ELSE '' END AS declared_in, coalesce(b.cosine, 0) AS cosine
FROM paths p LEFT JOIN best b USING (doc_id) LEFT JOIN near n ON n.folder = regexp_replace(p.path, '/[^/]*$', '')
"""


SQL = _sql()
