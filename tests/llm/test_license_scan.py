import math
import re
import textwrap
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from siltstone.llm import license_scan as ls
from siltstone.llm.queries import document_path, op8_license_scan


def brute(rows):
    cut = lambda t: re.findall(ls.TERM, t.lower())
    counts = [Counter(cut(t)) for _, t in ls.TEMPLATES]
    df = Counter(w for c in counts for w in c)
    n = len(counts)
    idf = {w: math.log((n + 1) / (k + 1)) + 1 for w, k in df.items()}
    rare = math.log(n + 1) + 1
    norm = lambda c: math.sqrt(sum((k * idf.get(w, rare)) ** 2 for w, k in c.items()))

    def own(path, text):
        whole = bool(path and re.search(ls.LICENCE_FILE.replace("(?i)", ""), path.rsplit("/", 1)[-1], re.I))
        parts = (text or "").split("\n") + [x for x in re.split(ls.PARAGRAPH, text or "") if "\n" in x]
        lines = [text] * whole + [x for x in parts if re.search(ls.STATEMENT.replace("(?i)", ""), x, re.I)]
        found = []
        for line in lines:
            c = Counter(cut(line or ""))
            for t, (name, _) in zip(counts, ls.TEMPLATES):
                dot = sum(k * idf.get(w, rare) * t[w] * idf.get(w, rare) for w, k in c.items())
                if dot and round(dot / norm(c) / norm(t), 6) >= ls.THRESHOLD:
                    found.append((-round(dot / norm(c) / norm(t), 6), name))
        return (min(found), whole) if found else None

    owned = {k: own(p, t) for k, (_, p, t) in enumerate(rows)}
    folders = {}
    for key in {(i, p, t) for i, p, t in rows}:
        found = own(key[1], key[2])
        if found and key[1] and "/" in key[1]:
            c = folders.setdefault(key[1].rsplit("/", 1)[0], Counter())
            c[found[0][1]] += 1
            c["file", found[0][1]] |= found[1]
    declared = {}
    for f, c in folders.items():
        names = [x for x in c if isinstance(x, str)]
        declared[f] = min(names, key=lambda x: (not c["file", x], -c[x], x))
    out = []
    for k, (i, p, _) in enumerate(rows):
        if owned[k]:
            out.append((i, p, owned[k][0][1], "file" if owned[k][1] else "header", None, -owned[k][0][0]))
            continue
        f = p.rsplit("/", 1)[0] if p and "/" in p else None
        while f is not None and f not in declared:
            f = f.rsplit("/", 1)[0] if "/" in f else None
        out.append((i, p, declared.get(f), "inherited" if f else "none", f, None))
    return sorted(out, key=str)


def test_against_brute_force(documents):
    df = documents.withColumn("p", document_path())
    got = sorted((tuple(r) for r in ls.scan(documents, document_path()).collect()), key=str)
    want = brute([(r.doc_id, r.p, r.text) for r in df.collect()])
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(a[5] is None and b[5] is None or abs(a[5] - b[5]) < 1e-5 for a, b in zip(got, want))
    assert {"MIT", "GPL-3.0", "Apache-2.0", "CC-BY-NC-4.0"} <= {x[2] for x in got}


def test_against_sql(documents):
    duck = duckdb.connect()
    duck.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    assert sorted(map(tuple, op8_license_scan(documents.sparkSession, "/root/testdata/sf0.01").collect()), key=str) == sorted(duck.sql(ls.SQL).fetchall(), key=str)


def test_folders(spark):
    rows = [
        (1, "r/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (2, "r/a.c", "no statement"),
        (3, "r/x/y/b.c", "nor here"),
        (4, "r/x/c.c", "// Licensed under the Apache License, Version 2.0."),
        (5, "r/x/d.c", None),
        (6, "other/e.c", ""),
        (7, None, "Released under the MIT License."),
        (8, "top.c", "x"),
        (4, "r/x/c.c", "// Licensed under the Apache License, Version 2.0."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string")
    got = sorted((tuple(r) for r in ls.scan(df, F.col("p")).collect()), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in brute(rows)]
    assert [(x[2], x[3]) for x in got if x[0] == 3] == [("Apache-2.0", "inherited")]


def test_whole_licence_files_and_wrapped_headers(spark):
    wrap = lambda t, n=60, lead="": "\n".join(lead + x for x in textwrap.wrap(t, n))
    title = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n\n" + "The precise terms follow. " * 300
    notice = dict(ls.TEMPLATES[7:8])["Apache-2.0"]
    rows = [
        (1, "mit/LICENSE", "The MIT License\n\nCopyright (c) 2020 Some Body\n\n" + wrap(ls._MIT)),
        (2, "isc/LICENSE.md", "Copyright (c) 2019, A. Person\n\n" + wrap(ls._ISC)),
        (3, "bsd2/COPYING", "Copyright 2011 Maker\n\n" + wrap(ls._BSD_START + ls._BSD_END)),
        (4, "bsd3/COPYING", "Copyright 2011 Maker\n\n" + wrap(ls._BSD_START + ls._BSD_NAMES + ls._BSD_END)),
        (5, "gpl/COPYING", title),
        (6, "code/a.c", "/*\n" + wrap(notice, 50, " * ") + "\n */\n\nint main() {}\n"),
        (7, "mit/src/b.c", "int x;"),
        (8, "plain/c.c", "/* nothing\n about it */"),
    ]
    got = sorted((r.id, r.licence, r.origin) for r in ls.scan(spark.createDataFrame(rows, "id long, p string, text string"), F.col("p"), "id").collect())
    assert got == [
        (1, "MIT", "file"), (2, "ISC", "file"), (3, "BSD-2-Clause", "file"), (4, "BSD-3-Clause", "file"), (5, "GPL-3.0", "file"),
        (6, "Apache-2.0", "header"), (7, "MIT", "inherited"), (8, None, "none"),
    ]


def test_odd_rows(odd, empty):
    assert ls.scan(odd, document_path()).count() == odd.count()
    assert ls.scan(empty, document_path()).count() == 0
