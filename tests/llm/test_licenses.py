import math
import re
from collections import Counter

from stopwise.llm import licenses as m

FILES = "doc_id long, path string, text string, row long, license string"


def scanned(spark, files):
    rows = m.scan(spark.createDataFrame([(*f, 1, "x") for f in files], FILES)).collect()
    return {r.doc_id: r for r in rows}


def test_similarity_equals_brute_force(spark):
    texts = {
        1: "some code\n# Licensed under the Apache License, Version 2.0.\nmore code here",
        2: "/* Licensed under CC-BY-NC 4.0 by somebody */", 3: "no notice at all",
        4: "the license of this house\nlicensed plumber", 5: "Released under the MIT License.", 6: None, 7: "",
    }
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    n = len(texts)
    df = Counter(w for t in texts.values() for w in set(words(t)))
    known = {w for _, t in m.NOTICES for w in words(t)}
    idf = lambda w: math.log((n + 2) / (df[w] + 1)) if w in known else math.log(n + 2)

    def cosine(a, b):
        a, b = Counter(words(a)), Counter(words(b))
        norm = lambda c: math.sqrt(sum((k * idf(w)) ** 2 for w, k in c.items()))
        return sum(a[w] * b[w] * idf(w) ** 2 for w in a) / (norm(a) * norm(b))

    got = scanned(spark, [(i, f"d{i}/f", t) for i, t in texts.items()])
    for i, text in texts.items():
        lines = [x for x in (text or "").split("\n") if re.search(m.MARKER, x)]
        best = max(((cosine(x, t), name) for x in lines for name, t in m.NOTICES), default=(0, None))
        if best[0] >= m.HEADER_SIMILARITY:
            assert got[i].license == best[1] and got[i].origin in ("header", "file")
        else:
            assert got[i].license is None
    assert got[1].license == "Apache-2.0" and got[5].license == "MIT" and got[4].license is None


def test_nearest_licensed_ancestor_is_inherited(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    got = scanned(spark, [
        (1, "a/LICENSE", mit + "\n" + "lorem ipsum dolor " * 30), (2, "a/x.py", "code"), (3, "a/b/COPYING", gpl),
        (4, "a/b/c/d/y.py", "code"), (5, "a/bb/z.py", "code"), (6, "other/w.py", "code"), (7, "a/b/own.py", f"code {'word ' * 9}\n# {mit}\n"),
        (8, None, "code"), (9, "top.py", "code"), (10, "/a//b/c/q.py", "code"),
    ])
    assert (got[1].license, got[1].origin) == ("MIT", "file")
    assert (got[2].license, got[2].origin, got[2].from_doc) == ("MIT", "directory", 1)
    assert (got[4].license, got[4].from_doc) == ("GPL-3.0", 3) and got[10].license == "GPL-3.0"
    assert (got[5].license, got[5].from_doc) == ("MIT", 1)
    assert (got[7].license, got[7].origin) == ("MIT", "header")
    assert {got[i].license for i in (6, 8, 9)} == {None}


def test_odd_rows(spark, odd_docs, no_docs):
    path = odd_docs.withColumnRenamed("source", "path")
    assert m.scan(path).count() == odd_docs.count()
    assert m.scan(no_docs.withColumnRenamed("source", "path")).collect() == []


def test_full_texts_wrapped_headers_and_identifiers(spark):
    texts = dict(m.NOTICES[-17:])
    mit = texts["MIT"].replace("<year> <copyright holders>", "2019 Ann Example")
    lesser = next(t for n, t in m.NOTICES if n == "LGPL-2.1" and len(t) < 1000).replace("program", "library")
    wrap = lambda t: "\n".join(f" * {' '.join(t.split()[i : i + 9])}" for i in range(0, len(t.split()), 9))
    got = scanned(spark, [
        (1, "a/one", mit), (2, "a/x.py", "code"), (3, "b/two", texts["GPL-3.0"]), (4, "c/y.c", f"/*\n{wrap(lesser)}\n */\n\nint main;"),
        (5, "d/z.c", "// SPDX-License-Identifier: MIT\ncode"), (6, "e/v.c", "# SPDX-License-Identifier: Zlib OR MIT"),
        (7, "f/isc", texts["ISC"]), (8, "g/w.c", "int a;\n// Permission to use, copy, modify, and/or distribute this software for any"),
    ])
    assert [(got[i].license, got[i].origin) for i in (1, 3, 7)] == [("MIT", "file"), ("GPL-3.0", "file"), ("ISC", "file")]
    assert (got[2].license, got[2].origin, got[2].from_doc) == ("MIT", "directory", 1)
    assert [(got[i].license, got[i].origin) for i in (4, 8)] == [("LGPL-2.1", "header"), ("ISC", "header")]
    assert [got[i].license for i in (5, 6)] == ["MIT", "Zlib OR MIT"]


def test_full_texts_are_read_from_an_archive(spark):
    import subprocess
    import sys
    import zipfile

    from stopwise.llm import common

    common.shipped(spark)
    archive = next(p for p in spark.sparkContext._python_includes if p.endswith("stopwise.zip"))
    path = f"{__import__('pyspark').SparkFiles.getRootDirectory()}/{archive}"
    assert any(n.endswith("texts/MIT.txt") for n in zipfile.ZipFile(path).namelist())
    code = "from stopwise.llm import licenses as m; print(m.__file__); print(len(m.TEXTS))"
    out = subprocess.run(
        [sys.executable, "-c", f"import sys; sys.path.insert(0, {path!r}); {code}"],
        capture_output=True, text=True, check=True, cwd="/",
    ).stdout.split()
    assert out == [f"{path}/stopwise/llm/licenses.py", str(len(m.TEXTS))]
