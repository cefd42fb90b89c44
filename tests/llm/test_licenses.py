"""License scans: cosines against brute force, whole licence files, negations, quotations, and inheritance."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses
from tidemark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def brute_pieces(text):
    """Lines, paragraphs and the whole, with whether each opens the text."""
    lines = [(k, x) for k, x in enumerate(text.split("\n")) if licenses.terms(x)]
    blocks = []
    for k, x in lines:
        if blocks and blocks[-1][-1][0] == k - 1:
            blocks[-1].append((k, x))
        else:
            blocks.append([(k, x)])
    first = lines[0][0] if lines else None
    return [(0, k, x, k == first) for k, x in lines] + [(1, b[0][0], "\n".join(x for _, x in b), b[0][0] == first) for b in blocks] + [(2, -1, text, True)]


def brute_best(text, idf, unseen):
    """Own licence, cosine, line, and whether the text is a licence file: every piece with every template."""
    found, top = [], False
    for kind, k, piece, opens in brute_pieces(text):
        a = Counter(licenses.terms(piece))
        for name, template in licenses.TEMPLATES:
            b = Counter(licenses.terms(template))
            if len(a & b) < min(3, len(b)) or piece.strip()[:1] in tuple(licenses.QUOTES) or any(t in a and t not in b for t in licenses.NEGATIONS):
                continue
            wa, wb = ({t: n * idf.get(t, unseen) for t, n in x.items()} for x in (a, b))
            cosine = sum(w * wb.get(t, 0) for t, w in wa.items()) / math.sqrt(sum(w * w for w in wa.values()) * sum(w * w for w in wb.values()))
            if round(cosine, 9) >= licenses.LEAST:
                found.append((name == "Proprietary", -round(cosine, 9), name, kind, k))
                top = top or opens
    return (min(found)[2], -min(found)[1], min(found)[4], top) if found else None


MIT_FILE = "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + (licenses._MIT + "\n\n" + licenses._MIT_REST).replace(", ", ",\n")
BSD_FILE = "Copyright (c) 2011, Jane Doe\nAll rights reserved.\n\n" + licenses._BSD + "\n\n" + licenses._BSD_TWO + licenses._BSD_THREE + "\n\n" + licenses._BSD_REST
APACHE_FILE = "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE\n\n" + "   many clauses follow here, of which this is one\n" * 200
GPL_FILE = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n\n" + "  The licenses for most software and other practical works are long.\n" * 300
GPL_2_FILE = GPL_FILE.replace("Version 3, 29 June 2007", "Version 2, June 1991")
WRAPPED = "/*\n * Licensed under the Apache License,\n * Version 2.0.\n */\nint main"
NOT_OWN = ["This is not released under the MIT License.", "\"Released under the MIT License.\" is what it says there", "> Released under the MIT License.", "It isn't licensed under the Apache License, Version 2.0.", "license", "the MIT", "copyright of the work"]


def test_cosines_against_brute_force(spark):
    texts = ["Released under the MIT License.", "some prose\nLicensed under CC BY-NC 4.0.\nmore", "nothing here", None, "", "apache license version 2.0 " * 3, "the license of the work", "copyright",
             "SPDX-License-Identifier: GPL-3.0-only\n" + "x y z\n" * 200, MIT_FILE, BSD_FILE, APACHE_FILE, GPL_FILE, GPL_2_FILE, WRAPPED, *NOT_OWN, "words\n\n" * 5 + "ISC License", "x " * 200_000 + "MIT"]
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in enumerate(texts)], "doc_id long, text string, line int, path string").repartition(3)
    held = [set(licenses.terms(x or "")) for x in texts]
    idf = {t: math.log((1 + len(texts)) / (1 + sum(t in h for h in held))) + 1 for t in set().union(*held)}
    unseen = math.log(1 + len(texts)) + 1
    got = {r.doc_id: r for r in licenses.scan(docs, F.concat(F.lit("d"), F.col("doc_id")), F.lit("n")).collect()}
    for i, x in enumerate(texts):
        want = brute_best(x or "", idf, unseen)
        assert (got[i].own_license, got[i].line) == (want[0] if want else None, want[2] if want else None), (i, want, got[i])
        assert got[i].score == (pytest.approx(min(want[1], 1.0)) if want else None)
    own = [got[i].own_license for i in range(len(texts))]
    assert own[:15] == ["MIT", "CC-BY-NC-4.0", None, None, None, "Apache-2.0", None, None, "GPL-3.0", "MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "GPL-2.0", "Apache-2.0"]
    assert own[15:22] == [None] * 7 and own[22:] == ["ISC", None]


@pytest.mark.parametrize("n", [300, 3000])
def test_common_words_in_a_notice_weigh_little_at_any_table_size(spark, n):
    notices = ["Released under the MIT License from that.", "This work is licensed under the GNU General Public License, version 3, or from that on.", "Released under the MIT License zyx wvu tsr qpo nml."]
    texts = notices + ["taken from that place" if k % 3 else "nothing here" for k in range(n - len(notices))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in licenses.scan(df, F.lit("d"), F.lit("n")).collect()}
    held = [set(licenses.terms(t)) for t in texts]
    idf = {t: math.log((1 + n) / (1 + sum(t in h for h in held))) + 1 for t in set().union(*held)}
    for k, t in enumerate(notices):
        want = brute_best(t, idf, math.log(1 + n) + 1)
        assert (got[k].own_license, got[k].score) == ((want[0], pytest.approx(want[1])) if want else (None, None))
    assert [got[k].own_license for k in range(3)] == ["MIT", "GPL-3.0", None] and len(got) == n


@pytest.mark.parametrize(("text", "name"), [(MIT_FILE, "MIT"), (APACHE_FILE, "Apache-2.0"), (GPL_FILE, "GPL-3.0"), (GPL_2_FILE, "GPL-2.0"), (BSD_FILE, "BSD-3-Clause"), ("MIT License", "MIT")])
def test_siblings_and_folders_below_inherit_from_licence_files(spark, text, name):
    rows = [(0, "a/b", "LICENSE", text), (1, "a/b", "x.py", "code"), (2, "a/b/c/d", "y.py", "code"), (3, "a", "z.py", "code"), (4, "a/b/c/d", "w.py", "some code\n" * 30 + WRAPPED)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, dir string, name string, text string"), F.col("dir"), F.col("name")).collect()}
    assert [(got[i].license, got[i].inherited_from) for i in range(5)] == [(name, None), (name, "a/b"), (name, "a/b"), (None, None), ("Apache-2.0", None)]


def test_what_is_no_licence_of_its_own_gives_none(spark):
    rows = [(i, t) for i, t in enumerate(NOT_OWN)] + [(99, "code")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), F.lit("d"), F.col("doc_id").cast("string")).collect()
    assert all(r.own_license is None and r.license is None for r in got)


def test_nearest_ancestor_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("a", "LICENSE", mit), ("a", "x.py", "code"), ("a/b", "y.py", "code"), ("a/b/c", "COPYING", gpl), ("a/b/c/d", "z.py", None), ("a/b/c/d", "own.py", "prose first that goes on for quite a while\n" + mit), ("q", "lost.py", "code"), ("a/b/c", "COPYING", gpl)]
    rows += [("tie", "L1", mit), ("tie", "L2", gpl), ("tie", "t.py", "code")]
    df = spark.createDataFrame([(i, d, n, t, "x") for i, (d, n, t) in enumerate(rows)], "doc_id long, dir string, name string, text string, license string")
    got = {r.doc_id: r for r in licenses.scan(df, F.col("dir"), F.col("name")).collect()}
    assert [(got[i].license, got[i].inherited_from) for i in (1, 2, 4, 5, 6)] == [("MIT", "a"), ("MIT", "a"), ("GPL-3.0", "a/b/c"), ("MIT", None), (None, None)]
    assert got[10].license == "GPL-3.0" and got[4].path == "a/b/c/d/z.py" and got[5].line == 1
    assert licenses.scan(df.limit(0), F.col("dir"), F.col("name")).count() == 0


def test_license_lines_of_the_test_data(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op10_license_scan"](spark, DATA).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        assert (got[i].own_license is not None) == bool(re.search(r"(?i)licen[sc]e|all rights reserved", t or ""))
