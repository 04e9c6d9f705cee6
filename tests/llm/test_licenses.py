import random
import re

import pytest
from pyspark.sql import functions as F

from stowage.llm.licenses import TEMPLATES, licenses

SCHEMA = "doc_id bigint, text string, uid int, license string, template int"


def tokens(text):
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, templates=TEMPLATES):
    out = []
    for i, t in rows:
        w = tokens(t)
        places = {}
        for k in range(len(w) - 4):
            places.setdefault(tuple(w[k:k + 5]), []).append(k)
        best = {}
        for n, (name, body) in enumerate(templates):
            tw = tokens(body)
            s = {tuple(tw[k:k + 5]) for k in range(len(tw) - 4)}
            hit = s & places.keys()
            if s and len(hit) / len(s) >= 0.8:
                at = [k for h in hit for k in places[h]]
                best[name] = max(best.get(name, (0,)), (len(hit) / len(s), len(hit), -n, min(at), max(at) + 5))
        out += [(i, name, b[0], b[1], b[3], b[4]) for name, b in best.items()]
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    noise = lambda n: " ".join(rng.choice(["the", "under", "license", "mit", "version", "of", "this"]) for _ in range(n))
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(3)):
            w = rng.choice(TEMPLATES)[1].split()
            if rng.random() < 0.5 and len(w) > 20:
                w[rng.randrange(len(w))] = "other"
            parts += [noise(rng.randrange(9)), "  ".join(w).upper() if rng.random() < 0.3 else "\n".join(w)]
        rows.append((i, " ".join([*parts, noise(rng.randrange(30))])))
    rows += [(200, None), (201, ""), (202, "MIT"), (203, "é" * 100_000 + " Released under the MIT License."), (None, TEMPLATES[2][1]),
             (3, TEMPLATES[0][1]), (3, TEMPLATES[0][1])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    out = licenses(df)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty_table_and_odd_templates(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert licenses(df).count() == 0
    assert licenses(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string"), [("X", "a b c")]).count() == 0


def test_every_license_line_of_documents_gets_a_row(spark):
    """The lines are found by a plain search, not by the templates."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("text").rlike("(?i)licen[sc]e"))
    found = {r.doc_id for r in licenses(docs).collect()}
    assert {r.doc_id for r in docs.collect()} == found and found


@pytest.mark.parametrize("line, name", [
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("This text is licensed under CC BY-SA 3.0, see below.", "CC-BY-SA-3.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.", "CC-BY-NC-ND-3.0"),
    ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Licensed under CC0 1.0.", "CC0-1.0"), ("Licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("Licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
])
def test_common_license_lines(spark, line, name):
    df = spark.createDataFrame([(1, f"some words before it. {line} And after.")], "doc_id bigint, text string")
    assert [r.license for r in licenses(df).collect()] == [name]
