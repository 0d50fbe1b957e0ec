import random

import pyarrow as pa

from millrace.llm import license_scan as op
from millrace.llm.license_templates import TEMPLATES
from tests.llm.test_decontaminate import words

SCHEMA = "doc_id long, text string, Text string, found string"
LICENSES = sorted({name for name, _ in TEMPLATES})


def brute(text, templates=TEMPLATES, size=5, contained=0.8):
    """The licenses of which some stretch of a template's length has the share of shingles."""
    w, out = words(text), set()
    for name, t in templates:
        v = words(t)
        g = min(size, len(v))
        own = {tuple(v[i : i + g]) for i in range(len(v) - g + 1)}
        grams = [tuple(w[i : i + g]) for i in range(len(w) - g + 1)]
        n = len(v) - g + 1
        if any(len(own & set(grams[i : i + n])) >= contained * len(own) for i in range(len(grams))):
            out.add(name)
    return out


def made(seed, n=80):
    rng = random.Random(seed)
    word = lambda: rng.choice(["under", "the", "License", "MIT", "of", "software", "é", "1", "is"])
    some = lambda a, b: [word() for _ in range(rng.randrange(a, b))]
    out = []
    for _ in range(n):
        w = some(0, 60)
        for _ in range(rng.randrange(3)):
            p = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 0, 1])):
                p[rng.randrange(len(p))] = word()
            w += p + some(0, 40)
        out.append(rng.choice([" ", "\n", " // "]).join(w))
    return out


def test_equals_brute_force(spark):
    texts = made(1) + made(2) + [None, "", "MIT", "released under the mit license", TEMPLATES[4][1] * 30, "x " * 40_000 + TEMPLATES[1][1]]
    got = {r.doc_id: r for r in op.license_matches(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)).collect()}
    for i, t in enumerate(texts):
        assert brute(t) <= {f.license for f in got[i].found}, t  # a window may be longer than the template and hold a little more
        for f in got[i].found:
            name = [x for n, x in TEMPLATES if n == f.license]
            stretch = " ".join(words(t)[f.start : f.stop])
            assert f.containment >= 0.8 and any(abs(share(x, stretch) - f.containment) < 1e-9 for x in name)


def share(template, text):
    v, w = words(template), words(text)
    g = min(5, len(v))
    own = {tuple(v[i : i + g]) for i in range(len(v) - g + 1)}
    return len(own & {tuple(w[i : i + g]) for i in range(len(w) - g + 1)}) / len(own)


def test_repeated_notices_are_all_found():
    text = ("q " * 50 + "Released under the MIT License. ") * 3
    found = op.scan(pa.array([text]), op.Templates(TEMPLATES))[0]
    assert [(f["license"], f["start"]) for f in found] == [("MIT", 50), ("MIT", 105), ("MIT", 160)]


def test_edges(spark):
    df = spark.createDataFrame([(None, "licensed under cc by 4.0", "a", "b"), (1, None, "a", "b"), (1, None, "a", "b")], SCHEMA)
    got = sorted((r.doc_id or 0, [f.license for f in r.found]) for r in op.license_matches(df).collect())
    assert got == [(0, ["CC-BY-4.0"]), (1, []), (1, [])]
    assert op.license_matches(spark.createDataFrame([], SCHEMA)).collect() == []
    assert op.license_matches(df, templates=[("x", "")]).count() == 3
    own = [("two", "alpha beta")]
    assert [f["start"] for f in op.scan(pa.array(["x alpha beta", "alpha"]), op.Templates(own))[0]] == [1]


def test_all_notices_in_the_documents_are_found(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: set(r.licenses) for r in op.query(spark, "/root/testdata/sf0.01").collect()}
    assert all(brute(r.text) <= got[r.doc_id] for r in rows) and any(got.values())


def test_versions_and_identifiers_are_told_apart():
    known = op.Templates(TEMPLATES)
    named = lambda t: sorted({f["license"] for f in op.scan(pa.array([t]), known)[0]})
    for v in "23":
        assert named(f"This work is licensed under the GNU General Public License, version {v}.") == [f"GPL-{v}.0"]
        assert named(f"# SPDX-License-Identifier: GPL-{v}.0-or-later") == [f"GPL-{v}.0"]
    assert named("// SPDX-License-Identifier: MIT") == ["MIT"] and named("SPDX-License-Identifier: EPL-2.0") == ["EPL"]


def test_every_template_is_found_in_its_own_text_alone():
    """Two-sided: of each template's text just the licenses come that plain containment gives, its own among them."""
    known = op.Templates(TEMPLATES)
    for name, text in TEMPLATES:
        found = {f["license"] for f in op.scan(pa.array(["before it " + text + " after it"]), known)[0]}
        assert name in found and found == brute("before it " + text + " after it"), text
    assert op.scan(pa.array(["nothing of the kind", None, ""]), known) == [[], [], []]
