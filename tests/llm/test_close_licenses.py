"""Licences that share most of their text, files of several licences, and tags with expressions."""

import pytest
from pyspark.sql import functions as F

from fieldloom.llm.license_texts import TEXTS
from fieldloom.llm.licenses import find_licenses, license_scan

FILLER = "int x = {n};  // nothing to see here\n"


@pytest.fixture(scope="module")
def found(spark):
    """(name of the case) -> licences, of whole texts alone, within code, in pairs, and of tags."""
    cases = {f"alone {n}": f"Copyright (c) 2020 Some Body\n\n{t}" for n, t in TEXTS.items()}
    cases |= {f"within {n}": "".join(FILLER.format(n=k) for k in range(400)) + TEXTS[n] + "".join(FILLER.format(n=k) for k in range(400)) for n in ("MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0")}
    pairs = [("Apache-2.0", "MIT"), ("MIT", "BSD-2-Clause"), ("GPL-2.0", "MPL-2.0"), ("Apache-2.0", "GPL-3.0"), ("LGPL-2.1", "GPL-2.0"), ("ISC", "BSD-3-Clause")]
    cases |= {f"both {a} {b}": TEXTS[a] + "\n\n" + TEXTS[b] for a, b in pairs}
    cases["renamed"] = TEXTS["GPL-3.0"].replace("GNU General Public License", "GNU Affero General Public License")
    tags = {
        "(MIT OR Apache-2.0)": ["Apache-2.0", "MIT"], "MIT-0": ["MIT-0"], "MIT": ["MIT"], "GPL-2.0-only WITH Classpath-exception-2.0 AND ISC": ["GPL-2.0", "ISC"],
        "Foo-1.0 OR MIT */": ["MIT"], "GPL-2.0+": ["GPL-2.0"], "Foo-1.0": [], "": [],
    }
    cases |= {f"tag {t}": f"// SPDX-License-Identifier: {t}\nint main() {{ return 0; }}\n" for t in tags}
    rows = [(k, name, text) for k, (name, text) in enumerate(cases.items())]
    got = find_licenses(spark.createDataFrame(rows, "doc_id long, name string, text string"), [F.col("name")]).collect()
    return {r.name: sorted({f.license for f in r.findings}) for r in got}, pairs, tags


def test_whole_texts_are_told_from_close_ones(found):
    got, _, _ = found
    assert {n: got[f"alone {n}"] for n in TEXTS} == {n: [n] for n in TEXTS}
    assert got["renamed"] == ["AGPL-3.0"]


def test_texts_within_code_are_told_by_their_surroundings(found):
    got, _, _ = found
    for n in ("MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0"):
        assert got[f"within {n}"] == [n]


def test_a_file_of_two_licences_has_both(found):
    got, pairs, _ = found
    assert {p: got[f"both {p[0]} {p[1]}"] for p in pairs} == {p: sorted(p) for p in pairs}


def test_tags_give_all_licences_of_their_expressions(found):
    got, _, tags = found
    assert {t: got[f"tag {t}"] for t in tags} == tags


def test_all_licences_of_a_file_are_inherited(spark):
    rows = [(1, "a/LICENSE", TEXTS["Apache-2.0"] + TEXTS["MIT"]), (2, "a/b/c.py", "print(1)"), (3, "d/LICENSE", TEXTS["BSD-2-Clause"]), (4, "d/e.c", "int x;"), (5, "f.c", None)]
    got = {r.doc_id: (r.licenses, r.origin, r.from_dir) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert got[2] == (["Apache-2.0", "MIT"], "inherited", "a") and got[4] == (["BSD-2-Clause"], "inherited", "d") and got[5] == ([], "none", None)
