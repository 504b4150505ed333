"""Licences of real notices: headers, full texts, tags, several licences, none."""

import textwrap

import pytest
from pyspark.sql import functions as F

from codeloom.llm import license_forms as forms
from codeloom.llm import licenses

HOLDER = "Copyright (c) 2021 The Example Authors. All rights reserved.\n"


def comment(*paragraphs, lead=" *"):
    """A header as it stands in sources: wrapped, marked, with code right below."""
    lines = [x for p in paragraphs for x in [*textwrap.wrap(p, 68), ""]]
    return "/*\n" + "".join(f"{lead} {x}".rstrip() + "\n" for x in lines) + " */\nimport x;\nint main() { return 0; }\n"


def text_of(license, start):
    return next(f.text for f in forms.FORMS if f.license == license and f.text.startswith(start))


def paragraphs(text, *cuts):
    for cut in cuts:
        text = text.replace(cut, "\n\n" + cut)
    return "\n\n".join("\n".join(textwrap.wrap(p, 76)) for p in text.split("\n\n"))


def mit():
    return HOLDER + "\n" + paragraphs(text_of("MIT", "Permission"), "The above copyright", "THE SOFTWARE IS PROVIDED")


def bsd(license):
    return HOLDER + "\n" + paragraphs(text_of(license, "Redistribution"), "1. ", "2. ", "3. Neither", "THIS SOFTWARE IS")


def gnu(license, start="This program"):
    return text_of(license, start)


REAL = {
    "mit/LICENSE": (mit(), "MIT"),
    "mit-titled/LICENSE.md": ("The MIT License (MIT)\n\n" + mit(), "MIT"),
    "mit/one.py": ("# " + HOLDER + "# Released under the MIT License.\nimport os\n", "MIT"),
    "mit/README": ("# Tool\n\nDoes much.\n\nThis tool is\nfast. Released under the\nMIT License. Enjoy.\n", "MIT"),
    "mit/tag.py": ("# SPDX-License-Identifier: MIT\nimport os\n", "MIT"),
    "gpl/tag.c": ("/* SPDX-License-Identifier: GPL-2.0-or-later */\n", "GPL-2.0"),
    "zlib/tag.c": ("// " + HOLDER + "// SPDX-License-Identifier: Zlib\n", "Zlib"),
    "apache/a.c": (comment(HOLDER.strip(), text_of("Apache-2.0", "Licensed")), "Apache-2.0"),
    "apache/b.py": ('"""Copyright 2020 Foo. Licensed under the Apache License, Version 2.0."""\n', "Apache-2.0"),
    "apache/LICENSE": ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS\n\n1. Definitions.\n", "Apache-2.0"),
    "bsd2/LICENSE": (bsd("BSD-2-Clause"), "BSD-2-Clause"),
    "bsd2/a.c": (comment(HOLDER.strip(), text_of("BSD-2-Clause", "Redistribution")), "BSD-2-Clause"),
    "bsd3/COPYING": (bsd("BSD-3-Clause").replace("copyright holder nor", "University nor"), "BSD-3-Clause"),
    "gpl2/a.c": (comment("foo.c - it does foo", HOLDER.strip(), gnu("GPL-2.0")), "GPL-2.0"),
    "gpl3/a.c": (comment("foo.c - it does foo", HOLDER.strip(), gnu("GPL-3.0")), "GPL-3.0"),
    "gpl3/COPYING": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nPreamble\n\nIt is not the GNU Affero General Public License.\n", "GPL-3.0"),
    "lgpl/a.c": (comment(HOLDER.strip(), gnu("LGPL-2.1")), "LGPL-2.1"),
    "lgpl3/a.c": (comment(HOLDER.strip(), gnu("LGPL-3.0")), "LGPL-3.0"),
    "agpl/a.c": (comment(HOLDER.strip(), gnu("AGPL-3.0")), "AGPL-3.0"),
    "mpl/a.js": (comment(text_of("MPL-2.0", "This Source")), "MPL-2.0"),
    "isc/LICENSE": ("ISC License\n\n" + HOLDER + "\n" + text_of("ISC", "Permission"), "ISC"),
    "two/a.c": (comment(HOLDER.strip(), gnu("LGPL-3.0"), "Parts: Released under the MIT License."), "LGPL-3.0"),
    "none/a.txt": ("This software is proprietary. You have no license to use it.", None),
    "none/b.txt": (HOLDER, None),
    "none/c.py": ("def check_license(license):\n    return license.valid\n", None),
    "none/d/LICENSE": ("No permission is granted to use, copy or distribute this software without a written license.", None),
    "none/e.txt": ("# SPDX-License-Identifier: NONE\n", None),
}


def scanned(spark, files, **more):
    frame = spark.createDataFrame(files, "path string, text string")
    return {r["path"]: r for r in licenses.scan(frame, **more).collect()}


@pytest.fixture(scope="module")
def real(spark):
    return scanned(spark, [(path, text) for path, (text, _) in REAL.items()])


@pytest.mark.parametrize("path", REAL)
def test_real_notices(real, path):
    wanted = REAL[path][1]
    origin = "none" if wanted is None else "file" if path.split("/")[-1].startswith(("LICENSE", "COPYING")) else "header"
    assert (real[path]["license"], real[path]["origin"]) == (wanted, origin)


def test_a_passage_depends_on_no_other_file(spark, real):
    """Neither on rare words of others nor on how often a notice stands in the table."""
    paths = ["apache/a.c", "bsd2/LICENSE", "gpl3/a.c"]
    got = scanned(spark, [(p, REAL[p][0]) for p in paths] + [(f"many/{i}.c", REAL["gpl3/a.c"][0]) for i in range(300)])
    assert [(got[p]["license"], got[p]["cosine"]) for p in paths] == [(real[p]["license"], real[p]["cosine"]) for p in paths]
    assert {r["license"] for p, r in got.items() if p.startswith("many/")} == {"GPL-3.0"}


def test_lines_that_only_sound_alike_match_no_passage(spark):
    lines = ["Released under the building license of the city.", "Licensed under the Zlib License.", "Released under the Foo License."]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(lines)], "path string, text string")
    parts = frame.select("path", licenses.passages(frame["text"], F.lit(False)).alias("passages"))
    assert licenses.passage_matches(parts).collect() == []


def test_a_full_text_is_inherited(spark):
    got = scanned(spark, [("a/LICENSE", bsd("BSD-2-Clause")), ("a/b/c.py", "x = 1"), ("a/b/d.py", None), ("e.py", "")])
    assert [(got[p]["license"], got[p]["from_dir"]) for p in ("a/b/c.py", "a/b/d.py", "e.py")] == [("BSD-2-Clause", "a")] * 2 + [(None, None)]


def test_parts_of_one_path_and_ties(spark):
    """Rows of a path are parts of one file; of equally near licences the first by name counts."""
    tag = "SPDX-License-Identifier: "
    got = scanned(spark, [
        ("a.c", None), ("a.c", comment(HOLDER, gnu("AGPL-3.0"))), ("a.c", "code"), (None, tag + "MIT"),
        ("b.c", tag + "Zlib"), ("b.c", tag + "ISC"), ("c.c", f"{tag}(MIT OR Apache-2.0)\n\n" + licenses.TEMPLATES[0].text),
    ])
    assert {p: (r["license"], r["cosine"]) for p, r in got.items()} == {"a.c": ("AGPL-3.0", 1.0), "b.c": ("ISC", 1.0), "c.c": ("MIT", 1.0)}


def test_long_files(spark):
    """A notice after many lines, and one line of many words."""
    got = scanned(spark, [
        ("a.c", "int x;\n" * 100_000 + "\n" + comment(HOLDER, gnu("GPL-2.0"))), ("b/LICENSE", "word license " * 50_000),
        ("c.txt", "\n" * 100_000 + " " * 100_000 + "Released under the MIT License.")])
    assert [got[p]["license"] for p in ("a.c", "b/LICENSE", "c.txt")] == ["GPL-2.0", None, "MIT"]


def test_many_passages_are_joined_by_a_shuffle(spark, real, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    assert scanned(spark, [(path, text) for path, (text, _) in REAL.items()]) == real
