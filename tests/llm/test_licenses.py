"""License scans against brute force; expressions against their meaning."""

import random
import re

import pytest

from tidelog.llm.licenses import BASE, Scanner, evaluate, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    places, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [None, "", "MIT", "Under the MIT License", "under-the\nMIT__license under THE mit license.", "CC BY-NC 4.0", "cc by nc by nc cc by nc", "Apache License, Version 2.0", "apache license version 20", "xunder the mit license", "under the mit licensé", "é cc BY nc é", "K cc by nc"]


def test_base_as_brute_force():
    scan = Scanner().scan
    rng = random.Random(2)
    parts = ["under", "the", "MIT", "license", "cc", "by", "nc", "apache", "version", "2", "é", "x"]
    more = ["".join(rng.choice(parts) + rng.choice([" ", "-", ", ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in TEXTS + more:
        got = scan((text or "").encode())
        assert got[:5] == brute(text), text
        assert set(filter(None, got[4].split(","))) <= set(got[5].split(",")) and 0 <= got[6] <= 1


@pytest.mark.parametrize(
    "text, value, labels",
    [
        ("MIT", 1.0, ["mit"]),
        ("MIT OR GPL-3.0-only", 1.0, ["mit", "gpl-3"]),
        ("MIT and gpl-3.0-or-later", 0.4, ["mit", "gpl-3"]),
        ("GPL-2.0+ WITH Classpath-exception-2.0", 0.75, ["gpl-2"]),
        ("MIT OR GPL-2.0 AND AGPL-3.0", 1.0, ["mit", "gpl-2", "agpl-3"]),
        ("(MIT OR GPL-2.0) AND AGPL-3.0", 0.2, ["mit", "gpl-2", "agpl-3"]),
        ("((Apache-2.0)) */", 0.95, ["apache-2"]),
        ("MIT and so on", 0.1, ["mit", "so"]),
        ("MIT the rest", 1.0, ["mit"]),
        ("MIT OR", 1.0, ["mit"]),
        ("(MIT OR (", 1.0, ["mit"]),
        ("CC-BY-NC-4.0", 0.3, ["cc-by-nc"]),
        ("", None, []),
        (") MIT", None, []),
    ],
)
def test_expressions(text, value, labels):
    assert evaluate(text) == (value, labels)


def test_tags_and_notices():
    scan = Scanner().scan
    assert scan(b"// SPDX-License-Identifier: Apache-2.0 OR MIT\ncode")[4:] == ("", "apache-2,mit", 1.0)
    assert scan(b"GNU General Public License, version 3")[4:] == ("", "gpl,gpl-3", 0.4)


@pytest.mark.parametrize(
    "text, labels, score",
    [
        ("SPDX License Identifier: MIT", "mit", 1.0),
        ("spdx_license identifier : (MIT OR GPL-3.0-only)", "gpl-3,mit", 1.0),
        ("SPDX-License-Identifier: MIT.", "mit", 1.0),
        ("SPDX-License-Identifier: Apache-2.0.\nSPDX-License-Identifier: GPL-2.0", "apache-2,gpl-2", 0.4),
        ("the SPDX license identifier is a tag", "", 0.0),
        ("é SPDX-License-Identifier: MIT é", "mit", 1.0),
        ("SPDX-License-Identifier:", "", 0.0),
        ("SPDX-License-Identifier", "", 0.0),
        ("spdx license spdx-license-identifier: CC0-1.0 -->", "cc0", 1.0),
        ("x " * 30_000 + "SPDX-License-Identifier: ISC", "isc", 1.0),
    ],
)
def test_expressions_are_read_where_the_automaton_finds_their_tag(text, labels, score):
    assert Scanner().scan(text.encode())[5:] == (labels, score)


def test_rows(spark):
    rows = [(i if i else None, t, 5) for i, t in enumerate([*TEXTS, TEXTS[3], "w, " * 100_000 + "cc by nc"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = [tuple(r)[:6] for r in scan_licenses(docs).collect()]
    assert sorted(got, key=str) == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert scan_licenses(docs.limit(0)).count() == 0
