"""License scans: phrases and identifier tags by Aho-Corasick, licence expressions by a shunting-yard parser.

A text becomes a sequence of lower-case words; one automaton finds notice phrases and identifier tags in it, and
the expression behind a tag is parsed from the text itself, from where the automaton found the tag. Labels are the licences found. The score is how freely
the text may be used, from 0 (nothing found, or nothing known) to 1: the value of an expression is the larger one
of an `or`, the smaller one of an `and`, and an exception (`with`) raises its licence; several findings count as `and`.

Defined results: a null text counts as empty (no words, no labels, score 0); a null doc_id stays null; malformed expressions count
as far as they can be read; a tag written with other separators than hyphens counts if a colon follows; repeated rows give repeated
results; a text of any length is scanned whole, alone in its slice of a batch; an empty table gives an empty result; columns
beyond the two named have no effect, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import documents, slices, utf8

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases beyond these.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "free and unencumbered software released into the public domain": "unlicense",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
}
TAG = "spdx license identifier"
PLAIN_TAG = TAG.replace(" ", "-").encode()
#: What stands between a tag and its expression, which ends with the line.
BEHIND = re.compile(rb"([\s:=]+)([^\r\n]*)")
#: How freely a licence lets a text be used, by the start of its label; the longest start counts.
FREEDOM = {"mit": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "bsl": 1.0, "apache": 0.95, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "cc-by-nd": 0.3, "cc-by-nc": 0.3, "agpl": 0.2}
UNKNOWN = 0.1
EXCEPTION = 0.75
RANK = {"or": 1, "and": 2, "with": 3}

WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def freedom(label: str) -> float:
    best = max((k for k in FREEDOM if label == k or label.startswith(f"{k}-")), key=len, default=None)
    return FREEDOM[best] if best else UNKNOWN


def label_of(identifier: str) -> str:
    """The label of a licence identifier: lower case, without `only`, `or later` and `.0`; some families without version."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    name = re.sub(r"\.0$", "", name)
    for family in ("bsd", "cc0"):
        if name.startswith(f"{family}-"):
            return family
    return re.sub(r"-[0-9.]+$", "", name) if name.startswith("cc-") else name


def evaluate(expression: str) -> tuple[float | None, list[str]]:
    """The value of a licence expression and its labels, read as far as it is well-formed."""
    values: list[float] = []
    labels: list[str] = []
    stack: list[str] = []
    operand = False  # whether the last token ended an operand
    hanging = 0  # operators and brackets since then, which lack what should follow

    def apply() -> None:
        op, right, left = stack.pop(), values.pop(), values.pop()
        values.append(max(left, right) if op == "or" else min(left, right) if op == "and" else max(left, right))

    for token in re.findall(r"[A-Za-z0-9.+-]+|[()]|\S", expression):
        token = token.rstrip(".") or token
        word = token.lower()
        if word in RANK and operand:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[word]:
                apply()
            stack.append(word)
            operand, hanging = False, 1
        elif token == "(" and not operand:
            stack.append("(")
            hanging += 1
        elif token == ")" and operand and "(" in stack:
            while stack[-1] != "(":
                apply()
            stack.pop()
        elif not operand and re.match(r"[A-Za-z0-9]", token) and word not in RANK:
            if stack and stack[-1] == "with":
                values.append(EXCEPTION)
            else:
                labels.append(label_of(token))
                values.append(freedom(labels[-1]))
            operand, hanging = True, 0
        else:
            break
    if hanging:
        del stack[-hanging:]
    while stack:
        if stack[-1] == "(":
            stack.pop()
        else:
            apply()
    return (values[0] if values else None), labels


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE}.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    found.add_word(f" {TAG} ", (len(TAG) + 2, None, False))
    found.make_automaton()
    return found


def expressions(text: bytes, tags: list[int]) -> Iterator[str]:
    """What follows the tags, which are given by the number of their first word."""
    if not tags:
        return
    solid = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[False, solid, False]))
    for word in tags:
        begin, end = int(edge[2 * word]), int(edge[2 * (word + TAG.count(" ")) + 1])
        m = BEHIND.match(text, end)
        if m and (text[begin:end].lower() == PLAIN_TAG or b":" in m[1]):
            yield m[2].decode("utf-8", "replace")


class Scanner:
    def __init__(self) -> None:
        self.automaton = automaton()

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = text.translate(WORD_BYTES).split()
        line = b" ".join([b"", *words, b""]).decode()
        base, more, tags, places = set(), set(), [], []
        count = at = 0
        for end, (length, label, is_base) in self.automaton.iter(line):
            if label is None or is_base:
                start = end - length + 1
                count, at = (count + line.count(" ", at, start), start) if start >= at else (line.count(" ", 0, start), start)
                if label is None:
                    tags.append(count)
                else:
                    base.add(label)
                    places.append(count)
            else:
                more.add(label)
        values = [freedom(x) for x in base | more]
        for expression in expressions(text, tags):
            value, labels = evaluate(expression)
            more.update(labels)
            values += [] if value is None else [value]
        if not base and not more:
            return len(words), 0, None, None, "", "", 0.0
        first, last = (min(places), max(places)) if places else (None, None)
        return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), min(values, default=0.0)


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and RESULT of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner().scan
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["doc_id", *(x.split()[0] for x in RESULT.split(", "))]
        for batch in slices(batches, "__text"):
            data, ends = utf8(batch.column(1))
            whole = data.tobytes()
            rows = [scan(whole[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"doc_id long, {RESULT}")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir, "doc_id", "text"))
