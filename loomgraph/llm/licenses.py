"""Licence scans: Aho-Corasick over identifier tags and notice phrases, and a shunting-yard evaluator.

Each text is reduced to its words joined by single spaces; one automaton pass finds every phrase at word borders. The
words after a licence tag are read as an SPDX-style expression, turned into postfix order by the shunting-yard method
and evaluated with and / or / with.

Defined results: null and empty texts have no words, no labels and score 0; overlapping places all count; repeated rows
give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import table, texts

#: Phrases and labels of the contract (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and the label of each.
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "creative commons": "cc",
    "creativecommons org licenses": "cc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "licensed under": "notice",
    "copyright": "copyright",
}
TAG = "spdx license identifier"
#: Openness of a licence by the first part of its identifier: 1 permissive, 0.6 share-alike, 0.5 weak, 0.3 strong copyleft.
OPENNESS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "unlicense": 1.0, "zlib": 1.0, "mpl": 0.5, "lgpl": 0.5, "epl": 0.5,
    "gpl": 0.3, "agpl": 0.3, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "cc-by-sa": 0.6, "cc-by": 0.9, "cc": 0.6, "public-domain": 1.0, "reserved": 0.0,
}
#: A-Z to a-z, other ASCII but letters and digits to a space; all other bytes stay.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
#: The rest of the line, or what stands before the next tag on it.
TAG_TEXT = re.compile(r"spdx-license-identifier\s*:\s*((?:(?!spdx-license-identifier\s*:)[^\r\n])+)", re.I)
TERM = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*")
RANK = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str]:
    """Shunting-yard: terms in postfix order; reading stops at the first word that can't continue an expression."""
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether the last term was an operand
    for m in TERM.finditer(expression):
        word = m[0].lower()
        if word == "(":
            if operand:
                break
            stack.append(word)
        elif word == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif word in RANK:
            if not operand:
                break
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = False
        else:
            if operand:
                break
            out.append(word.rstrip("."))
            operand = True
    if not operand and stack and stack[-1] in RANK:
        stack.pop()
    return out + [x for x in reversed(stack) if x != "("]


def openness(identifier: str) -> float:
    found = [k for k in OPENNESS if identifier == k or identifier.startswith(f"{k}-")]
    return OPENNESS[max(found, key=len)] if found else 0.5


def evaluate(terms: list[str]) -> tuple[float, list[str]]:
    """Openness of an expression (or: the most open side; and: the least; with: its licence), and its licences."""
    stack: list[tuple[float, list[str]]] = []
    for x in terms:
        if x in RANK:
            if len(stack) < 2:
                break
            b, a = stack.pop(), stack.pop()
            if x == "with":
                stack.append((a[0], [*a[1], *(f"with-{y}" for y in b[1])]))
            else:
                stack.append(((max if x == "or" else min)(a[0], b[0]), a[1] + b[1]))
        else:
            stack.append((openness(x), [x]))
    return (min(s for s, _ in stack), [y for _, ys in stack for y in ys]) if stack else (0.5, [])


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: "spdx"}.items():
        found.add_word(f" {phrase} ", (phrase, label, len(phrase)))
    found.make_automaton()
    return found


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = text.encode().translate(TO_WORDS).split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    starts, base, labels = [], set(), set()
    tagged = False
    at = passed = 0  # the spaces before ``at`` are counted already
    for end, (phrase, label, size) in automaton().iter(joined):
        labels.add(label)
        tagged |= phrase == TAG
        if phrase in BASE:
            base.add(label)
            start = end - size  # of the phrase; one space stands before each word
            passed += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
            at = start
            starts.append(passed - 1)
    opens = [OPENNESS[x] for x in labels if x in OPENNESS]
    if tagged:
        for m in TAG_TEXT.finditer(text):
            value, ids = evaluate(postfix(m[1]))
            if ids:
                opens.append(value)
                labels.update(f"id:{x}" for x in ids)
    score = min(opens) if opens else (0.5 if labels else 0.0)
    # A document's openness is that of its most restrictive notice; documents without notices have 0.
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), score,
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (see ``scan``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            rows = [scan(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return texts(docs).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
