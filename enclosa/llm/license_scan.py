"""Licence scans: Aho-Corasick notices and identifier tags with a shunting-yard parser.

Texts are lower-cased in A-Z; words are runs of 0-9, a-z and everything beyond
ASCII.  One automaton holds all notice phrases and the phrases that lead to an
expression: the identifier tag, and ``licensed under`` and its like.  The expression
behind each is read from the original text with precedence WITH > AND > OR;
behind the latter only known identifiers are read, since prose follows them as well.

``permissive`` says whether all that the text states can be met by permissive
licences alone: each expression by its logic (``GPL-2.0 OR MIT`` can, ``GPL-2.0
AND MIT`` cannot), each notice and base phrase by its label.  It is null where
nothing is stated.  ``score`` is the evidence for a licence, a fifth less where
it is not permissive.

A null text is empty: no words, no places, empty labels, score 0.  Rows that
repeat a doc_id, and rows without one, are scanned one by one.  An empty table
gives an empty one.  Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases; the labels are the method's own.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons": "cc",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "cc0 1 0": "cc0-1.0",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "this program is free software": "gpl",
}
#: Identifiers that are read in prose, those that permit use with notice alone, and what permissive notices are labelled.
IDENTIFIERS = {
    "mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0",
    "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mpl-2.0", "epl-2.0",
    "classpath-exception-2.0", "llvm-exception",
}
PERMISSIVE = {"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "apache", "bsd", "public-domain"}
#: Phrases that lead to an expression; the first is the identifier tag.
TAG = "spdx license identifier"
LEADS = [TAG, "licensed under", "released under", "distributed under", "license"]
TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
LEAD_LINE = re.compile(r"(?:(?:licensed|released|distributed) under(?: the)?|(?<!spdx-)\blicense:)[ \t]+([^\r\n]*)", re.IGNORECASE | re.ASCII)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:\-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean"


def postfix(expression: str, known: set[str] | None = None) -> list[str]:
    """The expression in postfix order (shunting-yard), of ``known`` identifiers alone where these are given.

    Reading stops at the first token that cannot continue an expression, so a
    comment that follows the expression on its line is left alone; a missing
    right operand or bracket is dropped with its operator.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for m in _TOKEN.finditer(expression):
        t = m[0].rstrip(".:") or m[0]
        low = t.lower()
        if t == "(" and operand:
            stack.append(t)
        elif t == ")" and not operand and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in _RANK and not operand:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif low not in _RANK and t not in "()" and operand and (known is None or low in known):
            out.append(low)
            operand = False
        else:
            break
    if operand and stack and stack[-1] in _RANK:
        stack.pop()
    out += [t for t in reversed(stack) if t != "("]
    return out


def licences(tokens: list[str]) -> set[str]:
    """The licences that a postfix expression names; an exception goes with its licence."""
    stack: list[set[str]] = []
    for t in tokens:
        if t not in _RANK:
            stack.append({t})
        elif len(stack) > 1:
            b, a = stack.pop(), stack.pop()
            stack.append({f"{x} with {y}" for x in a for y in b} if t == "with" else a | b)
    return stack[-1] if stack else set()


def evaluate(tokens: list[str], allowed: Callable[[str], bool]) -> bool:
    """Whether a postfix expression can be met by allowed licences alone; an empty one cannot."""
    stack: list[bool] = []
    for t in tokens:
        if t not in _RANK:
            stack.append(allowed(t))
        elif len(stack) > 1:
            b, a = stack.pop(), stack.pop()
            stack.append({"and": a and b, "or": a or b, "with": a}[t])
    return bool(stack and stack[-1])


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Matches whole words: phrases and texts have one space before and after each word."""
    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(f" {p} ", p)
    a.make_automaton()
    return a


def scan(text: str, auto: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive of one text."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    base: set[str] = set()
    own: set[str] = set()
    at: list[int] = []
    leads: set[str] = set()
    for end, p in auto.iter(line):
        if p in BASE:
            base.add(BASE[p])
            at.append(end - len(p))
        elif p in NOTICES:
            own.add(NOTICES[p])
        else:
            leads.add(p)
    starts: list[int] = []
    if at:  # characters to words, for all places at once
        begin = np.cumsum([1, *(len(x) + 1 for x in line[1:-1].split(" "))])
        starts = np.searchsorted(begin, at).tolist()
    noticed = base | own
    read = [postfix(m[1]) for m in TAG_LINE.finditer(text)] if TAG in leads else []
    read += [postfix(m[1], IDENTIFIERS) for m in LEAD_LINE.finditer(text)] if leads - {TAG} else []
    read = [tokens for tokens in read if tokens]
    for tokens in read:
        own.update(licences(tokens))
    permissive = None
    if noticed or read:
        allowed = lambda x: x in PERMISSIVE
        # A notice that an expression names as well is judged by the expression.
        told = {x.split(" ")[0] for tokens in read for x in licences(tokens)}
        permissive = all(evaluate(tokens, allowed) for tokens in read) and all(allowed(x) for x in noticed if not any(y.startswith(x) for y in told))
    evidence = min(1.0, 0.6 * bool(starts) + 0.3 * bool(read) + 0.1 * min(1.0, len(own) / 2))
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | {x.replace(",", " ") for x in own})), evidence * (0.8 if permissive is False else 1.0), "; ".join(" ".join(t) for t in read), permissive,
    )


def license_scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``; a narrow plan without a shuffle."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton([*BASE, *NOTICES, *LEADS])
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive"]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_()]
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                s = b.slice(lo, 1000)
                rows = [scan(x.as_py() or "", auto) for x in s.column(1)]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([s.column(0).cast(pa.int64()), *cols], ["doc_id", *names])

    return docs.select(key, text).mapInArrow(part, SCHEMA)
