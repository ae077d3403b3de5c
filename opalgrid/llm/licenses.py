"""License scans: an Aho-Corasick automaton over words, and SPDX expressions by shunting-yard.

All notice phrases are found in one pass of the automaton over the text's words (A-Z lower-cased,
joined by single blanks), at word boundaries only.  Identifier tags (``SPDX-License-Identifier:``)
are found by the same automaton; the expression after a tag is parsed by a shunting-yard parser
with the precedence WITH, AND, OR.  Its licences become labels, and the expression is evaluated:
``permitted`` says whether each expression of a text can be met by licences of ``PERMISSIVE`` alone
(null without an expression).  An exception after WITH leaves its licence's value as it is.

Only known licences and exceptions, and ``LicenseRef-`` names, are operands; reading stops at the
first word that cannot follow, so prose after a tag is no part of an expression.  Operators may be
in small letters, as prose is, only where an operand follows.

Scores: 1.0 for a well-formed expression, 0.9 for a notice phrase of the method, 0.8 for an
expression that is broken but names a licence, 0.7 for a base phrase; the highest counts.

Defined results: null and empty texts have no words and no labels; a malformed expression gives
the licences that could be read and permits nothing; repeated rows are scanned each; empty tables
give no rows; time and memory follow the length of a text; other columns, whatever their names, are
not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opalgrid.llm._text import chunks

BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# The scanner's own phrases; a label is the licence's family, or the licence where the phrase names one.
PHRASES = {
    "mit license": "mit",
    "the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "apache software license": "apache",
    "licensed under the apache license version 2 0": "apache-2.0",
    "apache license version 2 0": "apache-2.0",
    "apache 2 0 license": "apache-2.0",
    "gnu gpl": "gpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license v2": "gpl-2.0",
    "gnu general public license v3": "gpl-3.0",
    "either version 2 of the license or at your option any later version": "gpl-2.0-or-later",
    "either version 3 of the license or at your option any later version": "gpl-3.0-or-later",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "mozilla public license v 2 0": "mpl-2.0",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "neither the name of": "bsd-3-clause",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "eclipse public license": "epl",
    "eclipse public license version 2 0": "epl-2.0",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "boost software license": "bsl-1.0",
    "artistic license": "artistic",
    "zlib license": "zlib",
    "python software foundation license": "psf",
    "microsoft public license": "ms-pl",
    "open software license": "osl",
    "academic free license": "afl",
    "do what the fuck you want to public license": "wtfpl",
    "unlicense": "unlicense",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "server side public license": "sspl",
    "business source license": "busl",
    "creative commons": "cc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creativecommons org licenses by": "cc-by",
    "creativecommons org licenses by sa": "cc-by-sa",
    "creativecommons org licenses by nc": "cc-by-nc",
    "creativecommons org licenses by nd": "cc-by-nd",
    "creativecommons org publicdomain zero": "cc0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "public domain": "public-domain",
}


def _versions(family: str, versions: str, endings: tuple[str, ...] = ("",)) -> set[str]:
    return {f"{family}-{v}{e}" for v in versions.split() for e in endings}


# Identifiers of the SPDX list by family, in small letters.
GNU = ("", "-only", "-or-later", "+")
PERMISSIVE = (
    set("mit mit-0 mit-cmu 0bsd bsd-1-clause bsd-2-clause bsd-3-clause bsd-3-clause-clear bsd-2-clause-patent isc zlib libpng bsl-1.0 unlicense wtfpl cc0-1.0 ncsa x11 curl postgresql psf-2.0 python-2.0 ms-pl blueoak-1.0.0 upl-1.0 hpnd ftl openssl unicode-3.0 unicode-dfs-2016 ruby php-3.01 vim tcl icu json beerware fair pddl-1.0 xnet zpl-2.1 w3c afl-3.0 ecl-2.0 mulanpsl-2.0 artistic-2.0".split())
    | _versions("apache", "1.0 1.1 2.0")
    | _versions("cc-by", "1.0 2.0 2.5 3.0 4.0")
)
KNOWN = (
    PERMISSIVE
    | set("artistic-1.0 ms-rl bsd-4-clause sspl-1.0 busl-1.1 ofl-1.1 odbl-1.0 odc-by-1.0 elastic-2.0 qpl-1.0 sleepycat ipl-1.0 cpl-1.0 cecill-2.1 cecill-b cecill-c none noassertion".split())
    | _versions("gpl", "1.0 2.0 3.0", GNU)
    | _versions("lgpl", "2.0 2.1 3.0", GNU)
    | _versions("agpl", "1.0 3.0", GNU)
    | _versions("gfdl", "1.1 1.2 1.3", GNU)
    | _versions("mpl", "1.0 1.1 2.0 2.0-no-copyleft-exception")
    | _versions("epl", "1.0 2.0")
    | _versions("cddl", "1.0 1.1")
    | _versions("eupl", "1.0 1.1 1.2")
    | _versions("osl", "1.0 2.0 2.1 3.0")
    | {f"cc-{kind}-{v}" for kind in ("by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")}
) - {"none", "noassertion"}
EXCEPTIONS = set(
    "classpath-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 llvm-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 font-exception-2.0 linux-syscall-note openjdk-assembly-exception-1.0 qt-gpl-exception-1.0 qt-lgpl-exception-1.1 swift-exception wxwindows-exception-3.1 ocaml-lgpl-linking-exception universal-foss-exception-1.0 libtool-exception u-boot-exception-2.0 gpl-cc-1.0 freertos-exception-2.0 mif-exception".split()
)
TAG = "spdx license identifier"
SEPARATOR = bytes(32 if (b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F) else b + 32 * (0x41 <= b <= 0x5A) for b in range(256))
TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9+:-]+(?:\.[A-Za-z0-9+:-]+)*")
ORDER = {"OR": 1, "AND": 2, "WITH": 3}
OWN = re.compile(r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permitted boolean"


def _operand(token: str, operators: list[str]) -> bool:
    """Whether a token may stand as an operand: an exception after WITH, a licence elsewhere."""
    name = token.lower()
    if operators[-1:] == ["WITH"]:
        return name in EXCEPTIONS
    return name in KNOWN or name.endswith("+") and name[:-1] in KNOWN or OWN.fullmatch(name) is not None


def parse_expression(text: str) -> tuple[list, bool]:
    """Reverse Polish form of a licence expression, and whether all of it is well formed.

    Reading stops at the first token that cannot follow (a sentence after the expression).  An
    operator in small letters without an operand after it is the start of such a sentence."""
    out: list = []
    stack: list[str] = []
    operand, good, tokens = False, True, TOKEN.findall(text)
    for i, token in enumerate(tokens):
        name = token.upper()
        if token == "(" and not operand and stack[-1:] != ["WITH"]:
            stack.append(token)
        elif token == ")" and operand and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif name in ORDER and operand:
            after = tokens[i + 1] if i + 1 < len(tokens) else ""
            if token != name and after != "(" and not _operand(after, [name]):
                break
            while stack and stack[-1] != "(" and ORDER[stack[-1]] >= ORDER[name]:
                out.append(stack.pop())
            stack.append(name)
            operand = False
        elif not operand and _operand(token, stack):
            out.append(token)
            operand = True
        else:
            good = operand and token not in "()"
            break
    if not operand or "(" in stack:
        good = False
    if not operand and stack[-1:] != ["("] and stack:
        stack.pop()  # an operator that nothing follows
    out.extend(op for op in reversed(stack) if op != "(")
    return out, good and bool(out)


def evaluate(rpn: list, allowed) -> bool:
    """Whether a reverse Polish expression is satisfied by the allowed licences (lower case);
    WITH keeps its licence's value."""
    values: list[bool] = []
    for token in rpn:
        if token in ORDER:
            b, a = values.pop(), values.pop()
            values.append(a or b if token == "OR" else a and b if token == "AND" else a)
        else:
            values.append(token.lower().removesuffix("+") in allowed)
    return bool(values and values[-1])


def expression_licences(rpn: list) -> list[str]:
    """Licences of an expression: operands that do not follow WITH."""
    stack: list[list[str]] = []
    for token in rpn:
        if token in ORDER:
            b, a = stack.pop(), stack.pop()
            stack.append(a if token == "WITH" else a + b)
        else:
            stack.append([token.lower()])
    return sorted({x for s in stack for x in s})


def automaton(base: dict[str, str], phrases: dict[str, str]):
    found: dict[str, list] = {}
    for own, table in ((False, base), (True, phrases)):
        for phrase, label in table.items():
            found.setdefault(f" {phrase} ", []).append((label, own))
    found[f" {TAG} "] = [(None, True)]
    out = ahocorasick.Automaton()
    for phrase, entries in found.items():
        out.add_word(phrase, (len(phrase), entries))
    out.make_automaton()
    return out


def scan(line: str, text, machine) -> tuple:
    """(n_base, first, last, base labels, labels, score, permitted) of a line of words with blanks
    around; text() gives the raw text where a tag needs it."""
    places, base, labels, score, permitted, tagged = [], set(), set(), 0.0, None, False
    for end, (length, entries) in machine.iter(line):
        for label, own in entries:
            if label is None:
                for expression in () if tagged else TAG_LINE.findall(text()):
                    rpn, good = parse_expression(expression)
                    names = expression_licences(rpn)
                    labels.update(names)
                    if names:
                        permitted = permitted is not False and good and evaluate(rpn, PERMISSIVE)
                        score = max(score, 1.0 if good else 0.8)
                tagged = True  # one pass reads all tags of a text
                continue
            labels.add(label)
            if own:
                score = max(score, 0.9)
            else:
                base.add(label)
                places.append(end - length + 1)  # the blank before the first word
                score = max(score, 0.7)
    first = last = None
    if places:
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32)
        first, last = (bisect_left(blanks, p) for p in (min(places), max(places)))
    return len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, permitted


def _scan_task(base: dict[str, str], phrases: dict[str, str]):
    def run(batches):
        machine = automaton(base, phrases)
        for rows, data, offsets in chunks(batches):
            raw, at, out, n_words = data.tobytes(), offsets.tolist(), [], []
            for a, b in zip(at, at[1:]):
                words = raw[a:b].translate(SEPARATOR).split()
                n_words.append(len(words))
                line = " " + b" ".join(words).decode("utf-8", "replace") + " "
                out.append(scan(line, lambda a=a, b=b: raw[a:b].decode("utf-8", "replace"), machine))
            n, first, last, base_labels, labels, score, permitted = zip(*out)
            yield pa.record_batch(
                {
                    "doc_id": rows.column("doc_id"),
                    "n_words": pa.array(n_words, pa.int64()),
                    "n_base": pa.array(n, pa.int64()),
                    "first_word": pa.array(first, pa.int64()),
                    "last_word": pa.array(last, pa.int64()),
                    "base_labels": pa.array(base_labels, pa.string()),
                    "labels": pa.array(labels, pa.string()),
                    "score": pa.array(np.array(score, float)),
                    "permitted": pa.array(permitted, pa.bool_()),
                }
            )

    return run


def scan_licenses(documents: DataFrame, base: dict[str, str] = BASE_PHRASES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan_task(base, phrases), RESULT)
