"""Licence scans: identifier tags with their expressions, and notice phrases.

One Aho-Corasick automaton holds all phrases, as words parted by one blank, and the
tags that announce a licence expression. Texts are lower-cased (A-Z) and brought into
the same form: words are runs of digits, letters and non-ASCII bytes, so a phrase is
found whatever punctuation or white space parts its words. A match counts if it begins
and ends with a word of one text. Overlapping places all count.

After a tag and its colon, the rest of the line is read as a licence expression by a
shunting-yard parser: ``with`` binds closer than ``and``, ``and`` closer than ``or``, and
parentheses group. It's evaluated to a restriction (0 permissive, 1 share changes to
files, 2 share alike, 3 reserved or not known): ``or`` takes the less restrictive side, as
the user may choose, ``and`` the more restrictive one, and ``with`` an exception takes one
step off share-alike. Parsing stops at what is no licence id or operator; an operator
without a right side is left out, and a parenthesis left open closes with the line.

The score is the noisy-or of the weights of the distinct labels found. The restriction
is the most restrictive of all evidence, -1 without any.

Null and empty texts have no word and score 0. A very long text is taken alone, whole.
Repeated rows score alike; a null id is carried along; an empty table gives no rows.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marketloom.llm.textops import LOWER, gathered, lean, parts, words

#: Bytes of text that are searched together; a longer text is taken alone.
STEP = 1_000_000
#: Words that the automaton reads in one string.
WORDS = 200_000
#: What parts words: all ASCII but digits and small letters.
_BREAKS = np.zeros(256, bool)
_BREAKS[:128] = [not (chr(i).isdigit() or "a" <= chr(i) <= "z") for i in range(128)]

#: Notice phrases: label, and how surely such a phrase states a licence.
NOTICES = {
    "all rights reserved": ("reserved", 0.7),
    "affero general public license": ("agpl", 0.95),
    "apache license": ("apache", 0.9),
    "apache license version 2 0": ("apache-2.0", 0.95),
    "boost software license": ("bsl", 0.9),
    "bsd license": ("bsd", 0.9),
    "cc by": ("cc-by", 0.8),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc0 1 0": ("cc0", 0.9),
    "creative commons attribution": ("cc-by", 0.9),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.95),
    "creative commons attribution sharealike": ("cc-by-sa", 0.95),
    "dedicated to the public domain": ("public-domain", 0.9),
    "eclipse public license": ("epl", 0.9),
    "general public license": ("gpl", 0.9),
    "general public license version 2": ("gpl-2.0", 0.95),
    "general public license version 3": ("gpl-3.0", 0.95),
    "isc license": ("isc", 0.9),
    "lesser general public license": ("lgpl", 0.95),
    "mit license": ("mit", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.95),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "this is free and unencumbered software": ("unlicense", 0.95),
}
#: Tags before an expression, as words and as they are written.
TAGS = {"spdx license identifier": "spdx-license-identifier", "license expression": "license-expression"}
#: Restriction of licence ids by their beginnings; the longest that fits counts.
RESTRICTIONS = {
    "0bsd": 0, "apache": 0, "bsd": 0, "bsl": 0, "cc-by": 0, "cc0": 0, "isc": 0, "mit": 0, "public-domain": 0, "unlicense": 0, "zlib": 0,
    "cddl": 1, "epl": 1, "lgpl": 1, "mpl": 1,
    "agpl": 2, "cc-by-sa": 2, "gpl": 2,
    "cc-by-nc": 3, "cc-by-nd": 3, "licenseref-": 3, "noassertion": 3, "none": 3, "proprietary": 3, "reserved": 3,
}
TAG_WEIGHT = 0.99
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+:-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def restriction(licence: str) -> int | None:
    """How far a licence id restricts use; None for what begins like no known id."""
    known = [b for b in RESTRICTIONS if licence.startswith(b) and (licence == b or b.endswith("-") or not licence[len(b)].isalpha())]
    return RESTRICTIONS[max(known, key=len)] if known else None


def parse(line: str) -> tuple[list[str], int]:
    """The expression at the beginning of a lower-cased line, in postfix order, and the number of characters read."""
    out: list[str] = []
    held: list[str] = []
    at, wants = 0, True  # wants: a licence or an opening parenthesis comes next
    read, opened = 0, 0
    while m := _TOKEN.match(line, at):
        token = m[1]
        if wants and token == "(":
            held.append(token)
            opened += 1
        elif wants and token not in _BINDS and token != ")":
            exception = bool(held) and held[-1] == "with"
            if not exception and restriction(token) is None or exception and "exception" not in token:
                break
            out.append(token)
            wants, read = False, m.end()
        elif not wants and token in _BINDS:
            if token == "with" and (not out or out[-1] in _BINDS or held and held[-1] == "with"):
                break
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[token]:
                out.append(held.pop())
            held.append(token)
            wants = True
        elif not wants and token == ")" and opened:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            opened -= 1
            read = m.end()
        else:
            break
        at = m.end()
    # After the last licence, open parentheses and the operator before them have no right side.
    while wants and held:
        wants = held.pop() == "("
    while held:
        token = held.pop()
        if token != "(":
            out.append(token)
    return out, read


def evaluate(postfix: list[str]) -> tuple[list[str], int]:
    """The licence ids of an expression, with their exceptions, and its restriction; -1 if it is empty."""
    stack: list[tuple[list[str], int]] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append(([token], restriction(token) if restriction(token) is not None else 3))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(([f"{left[0]} with {right[0]}"], a - 1 if a == 2 else a))
        else:
            stack.append((left + right, min(a, b) if token == "or" else max(a, b)))
    ids, level = stack[0] if stack else ([], -1)
    return sorted(set(ids)), level


def _automaton(phrases: Sequence[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        out.add_word(phrase, k)
    out.make_automaton()
    return out


def places(automaton: ahocorasick.Automaton, phrases: Sequence[str], data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Places of phrases in some texts of lower-cased bytes: (number of the first word, phrase), in order of words."""
    wide, count = np.array([len(p) for p in phrases]), np.array([p.count(" ") + 1 for p in phrases])
    out: list[tuple[int, int]] = []
    for first in range(0, len(start), WORDS):
        # Phrases that begin in this part may end in the next.
        some = slice(first, first + WORDS + int(count.max()) - 1)
        size = end[some] - start[some] + 1
        flat = gathered(data, start[some], end[some])
        # Words begin at characters, which have several bytes each.
        length = np.add.reduceat((flat & 0xC0) != 0x80, np.cumsum(size) - size, dtype=np.int64)
        at = np.cumsum(length) - length
        hits = np.array(list(automaton.iter(flat.tobytes().decode())), np.int64).reshape(-1, 2)
        last, which = hits[:, 0], hits[:, 1]
        word = np.searchsorted(at, last - wide[which] + 1)
        upto = word + count[which] - 1
        ok = (upto < len(at)) & (word < WORDS)
        word, upto, last, which = word[ok], upto[ok], last[ok], which[ok]
        ok = (at[word] == last - wide[which] + 1) & (at[upto] + length[upto] == last + 2) & (owner[first + word] == owner[first + upto])
        out += sorted(zip((first + word[ok]).tolist(), which[ok].tolist(), strict=True))
    return out


def scan(docs: DataFrame, more: Sequence[tuple[str, str, float]] = ()) -> DataFrame:
    """``docs`` with n_words, notices (word, phrase, label), expressions (word, expression, ids, restriction), score and restriction.

    ``more`` are further phrases (words parted by one blank), labels and weights. Columns
    of the new names are replaced.
    """
    notices = NOTICES | {phrase: (label, weight) for phrase, label, weight in more}
    names = [*notices, *TAGS]
    made = T.StructType.fromDDL(
        "n_words long, notices array<struct<word: long, phrase: string, label: string>>, "
        "expressions array<struct<word: long, expression: string, ids: array<string>, restriction: int>>, score double, restriction int"
    )
    docs = docs.drop(*made.names)

    def read(data: np.ndarray, end: int, limit: int) -> str:
        """The rest of the line after a byte, if it begins with a colon."""
        if end >= limit or data[end] != 58:
            return ""
        to, chunk = end + 1, 256
        while to < limit and not (stop := np.flatnonzero(data[to : min(to + chunk, limit)] == 10)).size:
            to, chunk = min(to + chunk, limit), 2 * chunk
        to = min(to + int(stop[0]), limit) if to < limit else limit
        return data[end + 1 : to].tobytes().decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(names)
        for batch, data, offsets in (p for b in lean(batches) for p in parts(b, b.schema.get_field_index("text"), STEP)):
            n = len(offsets) - 1
            data = LOWER[data]
            start, end, owner = words(data, offsets, _BREAKS)
            size = np.bincount(owner, minlength=n)
            first = np.cumsum(size) - size
            told: list[list[dict]] = [[] for _ in range(n)]
            tags: list[list[dict]] = [[] for _ in range(n)]
            for word, which in places(automaton, names, data, start, end, owner):
                text, phrase = int(owner[word]), names[which]
                at = word - int(first[text])
                if phrase in notices:
                    told[text].append({"word": at, "phrase": phrase, "label": notices[phrase][0]})
                elif data[start[word] : (to := int(end[word + phrase.count(" ")]))].tobytes().decode() == TAGS[phrase]:
                    line = read(data, to, int(offsets[text + 1]))
                    postfix, length = parse(line)
                    if postfix:
                        ids, level = evaluate(postfix)
                        tags[text].append({"word": at, "expression": line[:length].strip(), "ids": ids, "restriction": level})
            score, limits = np.zeros(n), np.full(n, -1, np.int32)
            for k in (k for k in range(n) if told[k] or tags[k]):
                weights = {}
                for x in told[k]:
                    weights[x["label"]] = max(weights.get(x["label"], 0.0), notices[x["phrase"]][1])
                weights |= {i: TAG_WEIGHT for x in tags[k] for i in x["ids"]}
                score[k] = 1 - np.prod([1 - weights[i] for i in sorted(weights)])
                levels = [restriction(x["label"]) for x in told[k]] + [x["restriction"] for x in tags[k]]
                limits[k] = max(3 if x is None else x for x in levels)
            kinds = [pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string()), ("label", pa.string())]))]
            kinds.append(pa.list_(pa.struct([("word", pa.int64()), ("expression", pa.string()), ("ids", pa.list_(pa.string())), ("restriction", pa.int32())])))
            new = [pa.array(size.astype(np.int64)), pa.array(told, kinds[0]), pa.array(tags, kinds[1]), pa.array(score), pa.array(limits)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *made.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *made.fields]))
