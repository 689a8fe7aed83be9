"""License scans: phrases in place, and an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import texts

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label and wording of notices: what licenses ask for, and the sentences by which their texts are known.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Released under the BSD License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("reserved", "All rights reserved"),
    *(
        (f"cc-{short.lower()}", wording)
        for short, long in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
        for wording in (f"CC {short} 4.0", f"Licensed under CC {short} 4.0", f"licensed under a Creative Commons {long} 4.0 International License")
    ),
)

#: Tokens that name a license, by what they name. A notice is its template's license only if it holds
#: those that the template holds. Beside a template's word (the keys of VARIANTS) it must name the
#: same variants of the license.
NAMES = {
    b"mit": "mit", b"apache": "apache", b"mozilla": "mpl", b"bsd": "bsd", b"cc0": "cc0", b"reserved": "reserved", b"unencumbered": "unlicense",
}
VARIANTS = {
    "gnu": {b"lesser": "lgpl", b"library": "lgpl", b"affero": "agpl"},
    "cc": {b"nc": "nc", b"noncommercial": "nc", b"sa": "sa", b"sharealike": "sa", b"nd": "nd", b"noderivatives": "nd", b"noderivs": "nd"},
    "commons": {b"nc": "nc", b"noncommercial": "nc", b"sa": "sa", b"sharealike": "sa", b"nd": "nd", b"noderivatives": "nd", b"noderivs": "nd"},
}

_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_BREAK = re.compile(rb"\n|(?<=[.!?;])[ \t]")


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; runs of digits, letters and all beyond ASCII."""
    return text.translate(_WORDS).split()


def blocks(text: bytes) -> list[bytes]:
    """The text blocks that are matched: lines, cut after sentence marks that white space follows."""
    return _BREAK.split(text)


def wrapped_runs(text: bytes, longest: int) -> list[tuple[int, int, list[bytes]]]:
    """(first block, last block, words), from the last to the first: for every block that goes on
    in the next line the longest run of such blocks with fewer than ``longest`` words between its
    first and its last. Blank lines and sentence marks at line ends end a run."""
    cut = [words_of(b) for b in blocks(text)]
    ends = list(_BREAK.finditer(text))
    marks = (b".", b"!", b"?", b";")
    goes_on = [m.group() == b"\n" and text[max(0, m.start() - 2) : m.start()].rstrip(b"\r")[-1:] not in marks for m in ends]
    out = []
    for first in range(len(ends) - 1, -1, -1):
        last, inner = first, 0
        while last < len(ends) and goes_on[last] and cut[last] and cut[last + 1] and inner < longest:
            inner += len(cut[last]) if last > first else 0
            last += 1
        if last > first:
            out.append((first, last, [w for b in cut[first : last + 1] for w in b]))
    return out


@dataclass(frozen=True)
class Template:
    """A template's label, its distinct tokens from the rarest to the commonest, and how many of
    them a block must hold."""

    label: str
    tokens: tuple[bytes, ...]
    needed: int


def token_counts(docs: DataFrame, templates: tuple[tuple[str, str], ...], text_col: str = "text") -> dict[bytes, int]:
    """In how many texts each template token occurs, over all rows; one number per token comes back."""
    vocabulary = sorted({w for _, t in templates for w in words_of(t.encode())})
    known = set(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in texts(batch, "t"):
                for w in known.intersection(words_of(text)):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in vocabulary]), pa.array([counts[w] for w in vocabulary], pa.int64())], ["w", "n"]
        )

    partial = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "w string, n long")
    found = {r.w.encode(): r.n for r in partial.groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(w, 0) for w in vocabulary}


def order_templates(templates: tuple[tuple[str, str], ...], counts: dict[bytes, int], threshold: Fraction) -> list[Template]:
    out = []
    for label, text in templates:
        tokens = tuple(sorted(set(words_of(text.encode())), key=lambda w: (counts.get(w, 0), w)))
        if tokens:
            out.append(Template(label, tokens, max(1, ceil(threshold * len(tokens)))))
    return out


class Matcher:
    """Finds for a block the templates of which it holds the needed share of tokens.

    Tokens are in one global order, the rarest first, in templates and blocks alike. Prefix filter:
    such a block holds one of the template's ``n - needed + 1`` rarest tokens, so only those are
    indexed. Length filter: a block with fewer tokens than needed is passed over. Positional filter:
    at the first common token what the block has left, it included, must still suffice.
    """

    def __init__(self, templates: list[Template], order: list[bytes]) -> None:
        """``order``: every template token, in the one global order in which templates are sorted."""
        self.templates = templates
        self.order: dict[bytes, int] = {}
        for w in order:
            self.order[w] = len(self.order)
        self.index: dict[bytes, list[int]] = {}
        for k, t in enumerate(templates):
            for w in t.tokens[: len(t.tokens) - t.needed + 1]:
                self.index.setdefault(w, []).append(k)
        self.rare = frozenset(self.index)

    def match(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(template number, containment) of every template that the block meets."""
        held = self.order.keys() & set(words)
        seen: set[int] = set()
        out = []
        if self.rare.isdisjoint(held):
            return out
        ordered = sorted(held, key=self.order.__getitem__)
        for place, w in enumerate(ordered):
            left = len(ordered) - place
            for k in self.index.get(w, ()):
                if k in seen:
                    continue
                seen.add(k)  # none of the template's tokens before this one is held
                t = self.templates[k]
                if left < t.needed:
                    continue
                common = sum(x in held for x in t.tokens)
                if common >= t.needed:
                    out.append((k, common / len(t.tokens)))
        return out


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    present = set(words)
    out = []
    for parts, label in phrases:
        if not present.issuperset(parts):
            continue
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                out.append((at, label))
    return out


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: Fraction = Fraction(4, 5),
    wrapped: bool = True,
    names: dict[bytes, str] = NAMES,
    variants: dict[str, dict[bytes, str]] = VARIANTS,
) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks, found).

    The base part counts the places of ``phrases``. The method's part joins every text block
    (:func:`blocks`) of every whole text with every template of which it contains the share
    ``threshold`` of tokens or more, exactly: tokens are ordered by the number of texts they
    occur in, over all of ``docs``, and prefix, length and positional filters leave out only
    blocks that cannot reach the threshold. ``found`` lists every such pair as (block number,
    label, containment, meant). Licenses differ by single words, so a pair is ``meant`` only if
    the block names what the template names: each of its tokens in ``names``, and the same
    ``variants``. ``labels`` has the base labels and those that are meant; score is the largest
    containment of these, 1 where a phrase stands, else 0; n_blocks counts their blocks.

    ``wrapped``: notices that go on over line ends (:func:`wrapped_runs`) are matched as well,
    each at the block where it begins.

    Null texts count as empty: no words, no labels (empty strings), score 0, first and last null.
    Equal rows get equal results; an empty table gives an empty one; other columns are not read.
    The templates and phrases are part of the program, and so are shipped to every task.
    """
    counts = token_counts(docs, templates, text_col)
    matcher = Matcher(order_templates(templates, counts, threshold), sorted(counts, key=lambda w: (counts[w], w)))
    parts = [(words_of(p.encode()), label) for p, label in phrases]
    longest = max((len(words_of(t.encode())) for _, t in templates), default=0)
    needs = [names.keys() & set(t.tokens) for t in matcher.templates]
    families = [{w: v for word, named in variants.items() if word.encode() in t.tokens for w, v in named.items()} for t in matcher.templates]
    named = [{v for w, v in family.items() if w in t.tokens} for family, t in zip(families, matcher.templates)]

    def met(words: list[bytes]) -> list[tuple[int, float, bool]]:
        """Templates met by a block, their shares, and whether the block means them."""
        return [
            (k, share, needs[k].issubset(words) and {families[k][w] for w in families[k].keys() & set(words)} == named[k])
            for k, share in matcher.match(words)
        ]

    def wrapped_notices(text: bytes, lines: list[tuple[int, int, float, bool]]) -> list[tuple[int, int, float, bool]]:
        best: list[tuple[int, int, float, bool]] = []
        latest: dict[int, int] = {}
        for first, last, words in wrapped_runs(text, longest):
            for k, share, meant in met(words):
                if any(t == k and first <= n <= last for n, t, *_ in lines):
                    continue
                if k in latest and best[latest[k]][0] <= last:  # the same notice, with more lines before it
                    if (meant, share) > (best[latest[k]][3], best[latest[k]][2]):
                        best[latest[k]] = (first, k, share, meant)
                    continue
                latest[k] = len(best)
                best.append((first, k, share, meant))
        return best

    def scan(text: bytes) -> tuple:
        words = words_of(text)
        places = phrase_places(words, parts)
        base = {label for _, label in places}
        found, true = [], []
        if not matcher.rare.isdisjoint(words):
            for number, block in enumerate(blocks(text)):
                found += [(number, *hit) for hit in met(words_of(block))]
            if wrapped:
                found += wrapped_notices(text, found)
            found = [(number, matcher.templates[k].label, share, meant) for number, k, share, meant in found]
        true = [f for f in found if f[3]]
        starts = [at for at, _ in places]
        score = 1.0 if places else max((share for _, _, share, _ in true), default=0.0)
        labels = base | {label for _, label, *_ in true}
        return (
            len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            score, len({n for n, *_ in true}), [dict(zip(("block", "label", "share", "meant"), f)) for f in sorted(found)],
        )

    hit = pa.list_(pa.struct([("block", pa.int64()), ("label", pa.string()), ("share", pa.float64()), ("meant", pa.bool_())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), hit]
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t) for t in texts(batch, "t")]
            values = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(values, kinds))], [id_col, *columns])

    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(
        run,
        f"`{id_col}` {source.schema['i'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, n_blocks long, found array<struct<block: long, label: string, share: double, meant: boolean>>",
    )
