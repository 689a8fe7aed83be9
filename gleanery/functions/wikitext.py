"""Plain text from wiki markup."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DROPPED = re.compile(r"<!--.*?-->|<(ref|nowiki|math|gallery|timeline|syntaxhighlight|code|table)\b[^>/]*>.*?</\1\s*>|</?[a-zA-Z][^>]*>|__[A-Z]+__", re.S | re.I)
_INNERMOST = (
    re.compile(r"\{\{[^{}]*\}\}"),  # templates
    re.compile(r"\{\|(?:(?!\{\||\|\}).)*\|\}", re.S),  # tables
)
_LINK = re.compile(r"\[\[([^\[\]|]*)(?:\|([^\[\]]*))?\]\]")
_NO_TEXT = re.compile(r"\s*(?:file|image|category)\s*:", re.I)
_EXTERNAL = re.compile(r"\[(?:https?:|ftp:|mailto:|//)[^\s\]]*(?:\s+([^\]]*))?\]")
_EMPHASIS = re.compile(r"'''''(?:(?!'''').)*?'''''|'''(?:(?!''').)*?'''|''(?:(?!'').)*?''")
_HEADING = re.compile(r"^(={1,6})[ \t]*(.*?)[ \t]*\1[ \t]*(?:\n|$)", re.M)
_RULE = re.compile(r"^-{4,}", re.M)
_LIST = re.compile(r"^[*#]+\s*(.*)$", re.M)
_DEFINITION = re.compile(r"^[:;]+\s*", re.M)
_REDIRECT = re.compile(r"^\s*#redirect\b.*", re.I | re.S)

#: Texts that are worked on at once.
ROWS = 128


def strip_wikitext(text: str) -> str:
    """Text, entities, links' labels, preformatted text, headings and lists are kept; emphasised
    text, templates, tables, tags, comments, categories, images and redirects are dropped. Tabs and line ends become spaces and
    the ends are trimmed."""
    if _REDIRECT.match(text):
        return ""
    text = _DROPPED.sub("", text)
    for pattern in _INNERMOST:
        while True:
            text, n = pattern.subn("", text)
            if not n:
                break
    while True:
        text, n = _LINK.subn(lambda m: "" if _NO_TEXT.match(m.group(1)) else m.group(2) or m.group(1), text)
        if not n:
            break
    text = _EXTERNAL.sub(lambda m: m.group(1) or "", text)
    text = _EMPHASIS.sub("", text)
    text = _HEADING.sub(r"\n\2\n", text)
    text = _RULE.sub("", text)
    text = _LIST.sub(r"\1 ", text)
    text = _DEFINITION.sub("", text)
    return re.sub(r"[\t\n\r]", " ", unescape(text)).strip()


@F.arrow_udf(T.StringType())
def strip_wikitext_column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts in parts of a few, so that a task holds few of a batch as objects."""
    for texts in batches:
        for low in range(0, len(texts), ROWS):
            yield pa.array([None if x is None else strip_wikitext(x) for x in texts.slice(low, ROWS).to_pylist()], pa.string())
