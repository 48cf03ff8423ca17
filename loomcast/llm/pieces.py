"""Cutting texts where no token can span the cut, and memory-bounded memos of what is known about the pieces."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa

#: characters that Python's split takes for white space but the tokenizers' patterns may not, or the other way round
DOUBTFUL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎​ -     　﻿]")
#: white space goes with the word after it; what is left at the end is a piece of its own
_LEADING = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: characters of a text that are cut into pieces at a time
STRETCH = 1 << 20


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """A long text in stretches of about ``size`` characters, each but the first starting with white space that
    follows a word.  Text without such a place within reach stays whole."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while True:
            cut = min((p for p in (text.find(" ", cut), text.find("\n", cut)) if p > 0), default=-1)
            if cut < 0 or not text[cut - 1].isspace():
                break
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def dropped_space(text: str) -> Iterator[list[str]]:
    """Pieces for tokenizers that drop white space: between any white space."""
    for part in stretches(text):
        yield part.split(" ") if DOUBTFUL.search(part) else part.split()


def leading_space(text: str) -> Iterator[list[str]]:
    """Pieces for byte-level tokenizers, where white space belongs to the word that follows: a cut lies only between
    a character that isn't white space and one that is, which no token of their pattern spans.  A text with white
    space about which the patterns may disagree is one piece."""
    if DOUBTFUL.search(text):
        yield [text]
        return
    for part in stretches(text):
        yield _LEADING.findall(part)


class Memo:
    """What is known about pieces, in two generations: when the younger is full, the older is forgotten."""

    def __init__(self, entries: int = 150_000, longest: int = 64):
        self.young: dict = {}
        self.old: dict = {}
        self.entries, self.longest = entries, longest

    def missing(self, pieces: Iterable[str]) -> list[str]:
        """The distinct pieces that aren't known; those of the older generation become young again."""
        young, old, out = self.young, self.old, []
        for p in set(pieces).difference(young):
            if p in old:
                young[p] = old[p]
            else:
                out.append(p)
        return out

    def trim(self) -> None:
        """Between texts: long pieces go at once, a full generation becomes the older."""
        if len(self.young) > self.entries:
            self.old = {k: v for k, v in self.young.items() if len(k) <= self.longest}
            self.young = {}


def by_bytes(items: list[str], most: int) -> Iterator[list[str]]:
    """Batches of about ``most`` UTF-8 bytes each; an item above that is a batch of its own."""
    batch: list[str] = []
    size = 0
    for x in items:
        n = len(x.encode("utf-8", "replace"))
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(x)
        size += n
    if batch:
        yield batch


def texts_of(batch: pa.RecordBatch) -> Iterator[str]:
    """The second column's texts, null as empty."""
    for x in batch.column(1):
        yield x.as_py() or ""


def single_threaded() -> None:
    """One task has one core: the tokenizer library must not start threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
