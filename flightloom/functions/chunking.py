"""Recursive splitting of page texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Separators in the order they are tried.
SEPARATORS = ["\nArticle ", "\nSection ", "\n§ ", "\n\n", "\n", ". ", " "]


def merged(parts: list[str], size: int, overlap: int) -> list[str]:
    """Parts put together to chunks of at most ``size`` characters; a chunk begins with the last parts of the one before, up to ``overlap`` of them."""
    chunks: list[str] = []
    held: list[str] = []
    length = 0
    for p in parts:
        if held and length + len(p) > size:
            chunks.append("".join(held))
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    return [*chunks, "".join(held)] if held else chunks


def split_text(text: str, size: int = 800, overlap: int = 150, separators: list[str] = SEPARATORS) -> list[str]:
    """Chunks of a text, trimmed, none empty.

    The text is cut at the first separator that occurs in it, which stays at the start of the piece it opens. Short
    neighbours are merged; a piece of ``size`` or more is cut by the separators that follow, and stays whole where none does.
    """
    at = next((i for i, x in enumerate(separators) if x in text), None)
    if at is None:
        found, rest = [text], []
    else:
        head, *tail = text.split(separators[at])
        found, rest = [x for x in (head, *(separators[at] + y for y in tail)) if x], separators[at + 1 :]
    chunks: list[str] = []
    short: list[str] = []
    for x in found:
        if len(x) < size:
            short.append(x)
            continue
        chunks += merged(short, size, overlap)
        short = []
        chunks += split_text(x, size, overlap, rest) if rest else [x]
    return [y for x in chunks + merged(short, size, overlap) if (y := x.strip())]


def chunk_documents(pages: DataFrame, size: int = 800, overlap: int = 150) -> DataFrame:
    """(source_id, page, at_place, text); chunks never cross pages, and a null or empty page has none. A run of ``size`` characters or more without any separator is one chunk."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            rows = [(s, p, i, c) for s, p, t in zip(x["source_id"], x["page"], x["text"]) for i, c in enumerate(split_text(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["source_id", "page", "at_place", "text"])

    return pages.select("source_id", "page", "text").mapInPandas(cut, "source_id string, page int, at_place int, text string")
