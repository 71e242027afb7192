"""Token counts per section, from one encoding of each whole document.

The token spans follow from the bytes that each id stands for; they are interval-joined to the sections' spans, both
sorted. A token that crosses a boundary is allocated by an explicit rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shutterlake.llm.common import read
from shutterlake.llm.tokenizing import VOCABULARY, encoder

#: first/last: the section of the token's first/last character; majority: that with most of its characters, the
#: earlier of equals; share: each section gets the part of the token that lies in it.
RULES = ("first", "last", "majority", "share")

_COUNT = "doc_id long, section int, start long, end long, n_tokens double, n_crossing long"


def line_sections(text: str) -> list[tuple[int, int]]:
    """Character spans of the lines, each with its line break; a text without characters has one empty section."""
    spans = [m.span() for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]
    return spans or [(0, 0)]


def token_spans(ids: np.ndarray, text: str, byte_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token. A character whose bytes several tokens share belongs to each of them."""
    ends = np.cumsum(byte_length[ids])
    starts = ends - byte_length[ids]
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    if len(raw) == len(text):
        return starts, ends
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens allocated to each section and how many of the tokens that touch it cross its boundary.

    Sections are sorted and don't overlap; characters outside of any section give their tokens to none.
    """
    if rule not in RULES:
        raise ValueError(f"the rule must be one of {RULES}")
    bounds = np.array([x for s in sections for x in s], np.int64)
    n = len(sections)
    # Elementary intervals: an odd place is inside of section (place - 1) / 2.
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends - 1, side="right")
    got, crossing = np.zeros(n), np.zeros(n, np.int64)
    inside = (first == last) & (first % 2 == 1)
    got += np.bincount((first[inside] - 1) // 2, minlength=n)
    for i in np.flatnonzero(first != last):
        parts = []
        for place in range(first[i], last[i] + 1):
            a = bounds[place - 1] if place else starts[i]
            b = bounds[place] if place < len(bounds) else ends[i]
            if (size := min(b, ends[i]) - max(a, starts[i])) > 0:
                parts.append((place, int(size)))
        for place, _ in parts:
            if place % 2:
                crossing[(place - 1) // 2] += len(parts) > 1
        if rule == "share":
            for place, size in parts:
                if place % 2:
                    got[(place - 1) // 2] += size / (ends[i] - starts[i])
        else:
            place = {"first": parts[0], "last": parts[-1], "majority": max(parts, key=lambda p: p[1])}[rule][0]
            if place % 2:
                got[(place - 1) // 2] += 1
    return got, crossing


def _counts(vocabulary: str, rule: str, sections_of):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            ids_out, parts = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                sections = sections_of(text)
                if not sections:
                    continue
                got, crossing = attribute(*token_spans(own.ids(text), text, own.byte_length), sections, rule)
                spans = np.array(sections, np.int64)
                ids_out.extend([doc_id] * len(spans))
                parts.append((np.arange(len(spans), dtype=np.int32), spans[:, 0], spans[:, 1], got, crossing))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, t) for t in (np.int32, np.int64, np.int64, np.float64, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(ids_out, pa.int64()), *map(pa.array, columns)], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return count


def count_tokens(docs: DataFrame, rule: str = "majority", sections_of=line_sections, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each section of docs(doc_id, text): doc_id, section (from 0), start, end, n_tokens, n_crossing.

    `sections_of` gives a text's sorted, disjoint character spans. Null and empty texts have one empty section with no
    tokens. A text of any length is encoded whole. A token that lies in equal parts in several sections counts, by
    "majority", for the first of them. Null or repeated doc_ids keep a set of rows for each row of the input; an empty table gives none; extra
    columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_counts(vocabulary, rule, sections_of), _COUNT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the tokens of every line of every document, a crossing token going to the line with most of it."""
    return count_tokens(read(spark, sf_dir, "documents"))
