"""XML as node tables: one row per element, so that per-row names can be joined on."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame

NODE = "node INT, parent INT, depth INT, path STRING, tag STRING, attrs MAP<STRING,STRING>, text STRING"


def elements(xml: str | None) -> list[tuple]:
    """(node, parent, depth, path, tag, attrs, leading text) in document order; names keep their prefixes.

    Null and empty documents have no elements; of a malformed one, those before the error.
    """
    rows: list[list] = []
    stack: list[int] = []
    children: list[int] = []
    started: list[bool] = []
    parser = expat.ParserCreate()

    def start(tag: str, attrs: dict) -> None:
        parent = stack[-1] if stack else -1
        if stack:
            started[-1] = True
            children[-1] += 1
        path = f"{rows[parent][3]}/{children[-1]}" if stack else "0"
        rows.append([len(rows), parent, len(stack), path, tag, dict(attrs), ""])
        stack.append(len(rows) - 1)
        children.append(0)
        started.append(False)

    def end(_: str) -> None:
        stack.pop()
        children.pop()
        started.pop()

    def data(text: str) -> None:
        if stack and not started[-1]:
            rows[stack[-1]][6] += text

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.buffer_text = True
    try:
        if xml:
            parser.Parse(xml.lstrip("﻿ \t\r\n"), True)
    except expat.ExpatError:
        pass
    return [tuple(r) for r in rows]


def element_table(docs: DataFrame, keys: list[str]) -> DataFrame:
    """docs: ``keys`` and xml. Returns keys, node, parent, depth, path (child numbers), tag, attrs, text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema) + ", " + NODE
    names = [*keys, "node", "parent", "depth", "path", "tag", "attrs", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                got = elements(row[-1])
                if got:
                    yield pd.DataFrame([(*row[:-1], *e) for e in got], columns=names)

    return docs.select(*keys, "xml").mapInPandas(run, schema)
