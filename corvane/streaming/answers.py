"""Placeholders restored in answers that arrive in parts: an open bracket waits for the part that closes it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: An open bracket further back than this is no placeholder.
LONGEST = 24
RESTORED = "request string, part int, text string"


def replaced(text: str, names: dict[str, str]) -> str:
    """``text`` with its placeholders replaced, each once: a value that looks like a placeholder stays."""
    return re.sub(r"\[[A-Z]+_[0-9]+\]", lambda m: names.get(m[0], m[0]), text)


def cut_at(text: str) -> int:
    """Where ``text`` may be cut without splitting a placeholder: before a bracket near its end that is still open."""
    at = text.rfind("[")
    return at if at >= 0 and "]" not in text[at:] and len(text) - at < LONGEST else len(text)


class Restorer(StatefulProcessor):
    """Per request: what was held back, the next part's number, the placeholders, and parts that came too early."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        state = StructType([StructField("held", StringType()), StructField("next", IntegerType())])
        early = StructType([StructField("text", StringType()), StructField("last", IntegerType())])
        self.place = handle.getValueState("place", state)
        self.names = handle.getMapState("names", StructType([StructField("placeholder", StringType())]), StructType([StructField("value", StringType())]))
        self.early = handle.getMapState("early", StructType([StructField("part", IntegerType())]), early)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, due = self.place.get() if self.place.exists() else ("", 0)
        parts: dict[int, tuple[str, int]] = {}
        for batch in rows:
            for r in batch.itertuples():
                for placeholder, value in dict(r.names if r.names is not None else {}).items():
                    self.names.updateValue((placeholder,), (value,))
                if not pd.isna(r.part) and due >= 0 and r.part >= due:
                    parts[int(r.part)] = (r.text or "", int(r.last is not None and bool(r.last)))
        names = {k[0]: v[0] for k, v in self.names.iterator()} if self.names.exists() else {}
        waiting = self.early.exists()
        out: list[tuple[int, str]] = []
        while due >= 0 and (due in parts or waiting and self.early.containsKey((due,))):
            text, last = parts.pop(due) if due in parts else self.early.getValue((due,))
            if waiting and self.early.containsKey((due,)):
                self.early.removeKey((due,))
            held += text
            cut = len(held) if last else cut_at(held)
            out.append((due, replaced(held[:cut], names)))
            held, due = held[cut:], -1 if last else due + 1
        for part, early in parts.items() if due >= 0 else ():
            self.early.updateValue((part,), early)
        self.place.update((held, due))
        if out:
            yield pd.DataFrame({"request": [key[0]] * len(out), "part": [n for n, _ in out], "text": [t for _, t in out]})

    def close(self) -> None:
        pass


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests whose parts are all there, one after the other: what ``Restorer`` gives for them in one batch."""
    request: str | None = None
    names: dict[str, str] = {}
    parts: dict[int, tuple[str, bool]] = {}
    out: list[tuple[str | None, int, str]] = []

    def settle() -> None:
        held, due = "", 0
        while due in parts:
            text, last = parts[due]
            held += text
            cut = len(held) if last else cut_at(held)
            out.append((request, due, replaced(held[:cut], names)))
            held, due = held[cut:], -1 if last else due + 1

    def rows() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.string()))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["request", "part", "text"])

    for batch in batches:
        for of, part, text, last, given in zip(*(batch.column(c).to_pylist() for c in ("request", "part", "text", "last", "names")), strict=True):
            if of != request:
                settle()
                request, names, parts = of, {}, {}
            names.update(given or ())
            if part is not None:
                parts[part] = (text or "", bool(last))
        yield rows()
    settle()
    yield rows()


def restored(parts: DataFrame) -> DataFrame:
    """(request, part, text): the parts of streamed answers with placeholders put back, in the order of their numbers.

    ``parts`` has (request string, part int, text string, last boolean, names map<string, string>): parts count from 0 without
    gaps, ``names`` may be null on all but a request's first one. The texts of a request, joined by part, are its whole answer
    restored, however it was split. A part that comes before an earlier one waits; one that comes again changes nothing; after
    the last one the request is over. Null texts count as empty, rows without a part number give nothing. A stream
    needs the RocksDB state store provider; a table holds all parts already and keeps no state.
    """
    if not parts.isStreaming:
        dealt = parts.select("request", "part", "text", "last", "names").repartition("request").sortWithinPartitions("request")
        return dealt.mapInArrow(_at_once, RESTORED)
    return parts.groupBy("request").transformWithStateInPandas(Restorer(), outputStructType=RESTORED, outputMode="Append", timeMode="None")
