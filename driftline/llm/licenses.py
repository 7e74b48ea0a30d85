"""License scans: a positional index of the rarest words of licence texts, intersected by place, then verified."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words of lower-cased UTF-8: digits, letters, and all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a key phrase that are looked up; how far words around it may be displaced; least share of a text that must be there.
RARE, SLACK, LEAST = 2, 4, 0.6
# Key phrases and wording of public licences, and the labels they stand for.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (label, key phrase, licence text that holds it)
TEXTS = (
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "under the terms of the gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("apache-2.0", "apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "license identifier apache 2 0", "spdx license identifier apache 2 0"),
    ("gpl-2", "gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2", "license identifier gpl 2 0", "spdx license identifier gpl 2 0"),
    ("gpl-3", "gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "license identifier gpl 3 0", "spdx license identifier gpl 3 0"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("mit", "license identifier mit", "spdx license identifier mit"),
    ("bsd", "license identifier bsd", "spdx license identifier bsd"),
    ("mpl-2.0", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "eclipse public license", "made available under the terms of the eclipse public license 2 0"),
    ("bsl-1.0", "boost software license", "distributed under the boost software license version 1 0"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by-nd", "cc by nd", "cc by nd"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd"),
)


@dataclass(frozen=True)
class Template:
    """A licence text as words, and where in it its key phrase begins and ends. Base phrases are texts of their own."""

    label: str
    base: bool
    words: tuple[bytes, ...]
    begin: int
    end: int


def templates() -> list[Template]:
    out = []
    for label, key, text in [*[(v, k, k) for k, v in BASE.items()], *TEXTS]:
        words, phrase = tuple(text.encode().split()), tuple(key.encode().split())
        begin = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        out.append(Template(label, len(out) < len(BASE), words, begin, begin + len(phrase)))
    return out


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """The number of documents, and of those with each word of the licence texts: as many rows at most as these have words."""
    vocabulary = {w for t in templates() for w in t.words}

    def count(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        seen, rows = Counter(), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(vocabulary.intersection(WORD.findall((text or b"").lower())))
        names, counts = [None, *(w.decode() for w in seen)], [rows, *seen.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

    found = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop(None, 0), {w.encode(): n for w, n in found.items()}


class Index:
    """The rarest words of every key phrase, with the texts and places they stand at."""

    def __init__(self, total: int, frequencies: dict[bytes, int]):
        self.templates = templates()
        self.weight = {w: log(1 + (total + 1) / (frequencies.get(w, 0) + 1)) for t in self.templates for w in t.words}
        self.rare = []
        for t in self.templates:
            key = sorted(range(t.begin, t.end), key=lambda i: (-self.weight[t.words[i]], i))
            self.rare.append(key[:RARE])
        self.words = {t.words[i] for t, rare in zip(self.templates, self.rare, strict=True) for i in rare}

    def shifts(self, words: list[bytes]) -> Iterator:
        """Each text with the places in the file where it might begin: those on which its rare words agree."""
        here = self.words.intersection(words)
        if not here:
            return
        places: dict[bytes, list[int]] = {w: [] for w in here}
        for i, w in enumerate(words):
            if w in here:
                places[w].append(i)
        for t, rare in zip(self.templates, self.rare, strict=True):
            if all(t.words[i] in here for i in rare):
                first, *others = sorted(({p - i for p in places[t.words[i]]} for i in rare), key=len)
                agreed = first.intersection(*others)
                if agreed:
                    yield t, sorted(agreed)

    def share(self, t: Template, words: list[bytes], shift: int) -> float:
        """Share of the text that stands there by weight, each word at its place or SLACK words from it."""
        total = there = 0.0
        for i, w in enumerate(t.words):
            total += self.weight[w]
            at = shift + i
            if t.begin <= i < t.end or w in words[max(0, at - SLACK) : max(0, at + SLACK + 1)]:
                there += self.weight[w]
        return there / total

    def scan(self, words: list[bytes]) -> list[tuple[str, bool, int, int, float]]:
        """(label, base, first word of the key phrase, its words, score) of each verified place."""
        out = []
        for t, shifts in self.shifts(words):
            key = list(t.words[t.begin : t.end])
            for shift in shifts:
                a = shift + t.begin
                if words[a : a + len(key)] == key and (score := self.share(t, words, shift)) >= LEAST:
                    out.append((t.label, t.base, a, len(key), score))
        return out


def find_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places): places are (label, base, start, length, score), ordered by start and label.

    A file's licence words of highest inverse document frequency, over all documents, are looked up in the index; where a
    key phrase's rare words stand at the same places relative to it, the phrase is verified word for word and the text
    around it scored by weight. A phrase can't stand anywhere without its rare words, so none is missed, and a base phrase
    is all of its text, so it scores 1. Null and empty texts have no words; texts of any length take time in proportion.
    Repeated rows and null ids are answered each; other columns are not read; an empty table gives an empty result.
    """
    total, frequencies = document_frequencies(docs)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = Index(total, frequencies)
        place = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = WORD.findall((text or b"").lower())
                counts.append(len(words))
                rows = sorted(index.scan(words), key=lambda x: (x[2], x[0], x[3]))
                found.append([dict(zip(("label", "base", "start", "length", "score"), r, strict=True)) for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, place)], names=["doc_id", "n_words", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words long, places array<struct<label:string,base:boolean,start:long,length:long,score:double>>")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_licenses(table(spark, sf_dir, "documents")).withColumn("_b", F.filter("places", lambda x: x["base"]))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    starts = F.transform("_b", lambda x: x["start"])
    return rows.select(
        "doc_id", "n_words", F.size("_b").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(F.col("_b")).alias("base_labels"), names(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )
