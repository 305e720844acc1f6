"""License scan by diagonal voting.

Every rolling two-word hash of a document is joined to the places it has in the templates. A hit votes for a
diagonal (document place minus template place) of its template. A phrase stands where all its hashes lie on
one diagonal; for the longer passages neighbouring diagonals are merged, so a few words put in or left out do
not break a match. Merged diagonals are only a candidate: they are verified by the longest run of different
template places, rising with the document's words, that lies within the length a changed passage can have.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkveil.llm.common import plain_documents, text_rows

# The base phrases and their labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Labels of the method's own and the passages of license texts and notices that they are found by.
PASSAGES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("gpl-notice", "licensed under the gnu general public license version 3"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-text", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense-text", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("mit-notice", "released under the mit license"),
)
#: Word pairs without which a passage is another license's: its version, or what it does not allow.
DECISIVE = {
    "apache-notice": ("version 2", "2 0"), "gpl-notice": ("gnu general", "version 3"), "cc-by-nc": ("by nc", "nc 4"), "cc-by": ("by 4",),
    "mpl-text": ("mozilla public",), "mit-notice": ("mit license",), "gpl-text": ("gnu general",),
}
#: A passage needs this share of its hashes in one span; diagonals this close are merged, as each of the hashes that may
#: be missing stands for that many words put in at most (see `reach`).
LEAST_SHARE, NEIGHBOURS = 0.75, 3

# A-Z to lower case, other ASCII characters that are no digits or letters to spaces; bytes from 0x80 are word characters.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_ROW = 1 << 16  # hashes in one row
_PRESENT = 0  # hash that every document has once, so that none is lost in the join


def words(text: str) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lowered."""
    return text.encode("utf-8", "replace").translate(_WORDS).split()


def rolling_hashes(found: list[bytes]) -> np.ndarray:
    """Hash of each word and the next as signed 64-bit numbers; never the reserved one."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in found], np.uint64)
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29)))
    return np.where(pair == _PRESENT, np.uint64(1), pair).view(np.int64)


def _templates() -> list[tuple[str, bool, list[int]]]:
    both = [(label, True, text) for label, text in PHRASES.items()] + [(label, False, text) for label, text in PASSAGES]
    return [(label, base, rolling_hashes(words(text)).tolist()) for label, base, text in both]


def _decisive_places(number: int) -> frozenset[int]:
    """Places of a template's hashes that a span of it must have."""
    label, _, hashes = _templates()[number]
    wanted = {h for pair in DECISIVE.get(label, ()) for h in rolling_hashes(words(pair)).tolist()}
    return frozenset(place for place, h in enumerate(hashes) if h in wanted)


def template_places(spark: SparkSession) -> DataFrame:
    """(hash, template, place): a row per template hash, with one for the reserved hash. Its size is that of the lists above."""
    rows = [(h, number, place) for number, (_, _, hashes) in enumerate(_templates()) for place, h in enumerate(hashes)]
    return spark.createDataFrame([(_PRESENT, -1, 0), *rows], "hash long, template int, place int")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId() << 40, 0
    for _, ids, texts in text_rows(batches):
        for at in range(0, len(ids), 256):
            rows, hashes = [], []
            for doc, text in zip(ids[at:at + 256], texts[at:at + 256]):
                found = words(text)
                every = rolling_hashes(found) if len(found) > 1 else np.empty(0, np.int64)
                for start in range(0, max(1, len(every)), _ROW):
                    own = every[start:start + _ROW]
                    if not start:
                        own = np.append(own, _PRESENT)
                    rows.append((part + number, doc, len(found), start))
                    hashes.append(own)
                number += 1
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(h) for h in hashes]))), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(hashes), pa.int64()))
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([*columns, lists], ["row", "doc_id", "n_words", "start", "hashes"])


def votes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, template, diagonal, n, places): the votes of every diagonal, and one row with template -1 per document.

    `places` are the template places that voted, each once, as a diagonal and a place are one word of the document.
    """
    rows = plain_documents(docs).mapInArrow(_scan, "row long, doc_id long, n_words long, start long, hashes array<long>")
    places = rows.select("row", "doc_id", "n_words", "start", F.posexplode("hashes").alias("at", "hash"))
    hits = places.join(F.broadcast(template_places(docs.sparkSession)), "hash")
    diagonal = F.when(F.col("template") < 0, F.lit(0)).otherwise(F.col("start") + F.col("at") - F.col("place"))
    return hits.groupBy("row", "doc_id", "n_words", "template", diagonal.cast("long").alias("diagonal")).agg(
        F.count(F.lit(1)).alias("n"), F.collect_list("place").alias("places")
    )


def least_hashes(hashes: int) -> int:
    """Hashes of a passage that must be found."""
    return math.ceil(LEAST_SHARE * hashes)


def reach(hashes: int) -> int:
    """Words from the first to the last hash of a passage with as many words put in as the share allows."""
    return hashes + NEIGHBOURS * (hashes - least_hashes(hashes))


def _rising(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of the hits (word, place) in which both rise; `hits` are by word, then place downwards."""
    ends, last, before = [], [], []
    for n, (_, place) in enumerate(hits):
        at = bisect_left(ends, place)
        before.append(last[at - 1] if at else -1)
        ends[at:at + 1], last[at:at + 1] = [place], [n]
    run, n = [], last[-1]
    while n >= 0:
        run.append(hits[n])
        n = before[n]
    return run[::-1]


def verified(hits: list[tuple[int, int]], hashes: int, decisive: frozenset[int] = frozenset()) -> list[tuple[int, int, int]]:
    """(first diagonal, last diagonal, number of places) of the spans that hold enough of a passage's places in rising order.

    The decisive places have to be among them.

    From every hit the longest run within `reach` is looked for; only windows with enough different places are searched.
    """
    hits = sorted(hits, key=lambda hit: (hit[0], -hit[1]))
    need, width = least_hashes(hashes), reach(hashes)
    found, inside, end, after = [], Counter(), 0, -1
    for start, (word, place) in enumerate(hits):
        while end < len(hits) and hits[end][0] < word + width:
            inside[hits[end][1]] += 1
            end += 1
        if word > after and len(inside) >= need:
            run = _rising(hits[start:end])
            if len(run) >= need and decisive <= {p for _, p in run}:
                diagonals = [w - p for w, p in run]
                found.append((min(diagonals), max(diagonals), len(run)))
                if len(run) == hashes:  # nothing that starts in a whole passage is a better span of it
                    after = run[-1][0]
        inside[place] -= 1
        if not inside[place]:
            del inside[place]
    return found


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decisive = [_decisive_places(number) for number in range(len(_templates()))]
    for batch in batches:
        at, out = [], []
        for n, (template, hashes, voted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("template", "hashes", "voted")))):
            spans = verified([(v["diagonal"] + place, place) for v in voted for place in v["places"]], hashes, decisive[template])
            at += [n] * len(spans)
            out += [(first, last, number / hashes) for first, last, number in spans]
        kept = batch.select(["row", "doc_id", "n_words", "template", "label", "base"]).take(pa.array(at, pa.int64()))
        spans = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([*kept.columns, *spans], [*kept.schema.names, "first", "last", "share"])


def spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, template, label, base, first, last, share): verified places, and one row per document without a label.

    `first` is the word a span starts at (for merged diagonals the smallest), `last` the largest such start. `share` is
    the part of the passage's hashes in the span; spans of one passage may overlap.
    """
    templates = _templates()
    table = docs.sparkSession.createDataFrame([(-1, None, False, 1)] + [(i, label, base, len(h)) for i, (label, base, h) in enumerate(templates)], "template int, label string, base boolean, hashes int")
    named = votes(docs).join(F.broadcast(table), "template")
    exact = named.where(F.col("base") | (F.col("template") < 0)).where("n >= hashes")
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    passages = named.where(~F.col("base") & (F.col("template") >= 0))
    apart = passages.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOURS).cast("int"))
    grouped = apart.withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(along))
    merged = grouped.groupBy("row", "doc_id", "n_words", "template", "label", "base", "hashes", "span").agg(
        F.collect_list(F.struct("diagonal", "places")).alias("voted")
    )
    different = F.size(F.array_distinct(F.flatten("voted.places")))
    candidates = merged.where(different >= LEAST_SHARE * F.col("hashes"))
    columns = ["row", "doc_id", "n_words", "template", "label", "base"]
    return exact.select(*columns, F.col("diagonal").alias("first"), F.col("diagonal").alias("last"), F.lit(1.0).alias("share")).unionByName(
        candidates.mapInArrow(_verify, "row long, doc_id long, n_words long, template int, label string, base boolean, first long, last long, share double")
    )


def license_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of `docs`.

    A passage is labelled only with its decisive word pairs, so a notice of a similar license, or of another version,
    does not pass for it. Texts are read whole, as rows of at most 65,536 hashes. `score` is 1 with a base phrase, else the largest share of a passage found, else 0. Null text counts as
    empty; texts of fewer than two words have no hashes and no labels. Repeated rows are told apart by their
    place in the scan and give a row each. Null doc_ids stay null. Other columns are ignored. An empty table
    gives no rows.
    """
    base = F.col("base")
    found = spans(docs).groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("last"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"),
        F.max(F.when(F.col("template") >= 0, F.col("share"))).alias("score"),
    )
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"), F.array_join(F.array_sort("labels"), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
