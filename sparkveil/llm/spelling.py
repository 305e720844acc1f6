"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

Two words at one inserted, deleted or replaced letter have letter multisets that differ in at most two places,
taken as binary vectors with a place for each occurrence of each letter. PartEnum finds such vectors exactly:
the letters are dealt into GROUPS groups, a difference of two touches at most two of them, so the projections on
all but two groups agree for at least one choice of the groups. A signature is such a projection together with
the half of the word that the edit leaves alone (its front or its back, for the length of the shorter word),
because words made of the same letters are many. Equal signatures are joined; a pair is then held against the
distance of the vectors, folded to 64 bits, and against the edit distance of the words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import materialize, plain_documents, text_rows

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form is at least so many times as frequent as its variant.
FORM_FACTOR = 10
#: The letters are dealt into so many groups; a signature covers all but DISTANCE of them.
GROUPS = 4
DISTANCE = 2
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}")  # takes a run whole or not at all
_HELD = 1 << 17  # different words a task counts before it hands them on


def word_of(run: bytes, seed: int) -> bytes:
    """The lower-cased run, without one letter if its draw asks for that; `seed` is the checksum of '<doc_id>:'."""
    drawn = zlib.crc32(run, seed)
    if drawn % 31:
        return run
    letters = run.decode()
    at = drawn % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        words = [(w, n) for w, n in ((w.decode(), n) for w, n in held.items()) if len(w) >= LEAST_LETTERS]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], ["word", "n"])

    held: Counter = Counter()
    for _, ids, texts in text_rows(batches):
        for doc_id, text in zip(ids, texts):
            seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
            for run, times in Counter(_RUN.findall(text)).items():
                held[word_of(run.encode().translate(_LOWER), seed)] += times
            if len(held) > _HELD:
                yield rows()
    yield rows()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of LEAST_LETTERS letters or more that occur LEAST_COUNT times or more in all texts together.

    Each task counts its words before they travel, so a frequent word is a row per task.
    """
    counted = plain_documents(docs).mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters that occur, dealt into groups of about equal weight; at most 90 letters come to the driver."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n")).collect()
    loads, dealt = [0] * groups, [""] * groups
    for row in sorted(letters, key=lambda r: (-r.n, r.letter)):
        lightest = loads.index(min(loads))
        loads[lightest] += row.n
        dealt[lightest] += row.letter
    return dealt


def _folded_vector(letters: Column) -> Column:
    """The binary vector of the sorted letters, its places folded to 64 bits; two vectors differ in no fewer places than their folds."""
    place = lambda c, i: F.pmod(F.xxhash64(c, i + 1 - F.array_position(letters, c)), F.lit(64)).cast("int")
    bits = F.transform(letters, lambda c, i: F.call_function("shiftleft", F.lit(1).cast("long"), place(c, i)))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def signatures(words: DataFrame, groups: list[str]) -> DataFrame:
    """(signature, word, n, bits): all PartEnum signatures of each word, each with the half that stays as it is."""
    rows = words.withColumn("letters", F.array_sort(F.filter(F.split("word", ""), lambda c: c != "")))
    rows = rows.select("word", "n", F.coalesce(_folded_vector(F.col("letters")), F.lit(0).cast("long")).alias("bits"), F.array_join("letters", "").alias("sorted"), F.length("word").alias("size"))
    parts = [F.translate("sorted", "".join(g for g in groups if g is not own), "").alias(f"part{i}") for i, own in enumerate(groups)]
    rows = rows.select("word", "n", "bits", "size", *parts)

    def halves(shorter: Column) -> list[Column]:
        front = F.floor(shorter / 2).cast("int")
        return [F.struct(shorter.alias("of"), F.lit(side).alias("side"), half.alias("half")) for side, half in (
            (0, F.substring("word", F.lit(1), front)), (1, F.substring("word", F.col("size") - (shorter - front) + 1, shorter - front)),
        )]

    size = F.col("size")
    own, less = halves(size), halves(size - 1)  # as the shorter word of a pair, and as the longer one
    rows = rows.select("word", "n", "bits", *[f"part{i}" for i in range(len(groups))], F.explode(F.array(*own, *less)).alias("h"))
    rows = rows.where(F.col("h.of") >= LEAST_LETTERS)
    chosen = list(combinations(range(len(groups)), len(groups) - DISTANCE))
    keys = F.array(*[F.xxhash64("h.of", "h.side", "h.half", F.lit(i), *[f"part{g}" for g in choice]) for i, choice in enumerate(chosen)])
    return rows.select(F.explode(keys).alias("signature"), "word", "n", "bits")


def near_pairs(words: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(a, n_a, b, n_b), a before b: every pair of words at exactly one edit, once."""
    signed = signatures(words, letter_groups(words, groups))  # under two names, so that Spark shuffles it once
    close = F.expr(f"a.word < b.word AND bit_count(a.bits ^ b.bits) <= {DISTANCE} AND levenshtein(a.word, b.word, 1) = 1")
    pairs = signed.alias("a").join(signed.alias("b"), (F.col("a.signature") == F.col("b.signature")) & close)
    return pairs.groupBy(F.col("a.word").alias("a"), F.col("b.word").alias("b")).agg(F.max("a.n").alias("n_a"), F.max("b.n").alias("n_b"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): where the forms lead to in the end.

    Every step at least multiplies the count by FORM_FACTOR, so there are no circles and the doubling ends after
    a few rounds.
    """
    reached = materialize(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = reached.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = reached.join(onward, F.col("root") == F.col("at"), "left")
        moved = materialize(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        reached = moved.select("word", "root")


def spelling_forms(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of the vocabulary of `docs`.

    A word's form is the most frequent of the words one edit away, the first by code points of equals, if it is
    FORM_FACTOR times as frequent. Null texts have no words; a null doc_id draws as the empty one. Rows that
    repeat a doc_id count like any other. A text is read whole, its words counted before they travel. Other
    columns are ignored. An empty table gives no rows.
    """
    words = materialize(vocabulary(docs), "spelling-words")
    pairs = materialize(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(
        pairs.select(F.col("b"), F.col("a"), F.col("n_a"))
    )
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("top.near").alias("near"), (-F.col("top.less")).alias("near_n"))
    formed = F.col("near_n") >= FORM_FACTOR * F.col("n")
    forms = materialize(joined.select("word", F.when(formed, F.col("near")).alias("form"), "n", "n_near", F.when(formed, F.col("near_n")).alias("form_n")), "spelling-forms")
    ends = roots(forms.where("form IS NOT NULL"))
    return forms.join(ends.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
