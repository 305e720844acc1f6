"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. Equal lines are collapsed first, so a common line is one row per task before
it travels. The words of a line are ordered by rarity (counts of all words in a table of fixed size), and only
the rarest, the prefix, are joined: two sets with a Jaccard similarity of at least 4/5 share a prefix word.
Length, position and a 128-bit word signature, which still tells lines of some 200 words apart, bound the
overlap of a pair before it leaves the join; what is left is verified on the words themselves, read from the
documents again.

A line goes if an earlier line (by row, then line number) has a similarity of 4/5 or more. Rows are in order of
doc_id, those without one last and rows that share one by their place in the scan. One earlier
match is enough, so in a bucket of more than BUCKET lines (a word that many near copies share) every line is
first tried against the bucket's first line and the one before it; only lines that neither removes meet the
whole bucket. Work then grows with the lines, not with the pairs of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.llm.common import ROW_KEY, materialize, with_row_keys

#: Similarity as a fraction: 4/5.
ABOVE, BELOW = 4, 5
#: Lines in a prefix word's bucket up to which all its pairs are tried at once.
BUCKET = 256
#: Bits of the table of lines to verify; it only ever lets too many through. Spread over 64-bit words, so of a bounded size.
WANTED_BITS = 1 << 22
#: Cells of the table of word counts, and of its 4-bit levels in one 64-bit number.
CELLS, PACKED, WIDTH_BITS = 1 << 17, 16, 13  # CELLS = PACKED << WIDTH_BITS


def _blanks(text: Column) -> Column:
    """Tab, vertical tab, form feed and carriage return as spaces; texts without them, nearly all, are only searched."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike("[\\t\\x0b\\x0c\\r]"), F.translate(text, "\t\x0b\x0c\r", " " * 4)).otherwise(text)


def _lines(text: Column) -> Column:
    return F.split(_blanks(text), "\n")


def _cell(code: Column) -> Column:
    return code.bitwiseAND(F.lit(CELLS - 1)).cast("int")


def rarity_table(docs: DataFrame) -> Column:
    """Array of CELLS 4-bit levels, PACKED to a number: how often, by powers of two, all words that hash to the cell occur."""
    text = F.replace(_blanks(F.col("text")), F.lit("\n"), F.lit(" "))
    words = docs.select(F.explode(F.split(text, " ")).alias("w")).where("w <> ''")
    counts = words.groupBy(_cell(F.xxhash64("w")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    # Levels count down from the commonest cell, so that they tell common words apart at every size of the corpus.
    rows = counts.select("cell", F.floor(F.log2("n")).alias("level")).collect()  # at most CELLS rows
    top = max((r.level for r in rows), default=0)
    width = CELLS // PACKED
    packed = [0x8888888888888888] * width  # levels are kept with their highest bit turned, so that they sort as signed numbers
    for row in rows:
        packed[row.cell % width] ^= max(0, 15 - top + row.level) << 60 - 4 * (row.cell // width)
    signed = [x - (1 << 64) if x >> 63 else x for x in packed]
    return F.split(F.lit(",".join(map(str, signed))), ",").cast("array<bigint>")


def _tokens(line: Column, table: Column) -> Column:
    """One number per distinct word, rarest first: the level of its cell above 60 bits of its hash."""
    def token(code: Column) -> Column:
        levels = F.coalesce(F.get(table, code.bitwiseAND(F.lit(CELLS // PACKED - 1)).cast("int")), F.lit(0).cast("long"))  # never null: sorts as plain numbers
        shift = F.shiftright(code, WIDTH_BITS - 2).bitwiseAND(F.lit(60)).cast("int")  # four times the level's place
        level = F.call_function("shiftleft", levels, shift).bitwiseAND(F.lit(-1 << 60))
        return level.bitwiseOR(code.bitwiseAND(F.lit((1 << 60) - 1)))

    codes = F.array_distinct(F.array_remove(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))
    return F.sort_array(F.transform(codes, token))


def _parity(weight) -> Column:
    """64 cells with the parity of the words in each, counting those of `weight` 1."""
    def turned(cells: Column, t: Column) -> Column:
        return cells.bitwiseXOR(F.call_function("shiftleft", weight(t), t.bitwiseAND(F.lit(63)).cast("int")))

    return F.aggregate("t", F.lit(0).cast("long"), turned)


def distinct_sets(docs: DataFrame) -> DataFrame:
    """(doc, line, size, prefix, low, high) of the first line of every group of lines with equal word sets.

    `low` and `high` are a signature of 128 cells, with the parity of the words that hash to each. `doc` is the row's key. Lines without words take no part.
    """
    own = docs.select(F.col(ROW_KEY).alias("doc"), F.posexplode(_lines(F.col("text"))).alias("line", "text"))
    # Lines without words are told by their text: a filter on the tokens would have Spark make them a second time.
    own = own.where(F.trim("text") != "").select("doc", "line", _tokens(F.col("text"), rarity_table(docs)).alias("t"))
    all_words = _parity(lambda t: F.lit(1).cast("long"))
    high = _parity(lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(1).cast("long")))
    prefix = F.expr("slice(t, 1, prefix_size)")
    sets = own.withColumn("high", high).withColumn("prefix_size", _prefix_size("size(t)")).select(
        F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"),
        F.struct("doc", "line", F.size("t").alias("size"), prefix.alias("prefix"), all_words.bitwiseXOR(F.col("high")).alias("low"), F.col("high")).alias("set"),
    )
    return sets.groupBy("h1", "h2").agg(F.min("set").alias("set")).select("set.*")


def _prefix_size(size: str) -> Column:
    return F.expr(f"cast({size} - ({ABOVE} * {size} + {BELOW - 1}) div {BELOW} + 1 AS int)")


def _fits() -> Column:
    """Whether b stands before a and passes the length, position and signature filters; each only drops pairs below 4/5.

    A pair of sizes m and n needs an overlap of 4/9 (m + n), so at most (m + n) / 9 words stand on one side
    only; the overlap is at most the words before the shared one plus those from it on.
    """
    return F.expr(
        "(doc > b_doc OR (doc = b_doc AND line > b_line))"
        f" AND {BELOW} * least(size, b_size) >= {ABOVE} * greatest(size, b_size)"
        f" AND {ABOVE + BELOW} * (least(place, b_place) + least(size - place, b_size - b_place)) >= {ABOVE} * (size + b_size)"
        f" AND {ABOVE + BELOW} * (bit_count(low ^ b_low) + bit_count(high ^ b_high)) <= {BELOW - ABOVE} * (size + b_size)"
    )


_ROW = ("doc", "line", "size", "place", "low", "high")
_PAIR = ("doc", "line", "b_doc", "b_line")


def _prefix_rows(sets: DataFrame) -> DataFrame:
    """(token, doc, line, size, place, low, high) per prefix word of a line."""
    return sets.select("doc", "line", "size", "low", "high", F.posexplode("prefix").alias("place", "token")).select("token", *_ROW)


def _placed(rows: DataFrame) -> DataFrame:
    """Prefix rows with the first line of the token's bucket and the one before (first, before)."""
    along = Window.partitionBy("token").orderBy("doc", "line")
    own = F.struct(*_ROW)
    return rows.select("token", *_ROW, F.first(own).over(along).alias("first"), F.lag(own).over(along).alias("before"))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of prefix rows of one bucket that pass the filters."""
    right = right.select(F.col("token").alias("b_token"), *[F.col(c).alias(f"b_{c}") for c in _ROW])
    pairs = left.select("token", *_ROW).join(right, (F.col("token") == F.col("b_token")) & _fits())
    return pairs.select(*_PAIR, "size", "b_size")


def _near(large: DataFrame) -> DataFrame:
    """Pairs of prefix rows with their bucket's first row and the row before."""
    rows = large.select(*_ROW, F.explode(F.array("first", "before")).alias("other")).where(F.col("other").isNotNull())
    rows = rows.select(*_ROW, *[F.col("other")[c].alias(f"b_{c}") for c in _ROW])
    return rows.where(_fits()).select(*_PAIR, "size", "b_size")


def _pairs(met: DataFrame) -> DataFrame:
    """(doc, line, b_doc, b_line), each pair once, of pairs that may reach 4/5.

    `met` has a row per shared prefix word, so their number bounds the overlap too: what is shared beyond them
    lies behind the prefix of one of the two.
    """
    pairs = met.groupBy(*_PAIR, "size", "b_size").agg(F.count(F.lit(1)).alias("shared"))
    behind = F.greatest(F.col("size") - _prefix_size("size"), F.col("b_size") - _prefix_size("b_size"))
    return pairs.where((ABOVE + BELOW) * (F.col("shared") + behind) >= ABOVE * (F.col("size") + F.col("b_size"))).select(*_PAIR)


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, line) of the first side of the pairs whose words have a Jaccard similarity of 4/5 or more."""
    ids = pairs.select("doc", "line").union(pairs.select("b_doc", "b_line")).distinct()
    # Written first, so that Spark knows its size when it chooses how to join the texts.
    wanted = materialize(ids, "line-wanted")
    # Most lines are told by a bit table where they are read, and only the others travel.
    cell = F.pmod(F.xxhash64("doc", "line"), F.lit(WANTED_BITS))
    cells = wanted.select((cell / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int")).alias("bit"))
    cells = cells.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    lines = docs.select(F.col(ROW_KEY).alias("doc"), F.posexplode(_lines(F.col("text"))).alias("line", "text"))
    lines = lines.withColumn("word", (cell / 64).cast("int")).join(F.broadcast(cells), "word").where(F.getbit("bits", (cell % 64).cast("int")) == 1)
    # No semi join: Spark would take it before the bit table, on all lines. `wanted` has each line once.
    chosen = lines.select("doc", "line", "text").join(wanted, ["doc", "line"])
    words = chosen.select("doc", "line", F.array_distinct(F.array_remove(F.split("text", " "), "")).alias("words"))
    # Travels as one string: an array of strings takes more than twice the space.
    words = materialize(words.select("doc", "line", F.size("words").alias("n"), F.array_join("words", " ").alias("words")), "line-words")
    other = words.select(*[F.col(c).alias(f"b_{c}") for c in words.columns])
    both = pairs.join(words, ["doc", "line"]).join(other, ["b_doc", "b_line"])
    shared = F.size(F.array_intersect(F.split("words", " "), F.split("b_words", " ")))
    close = (ABOVE + BELOW) * shared >= ABOVE * (F.col("n") + F.col("b_n"))
    return materialize(both.where(close).select("doc", "line").distinct(), "line-matched")


def first_lines(docs: DataFrame) -> DataFrame:
    """(doc, line) of the lines that stay, of those that have words; `docs` has row keys, which `doc` holds."""
    sets = materialize(distinct_sets(docs), "line-sets")
    rows = _prefix_rows(sets)
    hot = rows.groupBy(F.col("token").alias("hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("hot")
    hot = materialize(hot, "line-hot")
    in_hot = F.col("token") == F.col("hot")
    if hot.isEmpty():
        rows = rows.repartition("token")  # one shuffle for both sides of the join; no bucket has over BUCKET lines here
        gone = _verified(docs, materialize(_pairs(_met(rows, rows)), "line-pairs"))
    else:
        large = rows.join(hot, in_hot, "left_semi")
        near = _near(_placed(large)).select(*_PAIR).distinct()
        first = _verified(docs, materialize(near, "line-near"))
        # Of a line that is gone already not all shared words are met below; it stays gone whatever they bound.
        small = rows.join(hot, in_hot, "left_anti").repartition("token")
        met = materialize(_met(small, small), "line-met")
        open_rows = _prefix_rows(sets.join(first, ["doc", "line"], "left_anti")).join(hot, in_hot, "left_semi")
        pairs = materialize(_pairs(met.unionByName(_met(open_rows, large))), "line-pairs")
        pairs = pairs.join(first, ["doc", "line"], "left_anti")
        gone = first.unionByName(_verified(docs, pairs))
    return sets.select("doc", "line").join(gone, ["doc", "line"], "left_anti")


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_lines) per row of `docs`: line numbers from 0, comma-joined, of the lines with words that stay.

    Lines without words always stay and are not listed; null text counts as empty, one line without words.
    Rows that repeat a doc_id or have none are told apart by a key of their own and lose lines like any other.
    Other columns are ignored. An empty table gives no rows.
    """
    docs = with_row_keys(docs)
    kept = first_lines(docs).groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("kept"))
    text = F.coalesce("text", F.lit(""))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1
    worded = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D][^\\n]*"))  # from a line's first word to its end
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ROW_KEY, n_lines.cast("long").alias("n_lines"), worded.alias("worded"))
    found = counts.join(kept, F.col(ROW_KEY) == F.col("doc"), "left")
    staying = F.coalesce(F.size("kept"), F.lit(0))
    return found.select(
        "doc_id", "n_lines", (F.col("worded") - staying).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("kept", ","), F.lit("")).alias("kept_lines"),
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated lines taken out of `text`; every row and column stays, null text stays null."""
    columns, docs = docs.columns, with_row_keys(docs)
    kept = first_lines(docs).groupBy("doc").agg(F.collect_set("line").alias("kept"))
    found = docs.join(kept, docs[ROW_KEY] == kept["doc"], "left")
    stays = lambda x, i: (F.length(F.translate(x, "\t\x0b\x0c\r ", "")) == 0) | F.array_contains(F.coalesce(kept["kept"], F.array().cast("array<int>")), i)
    text = F.array_join(F.filter(F.split(docs["text"], "\n"), stays), "\n")
    return found.select(*[text.alias("text") if c == "text" else docs[c] for c in columns])
