"""Line dedup by an exact set-similarity join, in DataFrame and SQL functions only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.llm.common import plain_names, written

#: Buckets (2^22) of the table of word counts that orders words by rarity: its size has a bound whatever
#: the vocabulary. Words that share a bucket only make the order less sharp, not the join inexact.
BUCKET_BITS = 22
#: Bits of the tables that tell which lines are needed.
FLAG_BITS = 23
#: Lines of a word's list that all others of the list are compared with first.
PIVOTS = 64
#: What stands between words inside a line, as SQL.
BLANK = "' \\t\\r\\u000b\\u000c'"
# Two lines match if their common words are at least 4/9 of both lines' words: Jaccard 0.8.
NUMERATOR, DENOMINATOR = 4, 9


def _with_ids(docs: DataFrame) -> DataFrame:
    """(d, text): rows without an id get a number from their text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(text)).alias("d"), text.alias("text"))


def _clean(text: Column) -> Column:
    """Lower case, with blanks for other white space inside a line."""
    low = F.lower(text)
    other = F.contains(low, F.lit("\t")) | F.contains(low, F.lit("\r")) | F.contains(low, F.lit("\x0b")) | F.contains(
        low, F.lit("\x0c"))
    return F.when(other, F.translate(low, "\t\r\x0b\x0c", "    ")).otherwise(low)


def _lines(rows: DataFrame) -> DataFrame:
    """(d, line_no, line): lines with at least one word, cleaned, one blank between words."""
    # in a step of its own a text is put into lower case once; inside a generator, once for every mention
    cleaned = rows.select("d", _clean(F.col("text")).alias("text"))
    line = F.trim("line")
    single = F.when(F.contains(F.col("line"), F.lit("  ")), F.regexp_replace(line, " +", " ")).otherwise(line)
    return cleaned.select("d", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(line != "").select(
        "d", "line_no", single.alias("line"))


def _by_bucket(counts: DataFrame) -> DataFrame:
    """Numbers by bucket as one row with an array of fixed length, put together from arrays of 1024."""
    none = counts.sparkSession.range(1 << BUCKET_BITS).select(F.col("id").alias("bucket"), F.lit(0).cast("bigint").alias("n"))
    whole = counts.union(none).groupBy("bucket").agg(F.least(F.sum("n"), F.lit((1 << 20) - 1)).cast("int").alias("n"))
    part = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "n"))), lambda x: x["n"])
    parts = whole.groupBy(F.shiftright("bucket", 10).alias("part")).agg(part.alias("counts"))
    listed = F.sort_array(F.collect_list(F.struct("part", "counts")))
    return parts.agg(F.flatten(F.transform(listed, lambda x: x["counts"])).alias("counts"))


def _bucket(of_hash: Column) -> Column:
    return F.shiftrightunsigned(of_hash, 64 - BUCKET_BITS)


@contextmanager
def _variable(counts: DataFrame) -> Iterator[str]:
    """The table as a variable of the session: functions of arrays can look into it without a copy
    of it in every row."""
    spark, name = counts.sparkSession, f"line_dedup_{uuid.uuid4().hex}"
    counts.createOrReplaceTempView(name)
    spark.sql(f"DECLARE VARIABLE {name} ARRAY<INT>")
    spark.sql(f"SET VAR {name} = (SELECT counts FROM {name})")
    spark.catalog.dropTempView(name)
    try:
        yield name
    finally:
        spark.sql(f"DROP TEMPORARY VARIABLE {name}")


def word_counts(rows: DataFrame) -> DataFrame:
    """How often the words of each bucket occur, over all lines of all documents."""
    cleaned = rows.select(F.replace(_clean(F.col("text")), F.lit("\n"), F.lit(" ")).alias("text"))
    every = cleaned.select(F.explode(F.split("text", " ")).alias("w"))
    return _by_bucket(every.filter("w <> ''").groupBy(_bucket(F.xxhash64("w")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")))


def line_sets(rows: DataFrame) -> DataFrame:
    """One row per different line, written: where it first stands (d, line_no), the number of its words,
    128 bits of its words, and its prefix. A bit is the parity of the words that fall on it, so two lines
    differ in no more bits than in words.

    The words of a line are ordered by rarity: by the count of their bucket, then by hash. Lines that match
    share one of the first n - ceil(0.8 n) + 1 words of each.
    """
    with _variable(word_counts(rows)) as table:
        place = f"cast({table}[cast(shiftrightunsigned(h, {64 - BUCKET_BITS}) as int)] as bigint)"
        hashed = _lines(rows).select(
            "d", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"),
            F.expr(f"sort_array(transform(array_distinct(transform(split(line, ' '), w -> xxhash64(w))), "
                   f"h -> shiftleft({place}, 43) | shiftrightunsigned(h, 21)))").alias("words"))
        ordered = hashed.select(
            "h1", "h2", "d", "line_no", F.size("words").alias("n"),
            F.expr("aggregate(words, 0L, (b, h) -> b ^ shiftleft(1L, cast(h & 63 as int)))").alias("bits0"),
            F.expr("aggregate(words, 0L, (b, h) -> b ^ shiftleft(shiftright(h, 6) & 1L, cast(h & 63 as int)))").alias("bits1"),
            F.expr("slice(words, 1, size(words) - (4 * size(words) + 4) div 5 + 1)").alias("prefix"))
        return written(ordered.groupBy("h1", "h2").agg(
            F.min(F.struct("d", "line_no")).alias("at"), *[F.first(c).alias(c) for c in ("n", "bits0", "bits1", "prefix")]).select(
            "at.d", "at.line_no", "n", "bits0", "bits1", "prefix"))


def _may_match() -> Column:
    """Order, length, position and bits: matching lines differ in at most a ninth of both lines' words."""
    # bits0 has the parity of all words that fall on a bit, bits1 of every second one of them
    all_bits, odd_bits = (F.col(f"a_bits{k}").bitwiseXOR(F.col(f"bits{k}")) for k in (0, 1))
    return (((F.col("a_d") < F.col("d")) | ((F.col("a_d") == F.col("d")) & (F.col("a_line_no") < F.col("line_no"))))
            & (F.least("a_n", "n") * 5 >= F.greatest("a_n", "n") * 4)
            & (F.least(F.col("a_n") - F.col("a_place"), F.col("n") - F.col("place")) * DENOMINATOR
               >= (F.col("a_n") + F.col("n")) * NUMERATOR)
            & ((F.bit_count(all_bits.bitwiseXOR(odd_bits)) + F.bit_count(odd_bits)) * DENOMINATOR <= F.col("a_n") + F.col("n")))


def _earlier(entries: DataFrame) -> DataFrame:
    return entries.withColumnsRenamed({c: f"a_{c}" for c in ("d", "line_no", "n", "bits0", "bits1", "place")})


PAIR = ["a_d", "a_line_no", "d", "line_no"]


def _bits(hashes: DataFrame) -> Column:
    """A table of 2^FLAG_BITS bits of the hashes in ``at``, as an array of numbers of 64 bits each."""
    place = F.shiftrightunsigned("at", 64 - FLAG_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(at, {64 - FLAG_BITS}) & 63 as int))")
    set_ = hashes.select(F.shiftrightunsigned(place, 6).alias("word"), bit.alias("bits"))
    none = hashes.sparkSession.range(1 << (FLAG_BITS - 6)).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    whole = set_.union(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    listed = F.sort_array(F.collect_list(F.struct("word", "bits")))
    return whole.agg(F.transform(listed, lambda x: x["bits"]).alias("bits")).scalar()


def _among(table: Column, hashed: Column) -> Column:
    """Whether the hash may be among those of the table; always true if it is."""
    place = F.shiftrightunsigned(hashed, 64 - FLAG_BITS)
    word = F.get(table, F.shiftrightunsigned(hashed, 64 - FLAG_BITS + 6).cast("int"))
    return F.call_function("getbit", word, place.bitwiseAND(F.lit(63)).cast("int")) == 1


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(d, line_no) of lines that match an earlier line, by their words. Texts are read again; tables of
    bits of fixed size pass over most documents and lines that are in no pair."""
    ends = pairs.select("d", "line_no").union(pairs.select("a_d", "a_line_no"))
    own, line = F.xxhash64("d"), F.xxhash64("d", "line_no")
    # written, as both joins take it: texts are not read once for each, and a line in many pairs may be split
    needed = written(_lines(rows.filter(_among(_bits(ends.select(own.alias("at"))), own))).filter(
        _among(_bits(ends.select(line.alias("at"))), line)).select(
        "d", "line_no", F.array_distinct(F.split("line", " ")).alias("words")))
    other = needed.select(F.col("d").alias("a_d"), F.col("line_no").alias("a_line_no"), F.col("words").alias("a_words"))
    common = F.size(F.array_intersect("words", "a_words"))
    return pairs.join(needed, ["d", "line_no"]).join(other, ["a_d", "a_line_no"]).filter(
        common * DENOMINATOR >= (F.size("words") + F.size("a_words")) * NUMERATOR).select("d", "line_no").distinct()


def repeated(docs: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(sets, matched): all different lines where they first stand, and those that match an earlier one.

    A word's list is first compared with its ``pivots`` earliest lines, which decides short lists
    altogether and most lines of long ones, such as the variants of a passage that thousands of
    documents share. Only the lines that are still undecided are compared with the rest of long lists.
    """
    rows = _with_ids(docs)
    sets = line_sets(rows)
    listed = sets.select("d", "line_no", "n", "bits0", "bits1", F.posexplode("prefix").alias("place", "word")).filter(
        F.shiftright("word", 43) > 1)  # a word that occurs once is in no other line
    # dealt out once for the ranks and both sides of the join: that nothing is null is said here, as
    # otherwise the planner would add it to one side only, and deal out each side on its own
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in listed.columns])
    entries = listed.filter(there).repartition("word")
    ranked = entries.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("d", "line_no")))
    early = _earlier(ranked.filter(F.col("rank") <= pivots).drop("rank"))
    pairs = entries.join(early, "word").filter(_may_match()).select(*PAIR).distinct()
    late = ranked.filter(F.col("rank") > pivots).drop("rank")
    first = written(pairs.unionByName(late, allowMissingColumns=True))
    found = written(_verified(first.filter("word is null").select(*PAIR), rows))
    late = first.filter("word is not null").drop("a_d", "a_line_no")
    # most undecided lines are told by the table of bits; only what may be decided is held against the list
    line = F.xxhash64("d", "line_no")
    maybe = _among(_bits(found.select(line.alias("at"))), line)
    undecided = late.filter(~maybe).unionByName(late.filter(maybe).join(found, ["d", "line_no"], "left_anti"))
    second = written(undecided.join(_earlier(late), "word").filter(_may_match()).select(*PAIR).distinct())
    return sets, written(found.union(_verified(second, rows)).distinct())


def removed_lines(docs: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """(d, kept): per document with lines that stay, the numbers of those that hold words."""
    sets, matched = repeated(docs, pivots)
    return sets.join(matched, ["d", "line_no"], "left_anti").groupBy("d").agg(
        F.sort_array(F.collect_list("line_no")).alias("kept"))


def _decided(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``docs`` with the text without its repeated lines in the place of ``text``."""
    named, (doc_id, own) = plain_names(docs, "doc_id", "text")
    text = F.coalesce(F.col(own).cast("string"), F.lit(""))
    keyed = named.withColumn("d", F.coalesce(F.col(doc_id).cast("bigint"), F.xxhash64(text)))
    stays = (f"transform(array(split(lines, '\\n')), l -> filter(l, (x, i) -> trim(BOTH {BLANK} FROM x) = '' "
             "or array_contains(coalesce(kept, array()), i)))[0]")
    left = keyed.join(kept, "d", "left").withColumn("lines", text).withColumn("lines", F.expr(stays))
    return left.withColumn(own, F.when(F.col(own).isNotNull(), F.array_join("lines", "\n"))).select(
        *named.columns).toDF(*docs.columns)


def without_repeated_lines(docs: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """``docs`` with the lines taken out of ``text`` that match an earlier line, all other columns as they are.

    Lines are ordered by document id and place in the text; rows without an id take part under a number
    from their text. A line's words are what stands between white space, in lower case, each once. Two
    lines match if the Jaccard similarity of their words is at least 0.8. A line goes if any earlier
    line matches, whether that one stays or not. Lines without words stay; a null text stays null, a
    text may become empty. Rows that share an id are one document: a line of one that goes, goes at
    its place in all. Empty tables give no rows. Other columns may have any names.
    """
    return _decided(docs, removed_lines(docs, pivots))


def line_report(docs: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, n_lines, removed): per row the number of its lines and the numbers of those that go.

    Lines and what matches are those of ``without_repeated_lines``; numbers begin at 0. A null or empty text
    has one line, without words, so none goes. A null id stays null, equal rows come out once each with the
    same numbers, an empty table gives no rows; only doc_id and text are read.
    """
    kept = removed_lines(docs, pivots)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    worded = F.expr(f"filter(transform(lines, (x, i) -> if(trim(BOTH {BLANK} FROM x) <> '', i, -1)), i -> i >= 0)")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("t")).select(
        "doc_id", F.coalesce("doc_id", F.xxhash64("t")).alias("own"), F.split("t", "\n").alias("lines")).select(
        "doc_id", "own", F.size("lines").alias("n_lines"), worded.alias("worded"))
    return own.join(kept, F.col("own") == F.col("d"), "left").select(
        "doc_id", "n_lines", F.array_except("worded", F.coalesce("kept", F.array().cast("array<int>"))).alias("removed"))
