"""Benchmark decontamination: short test items found inside long documents.

Shingles are five consecutive words (letters, marks and digits, lower case); a text of fewer words has
its whole word sequence as its only shingle. An item is found in a document that holds at least 80 % of
the item's distinct shingles. Items of one to four words are looked for as well: documents also give their
windows of those lengths below five that occur among the items.

Items are partitioned by size: class ``c`` holds those of ``2^c`` to ``2^(c+1) - 1`` shingles. The MinHash
signature of an item is its ``k`` smallest shingle hashes, with one ``k`` per class: one more than the
largest member of the class may miss. An item that is contained therefore has a signature hash in the
document, so the search loses nothing; the document side is probed with all its shingles, and only where
it is large enough to hold the class. Candidates are verified by their shingles themselves, not by hashes.

Only DataFrame functions are used. Signature and shingle tables are broadcast when their counted rows are
few and joined by shuffle otherwise. Grouping keys contain the document, so no group grows with an item.

Defined results: null texts and texts without a word hold nothing and are held by nothing. Rows that
share an item_id are one item; rows that share a doc_id are judged each by its own text, and the largest
share counts. Rows without an id are left out of the pairs; ``clean_documents`` judges every row by its own text,
whatever its id. Long texts are worked on whole; empty tables give no pairs and keep every document. Other columns
of either table are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.llm.common import bound_once, checked_side, materialized, whole_text

SHINGLE = 5
PERCENT = 80


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def _windows(words: Column, build, lengths: Sequence[int] = ()) -> Column:
    """``build`` of every five words, or of all words where there are fewer, and of all windows of ``lengths``."""
    n = F.size(words)

    def every(length: int) -> Column:
        return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), lambda i: build(words, i, length)))

    whole = F.when(n >= SHINGLE, every(SHINGLE)).when(n > 0, F.array(build(words, F.lit(0), SHINGLE)))
    if not lengths:
        return F.array_distinct(whole)
    short = [F.coalesce(every(length), F.array_except(whole, whole)) for length in lengths]
    return F.array_distinct(F.concat(whole, *short))


def _hash(words: Column, start: Column, length: int) -> Column:
    taken = [F.coalesce(F.get(words, start + k), F.lit("")) if k < length else F.lit("") for k in range(SHINGLE)]
    return F.xxhash64(*taken)


def _text(words: Column, start: Column, length: int) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def short_lengths(items: DataFrame) -> list[int]:
    """The numbers of words below five that occur among the items: four at most."""
    n = F.size(_words(whole_text()))
    found = items.filter("item_id IS NOT NULL").select(n.alias("n")).filter((F.col("n") > 0) & (F.col("n") < SHINGLE)).distinct()
    return sorted(r["n"] for r in found.collect())


def _shingled(docs: DataFrame, key: str, build, lengths: Sequence[int] = ()) -> DataFrame:
    """One row per distinct shingle of a text: key, version of the text, number of shingles, shingle.

    A row without an id or a word gives a null shingle, which joins with nothing.
    """
    text = F.when(F.col(key).isNotNull(), whole_text()).otherwise("")
    shingles = bound_once(_words(text), lambda words: _windows(words, build, lengths))
    exploded = docs.select(key, F.xxhash64(text).alias("version"), shingles.alias("shingles"))
    # Outer, because the size filter that Spark derives from a plain explode would be pushed below and
    # hash the text a second time.
    return exploded.select(key, "version", F.size("shingles").alias("size"), F.explode_outer("shingles").alias("shingle"))


def signatures(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """item_id, size_class, least (shingles a document needs) and one row per signature hash."""
    shingles = _shingled(items, "item_id", _hash).filter("shingle IS NOT NULL").withColumnRenamed("shingle", "hash")
    sets = shingles.groupBy("item_id").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))
    n = F.size("hashes")
    size_class = F.floor(F.log2(n.cast("double"))).cast("int")
    largest = F.pow(F.lit(2.0), size_class + 1) - 1
    may_miss = F.floor((100 - percent) * largest / 100).cast("int")
    return sets.select(
        "item_id",
        size_class.alias("size_class"),
        F.ceil(percent * n / 100).cast("int").alias("least"),
        F.explode(F.slice("hashes", F.lit(1), may_miss + 1)).alias("hash"),
    )


def candidates(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Distinct (doc_id, item_id) where a document holds a signature hash of an item it could contain."""
    index, rows = materialized(signatures(items, percent))
    probes = _shingled(docs, "doc_id", _hash, short_lengths(items)).withColumnRenamed("shingle", "hash")
    hits = probes.join(checked_side(index, rows), "hash").filter("coalesce(size, 0) >= least")
    return hits.select("doc_id", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, item_shingles, shared_shingles, containment of every contained item."""
    pairs, n_pairs = materialized(candidates(docs, items, percent))
    found = docs.select("doc_id", "text").join(
        checked_side(pairs.select("doc_id").distinct(), n_pairs), "doc_id", "leftsemi"
    )
    wanted = _shingled(items, "item_id", _text).select("item_id", "shingle").distinct().filter("shingle IS NOT NULL")
    wanted, n_wanted = materialized(wanted)
    sizes = wanted.groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    shared = (
        _shingled(found, "doc_id", _text, short_lengths(items))
        .join(checked_side(wanted, n_wanted), "shingle")
        .join(checked_side(pairs, n_pairs), ["doc_id", "item_id"], "leftsemi")
        .groupBy("doc_id", "version", "item_id")
        .agg(F.count_distinct("shingle").alias("shared_shingles"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("shared_shingles").alias("shared_shingles"))
    )
    return (
        shared.join(checked_side(sizes, n_wanted), "item_id")
        .filter(100 * F.col("shared_shingles") >= percent * F.col("item_shingles"))
        .select(
            "doc_id", "item_id", "item_shingles", "shared_shingles",
            (F.col("shared_shingles") / F.col("item_shingles")).alias("containment"),
        )
    )


def clean_documents(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that contain no item. Rows are told apart by their texts, so those without an id are judged too."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaks, rows = materialized(contained_items(texts, items, percent).select(F.col("doc_id").alias("leak")).distinct())
    # A text of many copies is one row on the other side, so a hot key only splits the documents.
    return docs.join(checked_side(leaks, rows), F.xxhash64("text") == F.col("leak"), "leftanti").select([F.col(f"`{c}`") for c in docs.columns])
