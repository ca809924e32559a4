r"""Benchmark decontamination with a positional inverted index over the training text.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lowered. A posting is (term, doc_id, pos); the index
holds the postings of every term that the benchmark has, stored in the order the text is read, so building it shuffles
nothing. Terms of the benchmark that are rarest in the index are looked up first: their postings, moved back by the
term's place in the item, meet on a diagonal (item, document, start). Diagonals that hold rare terms of a window are
then compared word by word with the document, so matches are exact.

All steps are DataFrame expressions. Benchmark tables are broadcast only while they are small (`MAX_BROADCAST` rows),
else joined by key. Null and empty texts have no words: they count 0 and match nothing. Items without an id or without
words are left out. Repeated rows are each reported; repeated items count once. Postings are kept by a hash of doc_id and
text, so that rows that share an id, or have none, are judged each by its own text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import Scratch
from millrace.llm.groups import fresh

WINDOW = 10
#: Rows of a benchmark table that may be sent to every executor.
MAX_BROADCAST = 500_000
#: Proximity: this many of an item's rarest terms, the others within so many words of the rarest.
RARE_TERMS, WITHIN = 4, 20


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (a key), item_id, words, width (of its windows)."""
    kept = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", words_of(F.col("text")).alias("words"))
    return kept.distinct().filter(F.size("words") > 0).select(
        F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.least(F.lit(WINDOW), F.size("words")).alias("width"))


def small(df: DataFrame) -> DataFrame:
    """`df` marked for broadcast if it has at most MAX_BROADCAST rows."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def build_index(docs: DataFrame, items: DataFrame, room: Scratch) -> DataFrame:
    """The postings (term, doc_id, pos) of all words of `items` in `docs`."""
    terms = items.select(F.explode("words").alias("term")).distinct()
    postings = docs.select("doc_id", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return room.store(postings.join(small(terms), "term").select("term", "doc_id", "pos"))


def rare_terms(index: DataFrame, items: DataFrame, room: Scratch) -> tuple[DataFrame, DataFrame]:
    """The two rarest places of every window, as (term, item, place, alone), and each item's rarest terms.

    `alone` marks items one of whose windows has but one word. Windows with a term that the index lacks are left out.
    """
    seen = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    places = items.select("item", "width", F.size("words").alias("size"), F.posexplode("words").alias("place", "term"))
    places = room.store(places.join(seen, "term", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - F.col("width") + 1), F.least("place", F.col("size") - F.col("width"))))
    windows = places.withColumn("start", start).groupBy("item", "width", "start").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("n", "place", "term"))), 1, 2).alias("rare"))
    picks = windows.filter("rare[0].n > 0").select("item", (F.col("width") == 1).alias("alone"), F.explode("rare").alias("r"))
    picks = picks.select("r.term", "item", "r.place", "alone").distinct()
    rarest = places.filter("n > 0").groupBy("item", "term").agg(F.min("n").alias("n")).groupBy("item").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("n", "term"))), 1, RARE_TERMS).alias("rare"))
    return room.store(picks), rarest.select("item", "rare.term")


def diagonals(index: DataFrame, picks: DataFrame) -> DataFrame:
    """item, doc_id, diagonal: starts of an item in a document at which two rare terms, or a lone one, are in place."""
    placed = index.join(small(picks), "term").select("item", "doc_id", "place", (F.col("pos") - F.col("place")).alias("diagonal"), "alone")
    met = placed.groupBy("item", "doc_id", "diagonal").agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.max("alone").alias("alone"))
    return met.filter("low < high OR alone").select("item", "doc_id", "diagonal")


def proximity(index: DataFrame, items: DataFrame, rarest: DataFrame, within: int = WITHIN) -> DataFrame:
    """item_id, doc_id where each of the item's rarest terms lies at most `within` words from one place of the rarest.

    Postings meet in blocks of `within` words: the rarest term is put into its block and both next to it.
    """
    terms = rarest.select("item", F.posexplode("term").alias("rank", "term"), F.size("term").alias("terms"))
    found = index.join(small(terms), "term").select(
        "item", "doc_id", "pos", "rank", "terms", F.floor(F.col("pos") / within).alias("block"))
    first = found.filter("rank = 0").select(
        "item", "doc_id", F.col("pos").alias("at"), "terms", F.explode(F.sequence(F.col("block") - 1, F.col("block") + 1)).alias("block"))
    rest = found.filter("rank > 0").select("item", F.col("doc_id").alias("other"), "block", "pos", "rank")
    near = first.join(rest, (first["item"] == rest["item"]) & (first["block"] == rest["block"])
                      & first["doc_id"].eqNullSafe(rest["other"]) & (F.abs(first["at"] - rest["pos"]) <= within))
    near = near.groupBy(first["item"], "doc_id", "at", "terms").agg(F.countDistinct("rank").alias("n")).filter("n = terms - 1")
    lone = found.filter("terms = 1").select("item", "doc_id")
    return near.select("item", "doc_id").union(lone).join(items.select("item", "item_id"), "item").select("item_id", "doc_id").distinct()


def row_key() -> Column:
    """A key that only rows equal in doc_id and text share."""
    return F.xxhash64("doc_id", "text")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, doc_id, n_words, hits (array of item_id, item_start, pos: words pos.. of the document equal item_start.. of the
    item), spans, near (number of items with a proximity match) for every document."""
    room = Scratch(docs.sparkSession, "index")
    items = room.store(items_of(benchmark))
    index = build_index(docs.select(row_key().alias("doc_id"), "text"), items, room)
    picks, rarest = rare_terms(index, items, room)
    found = diagonals(index, picks).join(small(items), "item").groupBy(F.col("doc_id").alias("in_doc")).agg(
        F.collect_list(F.struct("item_id", "words", "width", "diagonal")).alias("found"))
    near = proximity(index, items, rarest).groupBy(F.col("doc_id").alias("near_doc")).agg(F.count(F.lit(1)).alias("near"))
    found = found.join(near, F.col("in_doc") == F.col("near_doc"), "full").select(
        F.coalesce("in_doc", "near_doc").alias("in_doc"), "found", "near")
    found = room.store(found)

    def starts(candidate: Column) -> Column:
        """The places in the item whose window the document has on this diagonal."""
        places = F.sequence(F.greatest(F.lit(0), -candidate["diagonal"]), F.size(candidate["words"]) - candidate["width"])
        places = F.when(F.size(candidate["words"]) - candidate["width"] >= -candidate["diagonal"], places).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: F.slice(F.col("doc_words"), candidate["diagonal"] + i + 1, candidate["width"])
                        == F.slice(candidate["words"], i + 1, candidate["width"]))

    # Only the texts of documents in which something was found meet it; of the others the number of words is enough.
    keyed, in_found = docs.select(row_key().alias("key"), "doc_id", "text"), F.col("key") == F.col("in_doc")
    keys = small(found.select("in_doc"))
    others = keyed.join(keys, in_found, "left_anti")
    joined = keyed.join(keys, in_found, "left_semi").join(found, in_found).withColumn("doc_words", words_of(F.col("text")))
    hits = F.filter(
        F.transform(F.col("found"), lambda c: F.struct(
            c["item_id"].alias("item_id"), c["width"].alias("width"), c["diagonal"].alias("diagonal"), starts(c).alias("starts"))),
        lambda h: F.size(h["starts"]) > 0)
    checked = joined.select(
        "key", "doc_id", F.size("doc_words").cast("long").alias("n_words"),
        F.coalesce(hits, F.array()).alias("hits"), F.coalesce("near", F.lit(0)).alias("near"))
    return checked.unionAll(others.select(
        "key", "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
        F.array().cast(checked.schema["hits"].dataType).alias("hits"), F.lit(0).cast(checked.schema["near"].dataType).alias("near")))


def hit_words(hits: Column) -> Column:
    """The places of the document's words inside a match, each once."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.flatten(F.transform(
        h["starts"], lambda s: F.sequence(h["diagonal"] + s, h["diagonal"] + s + h["width"] - 1))))))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near for every document."""
    found = matches(docs, benchmark).withColumn(
        "items", F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("string")))))
    return found.select(
        "doc_id", "n_words", F.size(hit_words(F.col("hits"))).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"), F.col("near").cast("long").alias("n_near"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without those whose own text holds an item's window."""
    name = fresh("__dirty", docs.columns)
    dirty = matches(docs.select("doc_id", "text"), benchmark).filter(F.size("hits") > 0).select(F.col("key").alias(name)).distinct()
    return docs.join(dirty, row_key() == F.col(name), "left_anti")
