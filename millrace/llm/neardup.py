"""Near duplicates by ProbMinHash: probability Jaccard of weighted five-word shingles, banding and verification.

Words are runs of digits, letters and non-ASCII characters with A-Z lowered; a shingle is five of them in a row (all of
them where a text has fewer), weighted by how often the text has it. Every shingle is a Poisson process of arrivals
whose rate is its weight; an arrival falls on one of `registers`, and a register keeps the shingle that arrives first.
Two texts agree in a register with the probability J = sum over shared x of 1 / sum over y of
max(a(y) / a(x), b(y) / b(x)): the share of shared shingles where no shingle repeats. A process ends early, once its
next arrival is later than the last one that any register of its text has kept.

Equal texts become one node first, known by the MD5 of the text. Nodes that agree in all registers of a band share a
bucket; a bucket's members are compared with one of them, and members that are then still in different components with
each other, in blocks of a bounded number of members that report only links. So no link that connects different texts
is lost to a bucket's size, and no bucket emits its pairs. Links are verified by the exact J of the two texts. Classes
are connected components.

A pair of J = 0.8 shares no bucket with a probability of (1 - 0.8^4)^24 = 3e-6. A null text is a class of its own. Texts
without words link to equal texts only. Repeated rows are equal texts; every row is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import Scratch, components
from millrace.llm.groups import fresh
from millrace.llm.words import PLAIN, Texts, mix, pieces, run_hashes

SHINGLE, REGISTERS, BAND, SIMILARITY = 5, 96, 4, 0.8
#: Agreement of the registers below which a pair of the wanted similarity is not expected (4.5 standard deviations).
MARGIN = 4.5
#: Members of a bucket that one task compares with as many others.
BLOCK = 500

_ARRIVAL, _REGISTER, _BAND = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def shingles(texts: Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, weight), sorted by text and hash."""
    words = texts.spans(PLAIN, lower=True)
    hashes = words.hashes()
    at, runs = words.windows(hashes, k)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    text = np.concatenate([words.text[at], short])
    runs = np.concatenate([runs, run_hashes(hashes, words.first[short], words.first[short + 1])])
    order = np.lexsort((runs, text))
    text, runs = text[order], runs[order]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(first)
    return text[start], runs[start], np.diff(np.append(start, len(runs))).astype(np.float64)


def sketch(text: np.ndarray, runs: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The shingle that arrives first in every register, as n rows of 32-bit hashes; rows without shingles are 0."""
    best = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, dtype=np.uint32)
    size = np.bincount(text, minlength=n)
    alone = size[text] == 1  # One shingle holds every register.
    owner.reshape(n, registers)[text[alone]] = (runs[alone] >> np.uint64(32)).astype(np.uint32)[:, None]
    text, runs, weight = text[~alone], runs[~alone], weight[~alone]
    arrival, turn = np.zeros(len(text)), 0
    while len(text):
        turn += 1
        random = mix(runs + np.uint64(turn * int(_ARRIVAL) % 2**64))
        arrival = arrival - np.log(((random >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53) / weight
        slot = text * registers + (mix(random ^ _REGISTER) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, slot, arrival)
        first = best[slot] == arrival
        owner[slot[first]] = (runs[first] >> np.uint64(32)).astype(np.uint32)
        goes_on = arrival < best.reshape(n, registers).max(axis=1)[text]
        text, runs, weight, arrival = text[goes_on], runs[goes_on], weight[goes_on], arrival[goes_on]
    return owner.reshape(n, registers)


def _bands(sketches: np.ndarray, band: int) -> np.ndarray:
    n, registers = sketches.shape
    rows = sketches.reshape(n, registers // band, band).astype(np.uint64)
    value = np.broadcast_to(np.arange(registers // band, dtype=np.uint64) * _BAND, rows.shape[:2])
    for i in range(band):
        value = mix(value + rows[:, :, i] + np.uint64(1))
    return value.view(np.int64)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    data = np.ascontiguousarray(rows)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * (data.shape[1] * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def sketches(docs: DataFrame, registers: int = REGISTERS, band: int = BAND, k: int = SHINGLE) -> DataFrame:
    """doc_id, node, sketch, bands for rows with a text. Texts without words have no bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            rows = sketch(*shingles(texts, k), texts.n, registers)
            bands = _bands(rows, band)
            empty = ~rows.any(axis=1)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, bands.shape[1]))]), pa.int32()),
                pa.array(bands[~empty].ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("node"), _fixed(rows), lists], ["doc_id", "node", "sketch", "bands"])

    kind = dict(docs.dtypes)["doc_id"]
    known = docs.filter("text IS NOT NULL").select("doc_id", text_key().alias("node"), "text")
    return known.mapInArrow(work, f"doc_id {kind}, node binary, sketch binary, bands array<long>")


def text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard of two weighted sets, each as sorted hashes and weights."""
    both, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = a[1][in_a], b[1][in_b]
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    # For x with ratio r = a(x) / b(x): the sum over y of max(a(y), r b(y)), by prefix sums over ratios.
    ratio = wa / wb
    order = np.argsort(ratio, kind="stable")
    sorted_ratio = ratio[order]
    below_b = np.concatenate([[0], np.cumsum(wb[order])])
    above_a = wa.sum() - np.concatenate([[0], np.cumsum(wa[order])])
    cut = np.searchsorted(sorted_ratio, ratio, side="right")
    total = above_a[cut] + ratio * below_b[cut] + only_a + ratio * only_b
    return float((wa / total).sum())


def verify(pairs: DataFrame, least: float, k: int = SHINGLE) -> DataFrame:
    """a, b of the pairs (a, b, text_a, text_b) whose exact similarity is at least `least`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(iter([batch]), "text_a"):
                sides = []
                for side in (texts, Texts(part.column("text_b"))):
                    text, runs, weight = shingles(side, k)
                    cuts = np.searchsorted(text, np.arange(side.n + 1))
                    sides.append([(runs[i:j], weight[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
                # The margin is for the order of floating sums.
                near = [similarity(x, y) >= least - 1e-9 for x, y in zip(*sides, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(work, "a binary, b binary")


def _agreement(x: str, y: str) -> Column:
    """How many 32-bit registers of two sketches are equal."""
    at = F.sequence(F.lit(0), F.lit(REGISTERS - 1))
    return F.size(F.filter(at, lambda i: F.substring(F.col(x), i * 4 + 1, F.lit(4)) == F.substring(F.col(y), i * 4 + 1, F.lit(4))))


def _block_links(least: float, low: int, band: int, k: int):
    """Links inside a block of a bucket, or between two blocks, that join different components.

    Members are compared by their sketches; of pairs that agree at least `low` times the exact similarity is taken. A pair
    is looked at in the first bucket it shares, and not at all once links found here connect it.
    """

    def work(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("node").combine_chunks()
        node = group["node"].combine_chunks()
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), dtype=np.uint32).reshape(len(node), -1)
        names, root = np.unique(np.array(group["component"].to_pylist(), dtype=object), return_inverse=True)
        side = group["side"].to_numpy()
        # A block with itself comes once (side 2); two blocks come as side 0 and side 1.
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        text, runs, weight = shingles(Texts(group["text"].combine_chunks()), k)
        cuts = np.searchsorted(text, np.arange(len(node) + 1))
        size, plain = np.diff(cuts), np.bincount(text, weights=weight != 1, minlength=len(node)) == 0
        _, ids = np.unique(runs, return_inverse=True)
        has = np.zeros(len(ids) + 1, dtype=bool)
        equal = (sketch == sketch[0]).reshape(len(node), -1, band).all(axis=2).all(axis=0)
        here = int(equal.argmax())  # The first band in which all of the bucket agree.
        found = []
        for i in left:
            other = right[root[right] != root[i]]
            if not len(other):
                continue
            agree = sketch[other] == sketch[i]
            first = agree.reshape(len(other), -1, band).all(axis=2).argmax(axis=1)
            other = other[(first == here) & (agree.sum(axis=1) >= low)]
            if not len(other):
                continue
            has[ids[cuts[i]:cuts[i + 1]]] = True
            both = np.array([np.count_nonzero(has[ids[cuts[j]:cuts[j + 1]]]) for j in other])
            has[ids[cuts[i]:cuts[i + 1]]] = False
            near = both / (size[i] + size[other] - both)
            for j in np.flatnonzero(~(plain[other] & plain[i])):
                a, b = (slice(cuts[x], cuts[x + 1]) for x in (i, other[j]))
                near[j] = similarity((runs[a], weight[a]), (runs[b], weight[b]))
            for j in other[near >= least - 1e-9]:
                if root[i] != root[j]:
                    found.append((i, j))
                    root[root == root[j]] = root[i]
        a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": node.take(pa.array(a)), "b": node.take(pa.array(b))})

    return work


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, node (the text's key), class_id (the smallest doc_id of the class), class_docs, links, keeper.

    `links` are the verified links of the text to different texts that the classes rest on. `keeper` marks the rows of one
    (doc_id, text) of each class. A null doc_id names a class only where it has no other.
    """
    spark = docs.sparkSession
    room = Scratch(spark, "neardup")
    low = int(np.floor(REGISTERS * least - MARGIN * np.sqrt(REGISTERS * least * (1 - least))))
    marked = room.store(sketches(docs))
    nodes = marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))

    # A bucket is a band's value; the same text in it many times is one member.
    members = marked.select("node", F.explode("bands").alias("bucket")).distinct()
    shared = room.store(members.join(
        members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "node").alias("h"), "node")).alias("lead"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("bucket", F.col("lead.node").alias("lead"), "n"), "bucket"))
    active = shared.select("node").distinct()
    known = room.store(docs.filter("text IS NOT NULL").select(text_key().alias("node"), "text", "doc_id")
                       .join(active.join(nodes, "node").select("node", "first"), "node")
                       .filter("doc_id <=> first").select("node", "text").dropDuplicates(["node"]))
    sketched = marked.select("node", "sketch").join(active, "node", "left_semi").dropDuplicates(["node"])

    stars = shared.filter("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    sides = [sketched.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    stars = stars.join(sides[0], "a").join(sides[1], "b").filter(_agreement("sketch_a", "sketch_b") >= low)
    texts = [known.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"]
    links = room.store(verify(stars.select("a", "b").join(texts[0], "a").join(texts[1], "b"), least))
    found = components(links, room)

    members = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = members.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("n").alias("n"))
    mixed = mixed.filter("x <> y").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = members.drop("lead", "n").join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    # Block i meets every block j >= i: once as the left side, once as the right, with itself as both.
    every = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least("block", j).alias("low"), F.greatest("block", j).alias("high"),
        F.when(F.col("block") == j, 2).when(F.col("block") < j, 0).otherwise(1).alias("side"))))
    meetings = members.join(sketched, "node").join(known, "node").withColumn("m", every).select(
        "bucket", "m.*", "node", "component", "sketch", "text")
    more = room.store(meetings.groupBy("bucket", "low", "high").applyInArrow(
        _block_links(least, low, BAND, SHINGLE), "a binary, b binary"))
    if not more.isEmpty():
        # What is connected already enters as one edge for each node.
        found = components(found.toDF("a", "b").union(more), room)
        links = links.union(more).distinct()

    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    named = nodes.join(found, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = named.groupBy("component").agg(
        F.min(F.struct(F.col("first").isNull().alias("unnamed"), "first", "node")).alias("head"), F.sum("copies").alias("class_docs"))
    named = named.join(heads, "component").select(
        "node", F.col("head.first").alias("class_id"), "class_docs", F.coalesce("links", F.lit(0)).alias("links"),
        (F.col("head.node") == F.col("node")).alias("heads"))
    with_text = marked.select("doc_id", "node").join(named, "node").select(
        "doc_id", "node", "class_id", "class_docs", "links",
        (F.col("heads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("keeper"))
    without = docs.filter("text IS NULL").select(
        "doc_id", F.lit(None).cast("binary").alias("node"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_docs"),
        F.lit(0).cast("long").alias("links"), F.lit(True).alias("keeper"))
    return with_text.unionByName(without)


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of `docs`, all columns, of every class: the one with the smallest doc_id. Rows without text stay.

    Of rows equal in doc_id and text that differ elsewhere any one stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key, doc, node = (fresh(n, docs.columns) for n in ("__key", "__doc", "__node"))
    kept = classes(docs, least).filter("keeper AND node IS NOT NULL").select(F.col("doc_id").alias(doc), F.col("node").alias(node)).distinct()
    keyed = docs.filter("text IS NOT NULL").withColumn(key, text_key())
    rows = keyed.join(kept, (keyed[key] == kept[node]) & keyed["doc_id"].eqNullSafe(kept[doc]), "left_semi")
    return rows.dropDuplicates(["doc_id", key]).select(*columns).unionByName(docs.filter("text IS NULL"))
