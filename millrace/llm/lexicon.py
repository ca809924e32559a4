"""How often every token of a corpus occurs in its training part, told to the groups of documents that hold it.

Documents are dealt into groups by a hash of the row. A group asks about each of its distinct tokens once, in buckets by
token hash; a bucket adds the counts up and answers each group in the order it asked. A token that every document has is
one row per group, and no list of all tokens is ever in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.groups import dealt
from millrace.llm.words import SPACE, Texts, blobs, joined

GROUP_BYTES = 4 << 20
BUCKETS_PER_PARTITION = 2
#: The hash of the token that ends every text.
END = np.uint64(0x5851F42D4C957F2D)


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all tokens in order: words with A-Z lowered, then one end for each text."""
    words = texts.spans(SPACE, lower=True)
    at = words.first[1:]  # Ends go behind the last word of each text.
    return np.insert(words.text, at, np.arange(texts.n)), np.insert(words.hashes(), at, END)


def grouped(docs: DataFrame) -> DataFrame:
    """`docs` with the number of their group, `part`, and of the rows each stands for, `copies`."""
    return dealt(docs, GROUP_BYTES, "part", "copies")


def distinct(hashes: np.ndarray, counted: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens in the order they are asked about, occurrences among the `counted`, buckets and their borders."""
    known, place = np.unique(hashes, return_inverse=True)
    count = np.bincount(place, weights=counted, minlength=len(known)).astype(np.int64)
    bucket = (known % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, cuts = np.unique(bucket[order], return_index=True)
    return known[order], count[order], names, np.append(cuts, len(known)).astype(np.int64)


def planes(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """`blobs` of 64-bit values with all first bytes of a blob first, and so on: sorted values so take less when compressed."""
    data = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    turned = [data[i:j].T.ravel() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return blobs(np.concatenate([data[:0].ravel(), *turned]), cuts * 8)


def unplaned(column: pa.ChunkedArray) -> np.ndarray:
    parts = [np.frombuffer(x, np.uint8).reshape(8, -1).T.ravel() for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.uint8), *parts]).view("<u8").astype(np.uint64)


def trained(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """How many training documents each row is."""
    return np.where(table["held_out"].to_numpy(zero_copy_only=False), 0, table["copies"].to_numpy(zero_copy_only=False))


def ask(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, part, tokens, counts: a row for each bucket a group has tokens in. `texts` has part, text, held_out, copies."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        text, hashes = tokens(Texts(table["text"].combine_chunks()))
        known, count, names, cuts = distinct(hashes, trained(table)[text], buckets)
        return pa.table({"bucket": pa.array(names), "part": pa.array(np.full(len(names), key[0].as_py())),
                         "tokens": planes(known, cuts), "counts": blobs(count, cuts)})

    return texts.select("part", "text", "held_out", "copies").groupBy("part").applyInArrow(
        work, "bucket long, part long, tokens binary, counts binary")


def answer(asked: DataFrame, top: int, rare: int) -> DataFrame:
    """part, bucket, counts (over all groups, in the order asked), and in one row of each bucket what it holds:
    `total` training tokens, `words` distinct ones, its `top` most frequent ones, and sums by `rare` units of the others.
    """

    def work(key: tuple, table: pa.Table) -> pa.Table:
        hashes, counts = unplaned(table["tokens"]), joined(table["counts"], np.int64)
        known, place = np.unique(hashes, return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(known)).astype(np.int64)
        size = np.array([len(x) // 8 for x in table["tokens"].to_pylist()], dtype=np.int64)
        best = np.lexsort((known, -total))[:top]
        # What occurs once is not worth a unit of its own.
        best = best[total[best] > 1]
        unit = rare_unit(known, rare)
        first = {
            "total": int(total.sum()), "words": int((total > 0).sum()),
            "best": [{"token": int(known[i].view(np.int64)), "n": int(total[i])} for i in best],
            "unit_total": np.bincount(unit, weights=total, minlength=rare).astype(np.int64).tolist(),
            "unit_words": np.bincount(unit, weights=total > 0, minlength=rare).astype(np.int64).tolist()}
        held = [first] + [None] * (len(size) - 1)
        return pa.table({
            "part": table["part"], "bucket": table["bucket"], "counts": blobs(total[place], np.concatenate([[0], np.cumsum(size)])),
            "held": pa.array(held, _HELD)})

    return asked.groupBy("bucket").applyInArrow(work, (
        "part long, bucket long, counts binary, held struct<total: long, words: long, "
        "best: array<struct<token: long, n: long>>, unit_total: array<long>, unit_words: array<long>>"))


def told(answers: pa.Table, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The count of each of a group's hashes, the same ones that it asked about."""
    known, place = np.unique(hashes, return_inverse=True)
    order = np.argsort((known % np.uint64(buckets)).astype(np.int64), kind="stable")
    count = np.empty(len(known), dtype=np.int64)
    count[order] = joined(answers.sort_by("bucket")["counts"], np.int64)
    return count[place]


_HELD = pa.struct([
    ("total", pa.int64()), ("words", pa.int64()), ("best", pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))),
    ("unit_total", pa.list_(pa.int64())), ("unit_words", pa.list_(pa.int64()))])


def rare_unit(hashes: np.ndarray, rare: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(rare)).astype(np.int64)
