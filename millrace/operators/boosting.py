"""Boosted classification trees, a whole grid of models and folds grown together over rows that are binned once.

What the rows need is learned for every fold from the rows outside it, for all folds in the same two aggregations: means
that stand for missing numbers, and the borders of bins. Rows are then binned and stored once. A round of growth is one pass
over them: every task adds up the residuals of its rows by (model, open node, feature, bin), sums of tasks meet by
(model, node), and only the best split of each node comes back. So the passes are those of the deepest model and not
the sum of all, and what is collected is a row per open node of each model.

Loss, step and leaves are those of the usual binary log loss on labels -1 and 1: the first tree is fitted to the labels and
counts in full, each later one to the residuals 4y / (1 + exp(2yF)) and counts with the step. A tree takes every row of
its fold with the chance `subsample`, told by a hash of the row and the tree, so any partitioning grows the same trees.
A category is split off as one value against all others, which is what a one-hot column allows; the rarest has no column.
Columns that are only rescaled copies of others split rows in the same way and are not binned again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import delete_path, scratch_path

#: Categories are numbered in 16 bits.
MAX_CATEGORIES = (1 << 16) - 1
# Cells of nodes that a task hands on at a time.
SUMS_PER_BATCH = 1 << 18
#: Trees after which the margins of rows are stored, so that no pass works out more of them anew.
STORED_TREES = 5
#: Nodes that may still be split.
OPEN, LEAF = -2, -1
# What a node must gain, as a share of its squared residuals, to be split; less is rounding.
_LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Point:
    """Settings of one model. It learns from the rows outside `fold`, or from all of them."""

    depth: int
    bins: int
    fold: int | None = None


@dataclass
class Preparation:
    """What is known of the rows outside a fold: means, and the borders of bins by number of bins and column."""

    means: list[float]
    borders: dict[int, list[list[float]]]

    def binned(self, numbers: np.ndarray, bins: int) -> np.ndarray:
        """The bins of rows (by column), as bytes; missing numbers count as the mean."""
        out = np.empty(numbers.shape, dtype=np.uint8)
        for i, mean in enumerate(self.means):
            known = np.where(np.isnan(numbers[:, i]), mean, numbers[:, i])
            out[:, i] = np.searchsorted(np.array(self.borders[bins][i]), known, side="left")
        return out


@dataclass
class Tree:
    """A binary tree in heap order. A row goes left if its bin is at most `cut`, or its category is `cut`."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, depth: int) -> Tree:
        size = (2 << depth) - 1
        tree = cls(np.full(size, LEAF, np.int16), np.zeros(size, np.int32), np.zeros(size))
        tree.feature[0] = OPEN
        return tree

    def places(self, bins: np.ndarray, category: np.ndarray) -> np.ndarray:
        """The node that each row is in."""
        place, row = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        numbers = bins.shape[1]
        while True:
            feature = self.feature[place]
            inner = feature >= 0
            if not inner.any():
                return place
            cut = self.cut[place]
            value = bins[row, np.clip(feature, 0, numbers - 1)] if numbers else category
            right = np.where(feature == numbers, category != cut, value > cut)
            place = np.where(inner, 2 * place + 1 + right, place)


@dataclass
class Model:
    """A grown model: its settings, what prepares rows for it, and its trees."""

    point: Point
    preparation: Preparation
    numeric: list[str]
    category: str
    categories: dict[str, int]
    step: float
    trees: list[Tree] = field(default_factory=list)

    def margin(self, bins: np.ndarray, category: np.ndarray) -> np.ndarray:
        total = np.zeros(len(bins))
        for i, tree in enumerate(self.trees):
            total += (1.0 if i == 0 else self.step) * tree.value[tree.places(bins, category)]
        return total

    def score(self, df: DataFrame, out: str = "margin") -> DataFrame:
        """`df` with the margin of every row; above 0 the label 1 is likelier."""
        model, names, n = self, df.columns, len(self.numeric)
        numbers = [F.col(c).cast("double") for c in self.numeric]

        @F.pandas_udf("double")
        def margin(category, *columns):
            import pandas as pd

            table = np.column_stack([np.zeros((len(category), 0)), *(c.to_numpy(np.float64) for c in columns)])
            number = category.map(model.categories).fillna(len(model.categories)).to_numpy(np.int64)
            return pd.Series(model.margin(model.preparation.binned(table[:, :n], model.point.bins), number))

        return df.select(*names, margin(F.col(self.category).cast("string"), *numbers).alias(out))

    def text(self) -> str:
        """All of the model as JSON."""
        return json.dumps({
            "point": vars(self.point), "means": self.preparation.means, "borders": self.preparation.borders, "numeric": self.numeric,
            "category": self.category, "categories": self.categories, "step": self.step,
            "trees": [[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in self.trees]})

    @classmethod
    def read(cls, text: str) -> Model:
        x = json.loads(text)
        borders = {int(k): v for k, v in x["borders"].items()}
        trees = [Tree(np.array(f, np.int16), np.array(c, np.int32), np.array(v)) for f, c, v in x["trees"]]
        return cls(Point(**x["point"]), Preparation(x["means"], borders), x["numeric"], x["category"], x["categories"], x["step"], trees)


def _category_numbers(df: DataFrame, category: str) -> dict[str, int]:
    """Categories by frequency, ties by name. There may be MAX_CATEGORIES."""
    counted = df.filter(F.col(category).isNotNull()).groupBy(F.col(category).cast("string").alias("c")).count()
    rows = counted.orderBy(F.desc("count"), "c").limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{category} has more than {MAX_CATEGORIES} values")
    return {r["c"]: i for i, r in enumerate(rows)}


def prepare(df: DataFrame, fold: Column, folds: int, numeric: Sequence[str], bins: Sequence[int]) -> list[Preparation]:
    """What is known of the rows outside each fold, and last of all rows."""
    def outside(f: int, value: Column) -> Column:
        return value if f == folds else F.when(fold != f, value)

    def number(c: str) -> Column:
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))

    every = range(folds + 1)
    means = df.agg(*(F.avg(outside(f, number(c))).alias(f"m{f}_{i}") for f in every for i, c in enumerate(numeric))).head() if numeric else {}
    means = [[(means[f"m{f}_{i}"] or 0.0) for i in range(len(numeric))] for f in every]
    shares = {b: [j / b for j in range(1, b)] for b in set(bins)}
    cuts = df.agg(*(
        F.percentile_approx(outside(f, F.coalesce(number(c), F.lit(means[f][i]))), shares[b]).alias(f"b{f}_{b}_{i}")
        for f in every for b in shares for i, c in enumerate(numeric))).head() if numeric else {}
    return [Preparation(means[f], {b: [sorted(set(cuts[f"b{f}_{b}_{i}"] or [])) for i in range(len(numeric))] for b in shares}) for f in every]


@dataclass
class Layout:
    """How the columns of binned rows are laid out."""

    folds: int
    bins: list[int]
    numbers: int
    categories: int

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """fold, label (-1 or 1), key, bins by (row, fold, number of bins, column), category."""
        fold, label, key, category = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
        shape = (batch.num_rows, self.folds + 1, len(self.bins), self.numbers)
        return fold, label, key.view(np.uint64), _bytes(batch.column(3)).reshape(shape), category

    def of(self, point: Point, bins: np.ndarray) -> np.ndarray:
        return bins[:, self.folds if point.fold is None else point.fold, self.bins.index(point.bins)]

    def width(self, point: Point) -> int:
        """Bins of all features of a model."""
        return self.numbers * point.bins + self.categories


@dataclass
class Rows:
    """Rows that are binned for every fold and number of bins, and the margins that models have reached on them."""

    path: str
    frame: DataFrame
    layout: Layout


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def bin_rows(df: DataFrame, fold: Column, key: Column, label: str, numeric: Sequence[str], category: str,
             prepared: list[Preparation], categories: dict[str, int], bins: Sequence[int]) -> Rows:
    """The rows of `df` with a label, binned and stored. `key` tells rows apart for sampling."""
    settings = sorted(set(bins))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            numbers = np.column_stack([np.zeros((n, 0)), *(
                batch.column(4 + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(numeric)))])
            binned = np.stack([np.stack([p.binned(numbers, b) for b in settings], axis=1) for p in prepared], axis=1)
            packed = binned.reshape(n, -1)
            kind = np.array([categories.get(c, len(categories)) for c in batch.column(3).to_pylist()], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(kind)],
                ["fold", "label", "key", "bins", "category"])

    schema = "fold int, label double, key long, bins binary, category int"
    chosen = df.filter(F.col(label).isNotNull()).select(
        fold.cast("int").alias("fold"), (F.col(label).cast("double") * 2 - 1).alias("label"), key.alias("key"),
        F.col(category).cast("string").alias("category"), *(F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(numeric)))
    rows = chosen.mapInArrow(work, schema).withColumn("margins", F.lit(b""))
    path = scratch_path(df.sparkSession, "binned")
    rows.write.parquet(path)
    layout = Layout(len(prepared) - 1, settings, len(numeric), len(categories))
    return Rows(path, df.sparkSession.read.schema(rows.schema).parquet(path), layout)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit values spread (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(key: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree takes."""
    salt = _mixed(np.array([(tree * 0x9E3779B97F4A7C15 + seed) % 2**64], dtype=np.uint64))
    return (_mixed(key + salt) >> np.uint64(11)).astype(np.float64) < share * 2.0**53


@dataclass
class Growing:
    """Models in growth as tasks need them: the trees that stored margins lack, the one that grows last."""

    layout: Layout
    points: list[Point]
    trees: list[list[Tree]]
    number: int  # Of the tree that grows, from 0.
    step: float
    subsample: float
    seed: int

    def advanced(self, batch: pa.RecordBatch, bins: np.ndarray, category: np.ndarray, trees: int) -> np.ndarray:
        """The stored margins and those of the next `trees` trees, by (row, model)."""
        stored = _bytes(batch.column(5)).view(np.float64)
        margins = stored.reshape(-1, len(self.points)).copy() if len(stored) else np.zeros((batch.num_rows, len(self.points)))
        first = self.number + 1 - len(self.trees[0])
        for k, point in enumerate(self.points):
            own = self.layout.of(point, bins)
            for i, tree in enumerate(self.trees[k][:trees]):
                margins[:, k] += (1.0 if first + i == 0 else self.step) * tree.value[tree.places(own, category)]
        return margins

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums over the rows in open nodes, a row for each of these."""
        layout, growing = self.layout, [t[-1] for t in self.trees]
        nodes = [np.flatnonzero(t.feature == OPEN) for t in growing]
        count = [np.zeros((len(o), layout.width(p))) for o, p in zip(nodes, self.points, strict=True)]
        total = [np.zeros_like(c) for c in count]
        whole = [np.zeros((len(o), 3)) for o in nodes]
        for batch in batches:
            fold, label, key, bins, category = layout.read(batch)
            taken = drawn(key, self.number, self.seed, self.subsample)
            margins = self.advanced(batch, bins, category, len(self.trees[0]) - 1)
            for k, point in enumerate(self.points):
                if not len(nodes[k]):
                    continue
                own = layout.of(point, bins)
                place = growing[k].places(own, category)
                use = taken & (growing[k].feature[place] == OPEN)
                if point.fold is not None:
                    use &= fold != point.fold
                use = np.flatnonzero(use)
                if not len(use):
                    continue
                node = np.searchsorted(nodes[k], place[use])
                residual = label[use]
                if self.number:
                    residual = 4 * residual / (1 + np.exp(2 * residual * margins[use, k]))
                width = layout.width(point)
                cell = node[:, None] * width + np.arange(layout.numbers) * point.bins + own[use]
                known = category[use] < layout.categories
                cells = np.concatenate([cell.ravel(), (node * width + layout.numbers * point.bins + category[use])[known]])
                weights = np.concatenate([np.repeat(residual, layout.numbers), residual[known]])
                size = len(nodes[k]) * width
                count[k] += np.bincount(cells, minlength=size).reshape(-1, width)
                total[k] += np.bincount(cells, weights=weights, minlength=size).reshape(-1, width)
                for i, value in enumerate((np.ones(len(use)), residual, residual * residual)):
                    whole[k][:, i] += np.bincount(node, weights=value, minlength=len(nodes[k]))
        # A few at a time, as the open nodes grow with the rows.
        for k, named in enumerate(nodes):
            step = max(1, SUMS_PER_BATCH // layout.width(self.points[k]))
            for at in range(0, len(named), step):
                out = [(k, int(o), np.concatenate([w, c, t]).tobytes()) for o, w, c, t in zip(
                    *(x[at:at + step] for x in (named, whole[k], count[k], total[k])), strict=True) if w[0]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())],
                    ["model", "node", "sums"])
            count[k] = total[k] = None

    def best(self, key: tuple, table: pa.Table) -> pa.Table:
        """The best split of a node, from the sums of all tasks."""
        point, numbers, categories = self.points[key[0].as_py()], self.layout.numbers, self.layout.categories
        # In the order of tasks, so that sums of fractions are the same each time.
        total = sum(np.frombuffer(x, np.float64) for x in table.sort_by("part")["sums"].to_pylist())
        (n, s, squares), rest = total[:3], total[3:]
        count, residual = rest[:len(rest) // 2], rest[len(rest) // 2:]
        left_n, left_s, names = [], [], []
        for i in range(numbers):
            part = slice(i * point.bins, (i + 1) * point.bins)
            left_n.append(np.cumsum(count[part])[:-1])
            left_s.append(np.cumsum(residual[part])[:-1])
            names += [(i, c) for c in range(point.bins - 1)]
        only = max(0, categories - 1)
        left_n.append(count[numbers * point.bins:][:only])
        left_s.append(residual[numbers * point.bins:][:only])
        names += [(numbers, c) for c in range(only)]
        ln, ls = np.concatenate(left_n), np.concatenate(left_s)
        rn, rs = n - ln, s - ls
        gain = np.where((ln > 0) & (rn > 0), ls**2 / np.maximum(ln, 1) + rs**2 / np.maximum(rn, 1) - s**2 / n, -1.0)
        best = int(np.argmax(gain)) if len(gain) else -1
        split = best >= 0 and gain[best] > _LEAST_GAIN * squares
        feature, cut = names[best] if split else (LEAF, 0)
        return pa.table({
            "model": table["model"][:1], "node": table["node"][:1], "feature": pa.array([feature], pa.int32()), "cut": pa.array([cut], pa.int32()),
            "value": [s / n], "left": [ls[best] / ln[best] if split else 0.0], "right": [rs[best] / rn[best] if split else 0.0]})

    def stored(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with the margins of all trees so far."""
        for batch in batches:
            _, _, _, bins, category = self.layout.read(batch)
            margins = self.advanced(batch, bins, category, len(self.trees[0]))
            yield batch.set_column(5, "margins", pa.array([r.tobytes() for r in margins], pa.binary()))


def _best_splits(state: Growing) -> Callable[[tuple, pa.Table], pa.Table]:
    return lambda key, table: state.best(key, table)


def _decide(models: list[Model], splits: list) -> bool:
    """Split the open nodes of the trees that grow as found, or close them; whether any are open afterwards."""
    for model in models:
        feature = model.trees[-1].feature
        feature[feature == OPEN] = LEAF
    for r in splits:
        model, node = models[r["model"]], r["node"]
        tree = model.trees[-1]
        tree.value[node] = r["value"]
        if r["feature"] >= 0:
            tree.feature[node], tree.cut[node] = r["feature"], r["cut"]
            children = [2 * node + 1, 2 * node + 2]
            tree.value[children] = r["left"], r["right"]
            # Children of a node at depth d are at d + 1, and are split if the tree may be deeper than that.
            tree.feature[children] = OPEN if (node + 1).bit_length() < model.point.depth else LEAF
    return any((m.trees[-1].feature == OPEN).any() for m in models)


def _grow_trees(rows: Rows, models: list[Model], iterations: int, subsample: float, seed: int) -> None:
    spark, layout, points = rows.frame.sparkSession, rows.layout, [m.point for m in models]
    held = 0  # Trees of each model that the stored margins hold.

    def growing(number: int) -> Growing:
        return Growing(layout, points, [m.trees[held:] for m in models], number, models[0].step, subsample, seed)

    for i in range(iterations):
        for model in models:
            model.trees.append(Tree.of(model.point.depth))
        while True:
            state = growing(i)
            sums = rows.frame.mapInArrow(state.sums, "model int, node int, sums binary").withColumn("part", F.spark_partition_id())
            splits = sums.groupBy("model", "node").applyInArrow(
                _best_splits(state),
                "model int, node int, feature int, cut int, value double, left double, right double").collect()
            if not _decide(models, splits):
                break
        if i + 1 - held == STORED_TREES and i + 1 < iterations:
            path = scratch_path(spark, "margins")
            rows.frame.mapInArrow(growing(i).stored, rows.frame.schema).write.parquet(path)
            delete_path(spark, rows.path)
            rows.path, rows.frame, held = path, spark.read.schema(rows.frame.schema).parquet(path), i + 1


def grow(df: DataFrame, points: Sequence[Point], fold: Column, folds: int, key: Column, label: str, numeric: Sequence[str],
         category: str, iterations: int = 20, subsample: float = 0.8, step: float = 0.1, seed: int = 77) -> tuple[list[Model], Rows]:
    """A model for each of `points`, and the binned rows they have learned from. `df` is read several times."""
    bins = sorted({p.bins for p in points})
    prepared = prepare(df, fold, folds, numeric, bins)
    categories = _category_numbers(df, category)
    rows = bin_rows(df, fold, key, label, numeric, category, prepared, categories, bins)
    models = [Model(p, prepared[folds if p.fold is None else p.fold], list(numeric), category, categories, step) for p in points]
    _grow_trees(rows, models, iterations, subsample, seed)
    return models, rows


def held_out(rows: Rows, models: Sequence[Model]) -> DataFrame:
    """model (a place in `models`), fold, label (0 or 1), margin: every row by the models of the fold it is in."""
    models, layout = list(models), rows.layout

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, label, _, bins, category = layout.read(batch)
            for k, model in enumerate(models):
                mine = np.flatnonzero(fold == model.point.fold)
                margin = model.margin(layout.of(model.point, bins)[mine], category[mine])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(mine), k, np.int32)), pa.array(fold[mine]), pa.array((label[mine] > 0).astype(np.int32)), pa.array(margin)],
                    ["model", "fold", "label", "margin"])

    return rows.frame.mapInArrow(work, "model int, fold int, label int, margin double")
