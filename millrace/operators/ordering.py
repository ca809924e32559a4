"""Exact ranks over a global order, without putting a group into one task.

`row_number()` over a hot group sorts that whole group in one task, and without PARTITION BY it sorts the
whole table in one. Here rows are range-partitioned by (group, order), so a hot group is spread over many
partitions; what a partition must know about the ones before it is one small row per group it continues.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.session import store

_PART, _POS = "__part", "__pos"
# monotonically_increasing_id() holds the partition in its upper 31 bits and the position in the lower 33.
_POSITION_MASK = (1 << 33) - 1


def _lay_out(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Range-partition and sort by `keys`, note partition and position, and store the result.

    Stored because two readers need the very same layout: a second run of the range shuffle may sample
    other bounds.
    """
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = laid.withColumns({
        _PART: F.spark_partition_id(),
        _POS: F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)),
    })
    return store(laid, "ordered")


def _match(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Join on equal columns, nulls equal to each other; `columns` of the right side are dropped."""
    other = right.withColumnsRenamed({c: f"__other_{c}" for c in columns})
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).eqNullSafe(F.col(f"__other_{name}"))
    return left.join(other, condition, how).drop(*(f"__other_{c}" for c in columns))


def number_rows(
    df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "row_id"
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, … in `order`; one group if `by` is empty.

    `by` + `order` should identify a row: equal rows may be numbered either way, and cannot be split
    over partitions.
    """
    by = list(by)
    laid = _lay_out(df, [*by, *order])
    group = [_PART, *by]
    # Rows of the same group in earlier partitions. Only the group at the start of a partition can have
    # any, so at most one row per partition is left: a proven bound for the broadcast.
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        laid.groupBy(*group).agg(F.count(F.lit(1)).alias("__rows"))
        .select(*group, F.sum("__rows").over(earlier).alias("__before"))
        .filter(F.col("__before") > 0)
    )
    position = F.col(_POS)
    if by:
        position = (F.row_number().over(Window.partitionBy(*group).orderBy(_POS)) - 1).cast("long")
    placed = laid.withColumn("__position", position)
    return _match(placed, F.broadcast(carried), group, "left").select(
        *df.columns, (F.col("__position") + F.coalesce(F.col("__before"), F.lit(0))).alias(name))


def running_totals(df: DataFrame, columns: Mapping[str, str], order: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """Add for each of `columns` (name of the new one by that of the summed one) the total of the rows before in the group.

    Rows equal in `order` should be summed up first. A group is spread over partitions as in `number_rows`.
    """
    by = list(by)
    laid = _lay_out(df, [*by, *order])
    group = [_PART, *by]
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = laid.groupBy(*group).agg(*(F.sum(c).alias(f"__sum_{c}") for c in columns)).select(
        *group, *(F.sum(f"__sum_{c}").over(earlier).alias(f"__before_{c}") for c in columns)).filter(
        F.greatest(F.lit(False), *(F.col(f"__before_{c}").isNotNull() for c in columns)))
    inside = Window.partitionBy(*group).orderBy(_POS).rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumns({f"__inside_{c}": F.sum(c).over(inside) for c in columns})
    # A group that goes on in a partition: at most one row for each partition.
    return _match(placed, F.broadcast(carried), group, "left").select(*df.columns, *(
        (F.coalesce(f"__inside_{c}", F.lit(0)) + F.coalesce(f"__before_{c}", F.lit(0))).alias(name) for c, name in columns.items()))


def _ranks(method: str, q: float, total: Column) -> list[tuple[Column, Column]]:
    """The (index, share) pairs that make up a quantile of `total` sorted values."""
    whole = F.lit(1.0)
    if method == "index":
        return [(F.least(F.floor(F.lit(float(q)) * total), total - 1), whole)]
    if method == "lower":
        return [(F.greatest(F.ceil(F.lit(float(q)) * total) - 1, F.lit(0)), whole)]
    if method == "linear":
        exact = F.lit(float(q)) * (total - 1)
        part = exact - F.floor(exact)
        return [(F.floor(exact), whole - part), (F.ceil(exact), part)]
    raise ValueError(f"no such method: {method}")


#: Values are known by an image among doubles that never falls where they rise.
_IMAGES = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")
_LARGEST = 1.7e308
#: Ranks (of a group and quantile) that are looked for together; they are told to every task. Cells that their values are counted
#: in, over all of them, values that may be left for the last step, and rounds before it.
MAX_TARGETS, CELLS, KEPT, ROUNDS = 20_000, 1 << 18, 100_000, 8


def _image(value: Column, kind: str) -> Column:
    number = (F.unix_date(value) if kind == "date" else value).cast("double")
    return F.when(F.isnan(number), _LARGEST).otherwise(F.greatest(F.least(number, F.lit(_LARGEST)), F.lit(-_LARGEST)))


def _same(left: Sequence[str], right: Callable[[str], str]) -> Column:
    """Equal in all columns, nulls equal to each other."""
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(right(c))) for c in left))


def _quantile_rows(rows: DataFrame, qs: Sequence[float], by: list[str], method: str) -> DataFrame:
    """by, __q, __value: a row per group of `rows` (by, __value) and quantile; __q is its place in `qs`.

    Groups without values have one row, with null in both. The value at a rank is found by counting: each round counts
    the values of a group in cells between two of them, and goes on in the cell that holds the rank, between the smallest and
    the largest value in it. Only counts are shuffled, and at last the few values that are left. Where groups are too many for
    that, the ones with the most values are still taken so, at most MAX_TARGETS ranks of them, and the others are ranked.
    """
    kind = dict(rows.dtypes)["__value"]
    if kind not in _IMAGES and not kind.startswith("decimal"):
        return _ranked_rows(rows, qs, by, method)
    image = _image(F.col("__value"), kind)
    groups = store(rows.groupBy(*by).agg(
        F.count("__value").alias("__total"), F.min(image).alias("__low"), F.max(image).alias("__high")), "groups")
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("__total"), F.lit(0))).head()
    none = groups.filter(F.col("__total") == 0).select(*by)
    taken, ranks, rest = groups.filter("__total > 0"), len(qs) * (2 if method == "linear" else 1), None
    if n * ranks > MAX_TARGETS:
        # No more groups than that can have so large a part of all values.
        taken = groups.filter(F.col("__total") > F.lit(total * ranks / MAX_TARGETS))
        few = rows.join(F.broadcast(taken.select(*(F.col(c).alias(f"__t_{c}") for c in by))), _same(by, "__t_{}".format), "left_anti")
        rest = _ranked_rows(few.filter(F.col("__value").isNotNull()), qs, by, method)
    wanted = F.array(*(
        F.struct(F.lit(i).alias("q"), at.cast("long").alias("at"), share.cast("double").alias("share"))
        for i, q in enumerate(qs) for at, share in _ranks(method, q, F.col("__total"))))
    targets = taken.withColumn("__w", F.explode(wanted)).select(*by, "__w.*", "__low", "__high", F.lit(0).cast("long").alias("below"),
                                                              F.col("__total").alias("inside"))
    found = _select(rows, image, targets, by, kind)
    if method == "linear":
        found = found.groupBy(*by, "__q").agg(F.sum(F.col("__value") * F.col("__share")).alias("__value"))
    else:
        found = found.drop("__share")
    found = found.unionByName(none, allowMissingColumns=True)
    return found if rest is None else found.unionByName(rest)


def _select(rows: DataFrame, image: Column, targets: DataFrame, by: list[str], kind: str) -> DataFrame:
    """by, __q, __share, __value: the value at every rank `at` of `targets`, at most MAX_TARGETS rows."""
    spark, schema = rows.sparkSession, targets.schema
    held = [r.asDict() for r in targets.collect()]
    if not held:
        return rows.limit(0).select(*by, F.lit(0).alias("__q"), F.lit(1.0).alias("__share"), "__value")
    values = rows.filter(F.col("__value").isNotNull()).select(*by, "__value", image.alias("__image"))
    enough = max(KEPT, sum(t["inside"] for t in held) // 1000)

    def inside(some: list[dict]) -> DataFrame:
        """The values of a target that are not below or above the ones it can be, with the target."""
        told = spark.createDataFrame([tuple(t[c] for c in schema.names) for t in some], schema)
        told = told.withColumnsRenamed({c: f"__t_{c}" for c in by})
        within = F.col("__image").between(F.col("__low"), F.col("__high"))
        return values.join(F.broadcast(told), _same(by, "__t_{}".format) & within)

    for _ in range(ROUNDS):
        for number, target in enumerate(held):
            target["number"] = number
        open_targets = [t for t in held if t["__low"] < t["__high"]]
        if not open_targets or sum(t["inside"] for t in open_targets) <= enough:
            break
        # Enough that some 32 values share a cell, or so many that the counts stay within CELLS.
        each = sum(t["inside"] for t in open_targets) // len(open_targets) // 32
        cells = max(16, min(4096, each, CELLS // len(open_targets)))
        numbered = spark.createDataFrame(
            [(t["number"], *(t[c] for c in by), t["__low"], t["__high"], t["at"], t["below"]) for t in open_targets],
            StructType([StructField("number", IntegerType()), *(StructField(f"__t_{c}", schema[c].dataType) for c in by),
                        *(schema[c] for c in ("__low", "__high", "at", "below"))]))
        within = F.col("__image").between(F.col("__low"), F.col("__high"))
        # Halves, so that no difference overflows.
        part = (F.col("__image") / 2 - F.col("__low") / 2) / (F.col("__high") / 2 - F.col("__low") / 2)
        cell = F.least(F.floor(part * cells), F.lit(cells - 1)).cast("int")
        counted = values.join(F.broadcast(numbered), _same(by, "__t_{}".format) & within).groupBy("number", "at", "below", cell.alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min("__image").alias("low"), F.max("__image").alias("high"))
        earlier = Window.partitionBy("number").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("under", F.col("below") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        for r in placed.filter("under <= at AND at < under + n").collect():
            held[r["number"]].update(__low=r["low"], __high=r["high"], below=r["under"], inside=r["n"])
    same = (*by, "q", "share", "at", "below")
    left = inside(held).groupBy(*same, "__value").agg(F.count(F.lit(1)).alias("__n"))
    # Values with one image are one value, but for long whole numbers and decimals.
    equal = kind not in ("bigint",) and not kind.startswith("decimal")
    if max((t["inside"] for t in held if not equal or t["__low"] < t["__high"]), default=0) <= KEPT:
        under = F.coalesce(F.sum("__n").over(Window.partitionBy(*same).orderBy("__value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = left.withColumn("__under", under)
    else:
        left = running_totals(left, {"__n": "__under"}, ["__value"], same)
    under = F.col("below") + F.col("__under")
    return left.filter((under <= F.col("at")) & (F.col("at") < under + F.col("__n"))).select(
        *by, F.col("q").alias("__q"), F.col("share").alias("__share"), "__value")


def _ranked_rows(rows: DataFrame, qs: Sequence[float], by: list[str], method: str) -> DataFrame:
    """`_quantile_rows` of `__value` by ranks: all values are range-partitioned once.

    For groups that are too many to be told to every task, or values that are no numbers.
    """
    group = [_PART, *by]
    # Equal values first become one row with a count: less to shuffle, and no value too hot to split. Null has
    # the count 0, so that it is never picked but its group is known.
    counted = rows.groupBy(*by, "__value").agg(F.count("__value").alias("__n"))
    laid = _lay_out(counted, [*by, "__value"])

    whole = Window.partitionBy(*by or [F.lit(0)])
    earlier = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    spans = laid.groupBy(*group).agg(F.sum("__n").alias("__rows")).withColumns({
        "__before": F.coalesce(F.sum("__rows").over(earlier), F.lit(0)), "__total": F.sum("__rows").over(whole)})
    ranks = F.array(*(
        F.struct(F.lit(i).alias("q"), at.cast("long").alias("at"), share.alias("share"))
        for i, q in enumerate(qs) for at, share in _ranks(method, q, F.col("__total"))))
    inside = F.filter(ranks, lambda r: (F.col("__before") <= r["at"]) & (r["at"] < F.col("__before") + F.col("__rows")))
    wanted = spans.withColumn("__wanted", inside).filter(F.size("__wanted") > 0)
    # Only the partitions that hold a wanted index are read on, so no window spans more than one of them.
    kept = _match(laid, wanted.select(*group, "__before", "__wanted"), group, "inner")
    upto = F.sum("__n").over(Window.partitionBy(*group).orderBy("__value")) + F.col("__before")
    hit = (
        kept.withColumn("__upto", upto).withColumn("__w", F.explode("__wanted"))
        .filter((F.col("__w.at") < F.col("__upto")) & (F.col("__w.at") >= F.col("__upto") - F.col("__n")))
    )
    found = hit.select(*by, F.col("__w.q").alias("__q"), "__value", F.col("__w.share").alias("__share"))
    if method == "linear":
        found = found.groupBy(*by, "__q").agg(F.sum(F.col("__value") * F.col("__share")).alias("__value"))
    else:
        found = found.drop("__share")
    none = spans.filter(F.col("__total") == 0).select(*by).distinct()
    return found.unionByName(none, allowMissingColumns=True)


def exact_quantile(
    df: DataFrame, value: str, q: float, by: Sequence[str] = (), method: str = "index", name: str = "quantile"
) -> DataFrame:
    """The exact `q` quantile of `value` per group; nulls do not count, groups without values have null.

    `index`: the value at index floor(q * n) of the sorted values (the last one for q = 1), as the history server
    reports task quantiles. `lower`: the smallest value that at least the share q of all values does not exceed.
    `linear`: interpolated, so q = 0.5 is the usual median. `df` is read several times, see `_quantile_rows`: store it first if
    it is costly, or might not be the same each time.
    """
    # Without groups there is one, by a column that the planner can't take for a constant.
    column = F.explode(F.array(F.lit(0))) if not by else F.lit(0)
    rows = df.select(*by, column.alias("__column"), F.col(value).alias("__value"))
    found = _quantile_rows(rows, [q], [*by, "__column"], method).select(*by, F.col("__value").alias(name))
    return found if by else _one_row(found)


def _one_row(found: DataFrame) -> DataFrame:
    """At most one row as one row."""
    return found.agg(*(F.max(c).alias(c) for c in found.columns))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], qs: Mapping[str, float], by: Sequence[str] = (), method: str = "lower"
) -> DataFrame:
    """by, and for every column a struct of the same name with a field per quantile.

    All columns are ranked together. NaN and null do not count. Numbers of unlike types become double. `df` is read
    several times, as for `exact_quantile`.
    """
    by = list(by)
    types = {kind for name, kind in df.dtypes if name in columns}
    kind = types.pop() if len(types) == 1 else "double"

    def valid(c: str) -> Column:
        number = F.col(c).cast(kind)
        return F.when(~F.isnan(number), number) if kind in ("float", "double") else number

    entries = F.array(*(
        F.struct(F.lit(i).alias("column"), valid(c).alias("value")) for i, c in enumerate(columns)))
    long = df.select(*by, F.explode(entries).alias("__e")).select(
        *by, F.col("__e.column").alias("__column"), F.col("__e.value").alias("__value"))
    rows = _quantile_rows(long, list(qs.values()), [*by, "__column"], method)
    picked = {
        c: F.struct(*(
            F.max(F.when((F.col("__column") == i) & (F.col("__q") == j), F.col("__value"))).alias(name)
            for j, name in enumerate(qs))).alias(c)
        for i, c in enumerate(columns)
    }
    return rows.groupBy(*by).agg(*picked.values())


#: Lanes in which the sketches of a group are merged before they meet.
LANES = 64


def sketch_size(accuracy: float) -> int:
    """Numbers that a sketch must hold to be off by no more than 1 / accuracy of all ranks; 65,535 are the most."""
    return min(65_535, max(8, math.ceil(200 * (0.0165 * accuracy) ** (1 / 0.9))))


def approx_quantiles(
    df: DataFrame, columns: Sequence[str], qs: Mapping[str, float], by: Sequence[str] = (), k: int = 4096
) -> DataFrame:
    """by, and for every column a struct of the same name with a field per quantile, in one pass and to a rank.

    Every task makes a KLL sketch of each group and column, of some multiple of `k` numbers whatever it has seen. Sketches meet
    in LANES lanes and then once more, so a group that all tasks hold is merged in a tree. Ranks are off by a share of about 1.65 % *
    (200 / k)^0.9 of a group's values: 0.11 % for 4096 (with 99 % confidence). NaN and null do not count; values are doubles.
    """
    by = list(by)

    def number(c: str) -> Column:
        value = F.col(c).cast("double")
        return F.when(~F.isnan(value), value)

    lane = F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("__lane")
    rows = df.select(*by, lane, *(number(c).alias(f"__v{i}") for i, c in enumerate(columns)))
    some = rows.groupBy(*by, "__lane").agg(*(F.kll_sketch_agg_double(f"__v{i}", k).alias(f"__s{i}") for i in range(len(columns))))
    merged = [F.kll_merge_agg_double(f"__s{i}", k).alias(f"__s{i}") for i in range(len(columns))]
    whole = some.groupBy(*by).agg(*merged) if by else some.agg(*merged)

    def quantile(i: int, q: float) -> Column:
        sketch = F.col(f"__s{i}")
        return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(q))))

    return whole.select(*by, *(
        F.struct(*(quantile(i, q).alias(name) for name, q in qs.items())).alias(c) for i, c in enumerate(columns)))
