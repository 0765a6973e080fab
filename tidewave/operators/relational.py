"""Relational steps of a study: sources that match, pairs, pivots, duplicates, names and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_all(sources: DataFrame, wanted: list[str], key: str = "sid", source: str = "source") -> DataFrame:
    """Keys that every wanted source has: one aggregation instead of a chain of joins."""
    return sources.where(F.col(source).isin(wanted)).groupBy(key).agg(F.count_distinct(source).alias("n")).where(F.col("n") == len(wanted)).select(key)


def missing_sources(sources: DataFrame, wanted: list[str], key: str = "sid", source: str = "source") -> DataFrame:
    """Keys that lack some wanted source, those that have none of them too, with the sorted names of what they lack, joined by commas."""
    have = sources.groupBy(key).agg(F.collect_set(F.when(F.col(source).isin(wanted), F.col(source))).alias("have"))  # as many names as are wanted, at most
    lack = F.array_sort(F.array_except(F.array(*map(F.lit, wanted)), F.col("have")))
    return have.select(key, F.array_join(lack, ",").alias("missing")).where("missing <> ''")


def stems(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("stem", F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


#: Files of one stem on either side whose pairs a task makes at a time.
SIDE = 1_000


def pairs_by_stem(left: DataFrame, right: DataFrame, path: str = "path", by: tuple[str, ...] = (), side: int = SIDE) -> DataFrame:
    """stem, left_path, right_path of all pairs of files with one stem.

    A stem with many files is dealt out in squares of about `side` files each way, by hashes of the path and of `by`, which
    tells files of one path apart; so no task makes all of its pairs.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = [stems(x, path).select("stem", F.col(path).alias(f"{name}_path"), F.xxhash64(path, *by).alias("_hash")) for x, name in ((left, "left"), (right, "right"))]
    sides = [x.select("stem", *(F.lit(int(i == k)).alias(f"_{k}") for k in (0, 1))) for i, x in enumerate(files)]
    counts = sides[0].unionAll(sides[1]).groupBy("stem").agg(*(F.ceil(F.sum(f"_{k}") / side).alias(f"_{k}") for k in (0, 1)))
    wide = counts.where("_0 * _1 > 1")  # at most two stems for every `side` files
    cells = []
    for own, x in enumerate(files):
        told = x.join(F.broadcast(wide), "stem", "left")
        mine, all_other = F.pmod("_hash", F.coalesce(f"_{own}", F.lit(1))), F.explode(F.sequence(F.lit(0), F.coalesce(f"_{1 - own}", F.lit(1)) - 1))
        cells.append(told.select("stem", x.columns[1], mine.alias(f"_at{own}"), all_other.alias(f"_at{1 - own}")))
    keys = ["stem", "_at0", "_at1"]
    return cells[0].repartition(n, *keys).join(cells[1].repartition(n, *keys), keys).drop("_at0", "_at1")


def channels(x: DataFrame, names: list[str], keys: list[str], value: str = "v", channel: str = "channel") -> DataFrame:
    """A column for each channel, the names given so that no job has to look for them."""
    return x.groupBy(*keys).pivot(channel, names).agg(F.avg(value))


def first_of(x: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an order that is stated."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def most_frequent(x: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).limit(n)


def numeric_columns(x: DataFrame, but: tuple[str, ...]) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, kind in x.dtypes if (kind in kinds or kind.startswith("decimal")) and c not in but]


def natural_key(name: Column, width: int = 20) -> Column:
    """Sorts as the name with runs of digits by their value."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, width, "0")).otherwise(F.lower(x))), "")


def subject_id(text: Column) -> Column:
    """The first run of exactly three digits, else the first run of digits."""
    exact = F.regexp_extract(text, r"(?:^|\D)(\d{3})(?:\D|$)", 1)
    return F.nullif(F.when(exact != "", exact).otherwise(F.regexp_extract(text, r"(\d+)", 1)), F.lit(""))


def condition(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("before"), "before").when(low.contains("after"), "after").otherwise("unknown")


def path_parts(path: Column) -> list[Column]:
    """Subject, method and region: the three folders above the file."""
    parts = F.split(path, "/")
    return [F.try_element_at(parts, F.lit(-4 + i)).alias(n) for i, n in enumerate(("subject", "method", "roi"))]


def every_kth(frames: DataFrame, rate: float, target: float, limit: float, frame: str = "frame") -> DataFrame:
    """Frames (from 0) of `limit` seconds thinned from one rate to another."""
    step = max(1, round(rate / target))
    return frames.where((F.col(frame) % step == 0) & (F.col(frame) / rate <= limit))


def with_prefix(x: DataFrame, prefixes: tuple[str, ...], keys: list[str]) -> DataFrame:
    """The keys and the columns whose names start with one of the prefixes."""
    return x.select(*keys, *(c for c in x.columns if c.startswith(prefixes) and c not in keys))


def in_range(x: DataFrame, column: str, low: int, high: int, omit: tuple[int, ...] = ()) -> DataFrame:
    """Rows whose id is from low to high and not among those left out."""
    return x.where(F.col(column).between(low, high) & ~F.col(column).isin(*omit))


def complete(x: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without nulls or NaN in the columns."""
    return x.dropna(subset=columns)


def has_columns(x: DataFrame, required: list[str]) -> bool:
    return set(required) <= set(x.columns)


def each_with(x: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Every row once for each of a few given values: an explode, no join."""
    return x.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def stacked(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames by column name; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def leaked(train: DataFrame, test: DataFrame, subject: str) -> DataFrame:
    """Subjects on both sides of a split."""
    return train.select(subject).intersect(test.select(subject))


def members(x: DataFrame, key: str, row_id: str) -> DataFrame:
    """The rows of each key in order, a row each with its place (from 0) instead of one list that a large key would fill."""
    return x.select(key, row_id, (F.row_number().over(Window.partitionBy(key).orderBy(row_id)) - 1).cast("long").alias("place"))


def melted(x: DataFrame, keys: list[str], columns: list[str], name: str = "channel", value: str = "v") -> DataFrame:
    """A row for each of the columns."""
    return x.unpivot(keys, columns, name, value)


def _range_of(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most the key, by halving: a tree of comparisons.

    It names the key more than once, so Spark computes the key in a projection of its own, once a row.
    """

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(bounds[middle]), within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(bounds))


def global_rank(x: DataFrame, key: Column, name: str = "rank", parts: int = 64, per_part: int = 32) -> DataFrame:
    """Each row's place (from 0) in the order of a key without ties, and no task with all rows.

    A bounded sample of keys (those with the smallest hashes) bounds ranges; each is ranked by itself and shifted by the
    rows before it. Rows with a null key come first, in no set order.
    """
    dealt = _in_ranges(x, key, parts, per_part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over at most `parts` rows
    shifts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy("_key")) - 1)
    return ranked.join(F.broadcast(shifts), "_part").withColumn(name, (F.col(name) + F.col("_shift")).cast("long")).drop("_key", "_part", "_shift")


def rank_within(x: DataFrame, group: str, key: Column, name: str = "rank", parts: int = 64, per_part: int = 32) -> DataFrame:
    """Each row's place (from 0) among those of its group (null is one), in the order of a key without ties; ranked by group and range, as few groups may hold all rows."""
    dealt = _in_ranges(x, key, parts, per_part)
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = dealt.withColumn(name, F.row_number().over(Window.partitionBy(group, "_part").orderBy("_key")) - 1)
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_range"))
    return ranked.join(shifts, same).withColumn(name, (F.col(name) + F.col("_shift")).cast("long")).drop("_key", "_part", "_shift", "_group", "_range")


def _in_ranges(x: DataFrame, key: Column, parts: int, per_part: int) -> DataFrame:
    """x with _key and _part: the key's range between bounds from a sample; rows with a null key are in the first."""
    keyed = x.withColumn("_key", key)
    sample = sorted(r[0] for r in keyed.where("_key is not null").select("_key").orderBy(F.xxhash64("_key"), "_key").limit(parts * per_part).collect())
    bounds = sorted(set(sample[per_part::per_part]))
    return keyed.withColumn("_part", F.when(F.col("_key").isNotNull(), _range_of(F.col("_key"), bounds)).otherwise(F.lit(0)))
