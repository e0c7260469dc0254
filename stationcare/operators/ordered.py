"""Row order over tables of any size, with no task holding the whole table.

``with_index`` numbers rows by a sort key. Rows fall into buckets between cut
points taken from a sample of the keys; only the one-row-per-bucket summary is
ever seen by a single task. A dense stretch of time, or one timestamp shared by
a third of the rows, is split like any other because the cuts use the whole key.
The cuts steer balance only: the numbering is exact for any cuts.

``in_blocks`` regroups numbered rows into blocks of consecutive rows, each with
a halo copied from its neighbours, so bounded look-back windows run per block.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcare.settings import SEED

INDEX = "row_index"
ROWS_PER_BUCKET = 250_000
MAX_BUCKETS = 20_000
UNROLLED_BUCKETS = 64
SAMPLES_PER_BUCKET = 20
#: rows of a block, where its halo is not longer than a quarter of that; many blocks spread evenly over tasks
MAX_BLOCK = 100_000
HALO_LIMIT = 2_000_000


def sort_value(df: DataFrame, name: str) -> Column:
    """Sort key with a type that survives a JSON round trip."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(name)
    return F.col(name)


def _grouped(df: DataFrame, by: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Group columns packed in one never-NULL key, so that a NULL group joins like any other."""
    return (df.withColumn("_by", F.struct(*by)), ["_by"]) if by else (df, [])


def join_summary(df: DataFrame, summary: DataFrame, keys: list[str], bounded: bool) -> DataFrame:
    """Left join of a per-bucket summary; broadcast only where its row count has a fixed bound.

    Otherwise the rows are already partitioned by the same keys and only the
    summary moves.
    """
    renamed = summary.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [df[k] == renamed[f"_r_{k}"] for k in keys])
    side = F.broadcast(renamed) if bounded else renamed
    return df.join(side, on, "left").drop(*[f"_r_{k}" for k in keys])


def _cut_points(keyed: DataFrame, buckets: int, rows: int) -> str | None:
    """JSON list of at most ``buckets - 1`` ascending sort keys, from a bounded sample."""
    share = min(1.0, SAMPLES_PER_BUCKET * buckets / max(rows, 1))
    picked = keyed.sample(False, share, SEED) if share < 1.0 else keyed
    listed = picked.agg(F.sort_array(F.collect_list("_k")).alias("ks"))
    step = F.greatest(F.floor(F.size("ks") / F.lit(buckets)).cast("int"), F.lit(1))
    positions = F.when(F.size("ks") > step, F.sequence(step + 1, F.size("ks"), step))
    cuts = F.array_distinct(F.transform(positions, lambda i: F.element_at("ks", i)))
    return listed.select(F.to_json(cuts).alias("cuts")).first()["cuts"]


def _with_bucket(df: DataFrame, key: Column, cuts_json: str | None, schema: T.StructType,
                 buckets: int) -> DataFrame:
    """``_bucket``: how many cut points lie at or before the key.

    Binary search as one projection per halving, all inside generated code, for few cuts. The plan of so many
    projections outgrows the driver with the number of halvings, so many cuts are searched by one expression.
    """
    if not cuts_json or cuts_json == "[]":
        return df.withColumn("_bucket", F.lit(0))
    cuts = F.from_json(F.lit(cuts_json), T.ArrayType(schema))
    size, low = F.size(cuts), F.col("_bucket")
    if buckets > UNROLLED_BUCKETS:
        steps = F.array(*[F.lit(1 << power) for power in range(buckets.bit_length(), -1, -1)])
        keyed = df.withColumn("_key", key)
        return keyed.withColumn("_bucket", F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= size) & (F.get(cuts, at + step - 1) <= F.col("_key")), at + step).otherwise(at))).drop("_key")
    out = df.withColumns({"_key": key, "_bucket": F.lit(0)})
    for power in range(buckets.bit_length(), -1, -1):
        step = 1 << power
        right = (low + step <= size) & (F.get(cuts, low + (step - 1)) <= F.col("_key"))
        out = out.withColumn("_bucket", F.when(right, low + step).otherwise(low))
    return out.drop("_key")


def bucketed(df: DataFrame, order_by: list[str], by: list[str] | None = None,
             rows: int | None = None, buckets: int | None = None) -> DataFrame:
    """Add ``_bucket``: increasing with the sort key, about equal numbers of rows in each."""
    by = list(by or [])
    rows = df.count() if rows is None else rows
    if buckets is None:
        parallel = 4 * df.sparkSession.sparkContext.defaultParallelism
        buckets = int(min(MAX_BUCKETS, max(parallel, rows // ROWS_PER_BUCKET), max(1, rows // 500)))
    key = F.struct(*[sort_value(df, c).alias(f"k{i}") for i, c in enumerate(by + list(order_by))])
    keyed = df.select(key.alias("_k"))
    cuts = _cut_points(keyed, buckets, rows) if buckets > 1 else None
    return _with_bucket(df, key, cuts, keyed.schema["_k"].dataType, buckets)


def with_index(df: DataFrame, order_by: list[str], by: list[str] | None = None,
               rows: int | None = None, buckets: int | None = None,
               index: str = INDEX) -> DataFrame:
    """Number rows 1..n in sort order, per ``by`` group or over the whole table."""
    split, group = _grouped(bucketed(df, order_by, by, rows, buckets), by)
    keys = group + ["_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (split.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
               .select(*keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")))
    inside = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order_by])
    numbered = split.withColumn("_rn", F.row_number().over(inside))
    joined = join_summary(numbered, offsets, keys, bounded=not by)
    return joined.withColumn(index, F.col("_rn") + F.col("_off")).drop("_rn", "_off", "_bucket", "_by")


@dataclass(frozen=True)
class Blocks:
    """Numbered rows in blocks of consecutive rows plus halo copies."""

    df: DataFrame
    by: tuple[str, ...]
    index: str
    length: int
    count: int

    @property
    def keys(self) -> list[str]:
        return [*self.by, "_block"]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.index)

    @property
    def running(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def reversed(self) -> WindowSpec:
        return (Window.partitionBy(*self.keys).orderBy(F.col(self.index).desc())
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def with_columns(self, columns: dict[str, Column]) -> "Blocks":
        return replace(self, df=self.df.withColumns(columns))

    def own_rows(self) -> "Blocks":
        return replace(self, df=self.df.where(~F.col("_halo")))

    def result(self, *scratch: str) -> DataFrame:
        return self.df.where(~F.col("_halo")).drop("_block", "_halo", "_by", *scratch)

    def summarise(self, *aggs: Column) -> DataFrame:
        return self.df.where(~F.col("_halo")).groupBy(*self.keys).agg(*aggs)

    def attach(self, summary: DataFrame) -> "Blocks":
        """Join one summary row per block; broadcast while the blocks are known to be few."""
        joined = join_summary(self.df, summary, self.keys, bounded=not self.by and self.count <= MAX_BUCKETS)
        return replace(self, df=joined)

    def before(self) -> WindowSpec:
        """Over a summary: all earlier blocks."""
        return (Window.partitionBy(*self.by).orderBy("_block")
                .rowsBetween(Window.unboundedPreceding, -1))

    def after(self) -> WindowSpec:
        return (Window.partitionBy(*self.by).orderBy(F.col("_block").desc())
                .rowsBetween(Window.unboundedPreceding, -1))


def in_blocks(df: DataFrame, rows: int, back: int = 0, ahead: int = 0,
              by: list[str] | None = None, index: str = INDEX,
              length: int | None = None) -> Blocks:
    """Blocks of consecutive rows, each with ``back`` / ``ahead`` rows of its neighbours."""
    df, group = _grouped(df, by)
    if max(back, ahead) > HALO_LIMIT:
        raise ValueError("look-back too long for halo blocks; use look_back")
    if length is None:
        parallel = 4 * df.sparkSession.sparkContext.defaultParallelism
        halo = max(back, ahead)
        length = max(2 * halo, min(max(MAX_BLOCK, 4 * halo), -(-rows // parallel)), 500)
    length = max(length, back, ahead, 1)
    count = -(-rows // length)
    at = F.col(index) - 1
    own = F.floor(at / F.lit(length)).cast("long")
    place = F.pmod(at, F.lit(length))
    if back == 0 and ahead == 0:
        return Blocks(df.withColumns({"_block": own, "_halo": F.lit(False)}),
                      tuple(group), index, length, count)
    homes = [own]
    if back:
        homes.append(F.when(place >= length - back, own + 1))
    if ahead:
        homes.append(F.when((place < ahead) & (own > 0), own - 1))
    spread = (df.withColumn("_own", own)
              .withColumn("_block", F.explode(F.array_compact(F.array(*homes))))
              .withColumn("_halo", F.col("_block") != F.col("_own")).drop("_own"))
    return Blocks(spread, tuple(group), index, length, count)


def look_back(df: DataFrame, columns: list[str], k: int, by: list[str] | None = None,
              index: str = INDEX, suffix: str = "_back") -> DataFrame:
    """Values ``k`` rows earlier, by an equi-join on row position (for very long look-backs)."""
    df, group = _grouped(df, by)
    shifted = df.select(*[F.col(c).alias(f"_r_{c}") for c in group],
                        (F.col(index) + k).alias("_r_index"),
                        *[F.col(c).alias(c + suffix) for c in columns])
    on = reduce(lambda a, b: a & b, [df[index] == shifted["_r_index"]]
                + [df[c] == shifted[f"_r_{c}"] for c in group])
    return df.join(shifted, on, "left").drop("_by", "_r_index", "_r__by")


def running_total(df: DataFrame, columns: dict[str, Column], rows: int,
                  by: list[str] | None = None, index: str = INDEX) -> DataFrame:
    """Running sums from the first row on: per-block sums plus a carried total."""
    blocks = in_blocks(df.withColumns({f"_v_{n}": c for n, c in columns.items()}), rows,
                       by=by, index=index)
    totals = blocks.summarise(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in columns])
    carried = totals.select(*blocks.keys, *[
        F.coalesce(F.sum(f"_t_{n}").over(blocks.before()), F.lit(0)).alias(f"_c_{n}")
        for n in columns])
    done = blocks.attach(carried).with_columns({
        n: F.coalesce(F.sum(f"_v_{n}").over(blocks.running), F.lit(0)) + F.col(f"_c_{n}")
        for n in columns})
    return done.result(*[f"{p}{n}" for n in columns for p in ("_v_", "_c_")])


@dataclass(frozen=True)
class Rolling:
    """One rolling statistic over the last ``width`` rows."""

    name: str
    column: str
    width: int
    min_periods: int
    kind: str = "mean"  # or "variance" (sample variance)


def _finite(column: str) -> Column:
    """Value as double; an infinity counts as missing."""
    x = F.col(column).cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def _parts(specs: list[Rolling]) -> dict[str, Column]:
    """Aggregates per column: count and sum for means; count, mean and variance for variances."""
    out: dict[str, Column] = {}
    for s in specs:
        x = _finite(s.column)
        out[f"_n_{s.column}"] = F.count(x)
        if s.kind == "mean":
            out[f"_s_{s.column}"] = F.sum(x)
        else:
            out |= {f"_m_{s.column}": F.avg(x), f"_v_{s.column}": F.var_pop(x)}
    return out


def _statistic(s: Rolling, head: str, tail: str) -> Column:
    """The statistic of a window cut in two, from the aggregates of its parts (``tail`` may be NULL)."""
    def part(kind: str, side: str) -> Column:
        return F.coalesce(F.col(f"{side}_{kind}_{s.column}"), F.lit(0.0))

    n, k = part("n", head), part("n", tail)
    count = n + k
    if s.kind == "mean":
        mean = F.try_divide(part("s", head) + part("s", tail), count)
        return F.when(count >= F.greatest(F.lit(s.min_periods), F.lit(1)), mean)
    apart = F.when((n > 0) & (k > 0), part("m", head) - part("m", tail)).otherwise(F.lit(0.0))
    moment = n * part("v", head) + k * part("v", tail) + apart * apart * F.try_divide(n * k, count)
    return F.when((count >= s.min_periods) & (count > 1), F.try_divide(moment, count - 1))


def rolling(df: DataFrame, specs: list[Rolling], rows: int, by: list[str] | None = None,
            index: str = INDEX, halo_limit: int = HALO_LIMIT) -> DataFrame:
    """Rolling means and variances of any width, from values inside each window only.

    The order is cut every ``width`` rows. A window is the end of one such stretch and the
    beginning of the next, so it is a running aggregate from the cut back plus one from the
    cut on: nothing is subtracted, and no value outside the window has a part in it. Infinities
    count as missing. A window as long as the table needs no look-back at all. Windows longer
    than ``halo_limit`` take the position join instead of a halo.
    """
    return rolling_blocks(df, specs, rows, by, index, halo_limit).result()


def rolling_blocks(df: DataFrame, specs: list[Rolling], rows: int, by: list[str] | None = None,
                   index: str = INDEX, halo_limit: int = HALO_LIMIT, extra: int = 0) -> Blocks:
    """``rolling`` kept in blocks with ``extra`` valid halo rows, for further look-backs."""
    whole = [s for s in specs if s.width >= rows and s.kind == "mean"]
    short = [s for s in specs if s not in whole and (s.width + extra <= halo_limit or s.kind != "mean")]
    long = [s for s in specs if s not in whole and s not in short]
    if whole:
        df = _rolling_whole(df, whole, rows, by, index)
    for width in sorted({s.width for s in long}):
        df = _rolling_joined(df, [s for s in long if s.width == width], rows, by, index)
    halo = max([min(s.width, rows) for s in short], default=0) + extra
    blocks = in_blocks(df, rows, back=halo, by=by, index=index)
    for width in sorted({s.width for s in short}):
        blocks = _rolling_in(blocks, [s for s in short if s.width == width])
    # columns in the order of the specs, whichever way each one was made
    names = [s.name for s in specs]
    return replace(blocks, df=blocks.df.select(*[c for c in blocks.df.columns if c not in names], *names))


def _rolling_in(blocks: Blocks, specs: list[Rolling]) -> Blocks:
    width, at, parts = specs[0].width, F.col(blocks.index), _parts(specs)
    cut = blocks.with_columns({"_stretch": F.floor((at - 1) / F.lit(width))})
    inside = Window.partitionBy(*blocks.keys, "_stretch")
    on = inside.orderBy(blocks.index).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = inside.orderBy(at.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.with_columns({f"_a{n}": c.over(on) for n, c in parts.items()})
    if width > 1:
        cut = cut.with_columns({f"_z{n}": c.over(back) for n, c in parts.items()})
        # the last row of a stretch has the whole stretch for its window
        cut = cut.with_columns({f"_t{n}": F.when(F.pmod(at, F.lit(width)) != 0, F.lag(f"_z{n}", width - 1).over(
            cut.window)) for n in parts})
    else:
        cut = cut.with_columns({f"_t{n}": F.lit(None).cast("double") for n in parts})
    out = cut.with_columns({s.name: _statistic(s, "_a", "_t") for s in specs})
    return replace(out, df=out.df.drop("_stretch", *[f"{p}{n}" for n in parts for p in ("_a", "_z", "_t")]))


def _addends(specs: list[Rolling]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for s in specs:
        x = _finite(s.column)
        out |= {f"_n_{s.column}": x.isNotNull().cast("long"), f"_s_{s.column}": F.coalesce(x, F.lit(0.0))}
    return out


def _rolling_whole(df, specs, rows, by, index) -> DataFrame:
    parts = _addends(specs)
    total = running_total(df, {f"_a{n}": c for n, c in parts.items()}, rows, by, index)
    empty = total.withColumns({f"_t{n}": F.lit(None).cast("double") for n in parts})
    out = empty.withColumns({s.name: _statistic(s, "_a", "_t") for s in specs})
    return out.drop(*[f"{p}{n}" for n in parts for p in ("_a", "_t")])


def _rolling_joined(df, specs, rows, by, index) -> DataFrame:
    """Means of one width, with running totals per stretch in both directions and one join on position."""
    width, parts = specs[0].width, _addends(specs)
    cut = df.withColumns({"_stretch": F.floor((F.col(index) - 1) / F.lit(width)),
                          "_reverse": F.lit(rows + 1) - F.col(index)})
    keys = [*(by or []), "_stretch"]
    both = running_total(cut, {f"_a{n}": c for n, c in parts.items()}, rows, keys, index)
    both = running_total(both, {f"_z{n}": c for n, c in parts.items()}, rows, keys, "_reverse")
    ends = [f"_z{n}" for n in parts]
    seen = look_back(both, ends, width - 1, by, index)
    seen = seen.withColumns({f"_t{n}": F.when(F.pmod(F.col(index), F.lit(width)) != 0, F.col(f"_z{n}_back"))
                             for n in parts})
    out = seen.withColumns({s.name: _statistic(s, "_a", "_t") for s in specs})
    return out.drop("_stretch", "_reverse", *[f"{c}_back" for c in ends],
                    *[f"{p}{n}" for n in parts for p in ("_a", "_z", "_t")])


def centred_mean(df: DataFrame, name: str, column: str, width: int, rows: int,
                 by: list[str] | None = None, index: str = INDEX) -> DataFrame:
    """Mean over ``width`` rows around each row; NULL where the window is not full."""
    ahead = (width - 1) // 2
    blocks = in_blocks(df, rows, back=width, ahead=max(ahead, 1), by=by, index=index)
    # the window around a row is the trailing window of the row that ends it
    trailing = _rolling_in(blocks, [Rolling("_mean", column, width, width)])
    done = trailing.with_columns({name: F.when(
        F.col(index) >= width - ahead, F.lead("_mean", ahead).over(trailing.window))})
    return done.result("_mean")


def previous(df: DataFrame, columns: dict[str, str], rows: int, by: list[str] | None = None,
             index: str = INDEX) -> DataFrame:
    """Value one row earlier, for each ``new name -> column``."""
    blocks = in_blocks(df, rows, back=1, by=by, index=index)
    return blocks.with_columns({new: F.lag(old, 1).over(blocks.window)
                                for new, old in columns.items()}).result()


def change_runs(df: DataFrame, column: str, rows: int, by: list[str] | None = None,
                index: str = INDEX, flag: str = "changed", run: str = "run_id") -> DataFrame:
    """Number runs of equal values. The first row, and any row next to a NULL, starts a run."""
    blocks = in_blocks(df, rows, back=1, by=by, index=index)
    same = F.col(column) == F.lag(column, 1).over(blocks.window)
    flagged = blocks.with_columns({flag: F.when(same, 0).otherwise(1)}).own_rows()
    counts = flagged.summarise(F.sum(flag).alias("_t"))
    carried = counts.select(*blocks.keys, F.coalesce(
        F.sum("_t").over(blocks.before()), F.lit(0)).alias("_carry"))
    done = flagged.attach(carried).with_columns({
        run: F.sum(flag).over(blocks.running) + F.col("_carry")})
    return done.result("_carry")


def interpolate(df: DataFrame, columns: list[str], rows: int, by: list[str] | None = None,
                index: str = INDEX) -> DataFrame:
    """Fill NULLs on the line between neighbours by row position; ends take the nearest value."""
    blocks = in_blocks(df, rows, by=by, index=index)

    def point(c: str) -> Column:
        return F.when(F.col(c).isNotNull(),
                      F.struct(F.col(index).alias("i"), F.col(c).cast("double").alias("x")))

    ends = blocks.summarise(*[F.min(point(c)).alias(f"_first_{c}") for c in columns],
                            *[F.max(point(c)).alias(f"_last_{c}") for c in columns])
    carried = ends.select(
        *blocks.keys,
        *[F.last(f"_last_{c}", True).over(blocks.before()).alias(f"_cb_{c}") for c in columns],
        *[F.last(f"_first_{c}", True).over(blocks.after()).alias(f"_ca_{c}") for c in columns])
    wide = blocks.attach(carried)
    wide = wide.with_columns({f"_b_{c}": F.coalesce(F.last(point(c), True).over(blocks.running),
                                                    F.col(f"_cb_{c}")) for c in columns})
    wide = wide.with_columns({f"_a_{c}": F.coalesce(F.last(point(c), True).over(blocks.reversed),
                                                    F.col(f"_ca_{c}")) for c in columns})
    filled = {}
    for c in columns:
        b, a, i = F.col(f"_b_{c}"), F.col(f"_a_{c}"), F.col(index)
        line = b["x"] + F.try_divide((a["x"] - b["x"]) * (i - b["i"]), a["i"] - b["i"])
        filled[c] = F.coalesce(F.col(c).cast("double"), line, b["x"], a["x"])
    return wide.with_columns(filled).result(
        *[f"{p}{c}" for c in columns for p in ("_cb_", "_ca_", "_b_", "_a_")])
