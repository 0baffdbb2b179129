"""Ordered-sequence primitives that stay bounded per task however hot a key is.

A plain ``Window.partitionBy(video)`` or ``collect_list`` per video puts one
video into one task.  The helpers here cut each key into fixed-size *blocks* of
its order column, work inside the blocks, and pass only one small summary row
per block across block borders.  Two tiers of blocks keep the number of
summaries per task small too.

A series is cut once: ``blocked`` shuffles it, writes one row per block to the
shared folder with the block's first and last row beside it, and everything
after reads that table.  So neighbours, running values and scans read their
source once, however many of them are stacked.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import let
from ..sources.artifacts import materialize

BLOCK = 1024  # ordered rows per block
FAN = 512  # blocks per super-block
STEP = 32  # rows that a fold copies at most


def r6(c: Column | str) -> Column:
    """Six digits, without negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                cell: Sequence[Column], out: str) -> DataFrame:
    """Dense 0-based position of each row in its key.

    ``cell`` is a tuple of expressions that never decreases along ``order`` (a
    second of clock time, a range of ids).  Rows are numbered inside their cell
    and shifted by the counts of the cells before it: the only window over a
    whole key runs on one count per cell.
    """
    names = [f"_c{i}" for i in range(len(cell))]
    df = df.withColumns(dict(zip(names, cell)))
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (df.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
              .select(*keys, *names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    w = Window.partitionBy(*keys, *names).orderBy(*order)
    return (df.join(shifts, [*keys, *names])
            .withColumn(out, F.col("_off") + F.row_number().over(w) - 1)
            .drop("_off", *names))


def block_of(order: str | Column, block: int = BLOCK) -> Column:
    return F.floor((F.col(order) if isinstance(order, str) else order) / F.lit(block))


def blocked(df: DataFrame, keys: Sequence[str], order: str, block: int = BLOCK) -> DataFrame:
    """The series in blocks of ``block`` values of an integer order column, written once.

    One row per block: keys, ``_blk``, its ``_rows`` in order (structs of all other columns), and the
    first and last of them as ``_first`` and ``_last``.  Reading these two alone does not read the rows.
    """
    row = F.struct(order, *[c for c in df.columns if c not in (*keys, order)])
    cut = (df.withColumn("_blk", block_of(order, block)).groupBy(*keys, "_blk")
           .agg(F.array_sort(F.collect_list(row)).alias("_rows")))
    return materialize(cut.withColumns({"_first": F.element_at("_rows", 1), "_last": F.element_at("_rows", -1)}))


def emit_states(rows: Column, start: Column, step: Callable[[Column, Column], Column], give: Callable[[Column, Column, Column], Column]) -> Column:
    """Array of ``give(before, after, row)`` along ``rows``, where ``after = step(before, row)``.

    A fold that appends to its result copies it at every row.  Here rows are folded STEP at a time
    and only the arrays of these are appended, so work grows with the rows alone.
    """
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / STEP).cast("int")), lambda i: F.slice(rows, i * STEP + 1, F.lit(STEP)))
    none = F.slice(F.transform(rows, lambda r: give(start, start, r)), 1, 0)

    def inner(a: Column, r: Column) -> Column:
        return let(step(a["s"], r), lambda s: F.struct(s.alias("s"), F.concat(a["o"], F.array(give(a["s"], s, r))).alias("o")))

    def outer(a: Column, group: Column) -> Column:
        done = F.aggregate(group, F.struct(a["s"].alias("s"), none.alias("o")), inner)
        return let(done, lambda d: F.struct(d["s"].alias("s"), F.concat(a["o"], F.array(d["o"])).alias("o")))

    return F.aggregate(groups, F.struct(start.alias("s"), F.slice(F.array(none), 1, 0).alias("o")), outer, lambda a: F.flatten(a["o"]))


def _neighbour(df, keys, order, cols, out, block, step):
    over = Window.partitionBy(*keys).orderBy("_blk")
    edge, beside = ("_last", F.lag) if step > 0 else ("_first", F.lead)
    stored = blocked(df, keys, order, block)
    edges = stored.select(*keys, "_blk", F.struct(*[F.col(edge)[c].alias(c) for c in cols]).alias("_e"))
    edges = edges.select(*keys, "_blk", beside("_e").over(over).alias("_halo"))
    # A block's rows beside the same rows moved by one, with the halo where the block ends.
    own = F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in cols]))
    moved = F.concat(F.array("_halo"), F.slice(own, 1, F.size("_rows") - 1)) if step > 0 else F.concat(F.slice(own, 2, F.size("_rows")), F.array("_halo"))
    pairs = stored.select(*keys, "_blk", "_rows").join(edges, [*keys, "_blk"], "left").select(*keys, F.explode_outer(F.arrays_zip(F.col("_rows").alias("r"), moved.alias("o"))).alias("_z"))
    return pairs.select(*[c if c in keys else F.col("_z.r")[c].alias(c) for c in df.columns], F.col("_z.o").alias(out))


def with_previous(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str],
                  out: str = "prev", block: int = BLOCK) -> DataFrame:
    """Struct of ``cols`` from the preceding row (null for the first).

    ``order`` is an integer, distinct in a key; it may have gaps of any length.  The last row of
    each block that holds rows is carried to the next such block.
    """
    return _neighbour(df, keys, order, cols, out, block, 1)


def with_next(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str],
              out: str = "next", block: int = BLOCK) -> DataFrame:
    """Struct of ``cols`` from the following row (null for the last); gaps as in :func:`with_previous`."""
    return _neighbour(df, keys, order, cols, out, block, -1)


def _running(df, keys, order, value, out, block, agg, start, step, inclusive):
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    stored = blocked(df.withColumn("_v", value), keys, order, block)
    whole = stored.select(*keys, "_blk", F.aggregate(F.transform("_rows", lambda r: r["_v"]), start, step).alias("_s"))
    whole = whole.select(*keys, "_blk", F.coalesce(agg("_s").over(before), start).alias("_in"))
    along = emit_states(F.col("_rows"), F.col("_in"), lambda s, r: step(s, r["_v"]),
                        lambda s, t, r: F.struct((t if inclusive else s).alias("s"), r.alias("r")))
    rows = stored.select(*keys, "_blk", "_rows").join(whole, [*keys, "_blk"]).select(*keys, F.explode_outer(along).alias("_z"))
    return rows.select(*[c if c in keys else F.col("_z.r")[c].alias(c) for c in df.columns], F.col("_z.s").alias(out))


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
                block: int = BLOCK) -> DataFrame:
    """Inclusive running sum of ``value`` along an integer order column; nulls count as 0.

    Rows are summed inside blocks; the window over a whole key sees one total
    per block and streams over them.
    """
    kind = df.select(F.sum(value).alias("v")).schema["v"].dataType
    return _running(df, keys, order, value.cast(kind), out, block, F.sum, F.lit(0).cast(kind), lambda s, v: (s + F.coalesce(v, F.lit(0))).cast(kind), True)


def running_max(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
                inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Running maximum along an integer order column; null until a value was seen."""
    kind = df.select(value.alias("v")).schema["v"].dataType
    return _running(df, keys, order, value, out, block, F.max, F.lit(None).cast(kind), lambda s, v: F.greatest(s, v), inclusive)


def finite_scan(df: DataFrame, keys: Sequence[str], order: str, states: int, init: int,
                step: Callable[[Column, Column], Column], out: str, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Run a small state machine along each key; adds the state after every row.

    ``step(state, row)`` gives the next state number; a block of rows becomes a
    table over all states, and tables compose.
    """
    stored = blocked(df, keys, order, block)
    fns = stored.select(*keys, "_blk", F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.aggregate(
        "_rows", s, lambda a, r: step(a, r).cast("int"))).alias("_f"))
    enter = carry_in(fns, keys, "_f", lambda f, g: F.transform(f, lambda s: F.get(g, s)),
                     lambda f, s: F.get(f, s), F.lit(init), "_s", fan)
    done = emit_states(F.col("_rows"), F.col("_s"), lambda s, r: step(s, r).cast("int"), lambda s, t, r: F.struct(t.alias("s"), r.alias("r")))
    return (stored.select(*keys, "_blk", "_rows").join(enter, [*keys, "_blk"]).select(*keys, F.explode_outer(done).alias("_o"))
            .select(*keys, "_o.r.*", F.col("_o.s").alias(out)))


def carry_in(blocks: DataFrame, keys: Sequence[str], fn: str,
             compose: Callable[[Column, Column], Column],
             apply: Callable[[Column, Column], Column],
             init: Column, out: str = "carry", fan: int = FAN) -> DataFrame:
    """State (any type) on entry to every block, for state machines whose blocks compose.

    ``blocks`` holds one row per (keys, ``_blk``) with the block's transfer
    function in column ``fn``.  ``compose(f, g)`` is "f, then g";
    ``apply(f, state)`` runs one.  Super-blocks are composed first, chained per
    key, and only then unrolled, so a task sees at most ``fan`` functions of a
    key plus one per super-block.
    """
    sup = (blocks.withColumn("_sup", block_of("_blk", fan))
           .groupBy(*keys, "_sup")
           .agg(F.array_sort(F.collect_list(F.struct(F.col("_blk").alias("b"), F.col(fn).alias("f")))).alias("_items"))
           .withColumn("_whole", F.aggregate(
               F.slice("_items", 2, fan), F.col("_items")[0]["f"],
               lambda f, it: compose(f, it["f"]))))
    sup = materialize(sup)

    def walk(items: Column, start: Column) -> Column:
        return emit_states(items, start, lambda s, it: apply(it["f"], s), lambda s, t, it: F.struct(it["b"].alias("b"), s.alias("s")))

    top = (sup.groupBy(*keys)
           .agg(F.array_sort(F.collect_list(F.struct(F.col("_sup").alias("b"), F.col("_whole").alias("f")))).alias("_sups"))
           .withColumn("_e", F.explode_outer(walk(F.col("_sups"), init)))
           .select(*keys, F.col("_e.b").alias("_sup"), F.col("_e.s").alias("_enter")))
    return (sup.join(top, [*keys, "_sup"])
            .withColumn("_e", F.explode_outer(walk(F.col("_items"), F.col("_enter"))))
            .select(*keys, F.col("_e.b").alias("_blk"), F.col("_e.s").alias(out)))


def join_small(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column,
               how: str = "inner", salts: int = 16) -> DataFrame:
    """Join rows to a per-key table whose keys may be hot in ``big``.

    ``small`` has one row per key, so repeating it ``salts`` times is cheap; the
    big side is spread over the salts by a deterministic hash.  When the small
    side is measurably tiny, Spark's own size check turns this into a broadcast.
    """
    b = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s, [*keys, "_salt"], how).drop("_salt")


def value_bucket(c: Column) -> Column:
    """Monotone bucket of a number: 64 buckets per power of two, zero apart.

    A single-precision value has at most 2**17 distinct neighbours per bucket,
    which is what bounds the refinement step of :func:`exact_quantiles`.
    """
    v = c.cast("double")
    mag = F.floor(F.log2(F.abs(v)) * 64).cast("int") + 100_000
    return F.when(v == 0, F.lit(0)).otherwise(F.when(v > 0, mag).otherwise(-mag))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    levels: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per key, safe for hot keys.

    Pass one counts value buckets (a pure function of the value, combined before
    the shuffle) and locates the two order statistics each level needs; pass two
    refines only the buckets that hold them.  Nothing is ever gathered per key.
    """
    d = df.select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_b", value_bucket(F.col("_v")))
    hist = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = (hist.withColumn("_hi", F.sum("_n").over(upto))
            .withColumn("_lo", F.col("_hi") - F.col("_n"))
            .withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys))))
    wanted = F.array(*[F.struct(F.lit(n).alias("q"), F.lit(float(p)).alias("p")) for n, p in levels.items()])
    targets = (hist.withColumn("_t", F.explode(wanted))
               .withColumn("_pos", F.col("_t.p") * (F.col("_all") - 1))
               .withColumn("_k", F.explode(F.array_distinct(F.array(
                   F.floor("_pos"), F.ceil("_pos")))))
               .where((F.col("_k") >= F.col("_lo")) & (F.col("_k") < F.col("_hi")))
               .select(*keys, "_b", F.col("_t.q").alias("_q"), "_pos", (F.col("_k") - F.col("_lo")).alias("_local"), "_k"))
    picks = targets.groupBy(*keys, "_b").agg(
        F.collect_list(F.struct("_q", "_pos", "_local", "_k")).alias("_picks"))
    inside = d.join(picks.select(*keys, "_b"), [*keys, "_b"], "left_semi")
    vals = inside.groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    vals = vals.withColumn("_hi", F.sum("_n").over(run)).withColumn("_lo", F.col("_hi") - F.col("_n"))
    hit = (vals.join(picks, [*keys, "_b"])
           .withColumn("_t", F.explode("_picks"))
           .where((F.col("_t._local") >= F.col("_lo")) & (F.col("_t._local") < F.col("_hi"))))
    frac = F.col("_t._pos") - F.floor("_t._pos")
    weight = F.when(F.col("_t._k") == F.floor("_t._pos"), 1.0 - frac).otherwise(frac)
    return hit.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("_t._q") == n, F.col("_v") * weight)).alias(n) for n in levels])


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str,
                  start: str, end: str, width: float = 64, how: str = "inner") -> DataFrame:
    """Points to the closed interval [start, end] that holds them.

    Each interval is listed once per ``width``-wide cell it touches, so the join
    is an equi-join on (keys, cell) and a hot key is spread over its cells.
    """
    cells = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    iv = intervals.withColumn("_cell", F.explode(cells))
    pt = points.withColumn("_cell", F.floor(F.col(at) / width))
    p, i = pt.alias("p"), iv.alias("i")
    cond = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*keys, "_cell"]]
    cond.append((F.col(f"p.{at}") >= F.col(f"i.{start}")) & (F.col(f"p.{at}") <= F.col(f"i.{end}")))
    c = cond[0]
    for x in cond[1:]:
        c = c & x
    cols = [F.col(f"p.{x}") for x in points.columns]
    cols += [F.col(f"i.{x}") for x in intervals.columns if x not in points.columns]
    return p.join(i, c, how).select(*cols)
