"""Features of patches and of the ring around them: statistics, gradients and co-occurrence by centre, over two modalities.

Cells and centres are shuffled once by case, never a cell for each centre whose context covers
it: a task cuts contexts out of a case's array and works on a bounded number of them at once.
It holds one volume, or a few small ones. Patches as rows, and co-occurrence from them, are
there for other features of a patch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import contexts as kernels
from ..functions import stats
from ..session import spread

AXES = ("z", "y", "x")
CENTRE = ("case", "pz", "py", "px")
EPS = 1e-12
LEVELS, TEXTURE = kernels.LEVELS, kernels.TEXTURE
#: Values of contexts that a task works on at once, and rows of cells and centres that it gathers for that.
VALUES, ROWS = 1 << 17, 1 << 14


def patches(cells: DataFrame, centres: DataFrame, radius: Sequence[int], modalities: Sequence[str]) -> DataFrame:
    """(centre, modality, part, z, y, x, v, inside): the cells of each centre's core and of its context, cut at the array's border.

    part core has the core's cells; part ring has all of the context's, and inside tells those
    around the core. The context reaches twice as far as the core, and one cell at least.
    """
    outer = [max(1, 2 * r) for r in radius]
    span = lambda a, r: F.explode(F.sequence(F.col(f"p{a}") - r, F.col(f"p{a}") + r)).alias(a)
    reach = centres.select(*CENTRE)
    for a, r in zip(AXES, outer, strict=True):
        reach = reach.select("*", span(a, r))
    # Cells are many more than the arrays that Spark guesses their size by, so the hint keeps them off the driver.
    met = reach.join(cells.select("case", *AXES, *modalities).hint("shuffle_hash"), ["case", *AXES]).repartition("case")
    core = None
    for a, r in zip(AXES, radius, strict=True):
        one = F.abs(F.col(a) - F.col(f"p{a}")) <= r
        core = one if core is None else core & one
    parts = F.when(core, F.array(F.struct(F.lit("core").alias("part"), F.lit(True).alias("inside")), F.struct(F.lit("ring").alias("part"), F.lit(False).alias("inside"))))
    parts = parts.otherwise(F.array(F.struct(F.lit("ring").alias("part"), F.lit(True).alias("inside"))))
    values = F.array(*(F.struct(F.lit(m).alias("modality"), F.col(m).cast("double").alias("v")) for m in modalities))
    told = met.select(*CENTRE, *AXES, F.explode(parts).alias("p"), values.alias("values"))
    return told.select(*CENTRE, *AXES, "p.part", "p.inside", F.explode("values").alias("m")).select(*CENTRE, "m.modality", "part", *AXES, "inside", "m.v")


GROUP = (*CENTRE, "modality", "part")


def middle_layer(rows: DataFrame) -> DataFrame:
    """The cells of each patch's middle layer; of a ring's those in the box of the ring, the core's cells as the ring's median there."""
    whole = Window.partitionBy(*GROUP)
    low, high = F.min("z").over(whole), F.max("z").over(whole)
    layer = rows.withColumn("_at", low + F.floor((high - low + 1) / 2).cast("int")).filter("z = _at").drop("_at")
    own = F.col("inside")
    box = {f"_{n}{a}": f(F.when(own, F.col(a))).over(whole) for a in ("y", "x") for n, f in (("lo", F.min), ("hi", F.max))}
    told = layer.withColumns({**box, "_fill": F.percentile(stats.finite(F.when(own, F.col("v"))), F.lit(0.5)).over(whole)})
    told = told.filter("y between _loy and _hiy and x between _lox and _hix")
    return told.withColumn("v", F.when(own, F.col("v")).otherwise(F.coalesce("_fill", F.lit(0.0)))).drop("_fill", *box)


def texture(rows: DataFrame) -> DataFrame:
    """The seven co-occurrence features of each patch's middle layer, symmetric and over four directions.

    A pair of levels and its turned-round counterpart share one count, so pairs are counted once.
    """
    whole = Window.partitionBy(*GROUP)
    layer = middle_layer(rows).withColumns({"_lo": F.min("v").over(whole), "_hi": F.max("v").over(whole)})
    level = F.greatest(F.lit(0), F.least(F.floor((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + EPS) * LEVELS), F.lit(LEVELS - 1)))
    layer = layer.withColumn("q", F.when(F.col("_hi") - F.col("_lo") < EPS, 0).otherwise(level).cast("int")).select(*GROUP, "y", "x", "q")
    lines = {"_a": (F.col("y"), "x"), "_b": (F.col("x"), "y"), "_c": (F.col("y") - F.col("x"), "y"), "_d": (F.col("y") + F.col("x"), "y")}
    beside = layer.withColumns({n: F.lead("q").over(Window.partitionBy(*GROUP, line).orderBy(order)) for n, (line, order) in lines.items()})
    pairs = beside.select(*GROUP, "q", F.explode(F.array_compact(F.array(*lines))).alias("o"))
    counts = pairs.groupBy(*GROUP, F.least("q", "o").alias("i"), F.greatest("q", "o").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(whole))
    d, half = F.col("j") - F.col("i"), F.when(F.col("i") == F.col("j"), F.col("p")).otherwise(F.col("p") / 2)
    made = p.groupBy(*GROUP).agg(
        F.sum(F.col("p") * d * d).alias("contrast"), F.sum(F.col("p") * d).alias("dissimilarity"), F.sum(F.col("p") / (1 + d)).alias("homogeneity"),
        F.collect_list(F.struct("i", "j", (half * half).alias("s"))).alias("_squares"), (-F.sum(F.col("p") * F.ln(half))).alias("entropy"), F.sum(F.col("p") * (F.col("i") + F.col("j")) / 2).alias("_m"),
        F.sum(F.col("p") * (F.col("i") * F.col("i") + F.col("j") * F.col("j")) / 2).alias("_s"), F.sum(F.col("p") * F.col("i") * F.col("j")).alias("_ij"),
    )
    spread = F.greatest(F.col("_s") - F.col("_m") * F.col("_m"), F.lit(0.0)) + EPS
    # Squares are added up in the order of the levels, both ways round, so that the sum doesn't hang on the order of rows.
    turned = F.transform(F.filter("_squares", lambda s: s["i"] < s["j"]), lambda s: F.struct(s["j"].alias("i"), s["i"].alias("j"), s["s"].alias("s")))
    made = made.withColumn("asm", F.aggregate(F.array_sort(F.concat("_squares", turned)), F.lit(0.0), lambda acc, s: acc + s["s"]))
    made = made.withColumns({"energy": F.sqrt("asm"), "correlation": (F.col("_ij") - F.col("_m") * F.col("_m")) / (spread + EPS)})
    return made.select(*GROUP, *(F.col(t).alias(f"glcm_{t}") for t in TEXTURE))


def names() -> list[str]:
    """The 37 features of one part: fifteen statistics, the same of its gradient, and seven of co-occurrence."""
    return [*kernels.FIFTEEN, *(f"grad_{s}" for s in kernels.FIFTEEN), *(f"glcm_{t}" for t in TEXTURE)]


def context_features(cells: DataFrame, centres: DataFrame, radius: Sequence[int], first: str, second: str) -> DataFrame:
    """A row a centre: for each modality 37 features of the core, of the ring, their differences and ratios, and five across the modalities.

    cells: case, z, y, x and both modalities, an array without gaps a case; centres: case, pz, py, px. A difference or a ratio is null where a side is.
    """
    outer, sides = [max(1, 2 * r) for r in radius], [(m, p) for m in (first, second) for p in ("core", "ring")]
    own = cells.select("case", *AXES, *(F.col(m).cast("double").alias(f"_{k}") for k, m in enumerate((first, second))), F.lit(False).alias("_asked"))
    asked = centres.select("case", *(F.col(f"p{a}").alias(a) for a in AXES), *(F.lit(None).cast("double").alias(f"_{k}") for k in (0, 1)), F.lit(True).alias("_asked")).distinct()
    named = [f"{m}_{p}_{n}" for m, p in sides for n in names()] + [f"{m}_core_{how}_{n}" for how in ("minus_ring", "ring_ratio") for m in (first, second) for n in names()]
    named += [f"{first}_{second}_core_{c}" for c in ("corr", "mean_diff", "median_diff", "std_ratio", "mean_ratio")]
    schema = T.StructType([*(T.StructField(c, centres.schema[c].dataType) for c in CENTRE), *(T.StructField(n, T.DoubleType()) for n in named)])
    together = max(1, VALUES // (4 * int(np.prod([2 * r + 1 for r in outer]))))
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def told(keys: pa.Array, at: np.ndarray, v: np.ndarray, null: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
        parts, corr = kernels.features(v, null, there, radius, outer)
        a, b = parts[0], parts[2]
        both = ((parts[0], parts[1]), (parts[2], parts[3]))
        with np.errstate(invalid="ignore", over="ignore"):
            found = [p[n] for p in parts for n in names()] + [c[n] - r[n] for c, r in both for n in names()] + [c[n] / (r[n] + EPS) for c, r in both for n in names()]
            found += [corr, a["mean"] - b["mean"], a["median"] - b["median"], a["std"] / (b["std"] + EPS), a["mean"] / (b["mean"] + EPS)]
        return pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(at.T, kinds[1:4], strict=True)), *(pa.array(x, mask=np.isnan(x)) for x in found)], names=schema.names)

    def of_cases(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        ends = np.append(changes(rows.column("case")), rows.num_rows)
        at = np.stack([rows.column(a).to_numpy() for a in AXES], axis=1).astype(np.int64)
        null = np.stack([rows.column(f"_{k}").is_null().to_numpy() for k in (0, 1)], axis=1)
        values = np.stack([rows.column(f"_{k}").to_numpy() for k in (0, 1)], axis=1)
        is_centre = rows.column("_asked").to_numpy()
        firsts, held, many, begin = [], [], 0, 0
        for end in ends:
            centre, cell = (begin + np.flatnonzero(is_centre[begin:end] == flag) for flag in (True, False))
            if len(centre) and len(cell):
                held.append(kernels.boxes(at[cell], values[cell], null[cell], at[centre], radius, outer))
                firsts.append(np.full(len(held[-1][0]), begin))
                many += len(firsts[-1])
            begin = end
            if held and (end == rows.num_rows or many >= together):
                row, whole = np.concatenate(firsts), [np.concatenate(x) for x in zip(*held, strict=True)]
                for k in range(0, len(row), together):
                    some = slice(k, k + together)
                    yield told(rows.column("case").take(pa.array(row[some])).combine_chunks(), *(x[some] for x in whole))
                firsts, held, many = [], [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            case = batch.column(0)
            cut = changes(case)
            if held and case[0] != last:
                cut = np.append(0, cut)
            last = case[-1]
            # A case may go on in the next batch, so the last one waits.
            if len(cut) and count + cut[-1] >= ROWS:
                yield from of_cases(pa.Table.from_batches([*held, batch[: cut[-1]]]))
                held, count, batch = [], 0, batch[cut[-1] :]
            held.append(batch)
            count += batch.num_rows
        if held:
            yield from of_cases(pa.Table.from_batches(held))

    # Cells are few bytes and long work, so tasks are dealt by number and not by size.
    rows = own.unionByName(asked).filter(F.col("case").isNotNull()).repartition(spread(cells.sparkSession), "case")
    return rows.sortWithinPartitions("case").mapInArrow(run, schema)


def changes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one before."""
    v = np.asarray(column)
    return 1 + np.flatnonzero(v[1:] != v[:-1])
