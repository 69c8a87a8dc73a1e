"""Sharding in Hilbert-curve order.

Language, source and size are quantised to BITS bits each, all in their own order: names by cuts at the quantiles of their
first bytes, sizes on a logarithmic scale. The rows are sorted by the index of their cell on the Hilbert curve, and the sorted
run is cut into shards whose row counts differ by one at most (law "rows"), which are written as files. So each shard, and
each file, has a small range of languages, sources and sizes, and a reader skips the others by their bounds (manifest()).

Equal texts lie together: all of them have the cell of the first on the curve. Only a cut may part them.

The order is worked out on keys alone: what is summed up are counts and bytes for each text's hash, then for each cell. A cell
is cut into pieces of about the same number of bytes by that hash, and a text that is larger than a piece, with all its
copies, into parts by a hash of the row; so where a row goes is known without sampling, and the tasks that move whole texts
have about the same number of bytes, however long some texts are and however many rows share a cell or a text.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import private_names, shared_dir, store

BITS = 6
#: Bytes in a piece at most, and pieces for each shuffle partition.
PIECE, PIECES = 128 << 20, 4
#: The copied texts with rows in several cells are broadcast up to so many bytes; more of them are joined by a shuffle.
MOST_BROADCAST, TEXT_BYTES = 32 << 20, 48

OUTPUT = ("size", "curve", "shard", "slot")


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """The index on the Hilbert curve of a cell with these coordinates (longs from 0 to 2^bits - 1).

    The axes-to-transpose steps of J. Skilling, "Programming the Hilbert curve" (2004), as one fold over the bits.
    """
    n = len(axes)
    field = [f"x{i}" for i in range(n)]

    def state(xs: list[Column]) -> Column:
        return F.struct(*[x.alias(f) for f, x in zip(field, xs)])

    def undo(acc: Column, bit: Column) -> Column:
        q = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        p = q - F.lit(1)
        xs = [acc[f] for f in field]
        for i in range(n):
            on = xs[i].bitwiseAND(q) != 0
            if i == 0:
                xs[0] = F.when(on, xs[0].bitwiseXOR(p)).otherwise(xs[0])
            else:
                swap = xs[0].bitwiseXOR(xs[i]).bitwiseAND(p)
                xs[0], xs[i] = F.when(on, xs[0].bitwiseXOR(p)).otherwise(xs[0].bitwiseXOR(swap)), F.when(on, xs[i]).otherwise(xs[i].bitwiseXOR(swap))
        return state(xs)

    def gray(acc: Column) -> Column:
        xs = [acc[f] for f in field]
        for i in range(1, n):
            xs[i] = xs[i].bitwiseXOR(xs[i - 1])
        flips = [F.when(xs[-1].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(bits - 1, 0, -1)]
        flip = reduce(lambda a, b: a.bitwiseXOR(b), flips, F.lit(0).cast("long"))
        return state([x.bitwiseXOR(flip) for x in xs])

    start = state([x.cast("long") for x in axes])
    turned = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), start, undo, gray)

    def interleave(acc: Column, bit: Column) -> Column:
        index = acc["index"]
        for f in field:
            index = index * 2 + F.call_function("shiftright", acc[f], bit).bitwiseAND(F.lit(1))
        return F.struct(index.alias("index"), *[acc[f].alias(f) for f in field])

    # the coordinates travel in the fold's state, so that they are worked out once
    packed = F.transform(F.array(turned), lambda t: F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.struct(F.lit(0).cast("long").alias("index"), *[t[f].alias(f) for f in field]), interleave, lambda a: a["index"]))
    return packed[0]


def name_code(name: Column) -> Column:
    """The first seven bytes of a name as a number: names in their order. A null name comes before all others."""
    first = F.substring(F.coalesce(name, F.lit("")).cast("binary"), 1, 7)
    return F.when(name.isNull(), F.lit(-1).cast("long")).otherwise(F.conv(F.rpad(F.hex(first), 14, "0"), 16, 10).cast("long"))


def name_cuts(docs: DataFrame, names: tuple[str, ...], bits: int = BITS) -> list[list[int]]:
    """For each column of names the codes at which its cells start, from quantiles over all rows."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = docs.agg(*[F.percentile_approx(name_code(F.col(c).cast("string")), shares, 10_000) for c in names]).first()
    return [sorted(set(own or [])) for own in found]


def name_cell(name: Column, cuts: list[int]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c <= name_code(name))).cast("long")


def size_cell(size: Column, bits: int = BITS) -> Column:
    """Three cells for each doubling of the size, up to the last cell."""
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 3), F.lit((1 << bits) - 1)).cast("long")


def hilbert_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """docs with size (UTF-8 bytes of the text and one more), curve, shard (0 to n_shards - 1) and slot (gapless in its shard),
    read from the files of the shards, one folder each.

    Shard k of n over N rows has the rows of rank ceil(kN/n) to ceil((k+1)N/n) - 1. Inside a cell equal texts lie together, by
    a hash of the text, then by id and by a hash of the whole row.
    Nulls: a null text has size 1; null names come first. Repeated rows: each has a slot of its own. Empty table: empty
    result. Extra columns stay; one that has the name of an output column is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUTPUT])
    cell, text, home, cuts, parts, hot, piece, sub, start, run = private_names(docs, "cell", "text", "home", "cuts", "parts", "hot", "piece", "sub", "start", "run")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + F.lit(1)
    quantiles = name_cuts(docs, names)
    axes = [*(name_cell(F.col(c).cast("string"), q) for c, q in zip(names, quantiles)), size_cell(size)]
    packed = reduce(lambda a, b: a * (1 << BITS) + b, axes)
    rows = docs.withColumn("size", size).withColumn(cell, packed).withColumn(text, F.xxhash64(text_col))

    # what is in each text's cells, then in each cell: no text moves
    texts = store(rows.groupBy(text, cell).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")), "hilbert-texts")
    n_rows, n_bytes = texts.agg(F.sum("n"), F.sum("b")).first()
    if not n_rows:
        return docs.select("*", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("curve"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    coordinates = [F.call_function("shiftright", F.col(cell), F.lit(BITS * (len(axes) - 1 - i))).bitwiseAND(F.lit((1 << BITS) - 1)) for i in range(len(axes))]
    curves = store(texts.select(cell).distinct().select(cell, hilbert_index(coordinates, BITS).alias("curve")), "hilbert-cells")  # 2^(BITS x axes) at most
    by_text = store(texts.join(F.broadcast(curves), cell).groupBy(text).agg(F.min("curve").alias(home), F.max("curve").alias("last"), F.sum("b").alias("b")), "hilbert-homes")
    most = min(PIECE, max(1, n_bytes // (PIECES * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    moved = by_text.where(F.col(home) != F.col("last")).select(text, home)
    if moved.count() * TEXT_BYTES <= MOST_BROADCAST:
        moved = F.broadcast(moved)
    large = by_text.where(F.col("b") > most).select(text, F.ceil(F.col("b") / most).cast("int").alias(parts))  # one for each piece at most
    pieces = by_text.where(F.col("b") <= most).groupBy(home).agg(F.ceil(F.sum("b") / most).cast("int").alias(cuts))

    # where each row goes: (cell on the curve, texts larger than a piece last, piece or text, part of the text)
    share = F.call_function("shiftrightunsigned", F.col(text), F.lit(11)).cast("double") / F.lit(float(1 << 53))
    placed = (
        rows.join(F.broadcast(curves), cell)
        .join(moved, text, "left")
        .withColumn(home, F.coalesce(home, "curve"))
        .join(F.broadcast(pieces), home, "left")
        .join(F.broadcast(large), text, "left")
        .withColumn(hot, F.col(parts).isNotNull())
        .withColumn(piece, F.when(F.col(hot), F.col(text)).otherwise(F.floor(share * F.col(cuts))))
        .withColumn(sub, F.when(F.col(hot), F.pmod(F.xxhash64(*[c for c in docs.columns if c != text_col]), F.col(parts)).cast("int")).otherwise(F.lit(0)))
        .withColumn("curve", F.col(home))
        .drop(cell, home, cuts, parts)
    )
    unit = ["curve", hot, piece, sub]
    before = Window.orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)
    counted = store(placed.groupBy(*unit).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")), "hilbert-units")  # a row for each piece
    starts = counted.select(*unit, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start), F.floor(F.coalesce(F.sum("b").over(before), F.lit(0)) / most).alias(run))

    rank = F.row_number().over(Window.partitionBy(run, *unit).orderBy(text, id_col, F.xxhash64(*docs.columns))) - 1 + F.col(start)
    ranked = placed.join(F.broadcast(starts), unit).repartition(run).withColumn(start, rank).drop(run, hot, piece, sub, text)
    shard = F.expr(f"cast((cast(`{start}` as decimal(20,0)) * {n_shards}) div {n_rows} as int)")
    first = F.expr(f"cast((cast(`shard` as decimal(20,0)) * {n_rows} + {n_shards - 1}) div {n_shards} as bigint)")
    out = ranked.withColumn("shard", shard).withColumn("slot", F.col(start) - first).drop(start).select(*docs.columns, *OUTPUT)
    path = f"{shared_dir(spark)}/leafmill-shards-{uuid.uuid4().hex}"
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path).select(*out.columns)


def manifest(sharded: DataFrame, names: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per shard: rows, bytes, and the bounds of the curve, of the size and of each name, nulls apart, for pruning."""
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("size").alias("n_bytes"),
        *[f(c).alias(f"{c}_{end}") for c in ("curve", "size", *names) for f, end in ((F.min, "low"), (F.max, "high"))],
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in names],
    )
