"""N-gram Jaccard join by T-occurrence search.

Two documents link when den * |A and B| >= num * |A or B| for their sets of word shingles.

1. Documents with equal sets are one class; only classes are compared.
2. A class that links with another has at least ceil(tn) of its n shingles in common with it, t the similarity. Of a share
   of all shingles, by their hash, those that no other class has are counted; a class with more than n - ceil(tn) of them
   links with nothing. What is left is counted once more among itself, with all shingles. Documents that merely share
   passages drop out here.
3. The other classes are brought together. In one order of all shingles, two linked sets of sizes m and n have an equal
   shingle among the first m - ceil(tm) + 1 of the one and the first n - ceil(tn) + 1 of the other. Each class gives out
   these; equal ones meet by their hash, and the connected components of these meetings are the groups to search. Any order
   is right; shingles that repeat in a sample of documents come last, so that what is common brings few together. The groups
   are parted once more in the same way, in the order of how many classes in all groups have each shingle: copies that only
   share passages with other ones fall apart.
4. In each group, inverted lists from shingles to classes are built, and each class asks for the classes that occur in at
   least T of its lists, T from the sizes (DivideSkip of Li, Lu and Lu, 2008): the longest lists are set aside, the short
   ones are merged by a heap, and whoever occurs often enough in them is looked up in the long ones by binary search.
   Shingles with the same list are one list with a weight. A group of more than BLOCK classes is dealt to blocks. Each block
   is searched by itself and packed into one row (shingles that its sets share are stored once), and pairs of packed
   blocks are searched for the links between them, so that no task holds more than two blocks at a time.

Where only components are wanted (links=False), a class is compared with one class of each component first, and no more
with components that it has joined.
"""

from __future__ import annotations

import heapq
import math
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import releasing, slices, store
from .components import connected_components
from .shingles import mix, shingle_sets

#: Classes in a block of a group.
BLOCK = 128
#: Weight of binary searches against steps of the merge in DivideSkip's choice of long lists.
MU = 0.01
#: Bytes of the ids of documents whose texts are fetched by a broadcast; more of them are fetched by a shuffle.
MOST_BROADCAST, ID_BYTES = 32 << 20, 64
#: Sets that a task remembers, so that it gives out the shingles of equal sets once.
REMEMBERED = 200_000
#: The share of shingles whose owners are counted, as a multiple of the share that linked sets may lack.
COUNTED = 1.5
#: About so many documents are sampled for the order of shingles, and so many of their repeated shingles come last. Neither
#: changes what links.
SAMPLE, REPEATED = 8_000, 500_000
#: Bytes of text and rows that are worked on at a time.
SLICE, SLICE_ROWS = 1 << 20, 500


class Threshold:
    """Jaccard similarity of at least num / den."""

    def __init__(self, num: int = 85, den: int = 100):
        self.num, self.den = num, den

    def overlap(self, m: int, n: int) -> int:
        """The least number of common shingles of linked sets with m and n."""
        return -(-self.num * (m + n) // (self.num + self.den))

    def least(self, n: int) -> int:
        """The size of the smallest set that a set of n can link with."""
        return -(-self.num * n // self.den)

    def prefix(self, shingles: np.ndarray, repeated: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The first shingles of a set, one of which each linked set has among its own first ones. Order: those that are not
        among repeated, then by counts, then by hash. shingles and repeated are sorted."""
        n = len(shingles)
        wanted = n - self.least(n) + 1
        if not len(repeated):
            return shingles[:wanted]
        at = np.minimum(np.searchsorted(repeated, shingles), len(repeated) - 1)
        late = repeated[at] == shingles
        first = shingles[~late][:wanted]
        if len(first) == wanted:
            return first
        others = np.flatnonzero(late)
        others = others[np.argsort(counts[at[others]], kind="stable")][: wanted - len(first)]
        return np.concatenate((first, shingles[others]))

    def __getstate__(self):
        return self.num, self.den

    def __setstate__(self, state):
        self.num, self.den = state

    def __hash__(self):
        return hash((self.num, self.den))

    def __eq__(self, other):
        return (self.num, self.den) == (other.num, other.den)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two hashes of the set."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(mix(shingles, s).sum(dtype=np.uint64, keepdims=True), s + len(shingles)).view(np.int64)[0]) for s in (21, 22))


# ---- search in a group


class Together:
    """Which sets are known to be in one component."""

    def __init__(self, labels: np.ndarray):
        self.component = np.unique(labels, return_inverse=True)[1]
        self.first = np.zeros(len(labels), bool)  # of each component, one set that is asked for before the others

    def joined(self, x: int, y: int) -> bool:
        return self.component[x] == self.component[y]

    def join(self, x: int, y: int) -> None:
        old, new = self.component[x], self.component[y]
        own = self.component == old
        if (self.first & (self.component == new)).any():
            self.first[own] = False
        self.component[own] = new

    def seen(self, x: int) -> None:
        if not (self.first & (self.component == self.component[x])).any():
            self.first[x] = True


def search(sizes: list[int], sets: list[np.ndarray], sides: list[int] | None, rule: Threshold, together: Together | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (x, y), y < x, of linked sets; sets in ascending order of sizes. With sides (0 and 1), pairs of different sides
    only; with together, only links that join two components."""
    g = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.lexsort((owner, every))
    every, owner = every[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    lengths = np.diff(np.append(starts, len(every)))
    starts, lengths = starts[lengths > 1], lengths[lengths > 1]
    if not len(starts):
        return
    # shingles with the same list: one list with a weight
    names = mix(np.arange(g, dtype=np.uint64), 31)
    with np.errstate(over="ignore"):
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names[owner], dtype=np.uint64)))
        named = running[starts + lengths] - running[starts]
    _, firsts, weights = np.unique(mix(named, 32) ^ lengths.astype(np.uint64), return_index=True, return_counts=True)
    lists = [owner[starts[f] : starts[f] + lengths[f]] for f in firsts]
    by_set: list[list[int]] = [[] for _ in range(g)]
    for number, members in enumerate(lists):
        for d in members.tolist():
            by_set[d].append(number)
    if sides is None:
        asked = [lists]
    else:
        side = np.array(sides)
        asked = [[m[side[m] == 1 - own] for m in lists] for own in (0, 1)]
    plain = [[m.tolist() for m in own] for own in asked]
    weight = weights.tolist()

    for x in range(1, g):
        mine, arrays = (plain[0], asked[0]) if sides is None else (plain[sides[x]], asked[sides[x]])
        own = sorted((q for q in by_set[x] if mine[q]), key=lambda q: (-len(mine[q]), q))
        least = rule.least(sizes[x])
        t = rule.overlap(sizes[x], least)
        low = bisect_left(sizes, least, 0, x)
        if low == x or sum(weight[q] for q in own) < t:
            continue
        # the long lists: as heavy as DivideSkip's rule allows, and always less than T
        budget = min(t - 1, int(t / (MU * math.log2(len(mine[own[0]]) + 1) + 1)))
        cut = heavy = 0
        while cut < len(own) and heavy + weight[own[cut]] <= budget:
            heavy += weight[own[cut]]
            cut += 1
        long, short = own[:cut], own[cut:]

        def linked(short_lists: list[tuple[list[int], int]]) -> list[int]:
            found, counts = _heap_merge(short_lists, low, x, t - heavy)
            if not found:
                return found
            candidates, have = np.array(found), np.array(counts)
            need = np.array([rule.overlap(sizes[x], sizes[y]) for y in found])
            left = heavy
            for q in long:
                alive = have + left >= need
                if not alive.all():
                    candidates, have, need = candidates[alive], have[alive], need[alive]
                    if not len(candidates):
                        return []
                members = arrays[q]
                at = np.searchsorted(members, candidates)
                have = have + weight[q] * (members[np.minimum(at, len(members) - 1)] == candidates)
                left -= weight[q]
            return candidates[have >= need].tolist()

        if together is None:
            for y in linked([(mine[q], weight[q]) for q in short]):
                yield x, y
            continue
        for firsts_only in (True, False):
            wanted = (together.component != together.component[x]) & (together.first == firsts_only)
            if not wanted[low:x].any():
                continue
            for y in linked([(m[wanted[m]].tolist(), weight[q]) for q, m in ((q, arrays[q]) for q in short)]):
                if not together.joined(x, y):
                    together.join(x, y)
                    yield x, y
        together.seen(x)


def _heap_merge(lists: list[tuple[list[int], int]], low: int, high: int, least: int) -> tuple[list[int], list[int]]:
    """Members from low to high - 1 whose lists weigh at least so much together, ascending, and the weights."""
    heap = []
    for number, (members, _) in enumerate(lists):
        at = bisect_left(members, low)
        if at < len(members) and members[at] < high:
            heap.append((members[at], number, at))
    heapq.heapify(heap)
    found, counts = [], []
    while heap:
        member, total = heap[0][0], 0
        while heap and heap[0][0] == member:
            _, number, at = heap[0]
            members, w = lists[number]
            total += w
            at += 1
            if at < len(members) and members[at] < high:
                heapq.heapreplace(heap, (members[at], number, at))
            else:
                heapq.heappop(heap)
        if total >= least:
            found.append(member)
            counts.append(total)
    return found, counts


#: A class in a block: smallest id, copies, smallest id of its component in the block, shingles.
Member = tuple[int, int, int, np.ndarray]


def search_rows(rows: list[Member], sides: list[int] | None, rule: Threshold, links: bool) -> list[tuple[int, int, int]]:
    """(rep, smallest linked rep, number of linked documents) of each row; with two sides, of links between them."""
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i][3]), rows[i][0]))
    rows, sides = [rows[i] for i in order], sides and [sides[i] for i in order]
    parent = list(range(len(rows)))
    n_links = [0] * len(rows)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    together = None if links else Together(np.array([r[2] for r in rows]))
    for x, y in search([len(r[3]) for r in rows], [r[3] for r in rows], sides, rule, together):
        n_links[x] += rows[y][1]
        n_links[y] += rows[x][1]
        a, b = root(x), root(y)
        if rows[a][0] < rows[b][0]:
            parent[b] = a
        else:
            parent[a] = b
    return [(r[0], rows[root(i)][0], n_links[i]) for i, r in enumerate(rows)]


def pack_members(rows: list[Member]) -> bytes:
    """Each shingle once, and of each set the places of its shingles as differences."""
    distinct, places = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
    lengths = np.array([len(r[3]) for r in rows], "<u4")
    steps = np.diff(places, prepend=0).astype("<i4")
    firsts = np.cumsum(lengths) - lengths
    steps[firsts] = places[firsts]
    numbers = np.array([r[:3] for r in rows], "<i8")
    return zlib.compress(struct.pack("<II", len(rows), len(distinct)) + numbers.tobytes() + lengths.tobytes() + distinct.astype("<u8").tobytes() + steps.tobytes(), 1)


def unpack_members(payload: bytes) -> list[Member]:
    raw = zlib.decompress(payload)
    n, n_distinct = struct.unpack_from("<II", raw)
    numbers = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(n, 3).tolist()
    lengths = np.frombuffer(raw, "<u4", n, 8 + 24 * n).astype(np.int64)
    distinct = np.frombuffer(raw, "<u8", n_distinct, 8 + 28 * n)
    steps = np.frombuffer(raw, "<i4", int(lengths.sum()), 8 + 28 * n + 8 * n_distinct)
    ends = np.cumsum(lengths)
    return [(*own, distinct[np.cumsum(steps[e - k : e])]) for own, k, e in zip(numbers, lengths.tolist(), ends.tolist())]


# ---- the join


def jaccard_join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", links: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links, is_first (doc_id is component_id).

    component_id: the smallest id that is reachable by links. n_links: the documents that the document links with itself;
    null if links is false, which leaves out comparisons that can't change a component.
    Nulls: a null text has no shingles and no links, as an empty one; a row with a null id has no component and no links.
    Repeated rows link with one another. Very long texts: whole. Empty table: empty result. Extra columns are left out.
    """
    rule = Threshold(num, den)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def made(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for part in slices(batches, column, SLICE, SLICE_ROWS):
            yield part, shingle_sets([(t or "").encode() for t in part.column(column).to_pylist()], k)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in made(batches):
            digests = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(map(len, sets), pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64())],
                names=["doc_id", "n_shingles", "d1", "d2"],
            )

    sums = store(rows.mapInArrow(lambda batches: releasing(summaries(batches)), "doc_id long, n_shingles long, d1 long, d2 long"), "shingles")
    classes = sums.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))

    able = store(_able(rows, classes, rule, made, COUNTED * (1 - num / den)), "able")
    able = store(_able(_with_ids(rows, able.select("rep"), able.count()), able, rule, made, 1.0), "able")
    n_able = able.count()
    own_rows = _with_ids(rows, able.select("rep"), n_able)
    repeated = _repeated(own_rows.where(_drawn(SAMPLE, n_able)), made)
    groups = connected_components(_meetings(own_rows, rule, made, *repeated))  # of d1
    members = store(
        able.join(groups.select(F.col("node").alias("d1"), F.col("label").alias("grp")), "d1").select("rep", "copies", "d1", "d2", "grp"), "members"
    )
    members = _parted(rows, members, rule, made)
    found = _search_groups(rows, members, rule, made, links)

    split = found.where("blocks > 1")
    joined = connected_components(split.where("rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b")))
    results = (
        found.groupBy("rep")
        .agg(F.min("label").alias("label"), F.sum("n_links").alias("n_links"))
        .join(joined.select(F.col("node").alias("rep"), F.col("label").alias("joined")), "rep", "left")
        .select("rep", F.coalesce("joined", "label").alias("label"), "n_links")
    )
    labelled = classes.join(results, "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("label", "rep").alias("label"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = sums.select("doc_id", "n_shingles", "d1", "d2").join(labelled, ["d1", "d2", "n_shingles"], "left")
    has = F.col("doc_id").isNotNull()
    component = F.when(has, F.coalesce("label", "doc_id"))
    n_links = F.when(has, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)) if links else F.lit(None).cast("long")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), n_links.alias("n_links"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("is_first"))


#: Batches to pairs of a slice of them and the shingle sets of its texts.
Made = Callable[..., Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]]


def _with_ids(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """rows with the columns of ids where rep is the row's id. n: rows of ids."""
    return rows.join(F.broadcast(ids) if n * ID_BYTES <= MOST_BROADCAST else ids, rows["doc_id"] == ids["rep"])


def _able(rows: DataFrame, classes: DataFrame, rule: Threshold, made: Made, share: float) -> DataFrame:
    """The classes that may link with another one among these rows, by the shingles of this share that they have alone."""
    limit = np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in made(batches):
            own = {digest(s)[0]: s for doc_id, s in zip(part.column(0).to_pylist(), sets) if doc_id is not None and len(s)}
            if not own:
                continue
            low = [s[: np.searchsorted(s, limit, "right")] for s in own.values()]
            name, owner = np.concatenate(low), np.repeat(np.array(list(own)), [len(s) for s in low])
            order = np.argsort(name, kind="stable")
            name, owner = name[order], owner[order]
            # of a shingle with several owners in the slice two are enough
            third = np.zeros(len(name), bool)
            third[2:] = name[2:] == name[:-2]
            yield pa.RecordBatch.from_arrays([pa.array(name[~third].view(np.int64)), pa.array(owner[~third])], names=["shingle", "d1"])

    dealt = rows.mapInArrow(lambda batches: releasing(owners(batches)), "shingle long, d1 long")
    # sorted runs instead of a hash table of all shingles; a class that several tasks gave out counts once
    run = Window.partitionBy("shingle")
    owned = dealt.select("d1", F.row_number().over(run.orderBy("d1")).alias("n"), F.max("d1").over(run).alias("other"))
    alone = owned.where("n = 1 and d1 = other").groupBy("d1").agg(F.count(F.lit(1)).alias("alone"))
    may_lack = F.expr(f"n_shingles - (n_shingles * {rule.num} + {rule.den - 1}) div {rule.den}")
    return classes.join(alone, "d1", "left").where(F.coalesce("alone", F.lit(0)) <= may_lack).drop("alone")


def _drawn(wanted: int, n_rows: int) -> Column:
    """True for about so many rows, by a hash of their id."""
    return F.pmod(F.xxhash64("doc_id", F.lit("shingle order")), F.lit(1 << 30)) < F.lit(int(min(1.0, wanted / max(n_rows, 1)) * (1 << 30)))


def _repeated(rows: DataFrame, made: Made) -> tuple[np.ndarray, np.ndarray]:
    """The REPEATED shingles that most of these rows have, and in how many each is, in ascending order of the shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in made(batches):
            distinct, counts = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(counts.astype(np.int64))], names=["shingle", "n"])

    counts = rows.mapInArrow(lambda batches: releasing(count(batches)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(REPEATED)
    table = counts.toArrow()  # REPEATED rows at most
    shingles = table.column(0).to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], table.column(1).to_numpy()[order]


def _meetings(rows: DataFrame, rule: Threshold, made: Made, repeated: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Edges between classes that have an equal first shingle: of each shingle, its classes in order, each tied to the next.

    A shingle that several classes of a slice give out has a name of the slice's own for each of them, and its own name for
    the first of them. So a shingle of a share of all documents doesn't meet in one task, but once a slice.
    """

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part, sets in made(batches):
            names, owners = [], []
            for doc_id, s in zip(part.column(0).to_pylist(), sets):
                if doc_id is None or not len(s) or (d := digest(s)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(d)
                names.append(rule.prefix(s, repeated, counts))
                owners.append(np.full(len(names[-1]), d[0], np.int64))
            if not any(map(len, names)):
                continue
            name, owner = np.concatenate(names), np.concatenate(owners)
            order = np.lexsort((owner, name))
            name, owner = name[order], owner[order]
            is_first = np.concatenate(([True], name[1:] != name[:-1]))
            several = ~is_first
            several[:-1] |= ~is_first[1:]
            # the slice's own name depends on what is in it alone, so that a task that runs again says the same
            salted = mix(name[several], 77) ^ mix(owner.view(np.uint64).sum(dtype=np.uint64, keepdims=True), 78)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((name[is_first], salted)).view(np.int64)), pa.array(np.concatenate((owner[is_first], owner[several])))], names=["shingle", "d1"]
            )

    dealt = rows.mapInArrow(lambda batches: releasing(firsts(batches)), "shingle long, d1 long")
    run = Window.partitionBy("shingle").orderBy("d1")
    return dealt.select(F.col("d1").alias("a"), F.lag("d1").over(run).alias("b")).where("b is not null and a <> b").distinct()


def _parted(rows: DataFrame, members: DataFrame, rule: Threshold, made: Made) -> DataFrame:
    """members by new groups; classes that meet no other one are left out."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in made(batches):
            right = [(i, s) for i, (s, d) in enumerate(zip(sets, zip(part.column(4).to_pylist(), part.column(5).to_pylist()))) if digest(s) == d]
            if right:
                sizes = [len(s) for _, s in right]
                take = pa.array(np.repeat([i for i, _ in right], sizes))
                wanted = np.repeat([n - rule.least(n) + 1 for n in sizes], sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column(4).take(take), pa.array(np.concatenate([s for _, s in right]).view(np.int64)), pa.array(wanted.astype(np.int32))], names=["d1", "shingle", "wanted"]
                )

    texts = _with_ids(rows, members, members.count()).select("doc_id", "text", "rep", "copies", "d1", "d2")
    every = texts.mapInArrow(lambda batches: releasing(shingles(batches)), "d1 long, shingle long, wanted int")
    counted = every.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("shingle")).cast("int"))
    # a row that repeats gives its shingles again, at the same places
    firsts = counted.withColumn("place", F.dense_rank().over(Window.partitionBy("d1").orderBy("n", "shingle"))).where("place <= wanted and n > 1")
    run = Window.partitionBy("shingle").orderBy("d1")
    ties = firsts.select(F.col("d1").alias("a"), F.lag("d1").over(run).alias("b")).where("b is not null and a <> b").distinct()
    groups = connected_components(ties)
    return store(members.drop("grp").join(groups.select(F.col("node").alias("d1"), F.col("label").alias("grp")), "d1").select(*members.columns), "members")


def _search_groups(rows: DataFrame, members: DataFrame, rule: Threshold, made: Made, links: bool) -> DataFrame:
    """Of each block and pair of blocks of a group: rep, label, n_links, blocks."""
    blocks = members.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    wanted = members.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    texts = _with_ids(rows, wanted, members.count()).select("text", "rep", "copies", "d1", "d2", "grp", "block", "blocks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own_sets in made(batches, 0):
            # rows that share an id: the one whose set is the class's
            right = [digest(s) == d for s, d in zip(own_sets, zip(part.column(3).to_pylist(), part.column(4).to_pylist()))]
            own = [c.filter(pa.array(right, pa.bool_())) for c in (part.column(i) for i in (1, 2, 5, 6, 7))]
            yield pa.RecordBatch.from_arrays([*own, pa.array([s.tobytes() for s, r in zip(own_sets, right) if r], pa.binary())], names=["rep", "copies", "grp", "block", "blocks", "shingles"])

    arrays = texts.mapInArrow(lambda batches: releasing(sets(batches)), "rep long, copies long, grp long, block int, blocks int, shingles binary")
    dealt = arrays.repartition("grp", "block").sortWithinPartitions("grp", "block", "rep")

    def results(found: list[tuple[int, int, int]], n_blocks: int, packed: tuple[int, int, bytes] | None = None) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*((*f, n_blocks, None, None, None) for f in found))]
        if packed:
            columns = [c + [v] for c, v in zip(columns, (None, None, None, n_blocks, *packed))]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["rep", "label", "n_links", "blocks", "grp", "block", "packed"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n_blocks = None, {}, 0

        def close() -> pa.RecordBatch:
            own = list(held.values())
            found = search_rows(own, None, rule, links)
            if n_blocks == 1:
                return results(found, 1)
            label = {rep: low for rep, low, _ in found}
            return results(found, n_blocks, (*key, pack_members([(rep, n, label[rep], s) for rep, n, _, s in own])))

        for batch in batches:
            rep, copies, grp, block, blocks, shingles = (c.to_pylist() for c in batch.columns)
            for i in range(batch.num_rows):
                if (grp[i], block[i]) != key:
                    if held:
                        yield close()
                    key, held, n_blocks = (grp[i], block[i]), {}, blocks[i]
                held[rep[i]] = (rep[i], copies[i], rep[i], np.frombuffer(shingles[i], np.uint64))
        if held:
            yield close()

    schema = "rep long, label long, n_links long, blocks int, grp long, block int, packed binary"
    searched = store(dealt.mapInArrow(lambda batches: releasing(inside(batches)), schema), "blocks")
    own_links = searched.where("packed is null").select("rep", "label", "n_links", "blocks")

    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != F.col("block"))).alias("other")
    pairs = searched.where("packed is not null").select("grp", "block", "blocks", other, "packed")
    pairs = pairs.select("grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "packed")
    pairs = pairs.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high", "block")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, b""
        for batch in batches:
            for *own, packed in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("grp", "low", "high", "packed"))):
                if own != key:
                    key, first = own, packed
                    continue
                low, high = unpack_members(first), unpack_members(packed)
                found = search_rows([*low, *high], [0] * len(low) + [1] * len(high), rule, links)
                found = [f for f in found if f[0] != f[1] or f[2]]
                if found:
                    yield results(found, 2).select(["rep", "label", "n_links", "blocks"])

    between = store(pairs.mapInArrow(lambda batches: releasing(across(batches)), "rep long, label long, n_links long, blocks int"), "links")
    return own_links.unionByName(between)
