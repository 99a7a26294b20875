"""Links between sets that share keys, and their connected components, with no all-pairs step inside a large list.

A posting is (key, id, n) or (key, id, n, many): a set of n members has the key, and occurs `many` times. Sets that can be similar share `least` keys. list_pairs()
walks each list in the order of n: a list of up to SMALL_LIST sets gives all its pairs of fitting sizes; a longer one gives the
pairs of neighbours, and its postings are kept. Pairs that come `least` times are verified, and give the first components; neighbours
of near sizes join most of a group of near copies. Then, in STAR_ROUNDS rounds, the sets outside the largest component of a long
list are compared with a leader, the set with the most long lists: first of that component, then of those outside. Last,
cross_links() compares, in the lists that still hold several components, all sets of different components, so no link that
joins two components is lost: what is skipped lies inside one component. It does so block against block within tasks and
gives only links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, checkpoint, remove_folder, stage_folder, stored
from .wordhash import mix

SMALL_LIST = 24
STAR_ROUNDS = 2
BLOCK = 256
#: Edges (16 bytes each) that one task may hold.
FEW_EDGES = 50_000
#: Lists (some 50 bytes each) whose leaders are broadcast.
FEW_LISTS = 100_000
#: Bits of a bitmap: from 8 kB up to 32 MB, by what it holds.
LEAST_BITS = 1 << 16
MOST_BITS = 1 << 28
#: Bits of each value where few may be let through by mistake: one in 400 or fewer, up to MOST_BITS.
CLOSE = 4


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of edges (a, b): the smallest id reachable.

    Edges that are counted to be at most FEW_EDGES are united by one task, without a shuffle; others by alternating the
    large and the small star.
    """
    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = _state(e)
    if seen[0] <= FEW_EDGES:
        return e.coalesce(1).mapInArrow(_united, "id bigint, component bigint")
    pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    while True:
        both = e.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("x")).select("x.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("x")).select("x.*")
        e = checkpoint(small.where("u <> v").distinct())
        now = _state(e)
        if now == seen:
            break
        seen = now
    centres = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres)


def _united(batches) -> Iterator[pa.RecordBatch]:
    """Ids and the smallest id of their component, from edges that fit one task."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = above
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = top(u), top(v)
            up[max(a, b)] = min(a, b)
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], ["id", "component"])


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_033)).first())


def list_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(key, a, b, n): pairs a < b of short lists and neighbours in long ones, with a null key; postings (key, a, n) of long lists, with b
    null; and a = b, with a null key, for a set that occurs several times.

    Sizes fit when the smaller is at least percent/100 of the larger. Memory is bounded by SMALL_LIST and one batch.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []  # sets of the open list while it may be short
        state = {"key": None, "long": False, "last": None}
        pairs: list[tuple[int, int]] = []
        kept: list[tuple[int, int, int]] = []

        def close() -> None:
            for i, (x, n) in enumerate(held):
                for y, m in held[i + 1 :]:
                    if 100 * n < percent * m:
                        break
                    pairs.append((min(x, y), max(x, y)))
            held.clear()

        def beside(left: tuple[int, int], right: tuple[int, int]) -> None:
            if 100 * left[1] >= percent * right[1]:
                pairs.append((min(left[0], right[0]), max(left[0], right[0])))

        def flush() -> Iterator[pa.RecordBatch]:
            if pairs or kept:
                a = [p[0] for p in pairs] + [x for _, x, _ in kept]
                b = [p[1] for p in pairs] + [None] * len(kept)
                key, n = [None] * len(pairs) + [k for k, _, _ in kept], [None] * len(pairs) + [m for *_, m in kept]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, a, b, n)], ["key", "a", "b", "n"])
                pairs.clear()
                kept.clear()

        def take(rows: list[np.ndarray]) -> None:
            key, ids, n, many = rows
            pairs.extend((x, x) for x in ids[many > 1].tolist())
            # lists of one set, wholly inside the batch, have no pairs
            same = key[1:] == key[:-1]
            keep = np.append(False, same) | np.append(same, False)
            keep[[0, -1]] = True
            for k, x, m in zip(key[keep].tolist(), ids[keep].tolist(), n[keep].tolist(), strict=True):
                if k != state["key"]:
                    close()
                    state.update(key=k, long=False)
                if state["long"]:
                    beside(state["last"], (x, m))
                    state["last"] = (x, m)
                    kept.append((k, x, m))
                    continue
                held.append((x, m))
                if len(held) > SMALL_LIST:
                    state.update(long=True, last=held[-1])
                    for left, right in zip(held[:-1], held[1:], strict=True):
                        beside(left, right)
                    kept.extend((k, y, o) for y, o in held)
                    held.clear()

        wait = None  # the last set, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = rows if wait is None else [np.append(x, y) for x, y in zip(wait, rows, strict=True)]
            new = np.flatnonzero(np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))
            rows = [*[c[new] for c in rows[:3]], np.add.reduceat(rows[3], new)]
            wait = [c[-1:] for c in rows]
            if len(new) > 1:
                take([c[:-1] for c in rows])
            yield from flush()
        if wait is not None:
            take(wait)
        close()
        yield from flush()

    many = F.col("many") if "many" in postings.columns else F.lit(1).cast("bigint")
    ordered = postings.select("key", "id", "n", many.alias("many")).repartition("key").sortWithinPartitions("key", "n", "id")
    return ordered.mapInArrow(run, "key bigint, a bigint, b bigint, n bigint")


def known_lists(held: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, n, degree, component) of the long lists (id, n, keys); degree is how many of them have the set."""
    known = held.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return known.select("id", "n", "component", F.size("keys").alias("degree"), F.explode("keys").alias("key"))


def mixed_lists(known: DataFrame) -> DataFrame:
    """(key, major, lead) of lists with several components: the largest one, and its set with the most long lists."""
    lead = F.max_by(F.struct("id", "n", "component"), F.struct("degree", "id")).alias("lead")
    per = known.groupBy("key", "component").agg(F.count("*").alias("many"), lead)
    size = F.struct("many", "component")
    lists = per.groupBy("key").agg(F.max_by("component", size).alias("major"), F.max_by("lead", size).alias("lead"), F.count("*").alias("parts"))
    return lists.where("parts > 1").drop("parts")


def outsiders(known: DataFrame, lists: DataFrame) -> DataFrame:
    """known postings of mixed lists that are not of the list's largest component, with its lead."""
    return known.join(_few(lists), "key").where("component <> major")


def _few(lists: DataFrame) -> DataFrame:
    """Broadcast a row for each list only when counted to be few, so that a long list is not gathered in one task; beyond that
    Spark picks a shuffled join and divides skewed keys."""
    return F.broadcast(lists) if lists.limit(FEW_LISTS + 1).count() <= FEW_LISTS else lists


def _fits(percent: int) -> Column:
    return 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")


def _tallied(met: DataFrame) -> DataFrame:
    pairs = met.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("times"))


def star_pairs(outside: DataFrame, percent: int, own: bool) -> DataFrame:
    """(a, b, times) of each list's leader and its sets outside the largest component; own: with a leader from outside."""
    if own:
        leaders = outside.groupBy("key").agg(F.max_by(F.struct("id", "n", "component"), F.struct("degree", "id")).alias("lead"))
        outside = outside.drop("lead").join(_few(leaders), "key")
    return _tallied(outside.where(_fits(percent) & (F.col("component") != F.col("lead.component"))))


def _with_keys(held: DataFrame, lists: DataFrame) -> DataFrame:
    """(id, keys): the sets of the lists, with the keys among theirs that a bitmap of the lists lets through."""
    shared = held.sparkSession.sparkContext.broadcast(bloom(lists, "key"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            size = np.diff(batch.column(1).offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            keep = let_through(shared.value, value)
            left = np.bincount(row[keep], minlength=len(size))
            some = np.flatnonzero(left)
            offsets = pa.array(np.append(0, np.cumsum(left[some])), pa.int32())
            keys = pa.ListArray.from_arrays(offsets, pa.array(value[keep], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), keys], ["id", "keys"])

    return held.select("id", "keys").mapInArrow(run, "id bigint, keys array<bigint>")


def cross_links(held: DataFrame, labels: DataFrame, lists: DataFrame, outside: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(a, b): links that join components within a list, enough of them to join all that can be.

    Lists that share sets make a cloud. In a cloud, the sets outside some list's largest component meet all sets, block by
    block: a task has two blocks of about BLOCK sets and counts common members by a product of matrices. Only the links that
    join components within the task leave it.
    """
    near = checkpoint(_with_keys(held, lists))
    first = F.col("keys")[0]
    steps = F.transform(F.slice("keys", F.lit(2), F.size("keys")), lambda k: F.struct(first.alias("a"), k.alias("b")))
    clouds = components(near.select(F.explode(steps).alias("x")).select("x.*").distinct())
    sets = near.select("id", first.alias("key")).join(clouds.select(F.col("id").alias("key"), F.col("component").alias("cloud")), "key", "left")
    sets = sets.select("id", F.coalesce("cloud", "key").alias("cloud")).join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    minor = outside.select("id").distinct().withColumn("minor", F.lit(True))
    sets = checkpoint(sets.join(minor, "id", "left").withColumn("minor", F.coalesce("minor", F.lit(False))))
    sizes = sets.groupBy("cloud").agg(F.ceil(F.count("*") / BLOCK).alias("rights"), F.ceil(F.count_if("minor") / BLOCK).alias("lefts"))
    placed = sets.join(sizes, "cloud").withColumn("spot", F.xxhash64("id"))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = placed.where("minor AND lefts > 0").select("id", "component", "cloud", F.lit(True).alias("left"), F.pmod("spot", "lefts").cast("int").alias("i"), to("rights").alias("j"))
    right = placed.where("lefts > 0").select("id", "component", "cloud", F.lit(False).alias("left"), to("lefts").alias("i"), F.pmod("spot", "rights").cast("int").alias("j"))
    rows = left.unionByName(right).join(sets_of(sets.select("id")), "id")

    def meet(block: pa.Table) -> pa.Table:
        x, y = block.filter(block["left"]), block.filter(pc.invert(block["left"]))
        common, n, m = _common(x["members"].to_pylist(), y["members"].to_pylist())
        good = 100 * common >= percent * (n[:, None] + m[None, :] - common)
        up: dict[int, int] = {}

        def top(c: int) -> int:
            while (above := up.get(c, c)) != c:
                c = above
            return c

        out = []
        ids, others = x["id"].to_pylist(), y["id"].to_pylist()
        mine, theirs = x["component"].to_pylist(), y["component"].to_pylist()
        good &= np.array(mine)[:, None] != np.array(theirs)[None, :] if len(x) and len(y) else good
        for i, j in zip(*np.nonzero(good), strict=True):
            a, b = top(mine[i]), top(theirs[j])
            if a != b:
                up[a] = b
                out.append((ids[i], others[j]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("cloud", "i", "j").applyInArrow(meet, "a bigint, b bigint")


def _common(left: list[bytes], right: list[bytes], columns: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common members of each set on the left and each on the right, and the sizes of both; dense in `columns` members at a time."""
    sets = [np.frombuffer(s, np.uint64) for s in left + right]
    sizes = np.array([len(s) for s in sets], np.int64)
    if not left or not right:
        return np.zeros((len(left), len(right)), np.int64), sizes[: len(left)], sizes[len(left) :]
    row = np.repeat(np.arange(len(sets)), sizes)
    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = often[place] > 1
    row = row[keep]
    _, place = np.unique(place[keep], return_inverse=True)
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        a, b = np.searchsorted(place, [lo, lo + columns])
        dense = np.zeros((len(sets), columns), np.float32)
        dense[row[a:b], place[a:b] - lo] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return np.rint(out).astype(np.int64), sizes[: len(left)], sizes[len(left) :]


def _spots(values: np.ndarray, bits: int, probe: int = 0) -> np.ndarray:
    return (mix(values.view(np.uint64), 3 + probe) & np.uint64(bits - 1)).astype(np.int64)


def bloom(ids: DataFrame, column: str = "id", most_bits: int = MOST_BITS, probes: int = 1) -> np.ndarray:
    """A bitmap of hashed 64-bit values; it lets all of them through and few others. Its size follows their counted number,
    16 bits each, up to a fixed size; beyond that it lets more through, which costs time and no result. Each value sets `probes` bits."""
    values = ids.select(F.col(column).cast("bigint").alias("x")).where("x IS NOT NULL")
    bits = min(max(1 << int(16 * max(values.count(), 1) - 1).bit_length(), LEAST_BITS), most_bits)

    def place(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(0).to_numpy(zero_copy_only=False)
            spot = np.unique(np.concatenate([_spots(value, bits, p) for p in range(probes)]))
            yield pa.RecordBatch.from_arrays([pa.array((spot >> 15).astype(np.int32)), pa.array(spot & 32767)], ["at", "bit"])

    rows = values.mapInArrow(place, "at int, bit bigint").groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["at"] * 4096 : (r["at"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def let_through(bitmap: np.ndarray, values: np.ndarray, probes: int = 1) -> np.ndarray:
    """Which 64-bit values the bitmap, made with as many probes, has."""
    through = np.ones(len(values), bool)
    for p in range(probes):
        spots = _spots(values, 8 * len(bitmap), p)
        through &= (bitmap[spots >> 3] >> (spots & 7)) & 1 > 0
    return through


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (id, members as sorted 64-bit integers) have 100 * common >= percent * union."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = batch.columns
            good = []
            for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)  # binary probes of the short set in the long one
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good)], ["a", "b"])

    first = sets.select(F.col("id").alias("a"), F.col("members").alias("left"))
    second = sets.select(F.col("id").alias("b"), F.col("members").alias("right"))
    met = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "left", "right")
    return met.mapInArrow(run, "a bigint, b bigint")


def link(postings: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, least: int = 1, repeats: bool = False) -> DataFrame:
    """(id, component) of every set with a link, and, where asked for, of those that occur several times.

    sets_of(ids) gives (id, members) of at least the ids asked for.
    """
    folder = stage_folder(postings.sparkSession)
    found = stored(list_pairs(postings, percent), folder)
    met = checkpoint(found.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("times")))
    short = met.where("a <> b")
    labels = checkpoint(components(_verified(short.where(F.col("times") >= least), sets_of, percent)))
    kept = found.where("b IS NULL").select("key", F.col("a").alias("id"), "n")
    held = checkpoint(kept.groupBy("id").agg(F.first("n").alias("n"), F.collect_list("key").alias("keys")))
    remove_folder(postings.sparkSession, folder)
    done = short.where(F.col("times") >= least).select("a", "b")
    for turn in range(0 if held.isEmpty() else STAR_ROUNDS + 1):
        known = known_lists(held, labels)
        lists = checkpoint(mixed_lists(known))
        if lists.isEmpty():
            break
        outside = checkpoint(outsiders(known, lists))
        if turn < STAR_ROUNDS:
            pairs = star_pairs(outside, percent, own=turn > 0).where(F.col("times") >= least).select("a", "b")
            pairs = checkpoint(pairs.join(done, ["a", "b"], "left_anti"))
            done = done.unionByName(pairs)
            fresh = _verified(pairs, sets_of, percent)
        else:
            with arrow_rows(held.sparkSession, 2_000):
                fresh = checkpoint(cross_links(held, labels, lists, outside, sets_of, percent))
        if not fresh.isEmpty():
            labels = checkpoint(components(fresh.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b")))))
    if repeats:
        alone = met.where("a = b").select(F.col("a").alias("id")).join(labels, "id", "left_anti")
        return labels.unionByName(alone.withColumn("component", F.col("id")))
    return labels


def _verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    pairs = checkpoint(pairs)
    if pairs.isEmpty():
        return pairs.select("a", "b")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = sets_of(ids)
    with arrow_rows(pairs.sparkSession, 500):
        return checkpoint(verify(pairs, sets, percent))
