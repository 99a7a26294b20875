"""A trie of conversations: which ones begin alike, and what could be saved if each shared beginning were read once.

A node is a distinct sequence of first turns, named by two 64-bit sums over hashed turns, each times a power of an odd base. Such sums
of a part of a conversation can be moved to another place, so turns are dealt out by ranges of (conversation, place), sums run within
a range, and what a range hands on is a row of figures: a conversation of any length takes part in as many tasks as it has rows for.

Parent edges come from the digests. Counts of leaves and savings then reach all ancestors by pointer jumping: in round k each node sends what
it has gathered from below to its ancestor 2^k above, and takes that ancestor's own pointer. After log2(depth) rounds all is summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, remove_folder, stage_folder, stored

#: A rebuilt conversation takes fewer than so many turns from another one.
HEADS = 6
FAMILY = 100
#: Ids to a row when ids are joined to one text.
CHUNK = 4096
#: Characters of a text that order turns of equal number and role, before its hash does.
TIE = 32
EMPTY = hashlib.sha256(b"").hexdigest()

_BASES = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)
_TURNS = "part int, conv_id bigint, place bigint, before1 bigint, before2 bigint, after1 bigint, after2 bigint, chars bigint"


def _power(place: int) -> np.ndarray:
    """The bases to the power of place, which may be negative."""
    return np.array([pow(int(b), place, 1 << 64) for b in _BASES], np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _running(batches) -> Iterator[pa.RecordBatch]:
    """Places and sums before and after each turn, counted from the first turn of a conversation in this range."""
    part = TaskContext.get().partitionId()
    last, place, total = None, 0, np.zeros(2, np.uint64)
    with np.errstate(over="ignore"):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column(0).to_numpy()
            mark = batch.column(1)
            value = np.frombuffer(mark.buffers()[2], np.uint8)[np.frombuffer(mark.buffers()[1], np.int32)[mark.offset] :][: 16 * n].view("<u8").reshape(n, 2)
            new = np.append(True, conv[1:] != conv[:-1])
            begin = np.flatnonzero(new)
            own = np.arange(n) - begin[np.cumsum(new) - 1]
            powers = np.ones((int(own.max()) + 1, 2), np.uint64)
            powers[1:] = _BASES
            term = value * np.cumprod(powers, axis=0)[own] * _BASES
            going = conv == last if last is not None else np.zeros(n, bool)
            if going[0]:
                term[going] *= _power(place)
            sums = np.cumsum(term, axis=0, dtype=np.uint64)
            after = sums - (sums - term)[begin][np.cumsum(new) - 1]
            at = own + 1
            if going[0]:
                after[going] += total
                at[going] += place
            before = after - term
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), batch.column(0), pa.array(at), *(_signed(x[:, i]) for x in (before, after) for i in (0, 1)), batch.column(2)],
                ["part", "conv_id", "place", "before1", "before2", "after1", "after2", "chars"],
            )
            last, place, total = int(conv[-1]), int(at[-1]), after[-1].copy()


def _carries(turns: DataFrame) -> dict[int, tuple[int, int, np.ndarray]]:
    """By range: the conversation that goes on from the range before, its turns so far and their sums. A row for each range is read."""
    unsigned = lambda r: np.array([r["after1"] % (1 << 64), r["after2"] % (1 << 64)], np.uint64)
    edges = turns.groupBy("part").agg(
        F.min(F.struct("conv_id", (-F.col("place")).alias("place"), "after1", "after2")).alias("first"), F.max(F.struct("conv_id", "place", "after1", "after2")).alias("last")
    )
    found, conv, place, total = {}, None, 0, np.zeros(2, np.uint64)
    with np.errstate(over="ignore"):
        for r in sorted(edges.collect(), key=lambda r: r["part"]):
            first, last = r["first"], r["last"]
            if first["conv_id"] == conv:
                found[r["part"]] = (conv, place, total)
            if first["conv_id"] == conv == last["conv_id"]:
                place, total = place - first["place"], total + unsigned(first) * _power(place)
            else:
                conv, place, total = last["conv_id"], last["place"], unsigned(last)
    return found


def numbered(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, before1, before2, after1, after2, chars): each turn's place from 1, the digest of the turns before it and of
    those up to it, and its code points.

    Turns go by number (null first), then role, then the first TIE characters of the text, then its hash; equal rows are turns of
    their own. A null role or text is empty; rows without a conv_id are left out.
    """
    rows = only(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id IS NOT NULL")
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    mark = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows = rows.select("conv_id", "turn", "role", F.substring("text", 1, TIE).alias("tie"), mark.alias("mark"), F.length("text").cast("bigint").alias("chars"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartitionByRange(parts, "conv_id", "turn", "role", "tie").sortWithinPartitions("conv_id", "turn", "role", "tie", "mark")
    turns = stored(dealt.select("conv_id", "mark", "chars").mapInArrow(_running, _TURNS))
    carries = _carries(turns)
    if not carries:
        return turns.drop("part")

    def move_on(batches) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                part, conv, place = (batch.column(i).to_numpy() for i in range(3))
                place = place.copy()
                sums = [np.stack([batch.column(i).to_numpy().view(np.uint64), batch.column(i + 1).to_numpy().view(np.uint64)], axis=1) for i in (3, 5)]
                for p in np.unique(part):
                    if int(p) in carries:
                        going, done, total = carries[int(p)]
                        rows = (part == p) & (conv == going)
                        place[rows] += done
                        for s in sums:
                            s[rows] = s[rows] * _power(done) + total
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(place), *(_signed(s[:, i]) for s in sums for i in (0, 1)), batch.column(7)], batch.schema.names
                )

    return turns.mapInArrow(move_on, _TURNS).drop("part")


def _digest(one: str, two: str) -> F.Column:
    return F.struct(F.col(one).alias("d1"), F.col(two).alias("d2"))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n, end, head) of numbered turns: how many there are, the digest of all and of the first ones."""
    first = F.when(F.col("place") < HEADS, F.struct("place", _digest("after1", "after2").alias("d"), "chars"))
    return turns.groupBy("conv_id").agg(
        F.max("place").alias("n"), F.max_by(_digest("after1", "after2"), "place").alias("end"), F.array_sort(F.collect_list(first)).alias("head")
    )


def _moved(batches) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, node1, node2, parent1, parent2, chars) from (conv_id, place, h, took, up1, up2, own1, own2, before..., after..., chars)."""
    with np.errstate(over="ignore"):
        for batch in batches:
            conv, place, h, took = (batch.column(i).to_numpy() for i in range(4))
            up, own, before, after = (np.stack([batch.column(i).to_numpy().view(np.uint64), batch.column(i + 1).to_numpy().view(np.uint64)], axis=1) for i in (4, 6, 8, 10))
            back = np.stack([_power(took_less) for took_less in range(0, -HEADS, -1)])[h - took]
            node, parent = up + (after - own) * back, up + (before - own) * back
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(took + place - h), *(_signed(x[:, i]) for x in (node, parent) for i in (0, 1)), batch.column(12)],
                ["conv_id", "depth", "node1", "node2", "parent1", "parent2", "chars"],
            )


_ROWS = "conv_id bigint, depth bigint, node1 bigint, node2 bigint, parent1 bigint, parent2 bigint, chars bigint"


def plain_paths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, ends) of conversations as they are; see rebuilt()."""
    rows = turns.selectExpr("conv_id", "place AS depth", "after1 AS node1", "after2 AS node2", "before1 AS parent1", "before2 AS parent2", "chars")
    return rows, conversations(turns).select("conv_id", "end.*")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, ends) of conversations whose first h = crc32(id) % 6 turns are replaced by those of the first conversation of their hundred.

    rows: (conv_id, depth, node1, node2, parent1, parent2, chars), one for each turn; ends: (conv_id, d1, d2), the node where each one ends.
    """
    whole = stored(conversations(turns))
    root = F.struct(F.lit(0).cast("bigint").alias("d1"), F.lit(0).cast("bigint").alias("d2"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    mine = whole.select("conv_id", "n", "end", "head", h.cast("bigint").alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    others = whole.select(F.col("conv_id").alias("base"), F.col("head").alias("lent"))
    none = F.filter("head", lambda x: F.lit(False))
    taken = mine.join(others, "base", "left").withColumn("taken", F.coalesce(F.filter("lent", lambda x: x["place"] <= F.col("h")), none))
    taken = taken.withColumn("took", F.size("taken").cast("bigint"))
    taken = taken.withColumn("up", F.when(F.col("took") > 0, F.element_at("taken", F.greatest("took", F.lit(1)).cast("int"))["d"]).otherwise(root))
    cut = F.least("h", "n")
    plan = stored(taken.withColumn("own", F.when(cut > 0, F.element_at("head", F.greatest(cut, F.lit(1)).cast("int"))["d"]).otherwise(root)).select("conv_id", "n", "h", "took", "taken", "up", "own", "end"))
    columns = ["h", "took", "up1", "up2", "own1", "own2"]
    flat = plan.selectExpr("conv_id", "n", "h", "took", "up.d1 AS up1", "up.d2 AS up2", "own.d1 AS own1", "own.d2 AS own2", "end.d1 AS end1", "end.d2 AS end2")
    later = turns.join(flat.select("conv_id", *columns), "conv_id").where("place > h")
    later = later.select("conv_id", "place", *columns, "before1", "before2", "after1", "after2", "chars").mapInArrow(_moved, _ROWS)
    # the node above a taken turn is the taken turn before it
    above = F.transform("taken", lambda x, i: F.struct(x["place"].alias("depth"), x["d"].alias("node"), F.when(i > 0, F.get("taken", i - 1)["d"]).otherwise(root).alias("parent"), x["chars"].alias("chars")))
    early = plan.select("conv_id", F.explode(above).alias("x"))
    early = early.selectExpr("conv_id", "x.depth", "x.node.d1 AS node1", "x.node.d2 AS node2", "x.parent.d1 AS parent1", "x.parent.d2 AS parent2", "x.chars")
    last = flat.where("n > h").select("conv_id", F.col("n").alias("place"), *columns, "end1", "end2", "end1", "end2", F.lit(0).cast("bigint").alias("chars"))
    ends = last.mapInArrow(_moved, _ROWS).selectExpr("conv_id", "node1 AS d1", "node2 AS d2")
    ends = ends.unionByName(flat.where("n <= h").selectExpr("conv_id", "up1 AS d1", "up2 AS d2"))
    return later.unionByName(early), ends


def _chunks(batches) -> Iterator[pa.RecordBatch]:
    """Sorted (d1, d2, conv_id) as rows of up to CHUNK ids that end at one node: (d1, d2, conv_id of the first, ids joined)."""
    key, ids, rows = None, [], []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"d1": [r[0] for r in rows], "d2": [r[1] for r in rows], "conv_id": [r[2] for r in rows], "ids": [r[3] for r in rows]}, pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("conv_id", pa.int64()), ("ids", pa.string())]))
        rows.clear()
        return out

    for batch in batches:
        for d1, d2, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (d1, d2) != key or len(ids) == CHUNK:
                if ids:
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = (d1, d2), []
            ids.append(c)
        if rows:
            yield flush()
    if ids:
        rows.append((*key, ids[0], ",".join(map(str, ids))))
        yield flush()


def _hashed(batches) -> Iterator[pa.RecordBatch]:
    """(d1, d2, ends_sha256) of sorted chunks; the hash runs on from chunk to chunk, so no long text is put together."""
    key, state, rows = None, None, []
    for batch in batches:
        for d1, d2, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (d1, d2) == key:
                state.update(b",")
            else:
                if key:
                    rows.append((*key, state.hexdigest()))
                key, state = (d1, d2), hashlib.sha256()
            state.update(ids.encode())
        if rows:
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(("d1", "d2", "ends_sha256"))})
            rows = []
    if key:
        yield pa.RecordBatch.from_pydict({"d1": [key[0]], "d2": [key[1]], "ends_sha256": [state.hexdigest()]})


def end_hashes(ends: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256): the SHA-256 of the ascending decimal ids that end at each node, comma-joined."""
    parts = max(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # ranges split a node where very many end; then a row holds up to CHUNK ids
    dealt = ends.select("d1", "d2", "conv_id").repartitionByRange(parts, "d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id")
    chunks = dealt.mapInArrow(_chunks, "d1 bigint, d2 bigint, conv_id bigint, ids string")
    return chunks.repartition(parts, "d1", "d2").sortWithinPartitions("d1", "d2", "conv_id").mapInArrow(_hashed, "d1 bigint, d2 bigint, ends_sha256 string")


def nodes(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, d1, d2, conv_id, depth, parent_id, parent_conv_id, n_convs, n_children, chars) of the trie that rows make, stored."""
    found = rows.groupBy(F.col("node1").alias("d1"), F.col("node2").alias("d2")).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("depth", "parent1", "parent2", "chars")]
    )
    zero = lambda c: F.lit(0).cast("bigint").alias(c)
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero("d1"), zero("d2"), "conv_id", "n_convs", zero("depth"), F.lit(None).cast("bigint").alias("parent1"), F.lit(None).cast("bigint").alias("parent2"), zero("chars"))
    every = stored(found.unionByName(root).withColumn("id", F.monotonically_increasing_id()))
    top = every.where("depth = 0").select("id", "conv_id").first()  # one row
    if top is None:
        return stored(every.selectExpr("id", "d1", "d2", "conv_id", "depth", "id AS parent_id", "conv_id AS parent_conv_id", "n_convs", "n_convs AS n_children", "chars"))
    up = every.selectExpr("d1 AS parent1", "d2 AS parent2", "id AS parent_id", "conv_id AS parent_conv_id")
    near = every.where("depth <= 1").withColumn("parent_id", F.when(F.col("depth") == 1, F.lit(top["id"]))).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top["conv_id"])))
    linked = stored(every.where("depth > 1").join(up, ["parent1", "parent2"]).unionByName(near).drop("parent1", "parent2"))
    children = linked.where("depth > 0").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    return stored(linked.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))))


def rolled_up(tree: DataFrame) -> DataFrame:
    """(id, n_leaves, saved_tokens) of every node, summed over its subtree by pointer jumping."""
    spark = tree.sparkSession
    own = tree.select(
        "id", "depth", F.col("parent_id").alias("up"), (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
    )
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")]
    parts = [own.select("id", "n_leaves", "saved_tokens")]
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    state, path, step = own.where("depth >= 1"), None, 1
    while step <= deepest:
        sent = stored(state.groupBy(F.col("up").alias("id")).agg(*sums))
        parts.append(sent)
        if 2 * step <= deepest:
            further = state.where(F.col("depth") >= 2 * step)
            got = sent.select("id", F.col("n_leaves").alias("more"), F.col("saved_tokens").alias("further"))
            jump = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
            state = further.join(got, "id", "left").join(jump, "up").select(
                "id", "depth", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("more", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("further", F.lit(0))).alias("saved_tokens")
            )
            old, path = path, stage_folder(spark)
            state = stored(state, path)
            if old:
                remove_folder(spark, old)
        step *= 2
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    total = stored(total.groupBy("id").agg(*sums))
    if path:
        remove_folder(spark, path)
    return total


def trie(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node.

    A node's conv_id is its smallest member; a subtree includes its top. No conversations, no rows. Equal conversations end at
    one node; a conversation without turns ends at the root.
    """
    ends = stored(ends)
    tree = nodes(rows, ends)
    out = tree.join(rolled_up(tree), "id").join(end_hashes(ends), ["d1", "d2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def prefix_trie(df: DataFrame, rebuild: bool = False, **columns: str) -> DataFrame:
    """The trie of a table of turns; with rebuild, of conversations that take their first turns from another one. See numbered() and trie()."""
    turns = numbered(df, **columns)
    return trie(*(rebuilt(turns) if rebuild else plain_paths(turns)))
