"""Prefix trie of conversations, by distributed radix partitioning, finished by multikey quicksort.

Turns are numbered by a dictionary of the different ones. Equal conversations become one class,
which stands for all its copies. Classes are then dealt most significant turn first: each round
splits every open bucket by the next turn's number. A bucket of one class is a chain, emitted
row by row; one of few turns is local and finished in a task by multikey quicksort, whose
recursion emits the nodes; what is larger stays open for the next round. Sums over subtrees
come up from the local buckets through the open ones, level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch, join_spread

LOCAL_TURNS = 1000  # a bucket with more is split by another round
PIECE = 1 << 16  # characters of a class's ids that are joined before they are shuffled
SHARED_TURNS, FAMILY = 6, 100  # a rebuilt conversation begins with fewer turns than that, of its family's first

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_class long, end_n long"


def _positions(batches) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation, and sum their sizes, within a range; rows come in order."""
    task = TaskContext.get()
    part, last, k, total = task.partitionId() if task else 0, None, 0, 0
    for batch in batches:
        conv, size = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        if not len(conv):
            continue
        starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        runs = np.diff(np.append(starts, len(conv)))
        sums = np.cumsum(size)
        before = np.where(starts > 0, sums[starts - 1], 0)
        place = np.arange(1, len(conv) + 1) - np.repeat(starts, runs)
        cum = sums - np.repeat(before, runs)
        if last is not None and conv[0] == last:
            place[: runs[0]] += k
            cum[: runs[0]] += total
        last, k, total = conv[-1], place[-1], cum[-1]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(conv), part, np.int64)), pa.array(place.astype(np.int64)), batch.column(1), batch.column(2), pa.array(cum.astype(np.int64))], ["conv", "part", "k", "id", "size", "cum"])


def number_turns(turns: DataFrame, scratch: Scratch, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """conv, k, id, size, cum: each conversation's turns from 1, their numbers in the dictionary, code points, and running sum of these.

    No conversation is numbered in one task: ranges number their rows, and what a
    conversation has in earlier ranges is added; at most two conversations of a range are cut.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = scratch.keep(turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), name.alias("name"), F.length(text).cast("long").alias("size")), "turns")
    dictionary = scratch.keep(rows.groupBy("name").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    order = ["conv", "turn", "name"]
    ranged = join_spread(rows, dictionary, ["name"], "n").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = scratch.keep(ranged.select("conv", "id", "size").mapInArrow(_positions, "conv long, part long, k long, id long, size long, cum long"), "ordered")
    ends = ordered.groupBy("part").agg(F.min("conv").alias("lo"), F.max("conv").alias("hi"))
    after = Window.orderBy("part")  # one row for each range
    cut = ends.withColumn("next", F.lead("lo").over(after)).where("next = hi").select(F.col("hi").alias("conv")).distinct()
    held = ordered.join(F.broadcast(cut), "conv").groupBy("conv", "part").agg(F.max("k").alias("n"), F.max("cum").alias("sum"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("more"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("more_cum"))
    shifted = ordered.join(F.broadcast(shift), ["conv", "part"], "left")
    return shifted.select("conv", (F.col("k") + F.coalesce("more", F.lit(0))).alias("k"), "id", "size", (F.col("cum") + F.coalesce("more_cum", F.lit(0))).alias("cum"))


def _shared(conv: Column) -> Column:
    """How many turns a rebuilt conversation takes from its family's first."""
    return F.crc32(conv.cast("string").cast("binary")) % SHARED_TURNS


def rebuild(numbered: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their family's first (conv - conv % 100): all ids, and (conv, d, id, size, cum)."""
    few = SHARED_TURNS - 1
    convs = scratch.keep(numbered.groupBy("conv").agg(F.max("k").alias("n"), *(F.max(F.when(F.col("k") == j, F.col("cum"))).alias(f"c{j}") for j in range(1, few + 1))), "conversations")
    base = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.array(F.lit(0).cast("long"), *(f"c{j}" for j in range(1, few + 1))).alias("base_c"))
    own = convs.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).withColumn("h", _shared(F.col("conv")).cast("int")).withColumn("c", F.array(F.lit(0).cast("long"), *(f"c{j}" for j in range(1, few + 1))))
    m = F.least("h", F.coalesce("base_n", F.lit(0))).cast("int")
    plan = own.join(base, "base", "left").withColumn("m", m)
    plan = scratch.keep(plan.select("conv", "base", "n", "m", (F.col("m") - F.col("h")).alias("dk"), (F.coalesce(F.expr("base_c[m]"), F.lit(0)) - F.coalesce(F.expr("c[h]"), F.lit(0))).alias("dcum")), "plan")
    heads = numbered.where(F.col("conv") % FAMILY == 0).where(F.col("k") <= few).withColumnRenamed("conv", "base")
    heads = heads.join(plan.select("base", "conv", "m"), "base").where(F.col("k") <= F.col("m")).select("conv", F.col("k").alias("d"), "id", "size", "cum")
    tails = join_spread(numbered.where(F.col("k") > _shared(F.col("conv"))), plan.select("conv", "n", "dk", "dcum"), ["conv"], "n")
    tails = tails.select("conv", (F.col("k") + F.col("dk")).alias("d"), "id", "size", (F.col("cum") + F.col("dcum")).alias("cum"))
    return plan.select("conv"), scratch.keep(heads.unionByName(tails), "rebuilt")


def _joined_ids(batches) -> Iterator[pa.RecordBatch]:
    """Decimal ids of each class in order, joined by commas, in pieces; rows come ordered by class and id."""
    task = TaskContext.get()
    part, rows, now, held, size = (task.partitionId() if task else 0) << 32, [], None, [], 0

    def done():
        rows.append((now, part + len(rows), ",".join(held)))

    for batch in batches:
        for cls, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (cls != now or size >= PIECE):
                done()
                held, size = [], 0
            now = cls
            held.append(str(conv))
            size += len(held[-1]) + 1
        if len(rows) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["cls", "piece", "ids"])
            part, rows = part + len(rows), []
    if held:
        done()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["cls", "piece", "ids"])


def _hashed_ids(batches) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each class, which come in order."""
    now, state, out = None, None, []
    for batch in batches:
        for cls, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is not None and cls == now:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                out.append((now, state.hexdigest()))
            now, state = cls, hashlib.sha256(ids.encode())
    if state is not None:
        out.append((now, state.hexdigest()))
    cols = list(zip(*out, strict=True)) or [(), ()]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], ["end_class", "sha"])


class Bucket(NamedTuple):
    """Classes that share a node: its parent and depth, then by class id, copies, turn numbers and sizes from the node on."""

    parent: int
    depth: int
    classes: list[tuple[int, int, list[int], list[int]]]


def solve(bucket: Bucket) -> list[list]:
    """Nodes of a bucket as rows of NODES, and whether a node is the bucket's own, by multikey quicksort."""
    nodes: list[list] = []
    above: list[int] = []
    sizes: list[int] = []
    members = [(ids, text, cls, n) for cls, n, ids, text in bucket.classes]

    def emit(group, d, parent):
        """The node after d + 1 of the bucket's turns; what goes on from it."""
        at = len(nodes)
        smallest, n = min(m[2] for m in group), sum(m[3] for m in group)
        end = next((m for m in group if len(m[0]) == d + 1), None)
        nodes.append([smallest, bucket.depth + d, bucket.parent if parent < 0 else nodes[parent][0], n, 0, 0, 0, end and end[2], end and end[3], int(parent < 0)])
        above.append(parent)
        sizes.append(group[0][1][d])
        if parent >= 0:
            nodes[parent][4] += 1
        return at, [m for m in group if len(m[0]) > d + 1]

    todo = [(members, 0, -1)]
    while todo:
        group, d, parent = todo.pop()
        while len(group) == 1:  # a chain
            parent, group = emit(group, d, parent)
            d += 1
        if not group:
            continue
        pivot = group[len(group) // 2][0][d]
        less = [m for m in group if m[0][d] < pivot]
        more = [m for m in group if m[0][d] > pivot]
        if less:
            todo.append((less, d, parent))
        if more:
            todo.append((more, d, parent))
        at, on = emit([m for m in group if m[0][d] == pivot], d, parent)
        todo.append((on, d + 1, at))
    for k in range(len(nodes) - 1, -1, -1):  # children come after their parents
        node = nodes[k]
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * sizes[k]
        if above[k] >= 0:
            nodes[above[k]][5] += node[5]
            nodes[above[k]][6] += node[6]
    return nodes


def _solved(batches) -> Iterator[pa.RecordBatch]:
    """Solve buckets from rows (node, parent, depth, cls, n, d, id, size) ordered by node, class and d."""
    schema = pa.schema([(name, pa.int64()) for name in (*(f.split()[0] for f in NODES.split(", ")), "top")])
    now, bucket, out = None, None, []

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    for batch in batches:
        for node, parent, depth, cls, n, _, turn, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != now:
                if bucket:
                    out += solve(bucket)
                now, bucket = node, Bucket(parent, depth, [])
            if not bucket.classes or bucket.classes[-1][0] != cls:
                bucket.classes.append((cls, n, [], []))
            bucket.classes[-1][2].append(turn)
            bucket.classes[-1][3].append(size)
        if len(out) > 20_000:
            yield table(out)
            out = []
    if bucket:
        out += solve(bucket)
    if out:
        yield table(out)


def build(convs: DataFrame, rows: DataFrame, scratch: Scratch, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """Nodes of the trie of the sequences ``rows`` (conv, d from 1, id, size, cum = sum of sizes up to d) of the conversations ``convs``."""
    signed = rows.groupBy("conv").agg(F.count("*").alias("len"), F.bit_xor(F.xxhash64("d", "id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(7), "d")).alias("y"), F.sum("size").alias("total"))
    signed = scratch.keep(convs.join(signed, "conv", "left").fillna(0), "signed")
    classes = scratch.keep(signed.groupBy("len", "x", "y").agg(F.min("conv").alias("cls"), F.count("*").alias("n"), F.max("total").alias("total")), "classes")
    root = classes.agg(F.min("cls").alias("conv"), F.sum("n").alias("n"), F.min(F.when(F.col("len") == 0, F.struct("cls", "n"))).alias("end")).collect()[0]
    spark = convs.sparkSession
    if root.conv is None:
        return spark.createDataFrame([], NODES)
    chosen = join_spread(rows.withColumnRenamed("conv", "cls"), classes.select("cls", "n", "len", "total", F.col("len").alias("weight")), ["cls"], "weight").where("n is not null")
    rows = scratch.keep(chosen.select(F.lit(root.conv).alias("node"), "cls", "n", "len", "total", "d", "id", "size", "cum"), "chosen")
    first = [(root.conv, 0, None, root.n, 0, root.end and root.end.cls, root.end and root.end.n)]
    opened = [spark.createDataFrame(first, "conv_id long, depth long, parent_conv_id long, n_convs long, size long, end_class long, end_n long")]
    local, chains = [], []
    while True:
        depth = len(opened)
        ahead = rows.where(F.col("d") == depth)
        ended = F.when(F.col("len") == depth, F.struct("cls", "n"))
        kids = ahead.groupBy("node", "id").agg(F.min("cls").alias("kid"), F.sum("n").alias("n_convs"), F.count("*").alias("classes"), F.sum(F.col("len") - depth + 1).alias("turns"), F.max("size").alias("size"), F.max(ended).alias("end"))
        kids = scratch.keep(kids.withColumn("kind", F.when(F.col("classes") == 1, "chain").when(F.col("turns") <= local_turns, "local").otherwise("open")), f"kids{depth}")
        dealt = join_spread(ahead, kids.select("node", "id", "kid", "kind", "classes"), ["node", "id"], "classes")
        dealt = scratch.keep(dealt.select("cls", "kid", "kind", F.col("len").alias("weight")), f"dealt{depth}")
        moved = scratch.keep(join_spread(rows, dealt, ["cls"], "weight"), f"moved{depth}")
        chain = moved.where("kind = 'chain'")
        chains.append(
            chain.select(
                F.col("cls").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == depth, F.col("node")).otherwise(F.col("cls")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                (F.col("d") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * (F.col("total") - F.col("cum") + F.col("size"))).alias("saved_tokens"),
                F.when(F.col("d") == F.col("len"), F.col("cls")).alias("end_class"), F.when(F.col("d") == F.col("len"), F.col("n")).alias("end_n"), (F.col("d") == depth).cast("long").alias("top"),
            )
        )
        local.append(moved.where("kind = 'local'").select(F.col("kid").alias("node"), F.col("node").alias("parent"), F.lit(depth).cast("long").alias("depth"), "cls", "n", "d", "id", "size"))
        larger = kids.where("kind = 'open'")
        if not larger.head(1):
            break
        opened.append(larger.select(F.col("kid").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent_conv_id"), "n_convs", "size", F.col("end.cls").alias("end_class"), F.col("end.n").alias("end_n")))
        rows = moved.where((F.col("kind") == "open") & (F.col("d") > depth)).select(F.col("kid").alias("node"), "cls", "n", "len", "total", "d", "id", "size", "cum")
    buckets = reduce(DataFrame.unionByName, local).repartition("node").sortWithinPartitions("node", "cls", "d")
    solved = scratch.keep(buckets.mapInArrow(_solved, NODES + ", top long"), "solved")
    below = reduce(DataFrame.unionByName, chains, solved)
    tops = below.where("top = 1").select("parent_conv_id", "depth", "n_leaves", "saved_tokens")
    out, up = below.drop("top"), None
    for level in range(len(opened) - 1, -1, -1):
        children = tops.where(F.col("depth") == level + 1)
        if up is not None:
            children = children.unionByName(up.select(children.columns))
        sums = children.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        up = opened[level].join(sums, "conv_id", "left")
        none = F.lit(0).cast("long")
        up = scratch.keep(
            up.select(
                "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("kids", none).alias("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
                ((F.col("n_convs") - 1) * F.col("size") + F.coalesce("saved", none)).alias("saved_tokens"), "end_class", "end_n",
            ), f"open{level}",
        )
        out = out.unionByName(up)
    return _with_ends(out, signed, classes)


def _with_ends(nodes: DataFrame, signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Put the hash of a class's ids in place of the class. Ids of a class are joined range by range, then hashed in order as a stream."""
    keys = ["len", "x", "y"]
    members = join_spread(signed.select(*keys, "conv"), classes.where("n > 1").select(*keys, "cls", "n"), keys, "n").where("cls is not null").select("cls", "conv")
    pieces = members.repartitionByRange("cls", "conv").sortWithinPartitions("cls", "conv").mapInArrow(_joined_ids, "cls long, piece long, ids string")
    hashed = pieces.repartition("cls").sortWithinPartitions("cls", "piece").select("cls", "ids").mapInArrow(_hashed_ids, "end_class long, sha string")
    columns = [f.split()[0] for f in NODES.split(", ")[:7]]
    many = nodes.where("end_n > 1").join(hashed, "end_class").select(*columns, F.col("sha").alias("ends_sha256"))
    few = nodes.where("end_n is null or end_n = 1").select(*columns, F.sha2(F.coalesce(F.col("end_class").cast("string"), F.lit("")), 256).alias("ends_sha256"))
    return few.unionByName(many)


def prefix_trie(turns: DataFrame, shared: bool = True, id_col: str = "conv_id", turn_col: str = "turn", local_turns: int = LOCAL_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.

    Turns go by ``turn`` (nulls first), ties by the SHA-256 of role and text; null roles and
    texts are empty; repeated rows are turns of their own. With ``shared``, conversations are
    first rebuilt on their families' first turns. Rows without an id belong to no
    conversation; without conversations there are no nodes. Turns of any length are one
    number. A round is needed for each turn that more than ``local_turns`` turns of different
    conversations share; copies, and long conversations without relatives, need none. Ids are whole numbers.
    Other columns are ignored.
    """
    scratch = Scratch(turns.sparkSession)
    numbered = number_turns(turns, scratch, id_col, turn_col)
    if shared:
        convs, rows = rebuild(scratch.keep(numbered, "numbered"), scratch)
    else:
        rows = scratch.keep(numbered.withColumnRenamed("k", "d"), "numbered")
        convs = rows.select("conv").distinct()
    return build(convs, rows, scratch, local_turns)
