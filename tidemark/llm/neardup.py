"""Near-duplicate documents by SetSketch registers.

A document's shingle set is summarised by registers of exponentially spaced, truncated
minima. Sketches of a union are register-wise maxima, and equal registers are as likely
as shared elements. Bands of registers propose pairs, a joint maximum-likelihood estimate
of the similarity drops those far below the threshold, and the rest are verified on the
full sets, word for word. Equal sets (by the sums of two independent 64-bit lanes) are one
class before anything is compared; in a bucket of many classes each is first compared with
one hub, and only classes that then remain in different components are compared with each
other, in blocks that registers thin out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textcore as tc
from tidemark.llm.shared import Scratch, join_spread

REGISTERS = 163  # prime, so that any step visits all of them
BANDS, ROWS = 32, 5
SPACING = 1.001  # b: registers are floors of logarithms to this base
RATE = 20.0  # a: rate of the exponentials
MARGIN = 0.15  # about five standard deviations of the estimate
SALT_ROWS = 128  # rows that one copy of a hub's text serves: a copy more per 128 rows, and no task with more of one hub
BLOCK_ROWS, BLOCK_SHINGLES = 512, 250_000  # of one block of an open bucket


def minima(elements: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Uniform minima of the registers.

    Each element visits all registers in an order of its own, with a value from the k-th of
    m equal strata at its k-th visit; it stops once no register can still change.
    """
    low = np.full(m, 2.0)
    n, level = len(elements), 0
    if not n:
        return low
    first = (tc.mix(elements, 1) % tc.U64(m)).astype(np.int64)
    step = (tc.mix(elements, 2) % tc.U64(m - 1)).astype(np.int64) + 1
    while level < m and low.max() >= level / m:
        more = min(m - level, max(1, 2048 // n))
        ks = np.arange(level, level + more)
        with np.errstate(over="ignore"):
            u = tc.mix(elements[:, None] + (ks.astype(tc.U64) * tc.U64(0xA24BAED4963EE407))[None, :], 3)
        u = ((u >> tc.U64(11)).astype(np.float64) * 2.0**-53 + ks) / m
        np.minimum.at(low, ((first[:, None] + step[:, None] * ks) % m).ravel(), u.ravel())
        level += more
    return low


def registers(elements: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of a set of 64-bit elements; of none, all 0. Union: the maximum."""
    if not len(elements):
        return np.zeros(m, dtype=np.uint16)
    x = -np.log1p(-np.minimum(minima(elements, m), 1 - 2.0**-53)) / RATE
    k = np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(SPACING))
    return np.clip(k, 0, 65535).astype(np.uint16)


def likelihood(j, above: np.ndarray, below: np.ndarray, m: int, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Log-likelihood of similarities j, given how many of m registers are larger and smaller and both set sizes."""
    u = n1 / (n1 + n2)
    v = 1 - u

    def collision(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (SPACING - 1) / SPACING) / np.log(SPACING)

    p, q, tiny = collision(u - v * j), collision(v - u * j), 1e-12
    return above * np.log(p + tiny) + below * np.log(q + tiny) + (m - above - below) * np.log(np.maximum(1 - p - q, 0) + tiny)


def estimate(above: np.ndarray, below: np.ndarray, m: int, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Most likely similarities; the likelihood is concave."""
    lo, hi = np.zeros(len(n1)), np.minimum(n1 / n2, n2 / n1)
    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        better = likelihood(a, above, below, m, n1, n2) < likelihood(b, above, below, m, n1, n2)
        lo, hi = np.where(better, a, lo), np.where(better, hi, b)
    return (lo + hi) / 2


def at_least(j: float, above: np.ndarray, below: np.ndarray, m: int, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Whether the estimate is j or more: there the likelihood does not fall yet."""
    return (likelihood(j + 1e-6, above, below, m, n1, n2) >= likelihood(j, above, below, m, n1, n2)) & (np.minimum(n1, n2) >= j * np.maximum(n1, n2))


def _sketches(size: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for c in tc.chunks(batch.column(1)):
                w = tc.words(c)
                names = tc.word_names(c, w, lower=True)
                n, f1, f2, out = [], [], [], []
                for k in range(c.hi - c.lo):
                    s = tc.shingle_set(names.at(slice(w.first[k], w.first[k + 1])), size)
                    n.append(len(s.a))
                    f1.append(int(tc.mix(s.a, 11).sum(dtype=tc.U64).view(np.int64)))
                    f2.append(int(tc.mix(s.b, 12).sum(dtype=tc.U64).view(np.int64)))
                    out.append(registers(s.a).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(c.lo, c.hi - c.lo), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(out, pa.binary())],
                    ["id", "n_shingles", "f1", "f2", "sketch"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def _bands(batches):
    for batch in batches:
        sketch = _matrix(batch.column(1)).astype(tc.U64)
        ids = batch.column(0).to_numpy()
        for lo in range(0, len(ids), 2000):
            part = sketch[lo : lo + 2000]
            keys = np.stack([tc.row_hashes(part[:, b * ROWS : (b + 1) * ROWS], b) for b in range(BANDS)], axis=1)
            turns = np.tile(np.arange(BANDS, dtype=np.int32), len(part))
            yield pa.RecordBatch.from_arrays([pa.array(tc.signed(keys.ravel())), pa.array(turns), pa.array(np.repeat(ids[lo : lo + 2000], BANDS))], ["band", "turn", "node"])


def _plausible(least: float):
    """Pairs whose estimated similarity reaches ``least``: columns a, b, n_a, n_b, s_a, s_b."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column(4)), _matrix(batch.column(5))
            keep = at_least(least, (x > y).sum(1), (x < y).sum(1), x.shape[1], batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float))
            yield batch.filter(pa.array(keep)).select([0, 1])

    return run


def _reaches(h: tc.Names, s: tc.Names, numerator: int, denominator: int) -> bool:
    """Whether two sorted sets of names reach the threshold."""
    if not len(h.a) or not len(s.a):
        return False
    at = np.minimum(np.searchsorted(h.a, s.a), len(h.a) - 1)
    both = int(((h.a[at] == s.a) & (h.b[at] == s.b)).sum())
    return denominator * both >= numerator * (len(h.a) + len(s.a) - both)


def _exactly(x: bytes, y: bytes, size: int, numerator: int, denominator: int) -> bool:
    """Whether two lower-cased texts reach the threshold, by the words themselves.

    Words get numbers, then strings of words do, by doubling: a string's number stands for
    the numbers of the two shorter ones that cover it.
    """
    number: dict[bytes, int] = {}
    texts = [np.array([number.setdefault(w, len(number)) for w in t.split()], np.int64) for t in (x, y)]
    if any(len(t) < size for t in texts):
        return np.array_equal(*texts)
    span = 1
    while span < size:
        step = min(span, size - span)
        pairs = [t[:-step] << 32 | t[step:] for t in texts]
        flat = np.unique(np.concatenate(pairs), return_inverse=True)[1]
        texts = [flat[: len(pairs[0])], flat[len(pairs[0]) :]]
        span += step
    sets = [np.unique(t) for t in texts]
    both = len(np.intersect1d(*sets, assume_unique=True))
    return denominator * both >= numerator * (len(sets[0]) + len(sets[1]) - both)


def _across(size: int, least: float, numerator: int, denominator: int):
    """Links that join different components, within a block or between two blocks of a bucket.

    Rows come sorted by (band, i, j); a row's own block is i or j. Registers rule pairs out,
    the sets decide, and what a link has joined is not compared again. A pair is looked at
    in the first band that it shares.
    """

    def links(turn, node, comp, n, block, i, j, sketch, sets, texts):
        root = {int(c): int(c) for c in np.unique(comp)}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        left = np.flatnonzero(block == i)
        right = np.flatnonzero(block == j) if i != j else left
        for x in left:
            y = right[right > x] if i == j else right
            y = y[(comp[y] != comp[x]) & (denominator * np.minimum(n[y], n[x]) >= numerator * np.maximum(n[y], n[x]))]
            if not len(y):
                continue
            same = sketch[y] == sketch[x]
            near = same.sum(1) >= 0.8 * least * REGISTERS
            y, same = y[near], same[near]
            earlier = same[:, : turn * ROWS].reshape(len(y), turn, ROWS).all(2).any(1)
            y = y[~earlier]
            if not len(y):
                continue
            s = sketch[y]
            for z in y[at_least(least, (s < sketch[x]).sum(1), (s > sketch[x]).sum(1), REGISTERS, np.full(len(y), float(n[x])), n[y].astype(float))]:
                p, q = find(int(comp[x])), find(int(comp[z]))
                if p != q and _reaches(sets[x], sets[z], numerator, denominator) and _exactly(texts[x], texts[z], size, numerator, denominator):
                    root[max(p, q)] = min(p, q)
                    yield int(node[x]), int(node[z])

    def done(key, rows):
        t = pa.Table.from_batches(rows).combine_chunks()
        node, comp, n, block = (t.column(c).to_numpy() for c in ("node", "comp", "n", "block"))
        sets, texts = [], []
        for c in tc.chunks(t.column("text")):
            w = tc.words(c)
            names = tc.word_names(c, w, lower=True)
            sets += [tc.shingle_set(names.at(slice(w.first[k], w.first[k + 1])), size) for k in range(c.hi - c.lo)]
            lowered = tc.lower_cased(c.data)
            texts += [lowered[c.offsets[k] : c.offsets[k + 1]].tobytes() for k in range(c.hi - c.lo)]
        found = list(links(int(t.column("turn")[0].as_py()), node, comp, n, block, key[1], key[2], _matrix(t.column("sketch").combine_chunks()), sets, texts))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            band, i, j = (batch.column(c).to_numpy() for c in (0, 1, 2))
            cuts = np.flatnonzero((np.diff(band) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if rows and (band[lo], i[lo], j[lo]) != key:
                    yield done(key, rows)
                    rows = []
                key = (band[lo], i[lo], j[lo])
                rows.append(batch.slice(lo, hi - lo))
        if rows:
            yield done(key, rows)

    return run


def _verify(size: int, numerator: int, denominator: int):
    """Rows come sorted by (hub, salt, is_member): a hub's text, then the texts to hold against it."""

    def run(batches):
        key, hubs = None, []
        for batch in batches:
            hub, salt, member, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            for c in tc.chunks(batch.column(4)):
                w = tc.words(c)
                names, lowered = tc.word_names(c, w, lower=True), tc.lower_cased(c.data)
                a, b = [], []
                for k in range(c.hi - c.lo):
                    r = c.lo + k
                    if (hub[r], salt[r]) != key:
                        key, hubs = (hub[r], salt[r]), []
                    s = tc.shingle_set(names.at(slice(w.first[k], w.first[k + 1])), size)
                    text = lowered[c.offsets[k] : c.offsets[k + 1]].tobytes()
                    if not member[r]:
                        hubs.append((s, text))
                        continue
                    for h, said in hubs:
                        if _reaches(h, s, numerator, denominator) and _exactly(said, text, size, numerator, denominator):
                            a.append(int(ids[r]))
                            b.append(int(hub[r]))
                            break
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold. ``texts``: id, text."""
    asked = pairs.groupBy("b").agg(F.count("*").alias("asked")).select(F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.floor((F.col("asked") - 1) / SALT_ROWS).cast("int"))).alias("salt"), F.lit(False).alias("member"), F.col("b").alias("id"))
    salts = pairs.groupBy("b").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / SALT_ROWS)).cast("int").alias("salts"))
    members = pairs.join(salts, "b").select(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"), F.col("a").alias("id"))
    rows = asked.unionByName(members).join(texts, "id").select("hub", "salt", "member", "id", "text")
    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member").mapInArrow(_verify(size, numerator, denominator), "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the least node that can be reached; only nodes with an edge.

    Alternating stars: a node's larger neighbours are hung on its least neighbour, then its
    smaller ones are, until every component is a star around its least node. Rounds grow
    with the logarithm of the nodes, on paths too, and edges never grow in number.
    """

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])

    stars = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")  # larger a, smaller b
    was = state(stars)
    while was[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = scratch.keep(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(below, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = scratch.keep(hung.unionByName(below.select("a", F.col("m").alias("b"))).distinct(), "small")
        now = state(stars)
        if now == was:
            break
        was = now
    centres = stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(centres)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, numerator: int = 85, denominator: int = 100) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of ``docs``.

    Rows are linked if ``denominator`` x intersection >= ``numerator`` x union of their sets
    of distinct ``size``-word shingles (ASCII letters lower-cased; fewer words: the whole
    sequence). component_id is the least id that links reach. Null, empty and blank texts
    have no shingle and no link. Ids are numbers, and read as long integers. Rows that share an
    id are one document to the links. A row without an id is alone: component_id is null and
    it is kept. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signs = scratch.keep(texts.mapInArrow(_sketches(size), "id long, n_shingles long, f1 long, f2 long, sketch binary"), "signs")
    filled = signs.where("n_shingles > 0 and id is not null")
    classes = scratch.keep(filled.groupBy("f1", "f2").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "classes")
    nodes = scratch.keep(
        filled.join(classes.select("f1", "f2", F.col("node").alias("id")), ["f1", "f2", "id"], "left_semi").select(F.col("id").alias("node"), F.col("n_shingles").alias("n"), "f1", "sketch").dropDuplicates(["node", "f1"]).drop("f1"), "nodes"
    )
    banded = nodes.select("node", "sketch").mapInArrow(_bands, "band long, turn int, node long")
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size")
    members = scratch.keep(banded.join(hubs, "band").select("band", "turn", "node", "hub"), "members")
    texts = scratch.keep(texts.join(members.select(F.col("node").alias("id")).distinct(), "id", "left_semi"), "texts")
    pairs = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    least = numerator / denominator - MARGIN

    def side(c: str) -> DataFrame:
        return nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    tried = scratch.keep(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_plausible(least), "a long, b long").distinct(), "tried")
    links = scratch.keep(verified(tried, texts, size, numerator, denominator), "links")
    labels = components(links, scratch)

    # a bucket's rows in its hub's component are not compared with each other, all others are with each and with them
    of_hub = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    placed = members.join(labels, "node", "left").join(of_hub, "hub", "left").join(nodes.select("node", "n").distinct(), "node")
    placed = placed.select("band", "turn", "node", "n", F.coalesce("label", "node").alias("comp"), (F.coalesce("label", "node") == F.coalesce("hub_label", "hub")).alias("main"))

    def blocks(which: Column) -> Column:
        return F.greatest(F.ceil(F.count_if(which) / BLOCK_ROWS), F.ceil(F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")

    open_ = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks(~F.col("main")).alias("few"), blocks(F.col("main")).alias("many")).where("lo <> hi").select("band", "few", "many")
    draw = F.xxhash64("node")
    left = (
        placed.drop("n")
        .join(open_, "band")
        .withColumn("block", F.when(F.col("main"), F.col("few") + F.pmod(draw, F.col("many"))).otherwise(F.pmod(draw, F.col("few"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("main"), F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1))))
        .select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "turn", "node", "comp")
        .join(nodes, "node")
        .join(texts.withColumnRenamed("id", "node"), "node")
        .select("band", "i", "j", "block", "turn", "node", "comp", "n", "sketch", "text")
    )
    more = scratch.keep(left.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_across(size, least, numerator, denominator), "a long, b long").distinct(), "more")
    if not more.isEmpty():
        labels = components(links.unionByName(more), scratch)
    of_class = classes.join(labels, "node", "left").select("f1", "f2", "copies", F.coalesce("label", "node").alias("component"))
    placed = join_spread(filled.select("id", "n_shingles", "f1", "f2"), of_class, ["f1", "f2"], "copies").select("id", "n_shingles", F.col("component").alias("component_id"))
    alone = signs.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return placed.unionByName(alone).select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_shingles", "component_id", kept.alias("kept"))
