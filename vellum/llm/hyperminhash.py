"""MinHash near-dedup with HyperMinHash registers.

A document's set is its distinct word shingles. Documents with equal sets are one class at once. Each class has REGISTERS
minima of 32 bits; a register keeps a minimum's count of leading zeros and the MANTISSA bits that follow, in 16 bits.
BANDS bands of registers are compared; classes that agree in a whole band share a bucket. A pair of a bucket is a
candidate; the share of equal registers, corrected for collisions of compressed minima (their chance follows from both
set sizes), estimates the Jaccard similarity, and pairs far below the threshold go. The others are confirmed on the full
sets. At a similarity of 0.8 a pair shares no bucket with a chance of 5e-8.

Each round, a bucket links all its classes to one centre: the one whose buckets hold the most classes, which in a group of
near copies is the text they were made from. Classes that the confirmed links join need no further comparison in the
bucket. Rounds go on with centres from the parts that are left over, until few pairs of different parts remain or a round
makes little progress. The classes of buckets that are still open are then joined on their rarest shingles: sets of the
asked similarity share one of those, while classes that only have a common passage in common don't meet. So no link
between parts is lost, and no bucket is written out in pairs. Components come from rounds of label exchange and pointer
jumping over stored tables; nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import broadcast_below, by_batch, drop_folder, stored

REGISTERS, BANDS, MANTISSA = 128, 32, 10
#: An estimate may fall short of the threshold by so much (five standard errors) before a pair goes unconfirmed.
SLACK = 0.18
#: After the first round, the classes of open buckets are joined on rare shingles once their buckets have at most so many pairs a
#: class (each band counts), or once a round found no link or left more than half of the pairs.
PAIRS_A_CLASS = 64
MOST_ROUNDS = 12
MOST_BROADCAST = 1_000_000

_MULTIPLIERS = np.random.default_rng(20240607).integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADDENDS = np.random.default_rng(20240608).integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
#: Hashes whose products with all multipliers stay in a core's cache.
_BLOCK = 256


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the runs of `size` words: bytes between ASCII white space, A-Z as a-z. With
    fewer words the whole sequence is one; without words there are none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(words))], dtype=np.uint64)
    n = len(h) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):  # each step mixes the next word into all runs at once
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(values: np.ndarray) -> np.ndarray:
    """REGISTERS minima of a set of hashes: of the upper 32 bits, each register under a permutation of its own."""
    low = np.full(REGISTERS, np.iinfo(np.uint32).max, dtype=np.uint32)
    upper = (values >> np.uint64(32)).astype(np.uint32)[:, None]
    block = np.empty((_BLOCK, REGISTERS), dtype=np.uint32)
    for at in range(0, len(upper), _BLOCK):
        part = upper[at : at + _BLOCK]
        x = np.multiply(part, _MULTIPLIERS, out=block[: len(part)])
        x += _ADDENDS
        np.minimum(low, x.min(axis=0), out=low)
    return low


def compressed(minima: np.ndarray) -> np.ndarray:
    """16-bit registers of any array of minima: leading zeros (31 at most) above MANTISSA bits behind the leading one."""
    rest, zeros = minima.copy(), np.zeros(minima.shape, dtype=np.uint32)
    for step in (16, 8, 4, 2, 1):
        small = rest < np.uint32(1 << (32 - step))
        zeros[small] += np.uint32(step)
        rest[small] <<= np.uint32(step)
    mantissa = (rest << np.uint32(1)) >> np.uint32(32 - MANTISSA)
    return ((zeros << np.uint32(MANTISSA)) | mantissa).astype("<u2")


def collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of unrelated sets of n and m hashes agree: over all counts of leading zeros, both minima have
    that count, and the same mantissa."""
    k = np.arange(32)
    cell = lambda s: np.exp(-s[:, None] * 2.0 ** -(k + 1)) - np.exp(-s[:, None] * 2.0**-k)
    return (cell(n) * cell(m)).sum(1) * 2.0**-MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity from rows of registers."""
    share, chance = (a == b).mean(1), collision(n.astype(float), m.astype(float))
    return np.clip((share - chance) / (1 - chance), 0, 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, sig1, sig2, regs: a row to each row of docs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, one, two, lows = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, size)
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            one.append(_signed(d >> 64))
            two.append(_signed(d & (1 << 64) - 1))
            lows.append(minima(s))
        packed = compressed(np.array(lows).reshape(-1, REGISTERS))
        regs = [r.tobytes() if k else None for r, k in zip(packed, n, strict=True)]
        return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(regs, pa.large_binary())], ["doc_id", "n_shingles", "sig1", "sig2", "regs"])

    return by_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, sig1 long, sig2 long, regs binary")


def _bands(classes: DataFrame) -> DataFrame:
    """band, value, rep: a row to each band of a class."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        reps = np.repeat(batch.column(0).to_numpy(), BANDS)
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<i8")  # four registers of 16 bits are one number
        return pa.record_batch([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)), pa.array(values), pa.array(reps)], ["band", "value", "rep"])

    return by_batch(classes.select("rep", "regs"), run, "band int, value long, rep long")


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity isn't far below `least`."""
    own = classes.select("rep", F.col("n_shingles").alias("n"), "regs")
    both = pairs.join(own.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a").join(own.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
    both = both.where(F.least("na", "nb") >= F.greatest("na", "nb") * (least - 1e-9))  # the smaller set bounds the similarity

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for k in (4, 5))
        keep = estimate(a, b, batch.column(2).to_numpy(), batch.column(3).to_numpy()) >= least - SLACK
        return batch.select([0, 1]).filter(pa.array(keep))

    return by_batch(both.select("a", "b", "na", "nb", "ra", "rb"), run, "a long, b long")


def _sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """rep, set: the sets of the classes in needed (rep, sig1, sig2), from the row that the class is named after."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for doc_id, text, one, two in zip(*(batch.column(k).to_pylist() for k in range(4))):
            s = shingles(text, size)
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            if (_signed(d >> 64), _signed(d & (1 << 64) - 1)) == (one, two):
                rows.append((doc_id, s.tobytes()))
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.large_binary())], ["rep", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(needed, "rep").select("rep", "text", "sig1", "sig2")
    return by_batch(texts, run, "rep long, set binary")


def _stored_sets(ids: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """rep, set of the classes in ids (rep), stored: texts are hashed once, however many joins read the sets."""
    needed = broadcast_below(classes.select("rep", "sig1", "sig2").join(ids, "rep", "left_semi"), MOST_BROADCAST)
    return stored(_sets(docs, needed, size), "sets")


def _with_rare_shingle(parts: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) of classes in parts (rep, root) that differ in root and may reach the similarity: all that do are there.

    A set's shingles are ordered by the number of sets that hold them. Sets x and y of the similarity t have at least
    t * |x| shingles in common, so one of them is among the first |x| - ceil(t * |x|) + 1 of x, and of y likewise; from the
    first common one on, both must have enough shingles left."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = batch.column(1).to_pylist()
        n = np.array([len(x) // 8 for x in held], dtype=np.int64)
        return pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(np.frombuffer(b"".join(held), dtype="<i8"))], ["rep", "n", "shingle"])

    each = by_batch(sets.select("rep", "set"), run, "rep long, n long, shingle long", rows=64)
    shared = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    ranked = each.join(shared, "shingle").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("known"))
    ranked = ranked.withColumn("alone", F.col("n") - F.size("known"))  # shingles of no other set come first
    first = F.expr(f"cast(greatest(0, n - (n * {per_cent} + 99) div 100 + 1 - alone) as int)")
    rare = ranked.join(parts, "rep").select("rep", "root", "n", "alone", F.posexplode(F.slice("known", F.lit(1), first)).alias("at", "known"))
    rare = stored(rare.select("rep", "root", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"), F.col("known.shingle").alias("shingle")), "rare")
    other = rare.select(F.col("rep").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("m"), F.col("rest").alias("rest_b"), "shingle")
    enough = (100 + per_cent) * F.least("rest", "rest_b") >= per_cent * (F.col("n") + F.col("m"))
    return rare.join(other, "shingle").where((F.col("rep") < F.col("b")) & (F.col("root") != F.col("root_b")) & enough).select(F.col("rep").alias("a"), "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= per_cent * union of the full sets."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b")), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * common >= per_cent * (len(a) + len(b) - common))
        return batch.select([0, 1]).filter(pa.array(keep))

    return by_batch(both.select("a", "b", "set_a", "set_b"), run, "a long, b long", rows=256).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: of each node of edges (a, b) the smallest node it is connected with. Each round a node takes the smallest
    label among its neighbours' and then its label's label; rounds grow with the logarithm of a component's width."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stored(step.join(jump, "root", "left").select("node", "old", F.least("root", "next").alias("root")), "labels")
        drop_folder(labels.sparkSession, labels.vellum_path)
        labels = new
        if labels.where(F.col("root") != F.col("old")).isEmpty():
            return labels.select("node", "root")


def links(docs: DataFrame, classes: DataFrame, size: int, per_cent: int) -> DataFrame:
    """node, root for the classes that have links: the classes' components."""
    spark, least = docs.sparkSession, per_cent / 100
    bands = stored(_bands(classes), "bands")
    counts = bands.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # Few buckets hold several classes: where they can be broadcast, the bands aren't shuffled again.
    shared = bands.join(broadcast_below(stored(counts, "counts"), MOST_BROADCAST), ["band", "value"])
    degree = shared.groupBy("rep").agg(F.sum("n").alias("degree"))
    members = stored(shared.select("band", "value", "rep").join(degree, "rep"), "members")
    n_classes = max(1, members.select("rep").distinct().count())
    nothing = spark.createDataFrame([], "a long, b long")
    roots, last, grown = spark.createDataFrame([], "node long, root long"), False, False
    before = 0
    found, tested, joined = nothing, nothing, members.select("rep", F.col("rep").alias("root")).distinct()
    for step in range(MOST_ROUNDS + 1):
        # A bucket's classes by component; buckets that confirmed links don't make one part yet are open.
        at = members.join(joined, "rep")
        parts = at.groupBy("band", "value", "root").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("degree", -F.col("rep"))).alias("top"))
        open_ = parts.groupBy("band", "value").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("own"), F.max(F.struct("top", "root")).alias("best"))
        open_ = stored(open_.where(F.col("parts") > 1).select("band", "value", ((F.col("all") * F.col("all") - F.col("own")) / 2).alias("pairs"), (-F.col("best.top.col2")).alias("centre"), F.col("best.root").alias("centre_root")), "open")
        left = open_.agg(F.sum("pairs")).first()[0] or 0
        if not left:
            break
        last = step == MOST_ROUNDS or (step > 0 and (not grown or left <= PAIRS_A_CLASS * n_classes or left > before / 2))
        before, sets = left, None
        if last:
            rest = stored(at.join(open_.select("band", "value"), ["band", "value"]).select("rep", "root").distinct(), "rest")
            sets = _stored_sets(rest.select("rep"), docs, classes, size)
            pairs = _with_rare_shingle(rest, sets, per_cent)
        else:
            pairs = at.join(open_, ["band", "value"]).where(F.col("root") != F.col("centre_root")).select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
        pairs = stored(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        likely = stored(_likely(pairs, classes, least), "likely")
        if sets is None:
            sets = _stored_sets(likely.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), docs, classes, size)
        new = stored(_confirmed(likely, sets, per_cent), "links")
        if grown := not new.isEmpty():
            found = found.union(new)
        if last:
            break
        tested = tested.union(pairs)
        if grown:  # else the components are those of the round before
            roots = components(found)
            joined = _joined(members, roots)
        # A class that wasn't linked to this round's centre gets another one next round: centres that are done step back.
        spent = open_.select("band", "value", F.col("centre").alias("rep")).withColumn("spent", F.lit(True))
        members = members.join(spent, ["band", "value", "rep"], "left").select("band", "value", "rep", F.when(F.col("spent"), F.lit(0).cast("long")).otherwise(F.col("degree")).alias("degree"))
        if step % 3 == 2:
            members = stored(members, "members")
    return components(found) if last and grown else roots


def _joined(members: DataFrame, roots: DataFrame) -> DataFrame:
    """rep, root of all classes that share buckets."""
    every = members.select("rep").distinct()
    return stored(every.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("root")), "roots")


def near_duplicates(docs: DataFrame, size: int, per_cent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text; other columns are left out).

    component_id is the smallest doc_id that a document reaches over links, itself included; kept: it is that document.
    Null and empty texts, and texts of white space, have no shingles and no links. Rows that repeat a doc_id are one
    document. A row without a doc_id is never linked: its component_id is null, and it is kept. An empty table gives an
    empty one."""
    rows = stored(_sketches(docs, size), "sketches")
    sets = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # One row to a set: the document it is named after. A document of several rows names several sets; they are one node.
    by_set = sets.groupBy("sig1", "sig2").agg(F.min(F.struct("doc_id", "n_shingles", "regs")).alias("low"))
    classes = stored(by_set.select(F.col("low.doc_id").alias("rep"), "sig1", "sig2", "low.n_shingles", "low.regs"), "classes")
    roots = links(docs, classes, size, per_cent)
    # Sets that one document's rows share join those sets' components.
    named = sets.select("doc_id", "sig1", "sig2").distinct().join(classes.select("rep", "sig1", "sig2"), ["sig1", "sig2"]).select("doc_id", "rep")
    named = named.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("root"))
    several = named.groupBy("doc_id").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("n > 1 and low < high")
    if not several.isEmpty():
        more = named.join(several.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
        merged = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more).where("a != b"))
        roots = merged
        named = named.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("doc_id", F.coalesce("top", "root").alias("root"))
    ids = named.groupBy("doc_id").agg(F.min("root").alias("root"))
    out = rows.select("doc_id", "n_shingles").join(ids, "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of which each component keeps its smallest doc_id; of rows that repeat that doc_id the
    one with the smallest text stays (null first). Rows without a doc_id stay."""
    found = near_duplicates(docs, size, per_cent)
    gone = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    left = docs.join(broadcast_below(gone, MOST_BROADCAST), F.col("doc_id").cast("long") == F.col("gone_id"), "left_anti")
    twice = broadcast_below(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice_id")), MOST_BROADCAST)
    if twice.isEmpty():
        return left
    again = left.join(twice, F.col("doc_id").cast("long") == F.col("twice_id"), "left_semi")
    # Partial aggregation, so a doc_id with many rows costs one row a task. Of equal texts a hash of the whole row decides.
    low = F.min_by(F.struct(*again.columns), F.struct(F.col("text"), F.xxhash64(*again.columns)))
    again = again.groupBy("doc_id").agg(low.alias("row")).select("row.*")
    return left.join(twice, F.col("doc_id").cast("long") == F.col("twice_id"), "left_anti").unionByName(again)
