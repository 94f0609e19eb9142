"""Suffix-array dedup by prefix-free parsing.

A rolling hash of KGRAM bytes triggers phrase ends: among the k-grams of each WIDTH-byte string the leftmost one with the
smallest hash is its trigger, so equal strings have the same trigger at the same place, whatever stands around them. The
consecutive strings with one trigger make a phrase: the bytes from the first of them to the end of the last. Neighbouring
phrases overlap by WIDTH - 1 bytes, as the phrases of a prefix-free parse overlap by the trigger's width, so each
WIDTH-byte string lies in exactly one phrase of its document.

1. Parse: every document becomes its phrases (hashes of trigger and phrase). Grouped by trigger, they give the dictionary
   (distinct phrases) and each phrase's first document. In repetitive text most phrases are old: every string of such a
   phrase starts in a smaller doc_id, and nothing more has to be known of it.
2. Dictionary: a string can stand in two different phrases only if they have one trigger. Of triggers with several
   distinct phrases, the phrases themselves are fetched, and their suffixes are put in order by their first WIDTH bytes
   (a suffix array cut at depth WIDTH; phrases that share no trigger share no such prefix, so it is built in parts).
   Neighbours in that order with equal prefixes are equal strings; the smallest first document among their phrases is the
   string's first document in corpus order.
3. Documents take back which of their phrases, and which strings of their other phrases, are old, and drop those bytes.

Phrases are known by 96 bits of hash (48 of the trigger, 48 of the phrase); suffixes are compared byte by byte. A hot
phrase is settled among the rows of a batch first, so that one row of a batch stands for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import arrow, broadcast_below, by_batch, release, stored

WIDTH, KGRAM = 50, 16
SPAN = WIDTH - KGRAM + 1
#: Bytes that are parsed at once; longer texts are parsed in stretches that overlap by WIDTH - 1.
BLOCK = 1 << 20
#: Rows up to which the list of documents whose phrases are fetched is broadcast.
MOST_FETCHED = 300_000
#: Bytes of text whose phrases are settled in one part (about a tenth as many bytes of hashes, held at once).
PART_BYTES = 256 << 20
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)]
_MASK48 = np.uint64((1 << 48) - 1)
_ENTRY = np.dtype([("a0", "<u4"), ("a1", "<u2"), ("r0", "<u4"), ("r1", "<u2"), ("doc", "<u2")])


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def _phrases(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts end to end, `ends` where each ends: first and last string start of each phrase, its trigger's and its own hash."""
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < WIDTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    x = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    h = x[:-8] * _C[0] + x[8:] * _C[1]
    h ^= h >> np.uint64(32)
    h *= _C[2]
    h ^= h >> np.uint64(29)
    low = _sliding(h, SPAN, np.minimum)
    valid = np.ones(len(low), dtype=bool)
    for end in ends.tolist():
        valid[max(0, end - WIDTH + 1) : end] = False
    low[~valid] = 0
    pad = np.zeros(SPAN - 1, dtype=np.uint64)
    triggers = _sliding(np.concatenate([pad, low, pad]), SPAN, np.maximum) == h
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    places = np.flatnonzero(triggers)
    k = (np.cumsum(triggers) - triggers)[at]  # the first trigger at or behind each string's start
    want = low[at]
    while True:
        off = np.flatnonzero(h[places[k]] != want)
        if not len(off):
            break
        k[off] += 1
    new = np.flatnonzero((np.diff(k) != 0) | (np.diff(at) != 1)) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(at)]]) - 1
    a, b = at[first], at[last]
    view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
    own = np.fromiter((digest(view[i:j]) for i, j in zip(a.tolist(), (b + WIDTH).tolist())), dtype=np.uint64, count=len(a))
    return a, b, h[places[k[first]]] & _MASK48, own & _MASK48


def parse(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first, last, trigger, phrase) arrays of the phrases of texts, in pieces of BLOCK bytes or so."""
    held, owners, bases, size = [], [], [], 0

    def out() -> tuple[np.ndarray, ...]:
        raw = np.frombuffer(b"".join(held), dtype=np.uint8)
        lengths = np.array([len(p) for p in held])
        ends = np.cumsum(lengths)
        a, b, trigger, own = _phrases(raw, ends)
        k = np.searchsorted(ends, a, side="right")
        back = np.array(bases)[k] - (ends - lengths)[k] if len(a) else a
        return np.array(owners, dtype=np.int64)[k], a + back, b + back, trigger, own

    for i, text in enumerate(texts):
        for base in range(0, max(1, len(text) - WIDTH + 1), BLOCK):
            piece = text[base : base + BLOCK + WIDTH - 1]
            if len(piece) < WIDTH:
                continue
            held.append(piece)
            owners.append(i)
            bases.append(base)
            size += len(piece)
            if size >= BLOCK:
                yield out()
                held, owners, bases, size = [], [], [], 0
    if held:
        yield out()


def _all(texts: list[bytes]) -> list[np.ndarray]:
    pieces = list(parse(texts))
    if not pieces:
        return [np.zeros(0, dtype=t) for t in ("i8", "i8", "i8", "u8", "u8")]
    return [np.concatenate(c) for c in zip(*pieces)]


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _packed(texts: DataFrame, parts: int) -> DataFrame:
    """part, settled, docs, entries: the phrases of a batch for each part. Of equal phrases only that of the smallest doc_id
    asks; the others' doc_ids are settled and go to any part."""

    def rows(part: np.ndarray, settled: bool, doc: np.ndarray, trigger: np.ndarray, own: np.ndarray, names: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for group in np.split(order, cuts) if len(order) else ():
            used, place = np.unique(doc[group], return_inverse=True)
            e = np.empty(len(group), dtype=_ENTRY)
            t, o = trigger[group], own[group]
            e["a0"], e["a1"], e["r0"], e["r1"], e["doc"] = t, t >> np.uint64(32), o, o >> np.uint64(32), place
            yield int(part[group[0]]), settled, names[used].astype("<i8").tobytes(), e.tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.column(0).to_numpy()
        doc, _, _, trigger, own = _all(_bytes(batch.column(1)))
        order = np.lexsort((names[doc], own, trigger))
        doc, trigger, own = doc[order], trigger[order], own[order]
        ids = names[doc]
        first = np.ones(len(doc), dtype=bool)
        first[1:] = (trigger[1:] != trigger[:-1]) | (own[1:] != own[:-1])
        least = ids[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))] if len(doc) else ids
        fresh = np.ones(len(doc), dtype=bool)
        fresh[1:] = first[1:] | (ids[1:] != ids[:-1])  # once for each document
        old = fresh & (ids > least)
        out = [*rows((trigger[first] % np.uint64(parts)).astype(np.int32), False, doc[first], trigger[first], own[first], names)]
        spread = (np.arange(int(old.sum())) // 4096 + int(names[0]) % parts) % parts
        out += rows(spread.astype(np.int32), True, doc[old], trigger[old], own[old], names)
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.large_binary()), pa.array(cols[3], pa.large_binary())], ["part", "settled", "docs", "entries"])

    return by_batch(texts, run, "part int, settled boolean, docs binary, entries binary")


def _by_bucket(ids: np.ndarray, keys: np.ndarray, kind: int, parts: int) -> Iterator[tuple]:
    """(bucket, kind, doc_ids, keys of 6 bytes) rows, one to a bucket of doc_ids."""
    bucket = ((ids.astype(np.uint64) * _C[0]) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(bucket, kind="stable")
    ids, keys, bucket = ids[order], keys[order], bucket[order]
    cuts = (np.flatnonzero(np.diff(bucket)) + 1).tolist()
    raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    for low, high in zip([0, *cuts], [*cuts, len(ids)]) if len(ids) else ():
        yield int(bucket[low]), kind, ids[low:high].astype("<i8").tobytes(), raw[low:high].tobytes()


OLD, WANTED = 0, 1


def _answers(packed: DataFrame, parts: int) -> DataFrame:
    """doc_id, old, wanted: the phrases of a document that are old, and those that the dictionary's suffixes are wanted of; null
    where there are none. The answers of a part are sorted into buckets of documents, a row each, and a bucket's answers
    make one row a document, so rows don't multiply with the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, settled = [], []
        for batch in batches:
            for done, docs, entries in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                e = np.frombuffer(entries, dtype=_ENTRY)
                ids = np.frombuffer(docs, dtype="<i8")[e["doc"]]
                own = e["r0"].astype(np.uint64) | e["r1"].astype(np.uint64) << np.uint64(32)
                if done:
                    settled.append((ids, own))
                else:
                    asked.append((ids, own, e["a0"].astype(np.uint64) | e["a1"].astype(np.uint64) << np.uint64(32)))
        out: list[tuple] = []
        if settled:
            out += _by_bucket(*(np.concatenate(c) for c in zip(*settled)), OLD, parts)
        if asked:
            ids, own, trigger = (np.concatenate(c) for c in zip(*asked))
            order = np.lexsort((ids, own, trigger))
            ids, own, trigger = ids[order], own[order], trigger[order]
            n = len(ids)
            new_trigger, new = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
            new_trigger[1:] = trigger[1:] != trigger[:-1]
            new[1:] = new_trigger[1:] | (own[1:] != own[:-1])
            first = np.flatnonzero(new)
            least = np.repeat(ids[first], np.diff([*first, n]))
            out += _by_bucket(ids[ids > least], own[ids > least], OLD, parts)
            # Distinct phrases of one trigger, unless one document has them all.
            f_ids, f_own, start = ids[first], own[first], np.flatnonzero(new_trigger[first])
            size = np.diff([*start, len(first)])
            several = np.repeat(np.minimum.reduceat(f_ids, start) < np.maximum.reduceat(f_ids, start), size)
            out += _by_bucket(f_ids[several], f_own[several], WANTED, parts)
        if out:
            cols = list(zip(*out))
            yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int8()), pa.array(cols[2], pa.large_binary()), pa.array(cols[3], pa.large_binary())], ["bucket", "kind", "docs", "keys"])
        release()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, list]] = [([], []), ([], [])]
        for batch in batches:
            for kind, docs, keys in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                held[kind][0].append(docs)
                held[kind][1].append(keys)
        of: dict[int, list] = {}
        for kind, (docs, keys) in enumerate(held):
            ids = np.frombuffer(b"".join(docs), dtype="<i8")
            order = np.argsort(ids, kind="stable")
            ids, raw = ids[order], np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(-1, 6)[order]
            cuts = (np.flatnonzero(np.diff(ids)) + 1).tolist()
            for low, high in zip([0, *cuts], [*cuts, len(ids)]) if len(ids) else ():
                of.setdefault(int(ids[low]), [None, None])[kind] = raw[low:high].tobytes()
        if of:
            yield pa.record_batch([pa.array(list(of), pa.int64()), *(pa.array([x[kind] for x in of.values()], pa.large_binary()) for kind in (OLD, WANTED))], ["doc_id", "old", "wanted"])
        release()

    answers = packed.repartitionById(parts, "part").mapInArrow(run, "bucket int, kind byte, docs binary, keys binary")
    return answers.repartitionById(parts, "bucket").mapInArrow(unpack, "doc_id long, old binary, wanted binary")


def _keys(raw: list[bytes]) -> np.ndarray:
    six = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), dtype=np.uint8)
    out[:, :6] = six
    return out.view("<u8").reshape(-1)


def _fetched(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """trigger, key, doc_id, phrase: the phrases that are WANTED, once each."""
    wanted = answers.where(F.col("wanted").isNotNull()).select("doc_id", F.col("wanted").alias("keys"))
    both = texts.join(broadcast_below(wanted, MOST_FETCHED), "doc_id").select("doc_id", "text", "keys")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, ids = _bytes(batch.column(1)), batch.column(0).to_pylist()
        doc, a, b, trigger, own = _all(raw)
        cuts = np.searchsorted(doc, np.arange(len(raw) + 1))
        rows = {}
        for i, keys in enumerate(batch.column(2).to_pylist()):
            low, high = cuts[i], cuts[i + 1]
            for k in (np.flatnonzero(np.isin(own[low:high], _keys([keys]))) + low).tolist():
                rows.setdefault((int(trigger[k]), int(own[k]), ids[i]), raw[i][a[k] : b[k] + WIDTH])
        cols = [[k[j] for k in rows] for j in range(3)]
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in cols), pa.array(list(rows.values()), pa.large_binary())], ["trigger", "key", "doc_id", "phrase"])

    return by_batch(both, run, "trigger long, key long, doc_id long, phrase binary", rows=256)


def suffix_order(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of WIDTH bytes or more of all phrases in the order of their first WIDTH bytes: phrase, start, and whether
    each begins a new group of equal prefixes; and the number of its group."""
    lengths = np.array([len(p) for p in phrases], dtype=np.int64)
    n = lengths - WIDTH + 1
    owner = np.repeat(np.arange(len(phrases)), n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    raw = np.frombuffer(b"".join(phrases) + bytes(8), dtype=np.uint8)
    at = np.repeat(np.cumsum(lengths) - lengths, n) + start
    words = np.ndarray((len(raw) - 7,), dtype=">u8", buffer=raw, strides=(1,))
    cols = [words[at + k].astype(np.uint64) for k in range(0, WIDTH - 7, 8)]
    rest = WIDTH % 8
    if rest:
        cols.append(words[at + WIDTH - rest] >> np.uint64(64 - 8 * rest))
    order = np.lexsort(cols[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in cols], axis=0)
    return owner[order], start[order], new, np.cumsum(new) - 1


def _old_strings(fetched: DataFrame) -> DataFrame:
    """doc_id, key, starts (u32 each): the strings of a phrase that stand in a phrase of a smaller document."""

    def settle(rows: list[tuple]) -> Iterator[tuple]:
        owner, start, new, group = suffix_order([r[3] for r in rows])
        ids = np.array([r[2] for r in rows], dtype=np.int64)[owner]
        least = np.minimum.reduceat(ids, np.flatnonzero(new))[group] if len(ids) else ids
        old = ids > least
        owner, start = owner[old], start[old]
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for group_at in np.split(np.arange(len(owner)), cuts) if len(owner) else ():
            r = rows[owner[group_at[0]]]
            yield r[2], r[1], start[group_at].astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # sorted by trigger; whole triggers are settled together
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if size >= BLOCK and held[-1][0] != row[0]:
                    yield made(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield made(held)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*settle(rows))) or [(), (), ()]
        return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.large_binary())], ["doc_id", "key", "starts"])

    return fetched.repartition("trigger").sortWithinPartitions("trigger").mapInArrow(run, "doc_id long, key long, starts binary")


def removed_mask(text: bytes, phrases: tuple[np.ndarray, np.ndarray, np.ndarray], old: np.ndarray, strings: dict[int, bytes]) -> np.ndarray:
    """Which bytes of text go, from its phrases (first, last, hash), the old ones' hashes and old strings by phrase."""
    a, b, own = phrases
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    hit = np.isin(own, old) if len(old) else np.zeros(len(own), dtype=bool)
    np.add.at(edge, a[hit], 1)
    np.add.at(edge, b[hit] + WIDTH, -1)
    if strings:
        for k in np.flatnonzero(~hit).tolist():
            if raw := strings.get(int(own[k])):
                at = a[k] + np.frombuffer(raw, dtype="<u4").astype(np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WIDTH, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text; other columns are left out): each
    byte goes that a WIDTH-byte string covers which also starts in a document with a smaller doc_id.

    Null and empty texts and texts under WIDTH bytes keep all they have. Rows that repeat a doc_id are of one document: they
    remove nothing from each other. Rows without a doc_id stay whole and remove nothing. An empty table gives an empty one."""
    spark = docs.sparkSession
    arrow(spark)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    known = texts.where(F.col("doc_id").isNotNull())
    answers = stored(_answers(_packed(known, parts), parts), "phrases")
    strings = stored(_old_strings(_fetched(known, answers)), "strings")
    old = answers.where(F.col("old").isNotNull()).select("doc_id", "old")
    some = strings.groupBy("doc_id").agg(F.collect_list(F.struct("key", "starts")).alias("strings"))
    found = old.join(some, "doc_id", "full").select(F.col("doc_id").alias("of"), "old", "strings")
    both = texts.join(found, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "old", "strings")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, olds, parts_of = _bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        touched = [i for i in range(len(raw)) if olds[i] or parts_of[i]]
        doc, a, b, _, own = _all([raw[i] for i in touched])
        cuts = np.searchsorted(doc, np.arange(len(touched) + 1))
        n_removed, n_spans, digests = [0] * len(raw), [0] * len(raw), [None] * len(raw)
        for k, i in enumerate(touched):
            low, high = cuts[k], cuts[k + 1]
            by_key: dict[int, bytes] = {}
            for x in parts_of[i] or ():
                by_key[x["key"]] = by_key.get(x["key"], b"") + x["starts"]
            mask = removed_mask(raw[i], (a[low:high], b[low:high], own[low:high]), _keys([olds[i]] if olds[i] else []), by_key)
            n_removed[i] = int(mask.sum())
            n_spans[i] = int((np.diff(np.concatenate([[False], mask]).astype(np.int8)) > 0).sum())
            digests[i] = hashlib.sha256(np.frombuffer(raw[i], dtype=np.uint8)[~mask].tobytes()).hexdigest()
        digests = [d or hashlib.sha256(x).hexdigest() for d, x in zip(digests, raw)]
        return pa.record_batch([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return by_batch(both, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", rows=256)
