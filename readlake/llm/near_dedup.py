"""Near-duplicate classes by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. Shingles: five consecutive words (A-Z lower-cased, split at ASCII white space), hashed to 32 bits; a
   document's shingles are a multiset (term frequency).  Shorter texts are one shingle.  They are written once,
   and all later steps read them.  Documents with equal shingle sequences are one class from the start: from
   here on a node is a distinct sequence (128 bits of its digest), and its least doc_id stands for it.
2. A shingle's weight is its frequency times its inverse document frequency log(documents / holders), scaled to
   be 1 for what less than RARE of all documents hold, and IDF_LEAST at least.  Holders are counted over all
   documents in two rows of 2 ** DF_BITS hashed counters; a count is the lesser of the two, less the row's median
   (what other shingles add).  Its error is a small share of the documents (well under RARE), whatever their
   number, so that these counters keep their meaning at every size.
3. ICWS draws BANDS * ROWS samples of each document; equal samples are as likely as the documents' weighted
   Jaccard similarity.  Documents that agree in a whole band share a bucket.
4. Buckets are runs in one global order (bucket, further samples), so a bucket of any size is dealt over many
   tasks.  Each member is paired with two hubs of its run, those whose shingles are in most documents (the base
   of many edited copies) of two components, and with its neighbour in the order, which agrees in most further
   samples.  Pairs already in one component are passed over.
5. Pairs are verified by weighted Jaccard similarity of the whole multisets: they are linked if it reaches
   SIMILARITY with TF-IDF or with TF weights (idf weighs a large group's own changes more than the text that its
   members share, which would take the group apart).  A hub's shingles are dealt out once for each part of its
   run, so that no hub is a hot key.
6. Links are contracted to connected components by repeated minimum labels over the links alone.  Members of
   runs that hold several components go on, with FINER times as many samples in the key; all members stay, linked
   ones too.  It ends when no run holds two components, at the latest when all samples are in the key; no bucket
   is dropped or capped.  A run that the order's division into tasks cuts meets again at its ends.
7. What hubs and neighbours left out is found exactly: members of buckets that still hold several components are
   joined by the rarest shingles of each, so many that texts of SIMILARITY share one at least, and pairs of different
   components whose shingles from there on can reach it are verified too.  So no pair of a bucket is lost.

Cases: null text is empty; empty texts are one class; equal texts share a class whatever their number;
rows that repeat a doc_id and text count once in ``stage``; a null doc_id is a class member like others
(``class_id`` null last) and several are told apart by their texts, as are texts under one doc_id;
other columns are ignored by the query and carried by ``stage``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.llm.common import join_groups, materialize, small, table

WORDS = 5
SIMILARITY = 0.8
LEAST = SIMILARITY * (1 - 1e-6)  # for bounds from rounded sums
BANDS, ROWS = 12, 3
DF_BITS = 19
RARE = 1e-3  # share of documents below which a shingle's inverse document frequency is 1
IDF_LEAST = 0.5
CHUNK = 1 << 14  # frequencies in one row on their way to the sum
LEVEL = 64  # partial sums added by one task
RUN = 1 << 14  # members of a run that are looked at together
GIVEN = 1 << 12  # members with partners in a batch
FINER = 4  # times as many samples in the key of a further round
LOT = 1 << 10  # holders of a shingle that one key of the join takes on its left side
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MUL
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0xD6E8FEB86659FD93
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64, up to the n-th, kept by the worker."""
    if len(_powers[0]) < n + 1:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
                _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, base, np.uint64))])
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash for each word of a text, from running sums over its bytes."""
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    word = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(raw))
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=run[1:])
    return mixed((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * _MIX)


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Hashes (uint32) of the text's shingles in order."""
    h = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(h):
        return np.zeros(0, np.uint32)
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : k + n]
    return (mixed(out) >> np.uint64(32)).astype(np.uint32)


def mixed32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


class Sampler:
    """ICWS: for sample k and element s, with r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn from a hash of (k, s),
    t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the sample is (s, t) of the least a.
    """

    SIZE = 1 << 16

    def __init__(self, samples: int):
        self.seeds = (mixed(np.arange(1, samples + 1, dtype=np.uint64) * _MIX) >> np.uint64(32)).astype(np.uint32)
        u = (np.arange(self.SIZE) + 0.5) / self.SIZE
        # quantiles of Gamma(2, 1): solves 1 - (1 + x) exp(-x) = u
        x = np.sqrt(2 * u) + u
        for _ in range(60):
            x = np.maximum(1e-9, x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x) + 1e-300))
        self.gamma, self.log_gamma = x.astype(np.float32), np.log(x).astype(np.float32)

    def samples(self, elements: np.ndarray, log_weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(documents, samples) uint32; elements of document d are those from starts[d] on."""
        out = np.empty((len(starts), len(self.seeds)), np.uint32)
        lw = log_weights.astype(np.float32)
        for k, seed in enumerate(self.seeds):
            h = mixed32(elements ^ seed)
            r = self.gamma[h & np.uint32(0xFFFF)]
            c = self.log_gamma[h >> np.uint32(16)]
            b = ((h * np.uint32(0x9E3779B1)) >> np.uint32(8)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(lw / r + b)
            ln_a = c - r * (t - b + np.float32(1))
            # order-preserving bits of the float, then what identifies (element, t)
            bits = ln_a.view(np.uint32)
            order = bits ^ ((bits.view(np.int32) >> 31).view(np.uint32) | np.uint32(0x80000000))
            name = mixed32(elements + t.astype(np.int32).view(np.uint32) * np.uint32(0x27D4EB2F))
            out[:, k] = np.minimum.reduceat(order.astype(np.uint64) << np.uint64(32) | name, starts).astype(np.uint32)
        return out


def slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shingle's counter in each row."""
    return keys >> np.uint32(32 - DF_BITS), (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - DF_BITS)


def shingled(docs: DataFrame) -> DataFrame:
    """rid (a number for each row), doc_id, digest, node and sorted shingles of each row."""

    def run(batches):
        for batch in small(batches):
            nodes, held = [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text)
                nodes.append(node_of(s))
                s.sort()
                held.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "doc_id", "digest")), pa.array(nodes, pa.binary()), pa.array(held, pa.binary())], names=["rid", "doc_id", "digest", "node", "shingles"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", digest().alias("digest"), "text")
    return rows.mapInArrow(run, "rid long, doc_id long, digest long, node binary, shingles binary")


def document_frequencies(sets: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by hashed shingle (two rows of counters), and their number."""
    spark, size = sets.sparkSession, 2 << DF_BITS

    def count(batches):
        table_, n = np.zeros(size, np.int64), 0
        for batch in small(batches):
            keys = [np.unique(np.frombuffer(x, np.uint32)) for x in batch.column("shingles").to_pylist()]
            for k, at in enumerate(slots(np.concatenate(keys)) if keys else ()):
                np.add.at(table_, at.astype(np.int64) + (k << DF_BITS), 1)
            n += batch.num_rows
        if n:
            part = TaskContext.get().partitionId()
            chunks = [table_[at : at + CHUNK].tobytes() for at in range(0, size, CHUNK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(chunks)), pa.int32()), pa.array([part] * len(chunks), pa.int64()), pa.array(chunks, pa.binary()), pa.array([n if k == 0 else 0 for k in range(len(chunks))], pa.int64())],
                names=["chunk", "part", "counts", "n"],
            )

    def total(key, rows):
        sums = sum(np.frombuffer(x, np.int64) for x in rows.column("counts").to_pylist())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([sums.tobytes()], pa.binary()), "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64())})

    schema = "chunk int, part long, counts binary, n long"
    parts = sets.select("shingles").mapInArrow(count, schema)
    tasks = max(1, len(sets.inputFiles()), spark.sparkContext.defaultParallelism)
    while True:  # a tree: LEVEL partial sums a task, as many levels as the tasks need
        parts = parts.withColumn("part", F.floor(F.col("part") / LEVEL)).groupBy("chunk", "part").applyInArrow(total, schema)
        tasks = -(-tasks // LEVEL)
        if tasks == 1:
            break
    out, n = np.zeros(size, np.int64), 0
    for r in parts.collect():  # 2 << DF_BITS counts in all, whatever the input; a local iterator runs a job a partition
        at = r["chunk"] * CHUNK
        out[at : at + CHUNK] += np.frombuffer(r["counts"], np.int64)
        n += r["n"]
    return out.reshape(2, -1), n


def holders(frequencies: np.ndarray) -> np.ndarray:
    """Documents that hold the shingles of each counter, without what other shingles add to most counters."""
    return np.maximum(1.0, frequencies - np.median(frequencies, axis=1, keepdims=True))


def idf_tables(frequencies: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency by counter of each row; a shingle's is the greater of its two."""
    return np.clip(np.log(max(1, n) / holders(frequencies)) / np.log(1 / RARE), IDF_LEAST, 1.0).astype(np.float32)


def spread_tables(frequencies: np.ndarray) -> np.ndarray:
    """Logarithm of the holders by counter of each row; a shingle's is the lesser of its two."""
    return np.log(holders(frequencies)).astype(np.float32)


def idf_of(keys: np.ndarray, idf: np.ndarray) -> np.ndarray:
    one, two = slots(keys)
    return np.maximum(idf[0][one], idf[1][two])


def similarity(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    """The larger of the TF-IDF and TF weighted Jaccard similarities of two multisets (sorted hashes)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    ka, na = np.unique(a, return_counts=True)
    kb, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.minimum(na[ia], nb[ib])
    plain = both.sum() / (len(a) + len(b) - both.sum())
    wa = idf_of(ka, idf)
    common = float((both * wa[ia]).sum())
    weighted = common / float((na * wa).sum() + (nb * idf_of(kb, idf)).sum() - common)
    return max(float(plain), weighted)


def digest():
    """A hash of a row's text and of whether its doc_id is null; with the doc_id (or 0) it names a row, repeated ones alike."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("text").cast("string"))


def sampled(sets: DataFrame, idf, spread) -> DataFrame:
    """rid, doc_id, digest, node, samples and central (its shingles' mean spread) of each row of ``sets`` (idf, spread: broadcast tables)."""

    def run(batches):
        sampler = Sampler(BANDS * ROWS)
        rarity, spreads = idf.value, spread.value
        for batch in small(batches, 64, 1 << 18):
            names, logs, starts, at, who = [], [], [], 0, []
            central = np.zeros(batch.num_rows, np.float32)
            for k, raw in enumerate(batch.column("shingles").to_pylist()):
                if raw:
                    keys, n = np.unique(np.frombuffer(raw, np.uint32), return_counts=True)
                    one, two = slots(keys)
                    names.append(keys)
                    logs.append(np.log(n * np.maximum(rarity[0][one], rarity[1][two])))
                    starts.append(at)
                    who.append(k)
                    at += len(keys)
                    central[k] = np.minimum(spreads[0][one], spreads[1][two]).mean()
            signs: list = [b""] * batch.num_rows
            if who:
                found = sampler.samples(np.concatenate(names), np.concatenate(logs), np.array(starts))
                for k, row in zip(who, found, strict=True):
                    signs[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "doc_id", "digest", "node")), pa.array(signs, pa.binary()), pa.array(central)], names=["rid", "doc_id", "digest", "node", "samples", "central"])

    return sets.mapInArrow(run, "rid long, doc_id long, digest long, node binary, samples binary, central float")


def node_of(sequence: np.ndarray) -> bytes:
    return hashlib.blake2b(sequence.tobytes(), digest_size=16).digest()


def _members(first: DataFrame, labels: DataFrame | None, active: DataFrame | None, rows: int) -> DataFrame:
    """(node, comp, central, band, key, rest): members of buckets, their keys of so many samples and the next samples.

    Band b's samples are those from its own on, and on from the first again.
    """
    width, around = 4 * ROWS, F.concat("samples", "samples")
    signed = first.where(F.octet_length("samples") > 0)
    if active is None:
        m = signed.select("node", "central", "samples", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    else:
        m = active.select("node", "band").join(signed.select("node", "central", "samples"), "node")
    m = m.withColumn("comp", F.col("node")) if labels is None else m.join(labels, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    after = F.col("band") * width + 1
    key = F.concat(F.unhex(F.lpad(F.hex("band"), 2, "0")), around.substr(after, F.lit(4 * rows)))
    return m.select("node", "comp", "central", "band", key.alias("key"), around.substr(after + 4 * rows, F.lit(width)).alias("rest"))


def _partners(run: list, fresh: int) -> tuple[list, list]:
    """The two hubs of a run [(node, component, central, band)], and for each row from ``fresh`` on those that it is to be compared with."""
    one = max(run, key=lambda r: (r[2], r[0]))
    two = max((r for r in run if r[1] != one[1]), key=lambda r: (r[2], r[0]), default=None)
    if two is None:
        return [one], []
    out = []
    for k in range(fresh, len(run)):
        node, comp = run[k][:2]
        out.append([x[0] for x in dict.fromkeys((one, two, *run[k - 1 : k])) if x[1] != comp] if k else [x[0] for x in (one, two) if x[1] != comp])
    return [one, two], out


_PAIRED = "node binary, band int, partners array<binary>, part long"


def _scanned(batches):
    """Sorted members to those with partners; and, with a key, those at which a task's first and last run may go on in other tasks."""
    part = TaskContext.get().partitionId() << 32
    held, held_key, old, head = [], None, 0, None  # the last run so far; the first ``old`` rows of it have been passed on; its first row
    first = True
    made: tuple[list, ...] = ([], [], [], [], [], [], [])  # node, band, partners, part, key, comp, central of rows not yet given out

    def flush():
        kinds = (pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.binary(), pa.binary(), pa.float32())
        out = pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(made, kinds, strict=True)], names=["node", "band", "partners", "part", "key", "comp", "central"])
        for column in made:
            column.clear()
        return out

    def passed(run, fresh):
        nonlocal part
        part += 1
        hubs, partners = _partners(run, fresh)
        for r, near in zip(run[fresh:], partners, strict=False):
            for column, value in zip(made, (r[0], r[3], near, part, None, None, None), strict=True):
                column.append(value)
        return hubs

    def ended(final):
        """The held run's rows; its ends too, if the task begins or ends with it."""
        nonlocal first
        if len(held) > 1:
            passed(held, old)
        if held and (first or final):
            for r in dict.fromkeys([head, *_partners(held, len(held))[0], held[-1]]):
                for column, value in zip(made, (r[0], r[3], [], 0, held_key, r[1], r[2]), strict=True):
                    column.append(value)
        first = first and not held

    for batch in small(batches, RUN):
        keys, columns = batch.column("key").to_pylist(), [batch.column(c).to_pylist() for c in ("node", "comp", "central", "band")]
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
        starts = np.flatnonzero(np.concatenate([[True], (raw[1:] != raw[:-1]).any(axis=1)])).tolist()
        for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
            if s or keys[0] != held_key:
                ended(False)
                held, old = [], 0
                if e - s == 1 and e < len(keys) and not first:
                    continue
                head = tuple(c[s] for c in columns)
            held_key = keys[s]
            held += zip(*(c[s:e] for c in columns), strict=True)
            if len(held) > RUN:
                held = list(dict.fromkeys([*passed(held, old), held[-1]]))
                old = len(held)
            if len(made[0]) >= GIVEN:
                yield flush()
    ended(True)
    if made[0]:
        yield flush()


def _paired(members: DataFrame) -> DataFrame:
    """(node, band, partners, part): members of runs with several components; part numbers the pieces of a run.

    Runs that go on in other tasks meet again at their ends: each task passes on a few members of its first and last
    run, and these are paired by key.
    """
    order, schema = ["key", "rest", "node"], f"{_PAIRED}, key binary, comp binary, central float"
    found = materialize(members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scanned, schema), "near-runs")
    own = [c.split()[0] for c in _PAIRED.split(", ")]
    ends = found.where("key is not null").select("node", "comp", "central", "band", "key")
    each, me = W.partitionBy("key"), F.struct("node", "comp")
    last = lambda rows: F.max_by(me, F.when(rows, F.struct("central", "node"))).over(each)
    hubs = ends.withColumn("one", last(F.lit(True))).withColumn("two", last(F.col("comp") != F.col("one.comp"))).withColumn("before", F.lag(me).over(each.orderBy("node")))
    near = F.filter(F.array("one", "two", "before"), lambda x: x["comp"] != F.col("comp"))
    partners = F.array_distinct(F.transform(near, lambda x: x["node"])).alias("partners")
    seams = hubs.where("two is not null").select("node", "band", partners, F.xxhash64("key").alias("part"))
    return found.where("key is null").select(*own).unionByName(seams)


def _verified(pairs: DataFrame, sets: DataFrame, idf) -> DataFrame:
    """Pairs (node, hub, part) whose similarity reaches the threshold.  A hub's shingles go to each of its parts."""

    def run(batches):
        weights = idf.value
        for batch in small(batches):
            keep = [
                similarity(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), weights) >= SIMILARITY
                for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            ]
            yield batch.select(["node", "hub"]).filter(pa.array(keep, pa.bool_()))

    held = sets.select("node", F.col("shingles").alias("a"))
    hubs = pairs.select(F.col("hub").alias("node"), "part").distinct().join(held, "node").select(F.col("node").alias("hub"), "part", F.col("a").alias("b"))
    return pairs.join(held, "node").join(hubs, ["hub", "part"]).select("node", "hub", "a", "b").mapInArrow(run, "node binary, hub binary")


def _rarest(sets: DataFrame, idf, spread) -> DataFrame:
    """(shingle, node, comp, n, n_left, w, w_left): each node's rarest shingles, one of which two texts of SIMILARITY share.

    Shingles stand in one global order, by their holders; n and w are a node's counts and weights in all, n_left and
    w_left those from the shingle on.  Texts share no more than what either has left at the first shingle they share.
    """

    def run(batches):
        rarity, spreads = idf.value, spread.value
        for batch in small(batches, 64, 1 << 18):
            at, columns = [], [[], [], [], [], []]
            for k, raw in enumerate(batch.column("shingles").to_pylist()):
                keys, n = np.unique(np.frombuffer(raw, np.uint32), return_counts=True)
                one, two = slots(keys)
                order = np.lexsort((keys, np.minimum(spreads[0][one], spreads[1][two])))
                keys, n = keys[order], n[order]
                w = n * idf_of(keys, rarity).astype(np.float64)
                n_left, w_left = n[::-1].cumsum()[::-1], w[::-1].cumsum()[::-1]
                stop = int(((n_left >= LEAST * n_left[:1]) | (w_left >= LEAST * w_left[:1])).sum())
                at.append(np.full(stop, k))
                for column, x in zip(columns, (keys.view(np.int32), np.broadcast_to(n_left[:1], len(n)), n_left, np.broadcast_to(w_left[:1], len(n)), w_left), strict=True):
                    column.append(x[:stop])
            rows = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(rows), batch.column("comp").take(rows), *(pa.array(np.concatenate(c), kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))],
                names=["node", "comp", "shingle", "n", "n_left", "w", "w_left"],
            )

    return sets.select("node", "comp", "shingles").mapInArrow(run, "node binary, comp binary, shingle int, n long, n_left long, w double, w_left double")


def _left_out(met: DataFrame, first: DataFrame, labels: DataFrame | None, sets: DataFrame, idf, spread) -> DataFrame:
    """(node, hub, part): pairs of different components among members of mixed buckets that can reach SIMILARITY.

    met: node, band of members of buckets.  A shingle of many holders is dealt over keys of LOT on one side.
    """
    members = _members(first, labels, met.select("node", "band").distinct(), ROWS).select("node", "comp", "key")
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    asked = members.join(mixed, "key", "left_semi").select("node", "comp").distinct()
    rare = materialize(_rarest(sets.join(asked, "node"), idf, spread), "near-rare")
    shared = rare.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    rows = rare.join(shared.select("shingle", F.ceil(F.col("held") / LOT).alias("lots")), "shingle")
    one = rows.withColumn("lot", F.pmod(F.xxhash64("node"), "lots")).drop("lots").alias("a")
    two = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1))).drop("lots").alias("b")
    share = LEAST / (1 + LEAST)
    can = f"least(a.n_left, b.n_left) >= {share} * (a.n + b.n) or least(a.w_left, b.w_left) >= {share} * (a.w + b.w)"
    pairs = one.join(two, ["shingle", "lot"]).where(f"a.node > b.node and a.comp <> b.comp and ({can})")
    pairs = pairs.select(F.col("a.node").alias("node"), F.col("b.node").alias("hub")).distinct()
    return pairs.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(LEVEL)))


def linked(first: DataFrame, sets: DataFrame, idf, spread) -> DataFrame:
    """(node, root) for each node with a verified link to another.  first: rid, node, samples, central; sets: rid, node, shingles."""
    labels, active, rows, met = None, None, ROWS, None
    while True:
        now = materialize(_paired(_members(first, labels, active, rows)), "near-active")
        if now.isEmpty():
            break
        if active is None:  # the shingles of members of these buckets, once each
            wanted = now.select("node").distinct().join(first.select("node", "rid"), "node").select("rid")
            sets = materialize(sets.select("rid", "node", "shingles").join(wanted, "rid", "left_semi").drop("rid"), "near-sets")
            met = now
        each = now.select("node", F.explode("partners").alias("hub"), "part")
        once = each.groupBy(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).agg(F.min(F.struct("part", "hub")).alias("x"))
        pairs = once.select(F.when(F.col("x.hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node"), "x.hub", "x.part")
        good = materialize(_verified(materialize(pairs, "near-pairs"), sets, idf), "near-links")
        if not good.isEmpty():
            labels = joined(labels, good)
        if rows == BANDS * ROWS:
            break
        active, rows = now, min(FINER * rows, BANDS * ROWS)
    if met is not None:
        good = materialize(_verified(materialize(_left_out(met, first, labels, sets, idf, spread), "near-pairs"), sets, idf), "near-links")
        if not good.isEmpty():
            labels = joined(labels, good)
    return labels if labels is not None else first.sparkSession.createDataFrame([], "node binary, root binary")


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) with the links (node, hub) of a round: only their components' roots are contracted further."""
    edges = links.select(F.col("node").alias("a"), F.col("hub").alias("b"))
    if labels is None:
        return components(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    for end in ("a", "b"):
        edges = edges.join(labels.select(F.col("node").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    step = components(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moved = labels.join(step.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(moved.unionByName(step.join(labels, "node", "left_anti")), "cc-labels")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is its component's least node.

    Every node points to its least neighbour if that is less; edges and labels are rewritten through the
    pointers (followed to their ends by doubling) until no edge joins two roots.
    """
    spark = edges.sparkSession
    edges = materialize(edges, "cc-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
        point = materialize(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("to")), "cc-point")
        while True:
            far = point.select(F.col("x").alias("to"), F.col("to").alias("next"))
            doubled = materialize(point.join(far, "to").select("x", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "cc-point")
            point = doubled.select("x", "to")
            if doubled.where("moved").isEmpty():
                break
        if labels is None:
            labels = point.select(F.col("x").alias("node"), F.col("to").alias("root"))
        else:
            step = point.select(F.col("x").alias("root"), F.col("to").alias("next"))
            labels = materialize(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-labels")
        a, b = point.select(F.col("x").alias("a"), F.col("to").alias("ta")), point.select(F.col("x").alias("b"), F.col("to").alias("tb"))
        edges = materialize(
            edges.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "cc-edges"
        )
    return labels if labels is not None else spark.createDataFrame([], edges.select(F.col("a").alias("node"), F.col("b").alias("root")).schema)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, digest, node), nodes (node, root, copies) and classes (root, class_id, class_size, keep: one row's doc_id, node and digest)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialize(shingled(rows), "near-shingles")
    frequencies, n = document_frequencies(sets)
    idf, spread = (spark.sparkContext.broadcast(x) for x in (idf_tables(frequencies, n), spread_tables(frequencies)))
    signed = materialize(sampled(sets, idf, spread), "near-samples")
    equal = signed.groupBy("node").agg(
        F.min("rid").alias("rid"), F.min("doc_id").alias("doc_id"), F.max(F.struct("doc_id", "digest")).alias("last"), F.count(F.lit(1)).alias("copies"),
        F.first("samples").alias("samples"), F.first("central").alias("central"),
    )
    # one row for each set of equal documents goes on
    first = materialize(equal, "near-first")
    roots = linked(first.select("rid", "node", "samples", "central"), sets, idf, spread)
    named = first.drop("samples", "central", "rid").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = F.max(F.struct("last.doc_id", "node", "last.digest")).alias("keep")
    sizes = materialize(named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), keep), "near-sizes")
    return signed, named.select("node", "root", "copies"), sizes


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, class_id (the class's least doc_id), class_size, copies (rows with its very shingles), kept (its largest doc_id)."""
    signed, nodes, sizes = _classes(docs)
    total = signed.count()
    ends = sizes.select("root", "class_id", "class_size", F.col("keep.doc_id").alias("keep_id"))
    groups = materialize(
        join_groups(nodes, ends, "root", "class_size", total).select("node", "class_id", "copies", "class_size", "keep_id"),
        "near-classes",
    )
    return join_groups(signed.select("doc_id", "node"), groups, "node", "copies", total).select(
        "doc_id", "class_id", "class_size", "copies", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the largest doc_id; a repeated row goes."""
    stay = _classes(docs)[2].select(F.coalesce("keep.doc_id", F.lit(0)).alias("_id"), F.col("keep.digest").alias("_digest"))
    rows = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_digest": digest()})
    return rows.join(stay, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"]).select(*docs.columns)
