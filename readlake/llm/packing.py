"""Best-fit packing by length patterns fitted to the histogram.

A packing needs only the histogram of piece lengths (at most MAX_LEN bins, whatever the corpus):

1. tokenise, cut and hash every document on the executors; keep one small row per piece;
2. count the lengths; enumerate patterns of two to MOST lengths that fill a sequence exactly;
3. fit how often each pattern is used to the histogram by non-negative least squares, in which short
   lengths weigh less, as they also fill gaps; use whole repeats, then one more of the patterns with the
   largest remainders; enumerate and fit anew for what is left, until that places little;
4. pack what remains by best fit on the histogram: the longest remaining length first, then always the
   longest that fits, the whole pattern repeated as long as its lengths last.

The plan is a table of (length, first rank, repeats, ...) rows, bounded by MAX_LEN and not by the corpus.
Pieces get their rank within a length from a two-level count, so that a length which many pieces share
(copies) is spread over buckets, and find their place by binary search in the broadcast plan.

Cases: null or empty text is the lone end id; longer documents are cut into MAX_LEN pieces; repeated rows
are packed as documents of their own; an empty table packs to nothing.
"""

from __future__ import annotations

import array
import bisect
import functools
import os
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.llm.common import materialize, small, table

MAX_LEN = 4096
END_ID = 1
CACHE = 64 << 20  # bytes that a worker's words and their ids may take
OVERHEAD = 200  # bytes of an entry beside its word and ids
GROUP = 512  # words that are encoded as one text
LOT = 1 << 14  # distinct words that are looked at together
LONG_WORD = 64  # bytes; longer ones aren't remembered
MOST = 6  # documents of a pattern
DRAWS = 12_000  # candidate patterns of each number of documents that a round draws; rounds draw anew
ROUNDS = 12  # of fitting, at most; best fit packs whatever they leave
LEAST_FIT = 0.02  # repeats below which a pattern isn't used
LEAST_GAIN = 0.05  # share of pieces that a round must place for another one
STEPS = 150

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Remembered:
    """Bytes by key, in two generations: when the younger is full, the elder goes, so what is used often stays."""

    def __init__(self, limit: int):
        self.limit, self.held = limit // 2, 0
        self.young: dict = {}
        self.elder: dict = {}

    def missing(self, keys) -> list:
        """Keys that aren't known; the others are in ``young`` from now on."""
        if self.held > self.limit:
            self.young, self.elder, self.held = {}, self.young, 0
        young, elder, out = self.young, self.elder, []
        for k in keys:
            if k not in young:
                if k in elder:
                    self.put(k, elder[k])
                else:
                    out.append(k)
        return out

    def put(self, key, value: bytes) -> None:
        self.young[key] = value
        self.held += OVERHEAD + len(key) + len(value)

    def forget(self, keys) -> None:
        for k in keys:
            self.held -= OVERHEAD + len(k) + len(self.young.pop(k))


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words
    (split at ASCII white space) in order.  It also lower-cases
    and separates letters from what follows, so a word is looked up as lower-case letters and a tail of ASCII
    punctuation; these repeat, so their ids are remembered.
    """

    parts = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        tokenizer = Tokenizer.from_file(path)
        self.encode = tokenizer.encode_batch_fast
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)  # tokens that end a word
        for token, k in tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")
        self.cores = Remembered(CACHE)

    def halves(self, word: str) -> tuple[str, str]:
        """Two strings whose ids make up the word's; a word that isn't letters and punctuation stays whole."""
        if "<|" in word:  # may spell a special token
            return word, ""
        m = self.parts.fullmatch(word)
        if not m or len(m[1][-1].lower()) > 1:  # a letter whose lower case ends in a mark, which would join the tail
            return word, ""
        return m[1].lower() if m[1].isascii() else m[1], m[2]

    def encoded(self, cores: list[str]):
        """(core, ids): runs of lower-case letters, which are one word each, are encoded many at a time and told apart by their last tokens."""
        plain = [x for x in cores if x.isalpha() and x.islower() and (x.isascii() or (x == x.lower() and unicodedata.is_normalized("NFC", x)))]
        groups = [plain[k : k + GROUP] for k in range(0, len(plain), GROUP)]
        alone = list(set(cores).difference(plain))
        for group, e in zip(groups, self.encode([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(group):
                alone += group
                continue
            raw, at = ids.tobytes(), 0
            for x, stop in zip(group, stops.tolist(), strict=True):
                yield x, raw[at:stop]
                at = stop
        for x, e in zip(alone, self.encode(alone, add_special_tokens=False), strict=True):
            yield x, array.array("I", e.ids).tobytes()

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        pairs = list(map(self.halves, words))
        cores = self.cores.missing({y for pair in pairs for y in pair})
        for x, ids in self.encoded(cores):
            self.cores.put(x, ids)
        part = self.cores.young
        out = [part[a] + part[b] for a, b in pairs]
        self.cores.forget([x for x in cores if len(x) > LONG_WORD])
        return out

    def ids(self, texts: pa.Array) -> list[memoryview]:
        """The ids of each text.  Words are split, numbered and put together again by Arrow; only distinct ones are looked at."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        numbered = words.flatten().dictionary_encode()
        distinct = numbered.dictionary
        lots = range(0, max(1, len(distinct)), LOT)
        ids = pa.concat_arrays([pa.array(self.learn(distinct.slice(k, LOT).to_pylist()), pa.large_binary()) for k in lots]).take(numbered.indices)
        if not len(ids):
            return [memoryview(b"")] * len(texts)
        edges = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :]
        at = edges[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, which Spark uses for many tasks; what it remembers is bounded in bytes."""
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches):
        encoder, end = word_encoder(tokenizer), array.array("I", [end_id]).tobytes()
        for batch in small(batches, 1 << 14, 8 << 20):
            out = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids(batch.column("text")), strict=True):
                n, size = len(ids) // 4 + 1, 4 * max_len
                for k, at in enumerate(range(0, 4 * n, size)):
                    part, last = ids[at : at + size], at + size >= 4 * n
                    crc = zlib.crc32(end, zlib.crc32(part)) if last else zlib.crc32(part)
                    out.append((doc, k, at // 4, len(part) // 4 + last, crc))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


def exact_patterns(hist: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Rows of two to MOST lengths (0: none) that sum to ``size``, all present, longest first.

    All pairs are there; of longer patterns a round's DRAWS: lengths drawn as often as the histogram has them,
    and one length, or two, that fill what is left exactly.
    """
    rng = np.random.default_rng(seed)
    have = np.flatnonzero(hist)
    have = have[(have > 0) & (have < size)]
    rows = [np.array([(size - x, x) for x in have if x <= size - x and hist[size - x]], np.int64).reshape(-1, 2)]
    if len(have):
        share = np.cumsum(hist[have] / hist[have].sum())
        draw = lambda n: have[np.minimum(np.searchsorted(share, rng.random(n)), len(have) - 1)]
        for k in range(2, MOST):
            some = np.column_stack([draw(DRAWS) for _ in range(k)])
            room = size - some.sum(axis=1)
            ok = (room > 0) & (room < size)
            ok[ok] = hist[room[ok]] > 0
            rows.append(np.column_stack([some[ok], room[ok]]))
    wide = [np.pad(r, ((0, 0), (0, MOST - r.shape[1]))) for r in rows]
    return np.unique(-np.sort(-np.concatenate(wide), axis=1), axis=0)


def fit_counts(hist: np.ndarray, patterns: np.ndarray, size: int) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 with sum of patterns near the histogram.

    Projected gradient with momentum on the sparse system; short lengths weigh less.
    """
    if not len(patterns):
        return np.zeros(0)
    weight = np.where(np.arange(size + 1) < size // 8, 0.1, 1.0)
    weight[0] = 0

    def applied(x):
        return np.bincount(patterns.ravel(), np.repeat(x, patterns.shape[1]), size + 1)

    rate = 1.0 / max(1.0, applied(np.ones(len(patterns)))[1:].max() * patterns.shape[1])
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(STEPS):
        slope = (weight * (applied(y) - hist))[patterns].sum(axis=1)
        nxt = np.maximum(0, y - rate * slope)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def fitted_sequences(hist: np.ndarray, size: int = MAX_LEN) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(lengths of a sequence, longest first; repeats) from fitted patterns, and the histogram of what they leave."""
    left, plan = hist.astype(np.int64).copy(), []
    if left[size]:
        plan.append(((size,), int(left[size])))
        left[size] = 0
    for seed in range(ROUNDS):
        patterns = exact_patterns(left, size, seed)
        fit = fit_counts(left.astype(float), patterns, size)
        before = left.sum()
        # whole repeats first, then one more of those with the largest remainders, as far as the histogram has the lengths
        for counts, order in ((np.floor(fit), np.argsort(-fit, kind="stable")), (np.ones(len(fit)), np.argsort(np.floor(fit) - fit, kind="stable"))):
            for k in order:
                if counts[k] < 1 or fit[k] < LEAST_FIT:
                    continue
                need = Counter(int(x) for x in patterns[k] if x)
                times = min(int(counts[k]), *(int(left[x]) // n for x, n in need.items()))
                if times > 0:
                    plan.append((tuple(int(x) for x in patterns[k] if x), times))
                    for x, n in need.items():
                        left[x] -= n * times
        if before - left.sum() < LEAST_GAIN * before:
            break
    return plan, left


def plan_sequences(hist: np.ndarray, size: int = MAX_LEN) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, longest first; repeats), using every piece of the histogram exactly once."""
    plan, left = fitted_sequences(hist, size)
    have = [int(x) for x in np.flatnonzero(left)]  # ascending
    while have:
        lengths: list[tuple[int, int]] = []
        room, top = size, len(have)
        while room and (top := bisect.bisect_right(have, room, 0, top)):
            x = have[top - 1]
            n = min(room // x, int(left[x]))
            lengths.append((x, n))
            room -= n * x
            top -= 1
        times = min(int(left[x]) // n for x, n in lengths)
        plan.append((tuple(x for x, n in lengths for _ in range(n)), times))
        for x, n in lengths:
            left[x] -= n * times
            if not left[x]:
                have.pop(bisect.bisect_left(have, x))
    return plan


def placement_table(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Sorted by (length, first rank): [length, first rank, repeats, first sequence, offset].

    The pieces of a length with ranks first..first+repeats-1 go to consecutive sequences at one offset.
    """
    rows, seen, sequence = [], {}, 0
    for lengths, times in plan:
        offset = 0
        for x in lengths:
            first = seen.get(x, 0)
            rows.append((x, first, times, sequence, offset))
            seen[x], offset = first + times, offset + x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(rows: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Pieces with their sequence_id and offset.  ``rows``: doc_id, piece, length and any other columns."""
    spark = rows.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    rows = rows.withColumn("_bucket", spread)
    # at most max_len x buckets counts: their running sum within a length gives each bucket's first rank
    counts = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("n")
    first = counts.select(F.col("length").alias("_length"), F.col("_bucket").alias("_b"), before.alias("_before"))
    hist = np.zeros(max_len + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most max_len rows
        hist[length] = n
    where = spark.sparkContext.broadcast(placement_table(plan_sequences(hist, max_len)))
    rank = F.row_number().over(W.partitionBy("_bucket", "length").orderBy("doc_id", "piece")) - 1
    ranked = (
        rows.repartition(buckets, "_bucket", "length")
        .withColumn("_rank", rank)
        .join(first, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .drop("_length", "_b", "_before", "_bucket")
    )
    kept = [f for f in ranked.schema.fields if f.name != "_rank"]

    def place(batches):
        plan = where.value
        key = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            length, at = (batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            hit = plan[np.searchsorted(key, length << 44 | at, side="right") - 1] if len(at) else plan[:0]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(hit[:, 3] + at - hit[:, 1], pa.int64()), pa.array(hit[:, 4], pa.int64())],
                names=[*(f.name for f in kept), "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, max_len: int = MAX_LEN) -> DataFrame:
    rows = materialize(pieces(docs, tokenizer, max_len), "pieces")
    return packed(rows, max_len).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)
