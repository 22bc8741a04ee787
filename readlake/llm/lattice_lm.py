"""Document probability from a subword lattice.

A word's probability is the sum over all its segmentations into vocabulary pieces of the product of their
probabilities, found by a forward recursion in log space; a text's is the product over its words and the
end.  The vocabulary and its scores exist; they set first probabilities (Zipf's law in the rank that a
merge-type vocabulary's scores state), which expectation-maximisation over the training words' lattices
fits to the corpus.  Recursions run over many words at once.

1. Count words: every word of every document, with its count in training documents (map-side counts, one
   row per word).
2. Re-estimate pieces: expected counts over the distinct words, weighted by training counts (at most one
   row per piece comes to the driver).
3. Give each distinct word its marginal.
4. Score documents: words holding at least 1 / SHARE of the training tokens (so at most SHARE of them)
   come by broadcast, long ones as digests; the others are joined by word, where none is frequent.

Beside it the plain word model: add-half counts of words.

Cases: null or empty text is the end token alone; a null doc_id counts as an empty string for the
hold-out; with no training text all words are unknown; repeated rows are scored (and counted) as rows.
"""

from __future__ import annotations

import array
import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm.common import materialize, small, table

FOLDS, HELD_OUT = 5, 1
SHARE = 1_000_000
LONG_WORD = 64  # bytes; longer words go by a digest
BLOCK = 200_000  # characters that are worked through at once
LONG_BLOCK = 2_000  # characters; longer words are worked through one by one
FLUSH = 200_000  # words that a task counts before it passes them on
PRIOR = 3_200.0  # pseudo-count of the first probabilities
ROUNDS = 2  # of expectation-maximisation
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces by rolling hash, for whole arrays of substrings at once.  The last id is the end of a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = [sp.id_to_piece(i) for i in plain]
        scores = np.array([sp.get_score(i) for i in plain])
        rank = np.empty(len(plain))
        rank[np.argsort(-scores, kind="stable")] = np.arange(len(plain))
        self.bytes_at = len(plain)  # then 256 bytes, then the end
        weight = np.concatenate([1 / (rank + 10), np.full(256, 1e-6), [1e-2]])
        self.first = weight / weight.sum()
        self.longest = max(map(len, self.pieces))
        self.lengths = [len(p) for p in self.pieces]
        self.single = {p for p in self.pieces if len(p) == 1}
        self.automaton = None
        self.keys = np.array([self.hash(p) for p in self.pieces], np.uint64)
        self.tables = []
        rest = np.arange(len(self.keys))
        for shift in (44, 40, 36):  # each holds what collides in those before
            slot = self.slot(self.keys[rest], shift)
            table_id = np.full(1 << 20, -1, np.int32)
            table_id[slot[::-1]] = rest[::-1]
            self.tables.append((shift, table_id))
            rest = rest[table_id[slot] != rest]
            if not len(rest):
                break
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)

    @staticmethod
    def hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def slot(keys: np.ndarray, shift: int) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(shift)).astype(np.int64) & ((1 << 20) - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are pieces, in order, and the pieces' ids."""
        place, places, found = np.arange(len(keys)), [], []
        for shift, table_id in self.tables:
            ids = table_id[self.slot(keys, shift)]
            taken = np.flatnonzero(ids >= 0)  # only what meets another piece here can be in the next table
            ids, keys, place = ids[taken], keys[taken], place[taken]
            same = self.keys[ids] == keys
            places.append(place[same])
            found.append(ids[same])
            keys, place = keys[~same], place[~same]
            if not len(keys):
                break
        where, ids = np.concatenate(places), np.concatenate(found)
        order = np.argsort(where, kind="stable")
        return where[order], ids[order]

    def spelled(self, code: int, logp: np.ndarray) -> tuple[float, list[int]]:
        ids = [self.bytes_at + b for b in chr(code).encode("utf-8", "replace")]
        return float(logp[ids].sum()), ids

    def lattices(self, words: list[str], logp: np.ndarray, weights: np.ndarray | None = None):
        """Natural log of each word's marginal; with weights also the expected uses of each id."""
        out = np.zeros(len(words))
        uses = np.zeros(len(logp)) if weights is not None else None
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            n = length[order[at]]
            if n > LONG_BLOCK:
                i = order[at]
                out[i] = self._long(MARK + words[i], logp, 0.0 if weights is None else float(weights[i]), uses)
                at += 1
                continue
            width = length[order[at : at + BLOCK // int(n) + 1]]  # sorted, so a block is as wide as its last word
            fits = (width <= LONG_BLOCK) & (width * np.arange(1, len(width) + 1) <= BLOCK)
            stop = at + max(1, int(fits.sum()))
            pick = order[at:stop]
            text = "".join([MARK + words[i] for i in pick])
            codes = np.zeros((len(pick), length[pick[-1]]), np.uint32)
            codes[np.arange(codes.shape[1]) < length[pick][:, None]] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            out[pick] = self._block(codes, length[pick], logp, None if weights is None else weights[pick], uses)
            at = stop
        return (out, uses) if weights is not None else out

    def _long(self, text: str, logp: np.ndarray, weight: float, uses) -> float:
        """One long word: pieces come from an automaton, in time and memory proportional to its length."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for k, p in enumerate(self.pieces):
                self.automaton.add_word(p, (k, len(p)))
            self.automaton.make_automaton()
        lp, spelt = logp.tolist(), {c: self.spelled(ord(c), logp) for c in set(text) - self.single}
        ahead = [-math.inf] * (len(text) + 1)
        ahead[0] = 0.0
        matches = self.automaton.iter(text)
        end, piece = next(matches, (len(text), None))
        held = array.array("i")  # (end, piece) of each match, in order
        for j, c in enumerate(text):
            best = [ahead[j] + spelt[c][0]] if c in spelt else []
            while end == j:
                k, n = piece
                held.extend((j + 1, k))
                best.append(ahead[j + 1 - n] + lp[k])
                end, piece = next(matches, (len(text), None))
            top = max(best)
            ahead[j + 1] = top + math.log(sum([math.exp(x - top) for x in best])) if len(best) > 1 else top
        if weight and uses is not None:
            total, behind = ahead[-1], [-math.inf] * (len(text) + 1)
            behind[-1] = 0.0
            at = len(held)
            for j in range(len(text), 0, -1):  # everything that starts at j has been seen when its end comes up
                b = behind[j]
                c = text[j - 1]
                if c in spelt:
                    p, ids = spelt[c]
                    share = weight * math.exp(ahead[j - 1] + p + b - total)
                    for x in ids:
                        uses[x] += share
                    behind[j - 1] = float(np.logaddexp(behind[j - 1], b + p))
                while at and held[at - 2] == j:
                    k = held[at - 1]
                    i = j - self.lengths[k]
                    uses[k] += weight * math.exp(ahead[i] + lp[k] + b - total)
                    x, y = behind[i], b + lp[k]
                    behind[i] = y if x == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
                    at -= 2
        return ahead[-1]

    def _block(self, codes: np.ndarray, length: np.ndarray, logp: np.ndarray, weights, uses) -> np.ndarray:
        """Many words at once, in order of length: those that reach character j are the last ones."""
        rows, n = codes.shape
        reach = np.searchsorted(length, np.arange(n + 1))  # the first row of so many characters
        prefix = np.zeros((n + 1, rows), np.uint64)
        for j in range(n):
            prefix[j + 1] = prefix[j] * _BASE + codes[:, j] + np.uint64(1)
        ahead = np.full((n + 1, rows), -np.inf)
        ahead[0] = 0.0
        edges = []  # (from, to, rows, ids, log probability) of what is found
        bytewise = []  # (to, rows, kind of each, log probability, kinds) of characters without a piece
        for j in range(1, n + 1):
            low = reach[j]
            for size in range(1, min(j, self.longest) + 1):
                where, ids = self.find(prefix[j, low:] - prefix[j - size, low:] * self.powers[size])
                where += low
                if len(where):
                    p = logp[ids]
                    ahead[j, where] = np.logaddexp(ahead[j, where], ahead[j - size, where] + p)
                    edges.append((j - size, j, where, ids, p))
                if size == 1 and len(where) < rows - low:
                    lost = np.setdiff1d(np.arange(low, rows), where, assume_unique=True)
                    kinds, inverse = np.unique(codes[lost, j - 1], return_inverse=True)
                    spelled = [self.spelled(int(c), logp) for c in kinds]
                    p = np.array([x for x, _ in spelled])[inverse]
                    ahead[j, lost] = ahead[j - 1, lost] + p
                    bytewise.append((j, lost, inverse, p, spelled))
        total = ahead[length, np.arange(rows)]
        if weights is not None and weights.any():
            behind = np.full((n + 1, rows), -np.inf)
            behind[length, np.arange(rows)] = 0.0
            steps = [(i, j, where, p) for i, j, where, _, p in edges] + [(j - 1, j, lost, p) for j, lost, _, p, _ in bytewise]
            for i, j, where, p in sorted(steps, key=lambda x: -x[1]):
                behind[i, where] = np.logaddexp(behind[i, where], behind[j, where] + p)
            share = lambda i, j, where, p: weights[where] * np.exp(ahead[i, where] + p + behind[j, where] - total[where])
            if edges:
                mass = np.concatenate([share(i, j, where, p) for i, j, where, _, p in edges])
                uses += np.bincount(np.concatenate([x[3] for x in edges]), mass, len(uses))
            for j, lost, inverse, p, spelled in bytewise:
                for k, mass in enumerate(np.bincount(inverse, share(j - 1, j, lost, p), len(spelled))):
                    for b in spelled[k][1]:
                        uses[b] += mass
        return total


_held: dict = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    if path not in _held:
        _held[path] = Vocabulary(path)
    return _held[path]


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def key_of(word: bytes) -> bytes:
    """A word, or a digest of a long one (which starts with a byte that no word holds), so that keys have a bounded size."""
    return word if len(word) <= LONG_WORD else b"\xff" + hashlib.blake2b(word, digest_size=24).digest()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) for every word of rows (text, held_out); c counts training rows only."""

    def run(batches):
        known: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(known.keys(), pa.binary()), pa.array(known.values(), pa.int64())], names=["word", "c"])
            known.clear()
            return out

        for batch in small(batches):
            for text, held in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist(), strict=True):
                if held:
                    for w in set(tokens_of(text)):
                        known[w] += 0
                else:
                    known.update(tokens_of(text))
            if len(known) > FLUSH:
                yield flush()
        yield flush()

    return rows.select("text", "held_out").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fitted(words: DataFrame, model: str, ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of pieces, bytes and the end."""
    spark, first = words.sparkSession, vocabulary(model).first
    p = first
    trained = words.where("c > 0")
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(np.log(p))

        def expected(batches, now=now):
            vocab, total = vocabulary(model), 0.0
            for batch in small(batches, 1 << 14, 1 << 20):
                text = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
                total = total + vocab.lattices(text, now.value, batch.column("c").to_numpy().astype(float))[1]
            if isinstance(total, np.ndarray):
                ids = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.float64())], names=["id", "uses"])

        uses = np.zeros(len(first))
        for row in trained.mapInArrow(expected, "id int, uses double").groupBy("id").agg(F.sum("uses").alias("uses")).collect():  # one row per piece at most
            uses[row["id"]] = row["uses"]
        uses[-1] = ends
        p = (uses + PRIOR * first) / (uses.sum() + PRIOR)
    return np.log(p)


def scored(docs: DataFrame, model: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (rounds=0: by the vocabulary's own scores alone)."""
    spark, model = docs.sparkSession, model or default_model()
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold == HELD_OUT).alias("held_out"))
    counts = materialize(word_counts(rows), "words")
    ends = rows.where("not held_out").count()
    stats = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    total, distinct = (stats["n"] or 0) + ends, stats["v"] + (ends > 0)
    norm = total + 0.5 * (distinct + 1)
    logp = spark.sparkContext.broadcast(fitted(counts, model, ends, rounds))
    end_base, end_score = math.log10((ends + 0.5) / norm), float(logp.value[-1]) / math.log(10)

    def marginal(batches):
        vocab = vocabulary(model)
        for batch in small(batches, 1 << 14, 1 << 20):
            text = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            lp = vocab.lattices(text, logp.value) / math.log(10)
            yield pa.RecordBatch.from_arrays([pa.array([key_of(w) for w in batch.column("word").to_pylist()], pa.binary()), batch.column("c"), pa.array(lp, pa.float64())], names=["word", "c", "lp"])

    words = materialize(counts.mapInArrow(marginal, "word binary, c long, lp double"), "word-scores")
    often = (F.col("c") * SHARE >= total) & (F.col("c") > 0)
    top = words.where(often).toArrow()  # at most SHARE rows of at most LONG_WORD bytes
    known = spark.sparkContext.broadcast(
        {w: (math.log10((c + 0.5) / norm), lp) for w, c, lp in zip(*(top.column(k).to_pylist() for k in ("word", "c", "lp")), strict=True)}
    )

    def score(batches):
        table_ = known.value
        kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
        for batch in small(batches):
            n, found, base, lp, rest = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words_ = tokens_of(text)
                hits, b, s, others = 0, 0.0, 0.0, []
                for w, k in Counter(words_).items():
                    w = key_of(w)
                    hit = table_.get(w)
                    if hit is None:
                        others.append({"word": w, "n": k})
                    else:
                        hits += k
                        b += k * hit[0]
                        s += k * hit[1]
                n.append(len(words_) + 1)
                found.append(hits)
                base.append(b)
                lp.append(s)
                rest.append(others)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(found, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(lp, pa.float64()), pa.array(rest, kind),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lp", "rest"],
            )

    part = materialize(
        rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
            score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lp double, rest array<struct<word:binary,n:int>>"
        ),
        "doc-scores",
    )
    rest = part.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n")
    more = (
        rest.join(words.where(~often), "word")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
            F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(norm))).alias("more_base"),
            F.sum(F.col("n") * F.col("lp")).alias("more_lp"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return part.drop("rest").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("more_known") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + end_base).alias("base_score"),
        (F.col("lp") + F.coalesce("more_lp", F.lit(0.0)) + end_score).alias("score"),
    )


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
