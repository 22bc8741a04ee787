"""Merge-type subword encoding by a prefix table, and decoding.

For every prefix of a word exactly one token can end its encoding.  Tokens that end at a position come
from an Aho-Corasick automaton over the vocabulary; one of them is the prefix's last token if it is
compatible with the last token of the prefix before it, that is, if the two encode as themselves side by
side.  The table of last tokens is filled left to right and read backwards.  A word costs time in
proportion to its length, however long it is.

A word is a space mark and what follows up to the next; no vocabulary entry has a space mark after another
character, nor a line end, so a text's ids are those of its words, which tasks remember.  So are those of a
word's letters and of the punctuation after them, where no vocabulary entry joins the two.  Runs of space marks are entries
of equal, lowest merge score, merged from the left.

Cases: null text is empty; an empty text is begin and end alone; characters outside the vocabulary become
byte ids; every row has its result, repeated rows alike.
"""

from __future__ import annotations

import array
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm.common import small, table

MARK = "▁"
CACHE = 400_000  # words whose ids a task remembers
PAIRS = 1_000_000  # pairs of entries whose compatibility a task remembers
LONG_WORD = 48  # characters; longer ones aren't remembered
_BODY = re.compile(r"(.*?[^\W\d_])([!-/:-@\[-`{-~]+)", re.DOTALL)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encoder and decoder for a merge-type model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.piece = [sp.id_to_piece(i) for i in range(size)]
        self.control = {i for i in range(size) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: sp.get_score(i) for i in plain}
        self.chars = {c for p in self.id for c in p}
        self.runs = {len(p) for p in self.id if set(p) == {MARK}}
        self.matcher = ahocorasick.Automaton()
        for p in self.id:
            if len(p) == 1 or set(p) != {MARK}:
                self.matcher.add_word(p, (self.id[p], len(p)))
        self.matcher.make_automaton()
        #: Neighbours within entries: a word may be cut between others.
        self.joined = {pair for p in self.id for pair in zip(p, p[1:], strict=False)}
        newline = "" if "\n" in self.chars else "\n"
        self.words = re.compile(f"{MARK}+[^{MARK}{newline}]*" + (f"|\n[^{MARK}\n]*" if newline else ""))
        self.begin_bytes, self.end_bytes = (array.array("I", [x]).tobytes() for x in (self.begin, self.end))
        self.fits: dict[int, bool] = {}
        self.width = [len(p) for p in self.piece]
        self.halves: dict = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merges by score, leftmost first, and the last pair merged; only for single entries."""
        parts, last = list(text), None
        while True:
            best = max(
                ((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score),
                default=None,
            )
            if best is None:
                return parts, last
            k = -best[1]
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = ["".join(last)]

    def tree(self, token: str) -> tuple[str, str] | None:
        """The two entries that merge into ``token``; () for a character; None if its text encodes otherwise."""
        found = self.halves.get(token, 0)
        if found == 0:
            parts, last = self.merged(token)
            found = self.halves[token] = None if parts != [token] else last or ()
        return found

    def made(self, token: str) -> float:
        """When merging makes ``token``: higher scores first, characters at the start."""
        return -self.score[token] if len(token) > 1 else -1.0

    def edge(self, token: str, side: int) -> list[tuple[str, float, float]]:
        """What stands at the token's right (1) or left (0) edge in the course of its merging: entry, made, consumed."""
        found = self.edges[side].get(token)
        if found is None:
            found, until = [], float("inf")
            while True:
                found.append((token, self.made(token), until))
                halves = self.tree(token)
                if not halves:
                    break
                until, token = self.made(token), halves[side]
            self.edges[side][found[0][0]] = found
        return found

    def compatible(self, pair: int) -> bool:
        """Whether two entries (left id * size + right id) encode as themselves side by side.

        That is so if no merge across their seam comes before those that use up its sides.
        """
        if len(self.fits) > PAIRS:
            self.fits.clear()
        left, right = self.piece[pair // len(self.piece)], self.piece[pair % len(self.piece)]
        score, found = self.score, self.tree(right) is not None
        for a, made_a, until_a in self.edge(left, 1) if found else ():
            for b, made_b, until_b in self.edge(right, 0):
                s = score.get(a + b)
                if s is not None:
                    when = max(-s, made_a, made_b)
                    # of equal merges the leftmost comes first: that within the left side, before the seam's, before that within the right
                    if when < until_a and when <= until_b:
                        found = False
        self.fits[pair] = found
        return found

    def last_tokens(self, text: str) -> list[int]:
        """For each prefix the id of its last token; every character of the text is in the vocabulary."""
        last, fits, size = [-1] * len(text), self.fits, len(self.piece)
        for end, (token, length) in self.matcher.iter(text):
            if last[end] >= 0:
                continue
            before = end - length
            if before < 0:
                if self.tree(self.piece[token]) is not None:
                    last[end] = token
            else:
                pair = last[before] * size + token
                found = fits.get(pair)
                if self.compatible(pair) if found is None else found:
                    last[end] = token
        return last

    def split(self, text: str) -> list[int]:
        """The ids of a run of vocabulary characters, recovered from the end backwards."""
        last, out, at, width = self.last_tokens(text), [], len(text), self.width
        while at:
            token = last[at - 1]
            out.append(token)
            at -= width[token]
        return out[::-1]

    def run(self, n: int) -> list[int]:
        """Ids of n space marks: merged from the left as far as the vocabulary has a longer run."""
        lengths: list[int] = []
        for _ in range(n):
            lengths.append(1)
            while len(lengths) > 1 and lengths[-2] + lengths[-1] in self.runs:
                lengths[-2:] = [lengths[-2] + lengths[-1]]
        return [self.id[MARK * k] for k in lengths]

    def word(self, text: str) -> list[int]:
        """Ids of a run of space marks, maybe none, and what follows it."""
        body = text.lstrip(MARK)
        marks = len(text) - len(body)
        text = MARK + body if marks else body
        parts = [text]
        if not self.chars.issuperset(text):
            parts, start = [], 0
            for k, c in enumerate(text):
                if c not in self.chars:
                    parts += [text[start:k], c] if k > start else [c]
                    start = k + 1
            if start < len(text):
                parts.append(text[start:])
        ids: list[int] = []
        for part in parts:
            if part in self.id:
                ids += [self.id[part]] if len(part) == 1 else self.split(part)
            elif len(part) == 1:
                ids += [self.byte[b] for b in part.encode("utf-8")]
            else:
                ids += self.split(part)
        if marks and ids[0] == self.id[MARK]:
            return self.run(marks) + ids[1:]
        return self.run(marks - 1) + ids if marks > 1 else ids

    def cut(self, text: str) -> tuple[str, ...]:
        m = _BODY.fullmatch(text)
        return (m[1], m[2]) if m and (m[1][-1], m[2][0]) not in self.joined else (text,)

    def remembered(self, word: str) -> bytes:
        known, out = self.known, b""
        for part in self.cut(word):
            ids = known.get(part)
            if ids is None:
                ids = array.array("I", self.word(part)).tobytes()
                if len(part) <= LONG_WORD:
                    known[part] = ids
            out += ids
        if len(word) <= LONG_WORD:
            known[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """All ids, begin and end included, as little-endian 32-bit integers."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out = [self.begin_bytes]
        if text:
            words = self.words.findall(MARK + text.replace(" ", MARK))
            out += [known.get(w) or self.remembered(w) for w in words]
        out.append(self.end_bytes)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Text of ids: control ids vanish, byte ids join to characters, the dummy space goes."""
        if not hasattr(self, "surface"):
            self.surface = [
                b"" if i in self.control else b" \xe2\x81\x87 " if i == self.unknown else bytes([self.byte_of[i]]) if i in self.byte_of else p.encode("utf-8")
                for i, p in enumerate(self.piece)
            ]
        surface = self.surface
        raw = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()])
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@functools.lru_cache(maxsize=1)
def codec_of(path: str) -> PieceCodec:
    """One for each Python worker, which Spark uses for many tasks."""
    return PieceCodec(path)


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian 32-bit, begin and end included) and the decoded text of each document."""
    model = model or default_model()

    def run(batches):
        codec = codec_of(model)
        for batch in small(batches):
            ids = [codec.encode(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digested(docs: DataFrame, model: str | None = None) -> DataFrame:
    """The same pass, returning digests in place of ids and text."""
    model = model or default_model()

    def run(batches):
        codec = codec_of(model)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in small(batches):
            n, a, b = [], [], []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text or "")
                n.append(len(ids) // 4)
                a.append(sha(ids))
                b.append(sha(codec.decode(ids).encode("utf-8")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))
