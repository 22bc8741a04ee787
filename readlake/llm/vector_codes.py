"""Vector compression by product codes, fitted by Lloyd rounds over partition-local cover trees.

A vector is cut into PARTS parts; each part is replaced by the nearest of ENTRIES codebook entries.  All numbers
are integers (components are scaled by SCALE and floored), so that results don't depend on the order of sums.

1. Each task cuts its rows into chunks of CHUNK vectors and builds a cover tree of each part of a chunk: a node
   covers its descendants within its radius, its children are centres more than half the covering distance apart,
   one of them the node's own centre.  Points lie in the tree's order, so that a subtree is a slice of them, and
   cumulative sums give a subtree's sum in two reads.  Equal parts end in one leaf, however many they are.  Trees
   are written once and read in each round.
2. A round walks the trees level by level.  Where a centre's distance to its second nearest entry exceeds that to
   its nearest by more than twice the node's radius, all of the subtree has that nearest entry (the triangle
   inequality): its sum is added whole.  Other nodes descend; a leaf's distances are exact integers, and ties go
   to the lower index.  A point's distances to the entries are worked out once at most, as a node's centre stays the
   centre of one of its children.
3. Tasks emit one row for each entry; Spark adds these up, and the driver holds codebooks only (PARTS * ENTRIES
   rows), which go to the tasks of the next round.

Cases: rows whose vector is null or holds null or non-finite components are left out, as are those whose scaled
components pass LARGEST (their squared distances might not fit a long) and those of another length than the vector
of the smallest vec_id; lengths that PARTS doesn't divide are cut as evenly as they go; a null vec_id is the
largest; repeated vec_ids are rows of their own, in the order of their vectors; fewer vectors than ENTRIES give as
many entries; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.llm.common import discard, fresh_path, join_groups, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CHUNK = 2048  # vectors of a tree
LARGEST = 1 << 24
_EXACT = 1 << 20  # up to here products of components and their sums are exact in doubles, and so go through BLAS
_SLACK = 1e-9  # more than the rounding of square roots, relative to their size


def cuts(width: int) -> list[int]:
    return [width * k // PARTS for k in range(PARTS + 1)]


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """All squared distances, exact."""
    most = max((int(np.abs(x).max()) for x in (points, entries) if x.size), default=0)
    if most <= _EXACT:
        a, b = points.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(points), len(entries)), np.int64)
    for k, entry in enumerate(entries):
        diff = points - entry
        out[:, k] = (diff * diff).sum(1)
    return out


class CoverTree:
    """A cover tree of integer points, as arrays by node in level order: centre, radius, lo, hi, first child, children.

    ``order`` holds the points' rows in the tree's order; centre, lo and hi are places in it.
    """

    FIELDS = ("centre", "radius", "lo", "hi", "child", "children")

    def __init__(self, order: np.ndarray, nodes: np.ndarray):
        self.order = order
        self.centre, self.lo, self.hi, self.child, self.children = (nodes[k].astype(np.int64) for k in (0, 2, 3, 4, 5))
        self.radius = nodes[1]

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        order = np.arange(len(points))
        far = np.sqrt(squared(points, points[:1])[:, 0].astype(np.float64))
        nodes = [[0, float(far.max()), 0, len(points), 0, 0]]  # a node's centre is the first of its slice
        at = 0
        while at < len(nodes):
            _, radius, lo, hi, _, _ = nodes[at]
            if radius > 0:
                half, rest, begin = radius / 2, order[lo:hi].copy(), lo
                nodes[at][4] = len(nodes)
                while len(rest):
                    far = np.sqrt(squared(points[rest], points[rest[:1]])[:, 0].astype(np.float64))
                    near = far <= half
                    own = rest[near]
                    order[begin : begin + len(own)] = own
                    nodes.append([begin, float(far[near].max()), begin, begin + len(own), 0, 0])
                    begin += len(own)
                    rest = rest[~near]
                nodes[at][5] = len(nodes) - nodes[at][4]
            at += 1
        return cls(order, np.array(nodes, np.float64).T)

    def packed(self) -> np.ndarray:
        return np.array([getattr(self, f) for f in self.FIELDS], np.float64)

    def assign(self, points: np.ndarray, entries: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest entry of each of ``points`` (in the tree's order), count and sum by entry, and how many points met all entries.

        ``entries`` are distinct; ``book`` holds the index of each in the codebook.
        """
        n = len(points)
        sums = np.zeros((len(points) + 1, points.shape[1]), np.int64)
        np.cumsum(points, axis=0, out=sums[1:])
        best, gap, known = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
        label = np.zeros(n, np.int64)
        count, total = np.zeros(len(entries), np.int64), np.zeros((len(entries), points.shape[1]), np.int64)
        front = np.array([0])
        while len(front):
            centre = self.centre[front]
            new = np.unique(centre[~known[centre]])
            for some in np.array_split(new, max(1, len(new) // 2048)):
                d = squared(points[some], entries)
                best[some] = d.argmin(1)
                if len(entries) > 1:
                    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
                    gap[some] = two[:, 1] * (1 - _SLACK) - two[:, 0] * (1 + _SLACK)
                else:
                    gap[some] = np.inf
                known[some] = True
            radius = self.radius[front]
            sure = (radius == 0) | (gap[centre] > 2 * radius * (1 + _SLACK))
            settled = front[sure]
            entry = best[self.centre[settled]]
            size = self.hi[settled] - self.lo[settled]
            np.add.at(count, entry, size)
            np.add.at(total, entry, sums[self.hi[settled]] - sums[self.lo[settled]])
            inside = np.repeat(self.lo[settled] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(settled) else np.zeros(0, np.int64)
            label[inside] = np.repeat(entry, size)
            front = front[~sure]
            many = self.children[front]
            front = np.repeat(self.child[front] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(front) else front
        return book[label], count, total, int(known.sum())


def _scaled(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(batch.num_rows, width) * SCALE).astype(np.int64)


def _whole(values: pa.Array) -> pa.ListArray:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


FOREST = ("orders", "nodes", "points")


def _forest(width: int):
    """Batches of (vec_id, label, embedding) to one row for each chunk, with the trees of its parts."""

    def row(ids: list, labels: list, points: np.ndarray) -> pa.RecordBatch:
        kept = {name: [] for name in FOREST}
        for a, b in zip(cuts(width), cuts(width)[1:], strict=False):
            tree = CoverTree.build(points[:, a:b])
            kept["orders"].append(tree.order.astype("<i4").tobytes())
            kept["nodes"].append(tree.packed().tobytes())
            kept["points"].append(np.ascontiguousarray(points[tree.order, a:b].astype("<i4")).tobytes())
        own = [pa.array([kept[name]], pa.list_(pa.binary())) for name in FOREST]
        return pa.RecordBatch.from_arrays([_whole(pa.concat_arrays(ids)), _whole(pa.concat_arrays(labels)), *own], names=["ids", "labels", *FOREST])

    def made(batches):
        ids, labels, rows, held = [], [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, CHUNK - held)
                ids.append(piece.column(0))
                labels.append(piece.column(1))
                rows.append(_scaled(piece, width))
                at += piece.num_rows
                held += piece.num_rows
                if held == CHUNK:
                    yield row(ids, labels, np.concatenate(rows))
                    ids, labels, rows, held = [], [], [], 0
        if held:
            yield row(ids, labels, np.concatenate(rows))

    return made


def _read(row: dict, part: int, width: int) -> tuple[CoverTree, np.ndarray]:
    tree = CoverTree(np.frombuffer(row["orders"][part], "<i4"), np.frombuffer(row["nodes"][part], np.float64).reshape(len(CoverTree.FIELDS), -1))
    n = len(tree.order)
    return tree, np.frombuffer(row["points"][part], "<i4").reshape(n, width).astype(np.int64) if width else np.zeros((n, 0), np.int64)


def _distinct(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries in the order of their lowest index, and these indexes."""
    if not entries.shape[1]:
        return entries[:1], np.zeros(1, np.int64)
    _, first = np.unique(entries, axis=0, return_index=True)
    first.sort()
    return entries[first], first


def _sums(books: list[np.ndarray]):
    """Chunks to one row a task for each part and entry: count, and the sum by component."""
    width = max(b.shape[1] for b in books)
    names = ["part", "entry", "n", *(f"s{k}" for k in range(width))]

    def made(batches):
        own = [_distinct(b) for b in books]
        count = [np.zeros(len(e), np.int64) for e, _ in own]
        total = [np.zeros(e.shape, np.int64) for e, _ in own]
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                for part, (entries, index) in enumerate(own):
                    tree, points = _read(row, part, entries.shape[1])
                    _, n, s, _ = tree.assign(points, entries, index)
                    count[part] += n
                    total[part] += s
        for part, (_, index) in enumerate(own):
            used = count[part] > 0
            s = np.zeros((int(used.sum()), width), np.int64)
            s[:, : total[part].shape[1]] = total[part][used]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), part)), pa.array(index[used]), pa.array(count[part][used]), *(pa.array(np.ascontiguousarray(s[:, k])) for k in range(width))], names=names)

    return made, names


def _codes(books: list[np.ndarray]):
    """Chunks to vec_id, label, code and error of their vectors."""

    def made(batches):
        own = [_distinct(b) for b in books]
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = one.select(FOREST).to_pylist()[0]
                n = len(one.column(0)[0])
                code, error = np.empty((n, PARTS), np.uint8), np.zeros(n, np.int64)
                for part, (entries, index) in enumerate(own):
                    tree, points = _read(row, part, entries.shape[1])
                    label = tree.assign(points, entries, index)[0]
                    code[tree.order, part] = label
                    error[tree.order] += ((points - books[part][label]) ** 2).sum(1)
                text = code.tobytes().hex()
                hexed = [text[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(n)]
                yield pa.RecordBatch.from_arrays([one.column(0)[0].values, one.column(1)[0].values, pa.array(hexed, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return made


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that can be coded, but for their length."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / SCALE))
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & good)


def first_books(kept: DataFrame) -> list[np.ndarray]:
    """The parts of the ENTRIES smallest vec_ids' vectors, all of the length of the smallest's."""
    kept = kept.select("vec_id", "embedding")
    order = (F.col("vec_id").asc_nulls_last(), F.col("embedding").asc())
    least = kept.orderBy(*order).limit(1).collect()
    if not least:
        return []
    width = len(least[0]["embedding"])
    rows = kept.where(F.size("embedding") == width).orderBy(*order).limit(ENTRIES).collect()
    points = np.floor(np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), width) * SCALE).astype(np.int64)
    return [points[:, a:b] for a, b in zip(cuts(width), cuts(width)[1:], strict=False)]


def forest_of(kept: DataFrame, width: int) -> DataFrame:
    """ids, labels, orders, nodes, points: the cover trees of all chunks, made without a shuffle."""
    types = dict(kept.dtypes)
    binaries = ", ".join(f"{name} array<binary>" for name in FOREST)
    return kept.where(F.size("embedding") == width).mapInArrow(_forest(width), f"ids array<{types['vec_id']}>, labels array<{types['label']}>, {binaries}")


def fitted(forest: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after so many rounds; entries that no part is nearest to stay."""
    for _ in range(rounds):
        made, names = _sums(books)
        sums = forest.select(*FOREST).mapInArrow(made, ", ".join(f"{n} long" for n in names)).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])
        books = [b.copy() for b in books]
        for part, entry, n, *s in sums.collect():  # PARTS * ENTRIES rows at most
            books[part][entry] = [x // n for x in s[: books[part].shape[1]]]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def coded(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code (hex), error of every vector that can be coded; and the codebooks."""
    spark = vectors.sparkSession
    kept = whole_vectors(vectors)
    types = dict(kept.dtypes)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    books = first_books(kept)
    if not books:
        return spark.createDataFrame([], schema), []
    path = fresh_path(spark, "cover-trees")
    forest_of(kept, sum(b.shape[1] for b in books)).write.parquet(path)
    forest = spark.read.parquet(path)
    books = fitted(forest, books)
    codes = materialize(forest.mapInArrow(_codes(books), schema), "vector-codes")
    discard(spark, path)
    return codes, books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = coded(table(spark, sf_dir, "embeddings"))
    # null labels are a group of their own
    rows = codes.select("vec_id", "code", "error", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("_label"))
    groups = rows.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_size"))
    both = join_groups(rows, groups, "_label", "_size", rows.count())
    return both.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other, by all distances (exact in doubles)."""
    part = "SELECT part, i, x, list_inner_product(x, x) AS xx"
    steps = [
        f"""k AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS i, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS ({part} FROM (SELECT i, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM k, range({PARTS}) AS r(part))),
b0 AS (SELECT part, i AS e, x FROM p WHERE i < {ENTRIES})"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""a{k} AS (SELECT p.part, p.i, arg_min({{'e': b.e, 'd': p.xx - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x)}}, (p.xx - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x), b.e)) AS n
  FROM p JOIN b{k} b USING (part) GROUP BY p.part, p.i)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""m{k} AS (SELECT part, e, list(floor(s / n) ORDER BY pos) AS x FROM (
  SELECT part, e, pos, sum(x[pos]) AS s, count(*) AS n FROM (SELECT a.part, a.n.e AS e, p.x, unnest(range(1, len(p.x) + 1)) AS pos FROM a{k} a JOIN p USING (part, i)) GROUP BY part, e, pos) GROUP BY part, e),
b{k + 1} AS (SELECT part, e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, e))"""
            )
    last = ROUNDS
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM k
JOIN (SELECT i, string_agg(printf('%02x', n.e), '' ORDER BY part) AS code, sum(n.d)::BIGINT AS error FROM a{last} GROUP BY i) USING (i),
(SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, e, pos)) AS digest FROM (SELECT part, e, unnest(x) AS c, unnest(range(len(x))) AS pos FROM b{last}))"""


SQL = _sql()
