"""Near-duplicate embeddings by randomly rotated binary codes with stored correction factors.

1. Codes.  Each vector is scaled to unit length and turned by fixed random rotations.  The
   signs of the result are its binary code ``c``; the correction factor
   ``f = <c / sqrt(B), turned>`` makes ``<c / sqrt(B), other> / f`` an unbiased estimate of
   the cosine with error ``sqrt((1 - f^2) / f^2) / sqrt(B - 1)`` for ``B`` bits (RaBitQ: Gao
   and Long, SIGMOD 2024).  Equal vectors are one row with their number.  Code, factor and
   bucket keys are computed once and stored, about a tenth of the vectors' bytes each.
2. Buckets.  A vector is in one bucket of each table; a table's key is the largest
   coordinates of its rotations, with sign, and some sign bits.  The number of tables follows
   from ``recall`` at the threshold, the length of keys from the row count, so that buckets
   keep their mean size ``FILL``.  Only codes go to the buckets.  The share of bits in which
   two codes differ, times pi, is an unbiased estimate of the angle; vectors with a partner
   whose lower bound of the angle is inside the threshold's are open.
3. Exact.  Vectors are fetched for the open members of a bucket only.  There the estimate
   from stored code and factor against the whole vector, with its confidence bound, decides
   which pairs are recomputed in double precision; only these can become links.  A pair
   counts in the first table in which it meets, so no list of pairs is made.

A bucket over ``BUCKET`` rows is split into blocks, each pair of blocks being a group of its
own, so no bucket is capped and none needs one task.

Vectors that are null, zero, or hold null or non-finite components link with nothing;
vectors of different lengths never link; repeated rows are rows of their own; an empty
table gives an empty result.  Rows with a null vec_id get counts but name no component; ids
are below 2^62.  Very long vectors take memory with the square of their length for the
rotations.  Further columns are left out whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.components import connected_components
from cloakframe.llm.scratch import configure, materialize
from cloakframe.llm.streams import group_starts, whole_groups

#: Rows of a bucket that one group compares at once.
BUCKET = 1024
#: Mean rows of a bucket.
FILL = 512
#: Bits of a code, at least.
BITS = 128
#: Chance at which a pair right at the threshold shares a bucket.
RECALL = 0.999
#: Deviations of an estimate that its confidence bound spans.
EPSILON = 4.5
SEED = 20
#: Ids from here on stand for vectors without an id.
NAMELESS = 1 << 62


@cache
def _rotation(dim: int, k: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, dim, k])
    return np.linalg.qr(rng.standard_normal((dim, dim)))[0]


@cache
def embedding(dim: int) -> np.ndarray:
    """Rotations one below the other, scaled so that lengths stay: at least BITS rows."""
    k = -(-BITS // dim)
    return np.vstack([_rotation(dim, i) for i in range(k)]) / math.sqrt(k)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, factors) of unit vectors: packed sign bits, and the share of each vector in its code's direction."""
    turned = unit @ embedding(unit.shape[1]).T
    factor = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
    bits = np.packbits(turned > 0, axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))), factor


@cache
def _top_agrees(dim: int, threshold: float) -> float:
    """Chance that two vectors at the threshold have the same largest coordinate, with sign, after a rotation."""
    rng = np.random.default_rng([SEED, dim])
    n = max(2000, 400_000 // dim)
    a, u = rng.standard_normal((2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u -= (u * a).sum(1, keepdims=True) * a
    b = threshold * a + math.sqrt(1 - threshold**2) * u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    i, j = np.abs(a).argmax(1), np.abs(b).argmax(1)
    at = np.arange(n)
    return float(((i == j) & (a[at, i] * b[at, j] > 0)).mean())


@cache
def plan(n: int, dim: int, threshold: float, recall: float) -> tuple[int, int, int]:
    """(largest coordinates in a key, sign bits in it, tables) for ``n`` vectors: the fewest tables with buckets of FILL."""
    need = math.log2(max(1.0, n / FILL))
    sign = 1 - math.acos(threshold) / math.pi
    best = None
    for tops in range(5 if dim > 1 else 1):
        signs = math.ceil(max(0.0, need - tops * math.log2(2 * dim)))
        agree = _top_agrees(dim, threshold) ** tops * sign**signs
        tables = 1 if agree == 1 else math.ceil(math.log(1 - recall) / math.log(1 - agree))
        if best is None or tables < best[2]:
            best = tops, signs, tables
    return best


def keys(unit: np.ndarray, n: int, threshold: float, recall: float) -> np.ndarray:
    """Key of each vector in each table."""
    dim = unit.shape[1]
    tops, signs, tables = plan(n, dim, threshold, recall)
    out = np.zeros((len(unit), tables), np.int64)
    at = np.arange(len(unit))
    used = 1000  # rotations below are those of codes
    for t in range(tables):
        for _ in range(tops):
            turned = unit @ _rotation(dim, used).T
            used += 1
            top = np.abs(turned).argmax(1)
            out[:, t] = out[:, t] * (2 * dim) + 2 * top + (turned[at, top] > 0)
    total = tables * signs
    for first in range(0, total, dim):
        bits = unit @ _rotation(dim, used).T > 0
        used += 1
        for k in range(first, min(first + dim, total)):
            out[:, k // signs] = out[:, k // signs] * 2 + bits[:, k - first]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def open_rows(left: np.ndarray, right: np.ndarray | None, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two blocks of codes (uint64 words) have a partner in the other block that may be within the threshold.

    Without ``right``, partners are the other rows of ``left``.
    """
    bits = len(embedding(dim))
    p = math.acos(threshold) / math.pi
    most = bits * p + EPSILON * math.sqrt(bits * p * (1 - p)) + 1
    other = left if right is None else right
    on_left, on_right = np.zeros(len(left), bool), np.zeros(len(other), bool)
    for s in range(0, len(left), 256):
        part = left[s : s + 256]
        differ = np.zeros((len(part), len(other)), np.uint16 if bits < 1 << 16 else np.uint32)
        for w in range(left.shape[1]):
            differ += np.bitwise_count(part[:, w, None] ^ other[None, :, w])
        near = differ <= most
        if right is None:
            near[np.arange(len(part)), s + np.arange(len(part))] = False
        on_left[s : s + 256] = near.any(1)
        on_right |= near.any(0)
    return on_left, on_right


def linked(code: np.ndarray, factor: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j, recomputed): rows of ``a`` (unit, with code and factor) whose cosine with rows of ``b`` reaches the threshold.

    The estimate's upper bound decides which pairs are recomputed, each by the same sum.
    """
    turn = embedding(a.shape[1])
    bits = len(turn)
    signs = np.unpackbits(code, axis=1, count=bits).astype(np.float32) * 2 - 1
    estimate = signs @ (b @ turn.T / math.sqrt(bits)).astype(np.float32).T / factor[:, None]
    spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(bits - 1, 1))
    i, j = np.nonzero(estimate + EPSILON * spread[:, None] + 1e-5 >= threshold)
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 15):
        x, y = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
        keep[s : s + (1 << 15)] = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
    return i[keep], j[keep], len(i)


def _usable(column: str) -> F.Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def _read(vectors: DataFrame) -> DataFrame:
    """(vec_id, id, e, x, y): id stands in for a null one, x and y together tell vectors apart."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("e"))
    rows = rows.withColumns({"x": F.xxhash64("e"), "y": F.xxhash64(F.lit(SEED), "e")})
    return rows.withColumn("id", F.coalesce("vec_id", F.lit(NAMELESS) + F.shiftrightunsigned("x", 3)))


def codes(good: DataFrame, n: int, threshold: float = 0.95, recall: float = RECALL) -> DataFrame:
    """(rep, x, y, mult, dim, code, factor, keys) of each distinct vector of ``good`` (id, x, y, e)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(3).value_lengths())
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 2048):
                    piece = part.slice(at, 2048)
                    unit = _unit(_matrix(piece.column(3)))
                    code, factor = encode(unit)
                    found = keys(unit, n, threshold, recall)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [*piece.columns[:3], pa.array(np.full(len(unit), dim, np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(factor.astype(np.float32)), lists], ["id", "x", "y", "dim", "code", "factor", "keys"]
                    )

    coded = good.select("id", "x", "y", "e").mapInArrow(run, "id long, x long, y long, dim int, code binary, factor float, keys array<long>")
    same = [F.first(c).alias(c) for c in ("dim", "code", "factor", "keys")]  # equal for equal vectors
    return coded.groupBy("x", "y").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), *same)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, ...)."""
    configure(vectors.sparkSession)
    rows = _read(vectors)
    good = rows.filter(_usable("e"))
    stored = materialize(codes(good, vectors.count(), threshold, recall), "codes")
    spread = stored.select("rep", "dim", "code", F.posexplode("keys").alias("t", "key"))
    place = ["dim", "t", "key"]
    hot = materialize(spread.groupBy(*place).agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select(*place, F.ceil(F.col("n") / bucket).cast("int").alias("parts")), "hot")
    split = spread.join(hot, place, "left") if not hot.isEmpty() else spread.withColumn("parts", F.lit(None).cast("int"))
    # block pair (i, j), i <= j, is cell i * parts + j; each row goes to all pairs that hold its block
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, F.col("own")) * F.col("parts") + F.greatest(o, F.col("own")))
    placed = split.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("cell", F.explode(F.coalesce(pairs, F.array(F.lit(0))))).withColumn("parts", F.coalesce("parts", F.lit(1)))
    cell = [*place, "cell"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        """Each group of two rows or more with the rows of its two blocks, the second empty where both are one."""
        for t in whole_groups(batches, cell, 4000):
            starts = np.append(group_starts(t, cell), t.num_rows)
            owns, cells, parts = (t.column(c).to_numpy() for c in ("own", "cell", "parts"))
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s > 1:
                    first, second = divmod(int(cells[s]), int(parts[s]))
                    yield t.slice(s, e - s), np.flatnonzero(owns[s:e] == first), np.flatnonzero(owns[s:e] == second) if second != first else np.empty(0, np.int64)

    def words(column: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)

    def may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, left, right in groups(batches):
            code, dim = words(t.column("code")).view(np.uint64), t.column("dim")[0].as_py()
            on = np.zeros(t.num_rows, bool)
            if len(right):
                on[left], on[right] = open_rows(code[left], code[right], dim, threshold)
            else:
                on[left] = open_rows(code[left], None, dim, threshold)[0]
            if on.any():
                yield from t.select([*cell, "own", "parts", "rep"]).filter(pa.array(on)).combine_chunks().to_batches()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, left, right in groups(batches):
            one = not len(right)
            right = left if one else right
            unit = _unit(_matrix(t.column("e").combine_chunks()))
            code, factor = words(t.column("code")), t.column("factor").to_numpy().astype(np.float64)
            i, j, _ = linked(code[left], factor[left], unit[left], unit[right], threshold)
            # the bound holds from either side, so one direction of a pair is enough
            x, y = left[i], right[j]
            if one:
                x, y = x[x < y], y[x < y]
            found = np.stack(t.column("keys").to_pylist())
            fresh = (found[x, : t.column("t")[0].as_py()] != found[y, : t.column("t")[0].as_py()]).all(1)
            x, y = x[fresh], y[fresh]
            if not len(x):
                continue
            n, r, m = t.num_rows, t.column("rep").to_numpy(), t.column("mult").to_numpy()
            count = np.bincount(x, m[y], n) + np.bincount(y, m[x], n)
            label = np.arange(n)
            while True:  # linked rows end with the same label
                before = label.copy()
                np.minimum.at(label, x, label[y])
                np.minimum.at(label, y, label[x])
                label = label[label]
                if (label == before).all():
                    break
            on = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(r[on]), pa.array(r[label[on]]), pa.array(count[on].astype(np.int64))], ["a", "b", "n"])

    numbers = "dim int, t int, key long, cell int, own int, parts int, rep long"
    placed = placed.select(*cell, "own", "parts", "rep", "code")
    open_ = materialize(placed.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(may_link, numbers), "open")
    # vectors of open members, one of each; the join goes by the keys of the grouping
    wanted = stored.join(open_.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("id"), "x", "y", "mult", "code", "factor", "keys")
    whole = good.groupBy("id", "x", "y").agg(F.first("e").alias("e")).join(wanted, ["id", "x", "y"]).select(F.col("id").alias("rep"), "mult", "code", "factor", "keys", "e")
    met = open_.join(whole, "rep").select(*cell, "own", "parts", "rep", "mult", "code", "factor", "keys", "e")
    # a row for each table and member of a link: linear in the vectors
    found = materialize(met.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(links, "a long, b long, n long"), "links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    comps = connected_components(found)
    named = stored.join(counts, stored["rep"] == counts["a"], "left").join(comps, stored["rep"] == comps["node"], "left")
    named = materialize(named.select("x", "y", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c")), "named")
    # a component that only null ids reach has no name
    out = good.select("vec_id", "x", "y").join(named, ["x", "y"]).select("vec_id", "n_links", F.when(F.col("c") < NAMELESS, F.col("c")).alias("component_id"))
    rest = rows.filter(~_usable("e")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
