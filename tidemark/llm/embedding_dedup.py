"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import connected_components, cut

PREPARED = "rid bigint, vec_id bigint, digest binary, v binary"
HASHED = "id bigint, copies bigint, v binary, sketch binary, keys array<bigint>"
MARKED = "t int, key bigint, i int, j int, block int, id bigint"
FOUND = "id bigint, other bigint, links bigint"
#: Bits of a vector's sketch, and by how many standard deviations more bits than expected two linked vectors may differ in.
SKETCH, DEVIATIONS = 256, 6.0
#: A class with more rows than this (or a 100,000th of all) is joined by a broadcast: there are at most 100,000 such classes.
HOT_ROWS = 10_000


def collision(distance: float, width: float) -> float:
    """Chance that one quantised Gaussian projection of step `width` gives two points at this distance the same number."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, cosine: float, recall: float, width: float, bucket: float = 256, distances: np.ndarray | None = None) -> tuple[int, int]:
    """(projections a table, tables): as few projections as leave about `bucket` of n unlinked vectors in a bucket, and as many
    tables that a pair right at the threshold is met with chance `recall`.

    distances are those between unlinked vectors of a sample; without, vectors are taken to be at right angles.
    """
    near = collision(math.sqrt(max(2 - 2 * cosine, 1e-9)), width)
    at = np.array([math.sqrt(2)]) if distances is None or not len(distances) else distances
    counts, edges = np.histogram(at, 256, (0, 2))
    far = np.array([collision(d, width) for d in (edges[:-1] + edges[1:]) / 2])
    k = 1
    while k < 64 and n * float(counts @ far**k) / len(at) > bucket:
        k += 1
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; dividing by the largest component first keeps squares from overflowing."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _prepare(dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Digest and bytes of every vector that can link; nulls for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            lists, ids = batch.column("e"), batch.column("vec_id")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(dtype) + np.array(0, dtype)
            upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
            bad, some = upto(~np.isfinite(values)), upto(values != 0)
            lo, hi = offsets[:-1], offsets[1:]
            fine = lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False) & (bad[hi] == bad[lo]) & (some[hi] > some[lo])
            raw = [values[a:b].tobytes() if ok else None for a, b, ok in zip(lo, hi, fine, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), ids, pa.array([None if r is None else xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["rid", "vec_id", "digest", "v"])

    return run


def _keys(vectors: np.ndarray, tables: int, k: int, width: float, seed: list[int]) -> np.ndarray:
    """Bucket of every vector in every table: 64-bit hashes of k quantised projections."""
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((vectors.shape[1], tables * k))
    b = rng.uniform(0, width, tables * k)
    q = np.floor((vectors @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(vectors), tables, k)
    h = np.full((len(vectors), tables), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(k):
        h = (h ^ q[:, :, i]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h.astype(np.int64)


def _sketches(vectors: np.ndarray, seed: list[int]) -> np.ndarray:
    """Signs of SKETCH random projections, as bits."""
    a = np.random.default_rng(seed).standard_normal((vectors.shape[1], SKETCH))
    return np.packbits(vectors @ a >= 0, axis=1)


def _hash(dtype: str, tables: int, k: int, width: float, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                raw = part.column("v").to_pylist()
                # vectors of different lengths never compare; each length has projections of its own
                lengths = np.array([len(r) for r in raw])
                for d in np.unique(lengths).tolist():
                    at = np.nonzero(lengths == d)[0]
                    v = units(np.frombuffer(b"".join(raw[i] for i in at), dtype).reshape(len(at), -1))
                    keys = _keys(v, tables, k, width, [seed, d])
                    rows = part.take(pa.array(at))
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("copies"), rows.column("v"), pa.array([s.tobytes() for s in _sketches(v, [seed, d, 1])], pa.binary()), listed], names=["id", "copies", "v", "sketch", "keys"])

    return run


def _pairs(block: np.ndarray, i: int, j: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], strip: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of the rows of one block (i = j) or of two that near() finds, a strip of rows at a time; each pair once."""
    x, y = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
    for s in range(0, len(x), strip):
        part = x[s : s + strip]
        a, b = np.nonzero(near(part, y))
        a, b = part[a], y[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        yield a, b


def _first_here(keys: np.ndarray, t: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether table t is the first one that has both of a pair in one bucket."""
    out = np.ones(len(a), bool)
    for s in range(0, len(a) if t else 0, 1 << 16):
        out[s : s + (1 << 16)] = ~(keys[a[s : s + (1 << 16)], :t] == keys[b[s : s + (1 << 16)], :t]).any(axis=1)
    return out


def _column(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([p.column(name).to_numpy() for p in parts])


def _key_arrays(parts: list[pa.RecordBatch], n: int) -> np.ndarray:
    return np.concatenate([p.column("keys").flatten().to_numpy() for p in parts]).reshape(n, -1)


def _mark(cosine: float):
    """Members of a block pair whose sketches are near enough to another one's to link, that this table is the first to bring together."""
    p = math.acos(cosine) / math.pi
    most = SKETCH * p + DEVIATIONS * math.sqrt(SKETCH * p * (1 - p))

    def run(key: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, _, i, j = key
        ids, block = _column(parts, "id"), _column(parts, "block")
        if len(ids) < 2:
            return
        keys = _key_arrays(parts, len(ids))
        bits = np.frombuffer(b"".join(x for p in parts for x in p.column("sketch").to_pylist()), np.uint64).reshape(len(ids), -1)
        marked = np.zeros(len(ids), bool)

        def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            differ = np.zeros((len(x), len(y)), np.uint16)
            for w in range(bits.shape[1]):
                differ += np.bitwise_count(bits[x, w][:, None] ^ bits[y, w][None, :])
            return differ <= most

        for a, b in _pairs(block, i, j, near, 256):
            here = _first_here(keys, t, a, b)
            marked[a[here]] = marked[b[here]] = True
        n = int(marked.sum())
        if n:
            fixed = [pa.array(np.full(n, x), k) for x, k in zip(key, (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(block[marked], pa.int32()), pa.array(ids[marked])], names=["t", "key", "i", "j", "block", "id"])

    return run


def star(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of n nodes that the edges (a, b) connect with each."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _link(dtype: str, cosine: float):
    """Per member of a block pair its exact links that this table is the first to find, counted with copies, and the first member that these connect it with."""

    def run(key: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, _, i, j = key
        ids, block, copies = _column(parts, "id"), _column(parts, "block"), _column(parts, "copies")
        keys = _key_arrays(parts, len(ids))
        raw = [x for p in parts for x in p.column("v").to_pylist()]
        lengths = np.array([len(r) for r in raw])
        links, ends = np.zeros(len(ids)), []
        for d in np.unique(lengths).tolist():
            at = np.nonzero(lengths == d)[0]
            v = np.zeros((len(ids), d // np.dtype(dtype).itemsize))
            v[at] = units(np.frombuffer(b"".join(raw[k] for k in at), dtype).reshape(len(at), -1))

            def near(x: np.ndarray, y: np.ndarray, v: np.ndarray = v) -> np.ndarray:
                dots = v[x] @ v[y].T
                out = dots >= cosine
                # the product of matrices may sum in another order than a plain sum of products
                p, q = np.nonzero(np.abs(dots - cosine) < 1e-9)
                out[p, q] = [float(np.einsum("i,i", v[x[m]], v[y[n]])) >= cosine for m, n in zip(p, q, strict=True)]
                return out

            for a, b in _pairs(np.where(lengths == d, block, -1), i, j, near, 256):
                here = _first_here(keys, t, a, b)
                a, b = a[here], b[here]
                links += np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
                # edges enough to connect what these pairs connect
                label = star(a, b, len(ids))
                ends.append(np.stack([np.arange(len(ids)), label], 1)[label != np.arange(len(ids))])
        has = links > 0
        if has.any():
            edges = np.concatenate(ends)
            label = star(edges[:, 0], edges[:, 1], len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(ids[label[has]]), pa.array(links[has].astype(np.int64))], names=["id", "other", "links"])

    return run


def _by_group(work):
    """Runs work() on every run of rows with equal (t, key, i, j); rows come sorted, so one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("t", "key", "i", "j")]
            new = np.ones(batch.num_rows, bool)
            if batch.num_rows > 1:
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            starts = np.nonzero(new)[0]
            for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                key = tuple(int(c[s]) for c in cols)
                if key != now and held:
                    yield from work(now, held)
                    held = []
                now = key
                held.append(batch.slice(s, e - s))
        if held:
            yield from work(now, held)

    return run


def _grouped(rows: DataFrame, work, schema: str) -> DataFrame:
    by = ("t", "key", "i", "j")
    # a pandas group for each of many small buckets would cost more than its comparison
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(_by_group(work), schema)


def _with_classes(rows: DataFrame, classes: DataFrame, key: str, hot: Column) -> DataFrame:
    """rows with the columns of their class (a row for each key): classes of very many rows by a broadcast, so that no key is one task's; keys without class are left out."""
    by_hot = F.broadcast(classes.where(hot))
    return rows.join(by_hot, key).unionByName(rows.join(by_hot.select(key), key, "left_anti").join(classes.where(~hot), key))


def _distances(reps: DataFrame, dtype: str, cosine: float, sample: int) -> np.ndarray:
    """Distances between the unlinked ones of at most `sample` vectors, chosen by a hash."""
    raw = [r["v"] for r in reps.orderBy(F.xxhash64("id")).select("v").limit(sample).collect()]
    out = [np.zeros(0)]
    for d in {len(r) for r in raw}:
        v = units(np.frombuffer(b"".join(r for r in raw if len(r) == d), dtype).reshape(-1, d // np.dtype(dtype).itemsize))
        dots = (v @ v.T)[np.triu_indices(len(v), 1)]
        out.append(np.sqrt(2 - 2 * np.clip(dots[dots < cosine], -1, 1)))
    return np.concatenate(out)


def link_vectors(vectors: DataFrame, *, cosine: float = 0.95, recall: float = 0.99, width: float = 2.0, bucket: float = 256, block_rows: int = 1024, sample: int = 1000, broadcast_buckets: int = 200_000, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors (vec_id, embedding).

    Equal vectors are one class (by a 128-bit digest of their bytes), with their smallest vec_id: they are counted, not paired. Each
    class is normalised in double precision and hashed into several tables of quantised Gaussian projections. The number of projections is fitted to the
    distances within a sample of at most `sample` vectors, so that a bucket holds about `bucket` unlinked ones; the number of tables follows, so that a
    pair right at `cosine` is met with chance `recall`, nearer ones more surely. All vectors are indexed.

    Buckets are compared in blocks of about block_rows, however large they are: of m blocks each of the m (m + 1) / 2 pairs is a
    group of its own. What goes through the tables are ids, keys and sketches of 256 sign bits; only members whose sketch is near
    another's (6 standard deviations beyond what vectors at `cosine` differ by) fetch their vector for the exact check. A pair
    counts in the first table that brings it together, so counts add up without listing pairs, and a group emits
    a row for each member, with its links and one edge, as the members' components need no more.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: n_links 0, their own id as component.
    Vectors of different lengths never link. Rows that share a vec_id are told apart while linking, so n_links counts rows; they share the
    component of their id. Null vec_ids link with nothing and keep a null component. An empty table gives an empty table; other columns are left out.
    """
    element = vectors.schema["embedding"].dataType.elementType
    dtype = "float32" if isinstance(element, T.FloatType) else "float64"
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if dtype == "float32" else "array<double>").alias("e"))
    prepared = cut(rows.mapInArrow(_prepare(dtype), PREPARED))
    classes = cut(prepared.where("digest is not null").groupBy("digest").agg(F.min(F.struct("vec_id", "rid")).alias("m"), F.count(F.lit(1)).alias("copies")).select("digest", F.col("m.vec_id").alias("first"), F.col("m.rid").alias("id"), "copies"))
    n, total = classes.agg(F.count(F.lit(1)), F.sum("copies")).first()
    reps = prepared.join(classes.select("id", "copies"), F.col("rid") == F.col("id")).select("id", "copies", "v")
    k, tables = plan(n, cosine, recall, width, bucket, _distances(reps, dtype, cosine, sample))

    hashed = cut(reps.mapInArrow(_hash(dtype, tables, k, width, seed), HASHED))
    large = cut(hashed.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").count().where(F.col("count") > block_rows).select("t", "key", F.ceil(F.col("count") / block_rows).cast("int").alias("m")))
    few = large.count() <= broadcast_buckets
    members = hashed.select("id", "sketch", "keys", F.posexplode("keys").alias("t", "key")).join(F.broadcast(large) if few else large, ["t", "key"], "left")
    m = F.coalesce("m", F.lit(1))
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), m).cast("int"))
    others = F.transform(F.sequence(F.lit(0), m - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    spread = members.select("t", "key", "id", "block", "sketch", "keys", F.explode(others).alias("o")).select("t", "key", "o.i", "o.j", "block", "id", "sketch", "keys")
    marked = cut(_grouped(spread, _mark(cosine), MARKED))
    found = cut(_grouped(marked.join(hashed.select("id", "copies", "v", "keys"), "id"), _link(dtype, cosine), FOUND))

    linked = found.groupBy("id").agg(F.sum("links").alias("linked"))
    info = cut(classes.join(linked, "id", "left").select("digest", "id", "first", "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    hot = F.col("copies") > max(HOT_ROWS, (total or 0) // 100_000)
    own = cut(_with_classes(prepared.where("digest is not null").select("vec_id", "digest"), info.select("digest", "first", "copies", "n_links"), "digest", hot).select("vec_id", "first", "n_links"))
    first = info.select(F.col("id").alias("x"), F.col("first").alias("f"))
    edges = found.where("id <> other").select("id", "other").distinct()
    edges = edges.join(first, F.col("id") == F.col("x")).select(F.col("f").alias("a"), "other").join(first, F.col("other") == F.col("x")).select("a", F.col("f").alias("b"))
    # a vec_id with several vectors ties their classes together
    several = own.groupBy("vec_id").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).where("lo < hi")
    ties = own.join(several, "vec_id").select(F.col("lo").alias("a"), F.col("first").alias("b"))
    reached = connected_components(edges.union(ties))
    by_first = info.groupBy("first").agg(F.sum("copies").alias("copies")).join(reached, F.col("first") == F.col("node"), "left").select("first", "copies", F.coalesce("component", "first").alias("component_id"))
    out = cut(_with_classes(own, cut(by_first), "first", hot).select("vec_id", "n_links", "component_id"))
    # rows that can't link share the component of another row of their id
    alone = prepared.where("digest is null").select("vec_id").join(out.groupBy("vec_id").agg(F.min("component_id").alias("c")), "vec_id", "left")
    out = out.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
