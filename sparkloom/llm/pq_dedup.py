"""Embedding near-duplicates over coarse inverted lists and product-quantised residuals.

1. Equal vectors are folded; what follows runs over representatives.
2. A bounded sample (``sample_rows`` representatives, those of smallest hash)
   fits the coarse centroids, the cells of their residuals and one codebook a
   subspace, for each length of vector on its own. Every representative is
   then indexed: its list (centroid and cell), its residual's codes and the
   exact distance between residual and code.
3. A vector probes the lists whose border with its own list it is near: a
   neighbour within the radius r of the threshold can only lie beyond a border
   closer than r. How much closer is measured, as real vectors fill few of
   their dimensions: the reach is ``probe_sd`` standard deviations of a
   displacement of length r along the direction in which the sample's
   residuals vary most, no less than what the sample's own linked pairs need
   to meet, and never more than r, where nothing can be lost. ``probe_sd=None``
   sets the reach to r: the exact way. Of two lists the higher one's vectors
   probe the lower one, so a pair meets once.
4. Within a list, asymmetric distances from look-up tables give a lower bound
   (distance to the code less the code's own error), so no pair within the
   radius is lost there; what passes gets its exact cosine in doubles.
5. Lists are split into blocks of ``block_rows``; a tile is one block against
   another. A tile returns one row a vector (its links, and the smallest id it
   reaches in the tile), never its pairs. There is no cap on links.

Defined cases: null, zero and empty vectors, and those with null or non-finite
components, link with nothing; vectors link with those of their own length
only; a null id links with nothing, has a null component and is kept; rows
that repeat an id are vectors of their own in one node; repeated vectors link
with each other; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import written
from sparkloom.llm.components import components

DIGEST = 16


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision (first by their largest value, against overflow)."""
    x = x.astype(np.float64)
    if not x.size:
        return x
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Lloyd's centroids of x, begun at rows drawn with a fixed seed."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, rows: int = 2000) -> np.ndarray:
    size = (c * c).sum(axis=1)
    return np.concatenate([(size - 2 * x[k : k + rows] @ c.T).argmin(axis=1) for k in range(0, len(x), rows)] or [np.zeros(0, int)])


def _borders(u: np.ndarray, c: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Distance of each vector, nearest to centroid `home`, from the border to every centroid (0 for its own)."""
    d = (c * c).sum(axis=1) - 2 * u @ c.T
    near, at = np.unique(home, return_inverse=True)
    gap = np.sqrt(np.maximum((c[near] ** 2).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * c[near] @ c.T, 1e-24))
    return (d - d[np.arange(len(u)), home][:, None]) / (2 * gap[at])


class Index:
    """Lists in two levels (coarse centroids, and cells of the residual) and residual codebooks.

    List number c * n_cells + f belongs to coarse centroid c and cell f. The
    index's size is bounded by the sample's.
    """

    def __init__(self, sample: np.ndarray, lists: int, cells: int, subspaces: int, codes: int):
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.fine = kmeans(rest, cells) if cells > 1 else np.zeros((1, sample.shape[1]))
        rest = rest - self.fine[nearest(rest, self.fine)]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), subspaces) if len(p)]
        self.books = [kmeans(rest[:, p], codes, 8) for p in self.parts]
        self.size = len(self.coarse) * len(self.fine)
        # the part of the variance in its strongest direction: 1 / dim where none is preferred
        spread = np.linalg.eigvalsh(rest.T @ rest)
        self.strongest = float(spread[-1] / spread.sum()) if spread.sum() > 0 else 1.0

    def centre(self, at: int) -> np.ndarray:
        return self.coarse[at // len(self.fine)] + self.fine[at % len(self.fine)]

    def encode(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and code error of unit vectors."""
        c = nearest(u, self.coarse)
        rest = u - self.coarse[c]
        f = nearest(rest, self.fine)
        rest -= self.fine[f]
        code = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        miss = sum(((rest[:, p] - b[code[:, k]]) ** 2).sum(axis=1) for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)))
        return c * len(self.fine) + f, code, np.sqrt(miss)

    def probes(self, u: np.ndarray, home: np.ndarray, reach: float, chunk: int = 1 << 22) -> list[np.ndarray]:
        """For each vector the lower-numbered lists whose border with its own place lies within reach."""
        k = len(self.fine)
        row, c = np.nonzero(_borders(u, self.coarse, home // k) <= reach)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(row), max(1, chunk // k)):
            r, cc = row[a : a + max(1, chunk // k)], c[a : a + max(1, chunk // k)]
            rest = u[r] - self.coarse[cc]
            i, f = np.nonzero(_borders(rest, self.fine, nearest(rest, self.fine)) <= reach)
            at = cc[i] * k + f
            low = at < home[r[i]]
            found.append((r[i[low]], at[low]))
        r, at = (np.concatenate([x[j] for x in found]) if found else np.zeros(0, int) for j in (0, 1))
        order = np.argsort(r, kind="stable")
        return np.split(at[order], np.cumsum(np.bincount(r, minlength=len(u)))[:-1])

    def crossings(self, u: np.ndarray, threshold: float, rows: int = 4000, most: int = 200_000) -> np.ndarray:
        """For linked pairs of u in different lists, the reach at which they meet. Up to rows vectors meet all others, up to most pairs are measured."""
        home, _, _ = self.encode(u)
        k, out, n = len(self.fine), [], 0
        for i in range(0, min(rows, len(u)), 500):
            a, b = np.nonzero(u[i : min(i + 500, rows)] @ u.T >= threshold)
            a += i
            # the vector of the higher list is the one that probes
            a, b = np.where(home[a] > home[b], a, b), np.where(home[a] > home[b], b, a)
            own = home[a] != home[b]
            a, b = a[own], b[own]
            for at in range(0, len(a), 2000):
                x, to = u[a[at : at + 2000]], home[b[at : at + 2000]]
                pick = np.arange(len(x))
                coarse = _borders(x, self.coarse, home[a[at : at + 2000]] // k)[pick, to // k]
                rest = x - self.coarse[to // k]
                out.append(np.maximum(coarse, _borders(rest, self.fine, nearest(rest, self.fine))[pick, to % k]))
            n += len(a)
            if n >= most:
                break
        return np.concatenate(out) if out else np.zeros(0)

    def reach(self, u: np.ndarray, threshold: float, probe_sd: float | None, share: float = 0.9995) -> float:
        """How near a border a vector probes beyond it; at least what brings that share of the sample's linked pairs together, and a tenth more."""
        radius = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
        if probe_sd is None:
            return radius
        need = self.crossings(u, threshold)
        return min(radius, max(probe_sd * radius * np.sqrt(self.strongest), 1.1 * np.quantile(need, share) if len(need) else 0.0))

    def distances(self, u: np.ndarray, at: int, code: np.ndarray) -> np.ndarray:
        """Asymmetric distances from vectors to the coded members of list `at`."""
        rest = u - self.centre(at)
        total = np.zeros((len(u), len(code)), np.float32)
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            r = rest[:, p]
            table = ((r * r).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * r @ b.T).astype(np.float32)
            total += table[:, code[:, k]]
        return np.sqrt(np.maximum(total, 0))


def _plain(col: pa.Array, dtype: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(-1, dim)


def _vectors(rows: DataFrame, dtype: str) -> DataFrame:
    """id, digest (null where the vector is not usable), raw, dim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dig: list = [None] * b.num_rows
            out: list = [None] * b.num_rows
            dim: list = [None] * b.num_rows
            for i, v in enumerate(b.column(1)):
                if v.is_valid and len(v.values) and v.values.null_count == 0:
                    x = np.ascontiguousarray(v.values.to_numpy(), dtype)
                    if np.isfinite(x).all() and x.any():
                        out[i] = x.tobytes()
                        dig[i] = hashlib.blake2b(out[i], digest_size=DIGEST).digest()
                        dim[i] = len(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dig, pa.binary()), pa.array(out, pa.binary()), pa.array(dim, pa.int32())], names=["id", "digest", "raw", "dim"])

    return rows.mapInArrow(run, "id long, digest binary, raw binary, dim int")


def _tile(index: Index, at: int, members: tuple, others: tuple, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one tile: for members and others together, the number of linked
    vectors and the smallest id reached (its own where nothing is linked)."""
    rep, mult, u, code, miss = members
    q_rep, q_mult, q_u = others
    radius = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-5
    link = np.zeros((len(q_rep), len(rep)), bool)
    for i in range(0, len(q_rep), 256):
        q = q_u[i : i + 256]
        near = index.distances(q, at, code) - miss <= radius
        if same:
            near &= np.arange(i, i + len(q))[:, None] < np.arange(len(rep))
        if near.mean() > 0.02:
            link[i : i + 256] = near & (q @ u.T >= threshold)
        else:
            a, b = np.nonzero(near)
            ok = np.einsum("ij,ij->i", q[a], u[b]) >= threshold
            link[i + a[ok], b[ok]] = True
    if same:
        link |= link.T
        n, low = link @ mult, rep.copy()
        while True:
            nxt = np.minimum(low, np.where(link, low, np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
            if (nxt == low).all():
                return n, low
            low = nxt
    n, n_q, low, low_q = link.T @ q_mult, link @ mult, rep.copy(), q_rep.copy()
    big = np.iinfo(np.int64).max
    while True:
        nxt_q = np.minimum(low_q, np.where(link, low, big).min(axis=1, initial=big))
        nxt = np.minimum(low, np.where(link, nxt_q[:, None], big).min(axis=0, initial=big))
        if (nxt == low).all() and (nxt_q == low_q).all():
            return np.concatenate([n, n_q]), np.concatenate([low, low_q])
        low, low_q = nxt, nxt_q


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95,
    sample_rows: int = 20_000, lists: int | None = None, list_rows: int = 4096, subspaces: int = 8, codes: int = 256, probe_sd: float | None = 3.5, block_rows: int = 2048,
) -> DataFrame:
    """id_col, n_links, component_id (smallest id reachable over links), kept.

    For each length of vector, lists defaults to the square root of the number
    of distinct vectors, an eighth of the sample at most; where that leaves
    more than list_rows vectors a list, residual cells divide the lists
    further (an eighth of the sample at most, too), so lists keep their size
    as the table grows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    dtype = "<f4" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8"
    vecs = written(_vectors(rows, dtype), "pq-vectors")
    same = vecs.where("digest is not null and id is not null").groupBy("digest")
    reps = written(same.agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.min("raw").alias("raw"), F.min("dim").alias("dim")), "pq-reps")
    # one row a length that occurs
    sizes = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().orderBy("dim").collect()}
    if sizes:
        links = _linked(reps, sizes, dtype, cosine, sample_rows, lists, list_rows, subspaces, codes, probe_sd, block_rows)
        links = written(links, "pq-links")
        comp = components(links.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
        direct = links.groupBy("digest").agg(F.sum("n").alias("direct"))
    else:
        comp = reps.select(F.col("rep").alias("node"), F.col("rep").alias("component"))
        direct = reps.select("digest", F.col("mult").alias("direct"))
    node = reps.select("digest", "rep", "mult").join(direct, "digest", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    node = node.select("digest", (F.col("mult") - 1 + F.coalesce("direct", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    # ids that repeat with other vectors meet in one node
    by_id = F.min(F.coalesce("component", "id"))
    out = vecs.select("id", "digest").join(node, "digest", "left")
    if vecs.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        out = out.withColumn("cid", F.coalesce("component", "id"))
    else:
        extra = written(out.where("id is not null").groupBy("id").agg(by_id.alias("low"), F.max(F.coalesce("component", "id")).alias("high")), "pq-ids")
        merged = components(extra.select(F.col("id").alias("a"), F.col("low").alias("b")).unionByName(extra.select(F.col("id").alias("a"), F.col("high").alias("b"))).unionByName(out.where("id is not null and component is not null").select(F.col("id").alias("a"), F.col("component").alias("b"))))
        out = out.join(merged.select(F.col("node").alias("id"), F.col("component").alias("whole")), "id", "left").withColumn("cid", F.coalesce("whole", "component", "id"))
    cid = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.col("cid"))
    n_links = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0))).cast("long")
    return out.select(F.col("id").alias(id_col), n_links.alias("n_links"), cid.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _index(reps: DataFrame, sizes: dict[int, int], dtype: str, sample_rows: int, lists: int | None, list_rows: int, subspaces: int, codes: int, cosine: float, probe_sd: float | None) -> dict[int, tuple[Index, int, float]]:
    """For each length: an index fitted on its share of the sample, the number of its first list, and the reach of its probes."""
    out, first, total = {}, 0, sum(sizes.values())
    for dim, n in sizes.items():
        share = max(min(n, 64), sample_rows * n // total)
        drawn = reps.where(F.col("dim") == dim).orderBy(F.xxhash64("digest"), "digest").limit(share).select("raw").collect()
        sample = unit_rows(np.frombuffer(b"".join(bytes(r["raw"]) for r in drawn), dtype).reshape(-1, dim))
        most = max(1, len(sample) // 8)
        coarse = max(1, min(lists or round(n**0.5), most))
        index = Index(sample, coarse, max(1, min(-(-n // (coarse * list_rows)), most)), subspaces, min(codes, 256))
        out[dim] = (index, first, index.reach(sample, cosine, probe_sd))
        first += index.size
    return out


def _linked(reps: DataFrame, sizes: dict[int, int], dtype: str, cosine: float, sample_rows: int, lists: int | None, list_rows: int, subspaces: int, codes: int, probe_sd: float | None, block_rows: int) -> DataFrame:
    """(digest, rep, n, low) of every tile: links counted there, and the smallest id reached."""
    indexes = _index(reps, sizes, dtype, sample_rows, lists, list_rows, subspaces, codes, cosine, probe_sd)
    width = int(dtype[-1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in b.column("dim").unique().to_pylist():
                (index, first, reach), mine = indexes[dim], b.filter(pc.equal(b.column("dim"), dim))
                for k in range(0, mine.num_rows, 2000):
                    part = mine.slice(k, 2000)
                    u = unit_rows(_plain(part.column("raw"), dtype, dim))
                    home, code, miss = index.encode(u)
                    near = [first + p for p in index.probes(u, home, reach)]
                    code_col = pa.array([c.tobytes() for c in code], pa.binary())
                    cols = [part.column(c) for c in ("digest", "rep", "mult", "raw")]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(first + home), pa.array(near, pa.list_(pa.int64())), code_col, pa.array(miss)], names=["digest", "rep", "mult", "raw", "list", "probes", "code", "miss"])

    coded = written(reps.mapInArrow(encode, "digest binary, rep long, mult long, raw binary, list long, probes array<long>, code binary, miss double"), "pq-index")
    guests = coded.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count("*").alias("g"))
    part = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / block_rows).cast("int")
    blocks = coded.groupBy("list").agg(F.count("*").alias("c")).join(guests, "list", "left").select("list", part(F.col("c")).alias("nb"), part(F.col("g")).alias("ng"))
    blocks = written(blocks, "pq-lists")
    place = lambda n: F.pmod(F.xxhash64("digest"), F.col(n)).cast("int")
    span = lambda a, b: F.when(F.lit(True) & (a <= b), F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    m = coded.join(blocks, "list").withColumn("i", place("nb"))
    cols = ["list", "i", "j", "role", "digest", "rep", "mult", "raw", "code", "miss"]
    # tiles of a list: members i against members j >= i, and (j below 0) against guests
    held = F.concat(span(F.col("i"), F.col("nb") - 1), F.when(F.col("ng") > 0, F.transform(F.sequence(F.lit(1), F.col("ng")), lambda x: -x)).otherwise(F.array().cast("array<int>")))
    member = m.withColumn("j", F.explode(held)).withColumn("role", F.lit(0)).select(*cols)
    again = m.where("i > 0").withColumn("j", F.col("i")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j") - 1))).withColumn("role", F.lit(1)).select(*cols)
    guest = coded.withColumn("list", F.explode("probes")).join(blocks, "list").withColumn("j", -1 - place("ng"))
    guest = guest.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("role", F.lit(1))
    guest = guest.select(*[F.lit(None).cast("binary").alias("code") if c == "code" else c for c in cols])
    tiles = member.unionByName(again).unionByName(guest)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        at, i, j = (t.column(c)[0].as_py() for c in ("list", "i", "j"))
        dim = len(t.column("raw")[0].as_py()) // width
        index, first, _ = indexes[dim]
        at -= first
        role, rep, mult = (t.column(c).to_numpy() for c in ("role", "rep", "mult"))
        u = unit_rows(_plain(t.column("raw"), dtype, dim))
        a, b = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        empty = pa.table({"digest": pa.array([], pa.binary()), "rep": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "low": pa.array([], pa.int64())})
        if not len(a) or (i != j and not len(b)):
            return empty
        code = _plain(t.column("code").take(pa.array(a)), "u1", len(index.parts))
        members = (rep[a], mult[a], u[a], code, t.column("miss").to_numpy()[a])
        if i == j:
            n_links, low = _tile(index, at, members, (rep[a], mult[a], u[a]), True, cosine)
            rows = a
        else:
            n_links, low = _tile(index, at, members, (rep[b], mult[b], u[b]), False, cosine)
            rows = np.concatenate([a, b])
        hit = n_links > 0
        rows = rows[hit]
        return pa.table({"digest": t.column("digest").take(pa.array(rows)).cast(pa.binary()), "rep": pa.array(rep[rows]), "n": pa.array(n_links[hit].astype(np.int64)), "low": pa.array(low[hit])})

    return tiles.groupBy("list", "i", "j").applyInArrow(run, "digest binary, rep long, n long, low long")
