"""Whitening of vectors by a bit-sliced scatter matrix.

Vectors are whole numbers here. The fit list holds each distinct vector once (one grouping, so copies
are combined before they are shuffled). A task takes its part of the list in blocks of ``ROWS``: every
dimension is shifted by its least value in the block, cut into bit planes, and each plane packed across
the rows into 64-bit words. The product of two dimensions is the sum of 2**(a+b) times the bits that
plane a of the one and plane b of the other share, so AND and popcount give it exactly; the shifts are
added back as whole numbers. A task sends one row a pair of dimensions, in 32-bit limbs whose sums
can't overflow, and Spark adds them up. The driver sees dimensions x dimensions numbers, whatever the
rows, centres them as integers (n*Q - S*S', Python integers) and only then calls ``eigh``.

The whitened columns are checked on the fit list itself: ``identity_error`` is the largest entry of
their covariance (Spark's ``covar_pop``, which centres before it multiplies) minus the identity.

Edge cases: a vector that is null, empty or holds a null takes no part (callers turn what isn't finite
into nulls). Vectors of another length are a space of their own, with its own n, sums and components.
A null id stays a row; a repeated row is given again but fits once. A component without variance
(constant or too few distinct vectors: an eigenvalue not above ``FLAT`` of the largest) has no scale: its
``whitened`` is null and ``identity_error`` leaves it out (null if all are so); ``explained`` is null if
nothing varies. Of equal eigenvalues any basis is right. ``deviation`` is null where it passes a long.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import ship, write_shared

ROWS = 4096  # rows whose bits are packed together
LIMBS = 6  # of 32 bits, for sums of products of longs
FLAT = 1e-13
TOP = 2**63 - 1


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, vec array<long>): floor of ``scale`` times each entry, vectors with an entry that is null or
    not finite left out."""
    def whole(v: Column) -> Column:
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), F.floor(v.cast("double") * scale).cast("long"))

    out = rows.select(F.col(id_col).alias("id"), F.transform(F.col(vec_col), whole).alias("vec"))
    return out.where("vec IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, x -> x IS NULL)")


def planes_of(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bit planes x words, exponent of each plane, planes of each dimension) of shifted columns, which
    are unsigned and start at 0."""
    widths = [int(m).bit_length() for m in block.max(axis=0)]
    words = -(-len(block) // 64)
    planes = np.zeros((sum(widths), words), np.uint64)
    power = np.zeros(sum(widths), np.int64)
    at = 0
    for j, w in enumerate(widths):
        for b in range(w):
            bits = np.packbits(((block[:, j] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            planes[at].view(np.uint8)[:len(bits)] = bits
            power[at] = b
            at += 1
    return planes, power, widths


def scatter(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of the columns of ``vecs`` (rows x dimensions, int64), as Python integers."""
    n, d = vecs.shape
    low = vecs.min(axis=0)
    planes, power, widths = planes_of((vecs.astype(np.uint64) - low.astype(np.uint64)))  # modulo 2**64: exact
    shift = low.astype(object)
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    # n * 2**(2w) bounds a product of shifted columns: int64 while that fits, else Python integers
    kind = np.int64 if 2 * max(widths, default=0) + n.bit_length() < 63 else object
    weight = np.array([1 << int(p) for p in power], kind)
    starts = np.concatenate([[0], np.cumsum(widths)])[:-1].astype(int)
    used = [j for j, w in enumerate(widths) if w]
    heads = starts[used]
    counts = np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
    if used:
        sums[used] = np.add.reduceat(counts.astype(kind) * weight, heads).astype(object)
    for rank, j in enumerate(used):
        row = np.zeros(len(used) - rank, kind)
        for p in range(starts[j], starts[j] + widths[j]):
            shared = np.bitwise_count(planes[p] & planes[starts[j]:]).sum(axis=1, dtype=np.int64)
            row += weight[p] * np.add.reduceat(shared.astype(kind) * weight[starts[j]:], heads[rank:] - starts[j])
        products[j, used[rank:]] = products[used[rank:], j] = row.astype(object)
    products = products + np.outer(shift, sums) + np.outer(sums, shift) + n * np.outer(shift, shift)
    return sums + n * shift, products


def limbs(value: int) -> list[int]:
    """``value`` as ``LIMBS`` numbers of 32 bits, the last one signed."""
    return [value >> 32 * k & 0xFFFFFFFF for k in range(LIMBS - 1)] + [value >> 32 * (LIMBS - 1)]


SCATTER = "d int, i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, rows x length int64) of each length of vectors in the column ``vec``."""
    vec = batch.column(batch.schema.get_field_index("vec"))
    offsets = vec.offsets.to_numpy()
    values, size = vec.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for d in np.unique(size).tolist():
        own = np.flatnonzero(size == d)
        yield d, own, values[offsets[own][:, None] + np.arange(d)]


def scatter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's vectors: (d, i, j) the product of two dimensions, (d, i, -1) the sum of one and
    (d, -1, -1) the number of vectors."""
    held: dict[int, list] = {}
    total: dict[int, list] = {}

    def add(d):
        block = np.concatenate(held.pop(d))
        for at in range(0, len(block), ROWS):
            part = block[at:at + ROWS]
            s, q = scatter(part)
            t = total.setdefault(d, [0, 0, 0])
            t[0], t[1], t[2] = t[0] + len(part), t[1] + s, t[2] + q

    for batch in batches:
        for d, _, vecs in matrices(batch):
            held.setdefault(d, []).append(vecs)
            if sum(map(len, held[d])) >= ROWS:
                add(d)
    for d in list(held):
        add(d)
    for d, (n, s, q) in total.items():
        rows = [(d, -1, -1, *limbs(n))] + [(d, i, -1, *limbs(int(v))) for i, v in enumerate(s)]
        rows += [(d, i, j, *limbs(int(q[i, j]))) for i in range(d) for j in range(i, d)]
        names = [f.split()[0] for f in SCATTER.split(", ")]
        kinds = [pa.int32()] * 3 + [pa.int64()] * LIMBS
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class Space:
    """The whitening of one vector length from exact sums."""

    def __init__(self, n: int, sums: list[int], products: np.ndarray, components: int):
        self.n, self.sums = n, sums
        s = np.array(sums, object)
        centred = n * products - np.outer(s, s)  # integers
        cov = np.array([[v / (n * n) for v in row] for row in centred.tolist()], float)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[:components]
        trace = sum(centred.diagonal().tolist()) / (n * n)
        self.values = values[order]
        self.axes = vectors[:, order]
        self.axes = self.axes * np.where(self.axes[np.abs(self.axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
        self.explained = [v / trace if trace > 0 else None for v in np.maximum(self.values, 0.0).tolist()]
        self.flat = (self.values <= FLAT * max(values.max(), 0.0)) | (self.values <= 0)
        self.scale = np.where(self.flat, 1.0, np.sqrt(np.where(self.flat, 1.0, self.values)))
        self.mean = np.array([v / n for v in sums], float)
        self.identity_error: float | None = None

    def whiten(self, vecs: np.ndarray) -> np.ndarray:
        return (vecs - self.mean) @ self.axes / self.scale

    def deviation(self, vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of (n*x - S)**2, whether it passes a long) of each row: arithmetic modulo 2**64, which is exact
        for what fits; doubles tell what can't, Python integers decide near the border."""
        n, s = self.n, np.array([v % 2**64 for v in self.sums], np.uint64)
        off = vecs.astype(np.uint64) * np.uint64(n % 2**64) - s
        out = (off * off).sum(axis=1, dtype=np.uint64).view(np.int64)
        rough = ((vecs - self.mean) ** 2).sum(axis=1) * float(n) ** 2
        for r in np.flatnonzero(rough > 0.9 * TOP):
            exact = sum((n * x - t) ** 2 for x, t in zip(vecs[r].tolist(), self.sums, strict=True))
            out[r] = min(exact, TOP)
            rough[r] = 0 if exact <= TOP else np.inf
        return out, np.isinf(rough)


def fit_spaces(fit: DataFrame, components: int = 4) -> dict[int, Space]:
    """The space of each vector length in ``fit`` (vec: distinct vectors)."""
    by_pair = fit.mapInArrow(scatter_rows, SCATTER).groupBy("d", "i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    found: dict[int, dict] = {}
    for r in by_pair.collect():  # d * (d + 3) / 2 + 1 rows a length d
        found.setdefault(r["d"], {})[r["i"], r["j"]] = sum(r[f"l{k}"] << 32 * k for k in range(LIMBS))
    out = {}
    for d, sums in found.items():
        products = np.array([[sums[min(i, j), max(i, j)] for j in range(d)] for i in range(d)], object).reshape(d, d)
        out[d] = Space(sums[-1, -1], [sums[i, -1] for i in range(d)], products, min(components, d))
    return out


def measure_identity(fit: DataFrame, spaces: dict[int, Space]) -> None:
    """Set every space's ``identity_error`` from the covariance of its whitened fit list."""
    def whitened(batches):
        for batch in batches:
            for d, _, vecs in matrices(batch):
                w = spaces[d].whiten(vecs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), d, np.int32)), pa.array(list(w), pa.list_(pa.float64()))], names=["d", "w"])

    most = max((len(s.values) for s in spaces.values()), default=0)
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    if not pairs:
        return
    cols = [F.get("w", F.lit(k)).alias(f"w{k}") for k in range(most)]
    cov = fit.mapInArrow(whitened, "d int, w array<double>").select("d", *cols).groupBy("d").agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs])
    for r in cov.collect():  # a row a length
        space = spaces[r["d"]]
        own = [abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < len(space.values) and not space.flat[i] and not space.flat[j]]
        space.identity_error = max(own, default=None)


def whitened_rows(rows: DataFrame, id_col: str = "id", vec_col: str = "vec", components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of rows (id, vec array<long>): a
    row for each vector and component."""
    ship(rows.sparkSession)
    valid = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where("vec IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, x -> x IS NULL)")
    fit = write_shared(valid.select("vec").distinct(), "fit")
    spaces = fit_spaces(fit, components)
    measure_identity(fit, spaces)
    kind = valid.schema["id"].dataType.simpleString()

    def project(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            for d, own, vecs in matrices(batch):
                space = spaces[d]
                k, w = len(space.values), space.whiten(vecs)
                deviation, over = space.deviation(vecs)
                each = np.repeat(np.arange(len(own)), k)
                which = np.tile(np.arange(k), len(own))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(own[each])), pa.array((which + 1).astype(np.int32)), pa.array(np.full(len(each), space.n, np.int64)),
                    pa.array(deviation[each], mask=over[each]), pa.array(w.reshape(-1), mask=space.flat[which]),
                    pa.array([space.explained[c] for c in which], pa.float64()), pa.array([space.identity_error] * len(each), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return valid.mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
