"""Embedding whitening by an incremental eigendecomposition and a Rayleigh-Ritz refinement.

Each task keeps the eigenpairs of the scatter of its own vectors and updates them with every
vector: a centred rank-one change, whose new eigenvalues are the roots of a secular equation.
The spectra of tasks are combined in the same way, one eigenpair at a time. What comes out is an
orthonormal basis near the eigenvectors of the whole covariance; a pass over all vectors projects
the covariance on it, and the small eigenproblem that is left makes the components exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginflow.llm.frames import explode_batches, saved, ship_code, summed_arrays

COMPONENTS = 32
SCALE = 64  # an entry c becomes floor(SCALE * c) + OFFSET
OFFSET = 1_000_000
LARGEST = 2.0**52  # entries are cut there, far beyond any embedding
LOW_BITS = 26  # sums are kept in two halves, so that they stay exact
FLAT = 1e-12  # of the trace: a component of less variance is no direction but rounding
FAN_IN = (256, 16)  # spectra are combined in these many groups, one step after the other
EPS = np.finfo(np.float64).eps


# --- rank-one changes ------------------------------------------------------------------------------


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + rho z z^T, with differences to d that are exact to the last digits.

    `d` rises strictly, no `z` is 0, rho > 0. Root j lies between d[j] and d[j + 1], the last one
    beyond the last. Each is found as its distance from the nearer end, by a rational function with
    poles at both ends that agrees with the equation on either side; a bracket guards the steps.
    Returns the roots and the matrix d[i] - root[j].
    """
    k = len(d)
    zz = rho * z * z
    span = zz.sum()
    gap = np.append(np.diff(d), span)
    middle = d + gap / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        at_middle = 1 + (zz[:, None] / (d[:, None] - middle[None, :])).sum(axis=0)
        right = at_middle < 0  # the root is in the right half
        right[-1] = False
        origin = np.where(right, np.append(d[1:], d[-1]), d)
        delta = d[:, None] - origin[None, :]
        low = np.where(right, -gap / 2, 0.0)
        high = np.where(right, 0.0, gap / 2)
        high[-1] = gap[-1]
        if at_middle[-1] < 0:
            low[-1] = gap[-1] / 2
        x = (low + high) / 2
        own, after = np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
        a, b = delta[own, own], delta[after, own]
        # Poles up to each root, and those beyond.
        upto = (np.arange(k)[:, None] <= own[None, :]).astype(np.float64)
        beyond = 1 - upto
        inner = own < k - 1
        for _ in range(100):
            away = delta - x[None, :]
            terms = zz[:, None] / away
            slopes = terms / away
            psi, phi = np.einsum("ij,ij->j", terms, upto), np.einsum("ij,ij->j", terms, beyond)
            f = 1 + psi + phi
            low, high = np.where(f <= 0, x, low), np.where(f >= 0, x, high)
            done = np.abs(f) <= 2 * EPS * k * (1 + np.abs(psi) + np.abs(phi))
            done |= high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
            if done.all():
                break
            dpsi = np.einsum("ij,ij->j", slopes, upto)
            dphi = np.einsum("ij,ij->j", slopes, beyond)
            s, t = dpsi * (a - x) ** 2, np.where(inner, dphi * (b - x) ** 2, 0.0)
            c = 1 + (psi - dpsi * (a - x)) + np.where(inner, phi - dphi * (b - x), 0.0)
            # c + s / (a - x) + t / (b - x) = 0, for the last root without the pole at b.
            p = c * (a + b) + s + t
            q = c * a * b + s * b + t * a
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            half = (p + np.copysign(root, p)) / 2
            one, two = half / c, q / half
            new = np.where((one > low) & (one < high), one, two)
            new = np.where(inner, new, a + s / c)
            fits = np.isfinite(new) & (new > low) & (new < high)
            x = np.where(done, x, np.where(fits, new, (low + high) / 2))
        return origin + x, delta - x[None, :]


def rank_one(
    values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float
) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of Q diag(values) Q^T + rho v v^T, values rising; rho >= 0.

    Deflation: an eigenpair that the change hardly touches stays as it is, and of two eigenvalues
    that are almost one a rotation makes one vector free of the change.
    """
    z = vectors.T @ v
    size = np.sqrt(z @ z)
    rho = rho * size * size
    if not rho > 0:
        return values, vectors
    z = z / size
    d, q = values.copy(), vectors
    tol = 8 * EPS * max(np.abs(d).max(), rho)
    touched = np.flatnonzero(rho * np.abs(z) > tol)
    if len(touched) > 1:
        gaps = np.diff(d[touched])
        c, s = z[touched[1:]], z[touched[:-1]]
        if (np.abs(gaps * c * s) <= tol * (c * c + s * s)).any():
            q, kept, at = q.copy(), [], touched[0]
            for nxt in touched[1:]:
                tau = np.hypot(z[nxt], z[at])
                c, s = z[nxt] / tau, -z[at] / tau
                if abs((d[nxt] - d[at]) * c * s) <= tol:
                    z[nxt], z[at] = tau, 0.0
                    q[:, at], q[:, nxt] = c * q[:, at] + s * q[:, nxt], c * q[:, nxt] - s * q[:, at]
                    d[at], d[nxt] = d[at] * c * c + d[nxt] * s * s, d[at] * s * s + d[nxt] * c * c
                else:
                    kept.append(at)
                at = nxt
            touched = np.array([*kept, at])
    if len(touched):
        order = np.argsort(d[touched], kind="stable")
        touched = touched[order]
        roots, apart = secular_roots(d[touched], z[touched], rho)
        # The change whose exact eigenvalues these roots are; its vectors are orthogonal.
        k = len(touched)
        own = d[touched]
        ratio = -apart  # [i, j] = root[j] - d[i]
        # Root j is set against d[j] before i, and d[j + 1] from there on.
        at_or_after = np.arange(k)[:, None] <= np.arange(k - 1)[None, :]
        ratio[:, :-1] /= np.where(at_or_after, own[1:], own[:-1]) - own[:, None]
        exact = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=1) / rho)), z[touched])
        turn = exact[:, None] / apart
        turn /= np.sqrt((turn * turn).sum(axis=0))[None, :]
        q = q.copy() if q is vectors else q
        q[:, touched] = q[:, touched] @ turn
        d[touched] = roots
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


@dataclass
class Spectrum:
    """Number, mean and scatter of some vectors, the scatter by its eigenpairs."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def add(self, x: np.ndarray) -> None:
        """One vector more: the scatter changes by the product of its distances to both means."""
        gap = x - self.mean
        self.n += 1
        self.mean = self.mean + gap / self.n
        self.values, self.vectors = rank_one(
            self.values, self.vectors, gap, (self.n - 1) / self.n
        )

    def combine(self, other: Spectrum) -> None:
        """The vectors of another spectrum: its eigenpairs one by one, then the gap of the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        gap, n = other.mean - self.mean, self.n + other.n
        self.values, self.vectors = rank_one(
            self.values, self.vectors, gap, self.n * other.n / n
        )
        self.mean = self.mean + gap * (other.n / n)
        self.n = n

    def pack(self) -> bytes:
        return np.concatenate(
            [[self.n], self.mean, self.values, self.vectors.ravel()]
        ).astype(np.float64).tobytes()

    @classmethod
    def unpack(cls, data: bytes, d: int) -> Spectrum:
        x = np.frombuffer(data, dtype=np.float64)
        mean, values = x[1 : d + 1], x[d + 1 : 2 * d + 1]
        return cls(int(x[0]), mean.copy(), values.copy(), x[2 * d + 1 :].reshape(d, d).copy())


# --- the whole table -------------------------------------------------------------------------------


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and has neither null nor non-finite entries."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    entries = F.col(vector).cast("array<double>")
    return df.filter(F.coalesce(F.forall(entries, finite), F.lit(False)))


def vectors_of(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    """(rows, d) whole numbers as float64, exact: floor(SCALE * c), without the OFFSET."""
    column = batch.column(batch.schema.get_field_index(name))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).reshape(-1, d)


def exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the sum of each dimension, without the OFFSET."""

    def total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(1 + 2 * d, dtype=np.int64)
        for batch in batches:
            x = vectors_of(batch, "vector", d).astype(np.int64)
            out[0] += len(x)
            out[1 : d + 1] += (x >> LOW_BITS).sum(axis=0)
            out[d + 1 :] += (x & ((1 << LOW_BITS) - 1)).sum(axis=0)
        return out

    sums = summed_arrays(rows, total, "int64")
    if not len(sums):
        return 0, [0] * d
    high, low = sums[1 : d + 1].tolist(), sums[d + 1 :].tolist()
    return int(sums[0]), [(h << LOW_BITS) + l for h, l in zip(high, low)]


def basis_of(rows: DataFrame, d: int) -> np.ndarray:
    """An orthonormal basis (columns) near the eigenvectors of all vectors' covariance.

    Every task has one spectrum of its rows; those of a group of tasks are combined in the order
    of the tasks, in two steps, and what is left of them here. A spectrum is d * d numbers.
    """
    ship_code(rows.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(d)
        for batch in batches:
            for x in vectors_of(batch, "vector", d):
                own.add(x)
        if own.n:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], type=pa.int32()),
                    "data": pa.array([own.pack()], type=pa.binary()),
                }
            )

    def combined(table: pa.Table) -> Spectrum:
        ordered = table.sort_by("part").column("data")
        whole = Spectrum.unpack(ordered[0].as_py(), d)
        for data in ordered.slice(1):
            whole.combine(Spectrum.unpack(data.as_py(), d))
        return whole

    def combine(groups: int):
        def run(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py() % groups
            return pa.table(
                {
                    "part": pa.array([part], type=pa.int32()),
                    "data": pa.array([combined(table).pack()], type=pa.binary()),
                }
            )

        return run

    schema = "part int, data binary"
    spectra = rows.select("vector").mapInArrow(make, schema)
    for groups in FAN_IN:
        spectra = spectra.groupBy(F.pmod("part", F.lit(groups))).applyInArrow(
            combine(groups), schema
        )
    q, _ = np.linalg.qr(combined(spectra.toArrow()).vectors)
    return q


def second_moments(rows: DataFrame, d: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of all vectors projected on the columns of `basis`, centred first, divisor n."""
    k = basis.shape[1]

    def total(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(1 + k * k)
        for batch in batches:
            y = (vectors_of(batch, "vector", d) - mean) @ basis
            out[0] += len(y)
            out[1:] += (y.T @ y).ravel()
        return out

    sums = summed_arrays(rows, total, "float64")
    moments = sums[1:].reshape(k, k) / sums[0]
    return (moments + moments.T) / 2


@dataclass(frozen=True)
class Whitening:
    """What turns vectors into whitened ones: one column of `vectors` for each component."""

    n: int
    sums: tuple[int, ...]  # of the whole numbers, OFFSET included
    vectors: np.ndarray
    variances: np.ndarray  # falling
    explained: np.ndarray  # share of the trace
    identity_error: float  # of the covariance of the whitened vectors, largest absolute entry

    @property
    def mean(self) -> np.ndarray:
        """Without the OFFSET, each rounded once."""
        return np.array([(s - OFFSET * self.n) / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.variances)


def fit(rows: DataFrame, d: int, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of all `rows` (`vector`, of `d` entries each); None without rows.

    The basis from the spectra is refined by Rayleigh-Ritz: with all d directions in the basis
    the small eigenproblem has the covariance's own eigenvectors. Components of next to no
    variance are left out, as nothing can be scaled to 1 there.
    """
    n, sums = exact_sums(rows, d) if d > 0 else (0, [])
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    q = basis_of(rows, d)
    values, turn = np.linalg.eigh(second_moments(rows, d, mean, q))
    values, turn = values[::-1], turn[:, ::-1]
    trace = values.sum()
    k = int(min(most, (values > FLAT * max(trace, 0)).sum())) if trace > 0 else 0
    vectors = q @ turn[:, :k]
    # One sign for all rows and runs: the largest entry is positive.
    if k:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    error = 0.0
    if k:
        scaled = vectors / np.sqrt(values[:k])
        error = float(np.abs(second_moments(rows, d, mean, scaled) - np.eye(k)).max())
    whole = tuple(s + OFFSET * n for s in sums)
    return Whitening(n, whole, vectors, values[:k], values[:k] / trace if k else values[:0], error)


def deviations(x: np.ndarray, n: int, sums: Sequence[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)^2, exact; None where it has no place in a long."""
    # The OFFSET is in both and falls out.
    centre = [s - OFFSET * n for s in sums]
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, centre), default=0)
    if bound * bound * max(1, len(centre)) < 1 << 63:
        gap = n * x.astype(np.int64) - np.array(centre, dtype=np.int64)
        return (gap * gap).sum(axis=1).tolist()
    out = []
    for row in x.astype(np.int64).tolist():
        total = sum((n * v - c) ** 2 for v, c in zip(row, centre))
        out.append(total if total < 1 << 63 else None)
    return out


RESULT = (
    "{id} long, component int, n long, deviation long, whitened double, explained double,"
    " identity_error double"
)


def whiten(
    df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", most: int = COMPONENTS
) -> DataFrame:
    """A row for each usable vector and component, up to `most` components.

    Vectors that are null or hold null or non-finite entries are left out, and so are those of
    another length than most have (of two lengths that are as frequent, the longer one stays).
    Entries become whole numbers, floor(64 * c) + 1000000. `n` is how many vectors the whitening
    was made from, all that are left; `deviation` the sum over dimensions of (n * x - S)^2 with S
    the sum of all x, exact, null where it is beyond a long; `whitened` the centred vector along
    the component, numbered from 1 by falling variance, over its standard deviation; `explained`
    the component's share of the trace; `identity_error` how far the covariance of `whitened` is
    from the identity.

    Null ids stay null, rows that repeat an id or a vector count as they are. A table that is
    empty, or whose vectors are all equal, has no component and gives no rows. Other columns do
    not matter. The work is d^2 to d^3 a vector for d entries; tables of d * d numbers are all that
    leaves a task.
    """
    rows = usable(df, vector).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    most_frequent = (
        rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    )
    d = most_frequent["d"] if most_frequent else 0
    rows = saved(rows.filter(F.size("vector") == d))
    made = fit(rows.select("vector"), d, most)
    schema = T.StructType.fromDDL(RESULT.format(id="vec_id"))
    if made is None or not len(made.variances):
        return df.sparkSession.createDataFrame([], schema)
    k = len(made.variances)

    def compute(batch: pa.RecordBatch) -> Iterator[dict]:
        x = vectors_of(batch, "vector", d)
        ids = batch.column(batch.schema.get_field_index("vec_id"))
        step = max(1, (1 << 16) // k)
        for at in range(0, len(x), step):
            part = x[at : at + step]
            times = np.repeat(np.arange(len(part)), k)
            exact = pa.array(deviations(part, made.n, made.sums), type=pa.int64())
            yield {
                "vec_id": ids.slice(at, step).take(pa.array(times)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                "n": pa.array(np.full(len(times), made.n)),
                "deviation": exact.take(pa.array(times)),
                "whitened": pa.array(made.whitened(part).ravel()),
                "explained": pa.array(np.tile(made.explained, len(part))),
                "identity_error": pa.array(np.full(len(times), made.identity_error)),
            }

    return explode_batches(rows, schema, compute)
