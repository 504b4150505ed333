"""Whitening by principal components that come from an exact characteristic polynomial.

Entries are fixed to integers, so the scatter matrix is an integer matrix without
rounding. Its characteristic polynomial is computed modulo many primes, each by
reduction to Hessenberg form, and put together by the Chinese remainder theorem. The
polynomial of a symmetric matrix has real roots only, so the sign changes of its
coefficients count the roots above any point exactly; halving isolates the largest
ones. Components are null vectors of the matrix less the root, by inverse iteration
in decimals of many digits.

Rows are read in Arrow batches where they lie. What the driver holds depends on the
number of dimensions d alone: d * d integers, and d coefficients of some d * 60 bits.
Work per prime grows with the cube of d and is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codeloom.session import stage

# A step of the integer grid is one part in GRID.
GRID = 256
COMPONENTS = 4
# Integers are cut into limbs of so many bits, and as many rows are multiplied at once:
# the products then add up below 2**53, so that floating-point products are exact.
LIMB_BITS, PRODUCT_ROWS = 20, 4096
# Roots are known to so many bits; roots that agree in all of them count as one
# root with a space of components.
ROOT_BITS = 240
DIGITS = 120
_LONG = 1 << 63


def fixed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, x``: entries as whole steps of the grid, without the vectors that are null
    or hold a null or non-finite entry. Steps beyond 64 bits are held at its ends."""
    entry = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    double = F.transform(vector_col, lambda c: c.cast("double"))
    return (
        vectors.select(F.col(id_col).alias("id"), double.alias("v"))
        .filter(F.col("v").isNotNull() & ~F.exists("v", entry))
        .select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(GRID)))).alias("x"))
    )


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch as rows, shorter ones followed by zeros."""
    column = batch.column("x")
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def fit_list(fixed_vectors: DataFrame, dims: int) -> DataFrame:
    """``x``: each distinct vector once, shorter ones followed by zeros."""
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    return fixed_vectors.select(padded.alias("x")).distinct()


def _exact_sums(fit: DataFrame, places: int, dims: int, add) -> list[int]:
    """Whole numbers of any size, summed over the tasks' rows.

    ``add(total, rows)`` adds a batch to a task's ``places`` Python numbers. They leave
    the task as digits in base 2**40, which Spark adds up as longs, place by place.
    """
    low = (1 << 40) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(places, object)
        for batch in batches:
            for at in range(0, batch.num_rows, PRODUCT_ROWS):
                total = add(total, _rows(batch.slice(at, PRODUCT_ROWS), dims))
        digits = []
        for place, value in enumerate(total.tolist()):
            sign, value, digit = (-1 if value < 0 else 1), abs(value), 0
            while value:
                digits.append((place, digit, sign * (value & low)))
                value, digit = value >> 40, digit + 1
        columns = [pa.array(c, pa.int64()) for c in zip(*digits, strict=True)] or [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays(columns, names=["place", "digit", "s"])

    out = [0] * places
    parts = fit.mapInArrow(run, "place long, digit long, s long").groupBy("place", "digit").agg(F.sum("s").alias("s"))
    for r in parts.collect():
        out[r["place"]] += r["s"] << (40 * r["digit"])
    return out


def _large(values: np.ndarray) -> bool:
    """Whether a sum or difference of two such numbers may leave 64 bits."""
    return bool(values.size) and max(int(values.max()), -int(values.min())) >= 1 << 61


def _limbs(rows: np.ndarray, centre: list[int]) -> list[np.ndarray]:
    """``rows - centre`` as limbs: its value is the sum of limb k times 2**(20 k)."""
    own = np.array(centre, object)
    rest = rows.astype(object) - own if _large(rows) or _large(own) else rows - own.astype(np.int64)
    out, half = [], 1 << (LIMB_BITS - 1)
    while True:
        low = ((rest + half) & ((1 << LIMB_BITS) - 1)) - half
        out.append(low.astype(np.float64))
        rest = (rest - low) >> LIMB_BITS
        if not rest.any():
            return out


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many vectors, and the sum of each dimension."""

    def add(total: np.ndarray, rows: np.ndarray) -> np.ndarray:
        # halves of the bits, so that no sum of a batch leaves 64 bits
        high, low = (rows >> 32).sum(axis=0).astype(object), (rows & 0xFFFFFFFF).sum(axis=0).astype(object)
        return total + np.append(high * (1 << 32) + low, len(rows))

    *of_dims, n = _exact_sums(fit, dims + 1, dims, add)
    return n, of_dims


def scatter(fit: DataFrame, n: int, of_dims: list[int]) -> list[list[int]]:
    """``n * n`` times the covariance, exactly.

    Vectors are centred by the whole number nearest to their mean before they are
    multiplied; what that leaves of the mean is taken off at the end.
    """
    dims = len(of_dims)
    centre = [(2 * s + n) // (2 * n) for s in of_dims]

    def add(total: np.ndarray, rows: np.ndarray) -> np.ndarray:
        limbs = _limbs(rows, centre)
        for j, a in enumerate(limbs):
            for k, b in enumerate(limbs):
                total = total + (a.T @ b).astype(np.int64).astype(object).ravel() * (1 << LIMB_BITS * (j + k))
        return total

    products = _exact_sums(fit, dims * dims, dims, add)
    rest = [s - n * c for s, c in zip(of_dims, centre, strict=True)]
    return [[n * products[i * dims + j] - rest[i] * rest[j] for j in range(dims)] for i in range(dims)]


def _is_prime(n: int) -> bool:
    """Exact for n below 3,215,031,751 (four bases of the strong test)."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_above(bound: int) -> list[int]:
    """The largest primes below 2**31 whose product passes ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """``det(x I - matrix)`` modulo a prime below 2**31, leading coefficient first."""
    d = len(matrix)
    h = np.array([[v % p for v in row] for row in matrix], np.int64).reshape(d, d)
    for m in range(1, d - 1):
        found = np.flatnonzero(h[m:, m - 1])
        if not len(found):
            continue
        i = m + int(found[0])
        if i != m:
            h[[m, i]] = h[[i, m]]
            h[:, [m, i]] = h[:, [i, m]]
        inverse = pow(int(h[m, m - 1]), -1, p)
        u = h[m + 1 :, m - 1] * inverse % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    # row k: the polynomial of the leading k columns, lowest coefficient first
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        weights, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * below % p
            below = below * int(h[i, i - 1]) % p if i else below
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (polys[:k] * weights[:, None] % p).sum(axis=0)) % p
    return polys[d, ::-1].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """``det(x I - matrix)`` of a positive semi-definite matrix, leading coefficient first.

    Its roots add up to the trace, which bounds every coefficient and so the number
    of primes. Each prime is a row of a Spark job.
    """
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    mean = -(-trace // d)
    bound = max(math.comb(d, k) * mean**k for k in range(d + 1))
    primes = primes_above(2 * bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("p").to_pylist()
            found = [polynomial_mod(matrix, p) for p in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("p"), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"]
            )

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    product, out = math.prod(primes), [0] * (d + 1)
    for r in rows.mapInArrow(run, "p long, c array<long>").collect():
        others = product // r["p"]
        basis = others * pow(others, -1, r["p"])
        out = [o + basis * c for o, c in zip(out, r["c"], strict=True)]
    out = [o % product for o in out]
    return [o - product if 2 * o > product else o for o in out]


def roots_above(poly: list[int], point: int) -> int:
    """How many roots of a polynomial with real roots only are above ``point``, each as
    often as it occurs: the sign changes of the coefficients after a shift."""
    shifted = list(poly)
    if point:
        for end in range(len(shifted), 1, -1):
            for i in range(1, end):
                shifted[i] += point * shifted[i - 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], top: int, bits: int) -> list[tuple[int, int]]:
    """The ``top`` largest positive roots, or what there is of them, in falling order, as
    ``(ceil(root * 2**bits), multiplicity)``; roots that agree in this count as one."""
    scaled = [c << (bits * k) for k, c in enumerate(poly)]
    limit = abs(poly[1]) << bits if len(poly) > 1 else 0  # their sum

    def value(point: int) -> int:
        out = 0
        for c in scaled:
            out = out * point + c
        return out

    found: list[tuple[int, int]] = []
    # intervals without their lower end, the highest one last, and the roots above both ends
    positive = roots_above(scaled, 0)
    todo = [(0, limit, positive, 0)]
    while todo and sum(m for _, m in found) < top:
        low, high, above_low, above_high = todo.pop()
        inside = above_low - above_high
        if inside == 0:
            continue
        if inside == 1 and (sign := value(high)) != 0:
            # one root: halve by the sign of the polynomial alone
            while high - low > 1:
                middle = (low + high) // 2
                v = value(middle)
                if v == 0:
                    low, high = middle - 1, middle
                elif (v > 0) == (sign > 0):
                    high = middle
                else:
                    low = middle
        if inside == 1 or high - low == 1:
            found.append((high, inside))
        else:
            middle = (low + high) // 2
            above = roots_above(scaled, middle)
            todo += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found


def null_vectors(matrix: list[list[int]], root: Decimal, count: int) -> list[list[Decimal]]:
    """``count`` orthonormal vectors of the null space of ``matrix - root``, by inverse
    iteration. The root is known to far more digits than a double has, so that one
    solution already leaves next to nothing of the other components."""
    d = len(matrix)
    with localcontext(Context(prec=DIGITS)):
        lu = np.array([[Decimal(v) for v in row] for row in matrix], object).reshape(d, d)
        for i in range(d):
            lu[i, i] -= root
        tiny = (abs(root) + 1) * Decimal(10) ** (10 - DIGITS)
        order = list(range(d))
        for k in range(d):
            best = k + max(range(d - k), key=lambda i: abs(lu[k + i, k]))
            if best != k:
                lu[[k, best]] = lu[[best, k]]
                order[k], order[best] = order[best], order[k]
            if abs(lu[k, k]) < tiny:
                lu[k, k] = tiny
            lu[k + 1 :, k] /= lu[k, k]
            lu[k + 1 :, k + 1 :] -= np.outer(lu[k + 1 :, k], lu[k, k + 1 :])

        def solve(v: np.ndarray) -> np.ndarray:
            v = v[order]
            for k in range(d):
                v[k + 1 :] -= lu[k + 1 :, k] * v[k]
            for k in range(d - 1, -1, -1):
                v[k] /= lu[k, k]
                v[:k] -= lu[:k, k] * v[k]
            return v

        out: list[np.ndarray] = []
        for j in range(count):
            # no two starts alike, and none that a symmetry of the data would make vanish
            v = np.array([Decimal(1) / (1 + (i + 1) * (i + j + 2) % (d + 7)) for i in range(d)], object)
            for _ in range(3):
                v = solve(v)
                for _ in range(2):
                    for other in out:
                        v = v - other * (v * other).sum()
                    v = v / (v * v).sum().sqrt()
            out.append(v)
        largest = [max(range(d), key=lambda i: abs(v[i])) for v in out]
        return [list(v if v[i] > 0 else -v) for v, i in zip(out, largest, strict=True)]


@dataclass(frozen=True)
class Whitening:
    """What is needed to whiten a vector. ``components`` are over the root of their
    eigenvalue (of the scatter), in falling order; null for an eigenvalue of zero."""

    n: int
    sums: list[int]
    components: list[list[float] | None]
    explained: list[float | None]

    def project(self, fixed_vectors: DataFrame) -> DataFrame:
        """``id, deviation, whitened``: an exact sum of squares and one number per
        component, in a narrow pass."""
        n, dims = self.n, len(self.sums)
        own = np.array(self.sums, object)
        weights = np.array([c or [0.0] * dims for c in self.components]).reshape(len(self.components), dims).T
        known = [c is not None for c in self.components]
        id_type = fixed_vectors.schema["id"].dataType
        kind = to_arrow_type(id_type)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _rows(batch, dims)
                most = max(int(x.max()), -int(x.min())) if x.size else 0
                bound = n * most + max(map(abs, self.sums), default=0)
                small = bound * bound * max(dims, 1) < 1 << 63
                away = x * n - own.astype(np.int64) if small else x.astype(object) * n - own
                squares = (away * away).sum(axis=1).tolist()
                made = (away.astype(np.float64) @ weights).tolist()
                whitened = [[v if k else None for v, k in zip(row, known, strict=True)] for row in made]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").cast(kind), pa.array(list(map(str, squares)), pa.string()),
                        pa.array(whitened, pa.list_(pa.float64())),
                    ],
                    names=["id", "deviation", "whitened"],
                )

        return fixed_vectors.select("id", "x").mapInArrow(
            run, f"id {id_type.simpleString()}, deviation string, whitened array<double>"
        )


def fit(spark: SparkSession, distinct: DataFrame, dims: int, top: int = COMPONENTS) -> Whitening:
    """The components of the distinct vectors, to double precision."""
    n, of_dims = sums(distinct, dims)
    count = min(top, dims)
    if n == 0 or dims == 0:
        return Whitening(n, of_dims, [None] * count, [None] * count)
    matrix = scatter(distinct, n, of_dims)
    trace = sum(matrix[i][i] for i in range(dims))
    bits = max(0, ROOT_BITS - trace.bit_length())
    components: list[list[float] | None] = []
    explained: list[float | None] = []
    if trace:
        for root, many in largest_roots(characteristic_polynomial(spark, matrix), count, bits):
            with localcontext(Context(prec=DIGITS)):
                value = Decimal(root) / (1 << bits)
                vectors = null_vectors(matrix, value, min(many, count - len(components)))
                components += [[float(c / value.sqrt()) for c in v] for v in vectors]
            explained += [root / (trace << bits)] * len(vectors)
    flat = count - len(components)
    return Whitening(
        n, of_dims, components + [None] * flat, explained + [0.0 if trace else None] * flat
    )


def identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """The largest entry, but for its sign, of the covariance of ``whitened`` (arrays of
    the fit list) less the identity; null without components."""
    known = [i for i, c in enumerate(model.components) if c is not None]
    if not known:
        return None
    at = [F.get("whitened", F.lit(i)) for i in known]
    pairs = [(i, j) for i in range(len(known)) for j in range(i + 1)]
    row = whitened.agg(*[F.covar_pop(at[i], at[j]).alias(f"c{k}") for k, (i, j) in enumerate(pairs)]).first()
    return max(abs(row[k] - (i == j)) for k, (i, j) in enumerate(pairs))


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = COMPONENTS
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for each vector
    and each of the ``top`` largest components (fewer in fewer dimensions).

    Vectors that are null or hold a null or non-finite entry are left out; shorter ones
    are read with zeros behind them, up to the longest. The model is fitted on each
    different vector once, so copies count once there, but every row is returned, also
    repeated and null ids. ``deviation`` is exact, as digits. Equal eigenvalues have some
    orthonormal components of their space; an eigenvalue of zero has none, so
    ``whitened`` is null there. An empty table, and one of empty vectors, gives no rows.
    """
    spark = vectors.sparkSession
    own = fixed(vectors, id_col, vector_col)
    dims = own.agg(F.max(F.size("x"))).first()[0] or 0
    distinct = stage(fit_list(own, dims), "whitening-fit")
    model = fit(spark, distinct, dims, top)
    of_fit = model.project(distinct.select(F.lit(0).alias("id"), "x"))
    error = identity_error(of_fit, model)
    explained = F.lit(model.explained).cast("array<double>") if model.explained else F.array().cast("array<double>")
    return (
        model.project(own)
        .select("id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
        .select(
            "id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
            "whitened", F.get(explained, F.col("i")).alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        )
    )
