"""Several viewing geometries: decomposition into components, and their joint tie to stations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Term
from . import solve


def decompose_los(frames: DataFrame, components: Sequence[int] = (1, 3), key: Sequence[str] = ("pixel",), vector: Sequence[Column] | None = None) -> DataFrame:
    """Per cell the components (1 east, 2 north, 3 up) from views (los, sigma and the unit vector e, n, u).

    Cells with fewer than two valid views get nulls.  sigma is the root of the
    diagonal of the inverse normal matrix.
    """
    e, n, u = vector or (F.col("e"), F.col("n"), F.col("u"))
    by_number = {1: ("east", e), 2: ("north", n), 3: ("up", u)}
    terms = [Term(*by_number[c]) for c in components]
    names = [t.name for t in terms]
    sums = solve.gram(frames, F.col("los"), terms, list(key), F.col("sigma"))
    m = len(terms)
    width = (m + 1) * (m + 2) // 2

    def run(batches):
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            if not batch.num_rows:
                continue
            full = solve._square(solve._list(batch.column(at["weighted"]), width), m + 1)
            count = np.asarray(batch.column(at["n"]))
            a, b = full[:, :m, :m], full[:, :m, m]
            inverse = np.linalg.pinv(a, hermitian=True)
            x, s = np.einsum("gij,gj->gi", inverse, b), np.sqrt(np.maximum(np.einsum("gii->gi", inverse), 0))
            bad = count < max(2, m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(at[k]) for k in key] + [pa.array(count)] + [pa.array(v[:, i].copy(), mask=bad) for v in (x, s) for i in range(m)],
                names=[*key, "views", *names, *[f"s_{c}" for c in names]],
            )

    keys = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in key)
    return sums.mapInArrow(run, f"{keys}, views long, " + ", ".join(f"`{c}` double" for c in [*names, *[f"s_{c}" for c in names]]))


def tie_frames(points: DataFrame, stations: DataFrame, components: Sequence[str] = ("e", "u"), floor: float = 0.1) -> DataFrame:
    """Joint tie of frames: components of every point and a plane for every frame, with station velocities as data.

    points: point, frame, x, y, los, sigma, e, n, u.  stations: point and the
    component columns ve, vn, vu.  Each point's components are eliminated (Schur
    complement) within its own rows, so what is summed over all points is one
    small matrix of the frames' planes, solved once -> frame, a, b, c.
    """
    sigma = F.greatest(F.col("sigma") / F.lit(points.agg(F.avg("sigma")).first()[0] or 1.0), F.lit(floor))
    named = {"e": "ve", "n": "vn", "u": "vu"}
    known = stations.select("point", *[F.col(named[c]).alias(f"k_{c}") for c in components])
    rows = points.select("point", "frame", F.struct("frame", "x", "y", "los", sigma.alias("s"), *components).alias("r")).join(known, "point", "left")
    grouped = rows.groupBy("point").agg(F.sort_array(F.collect_list("r")).alias("rows"), *[F.max(f"k_{c}").alias(f"k_{c}") for c in components])
    frames = [r[0] for r in points.select("frame").distinct().orderBy("frame").collect()]  # a handful of viewing geometries
    at, m, k = {f: i for i, f in enumerate(frames)}, 3 * len(frames), len(components)

    def run(batches):
        total, right = np.zeros((m, m)), np.zeros(m)
        for batch in batches:
            for held, *truth in zip(*[batch.column(i).to_pylist() for i in range(1, batch.num_columns)], strict=True):
                if all(v is not None for v in truth):
                    prior = np.array(truth, float)
                else:
                    prior = None
                if len(held) < 2 and prior is None:
                    continue
                a, f, d = np.zeros((len(held), k)), np.zeros((len(held), m)), np.zeros(len(held))
                for i, r in enumerate(held):
                    s = 1 / r["s"]
                    a[i] = [r[c] * s for c in components]
                    f[i, 3 * at[r["frame"]] : 3 * at[r["frame"]] + 3] = r["x"] * s, r["y"] * s, s
                    d[i] = r["los"] * s
                if prior is not None:  # stations: the components are data of their own
                    a, f, d = np.vstack([a, np.eye(k) / floor]), np.vstack([f, np.zeros((k, m))]), np.concatenate([d, prior / floor])
                project = np.eye(len(d)) - a @ np.linalg.pinv(a)
                total += f.T @ project @ f
                right += f.T @ project @ d
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64())), pa.array([right], pa.list_(pa.float64()))], names=["a", "b"])

    parts = grouped.mapInArrow(run, "a array<double>, b array<double>")
    summed = parts.select(F.posexplode(F.concat("a", "b")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(m * m + m)
    for r in summed:
        flat[r["i"]] = r["v"]
    a, b = flat[: m * m].reshape(m, m), flat[m * m :]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    x = np.linalg.lstsq(a / scale[:, None] / scale, b / scale, rcond=1e-10)[0] / scale
    return points.sparkSession.createDataFrame([(f, *map(float, x[3 * i : 3 * i + 3])) for f, i in at.items()], "frame string, a double, b double, c double")
