"""Exact nearest neighbours that skip cells of vectors.

Vectors are dealt to the nearest of some centres; a cell keeps its centre, its radius and how many it holds. By the triangle inequality no vector of a cell scores
more with a question than centre times question, plus radius times the question's length. Each question first opens the cells that look
best; the kth score found there rules out every cell whose bound stays below it, so the rows are those of a full scan.

Centres come from a bounded sample and decide only how much is skipped. Large cells, such as of a vector that many rows repeat, are written in many pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import search
from colloquy.operators.leading import Leading, giving_back
from colloquy.operators.postings import top
from colloquy.sources.scratch import written

#: Vectors that the centres are chosen from, rounds of choosing, rows of a written piece, cells that a question opens first, and what rounding may add to a score.
SAMPLE, ROUNDS, PIECE, FIRST, EPSILON = 20_000, 8, 50_000, 4, 1e-6


class Cells(NamedTuple):
    """vectors: (id, vec, cell, size); table: one row per cell, as arrays by dimension."""

    vectors: DataFrame
    centres: dict[int, np.ndarray]
    radii: dict[int, np.ndarray]
    counts: dict[int, np.ndarray]


def centres_of(vectors: DataFrame, wanted: int) -> dict[int, np.ndarray]:
    """Per dimension centres of a sample of SAMPLE vectors at most: k-means from evenly spaced members."""
    n = vectors.count()
    rows = vectors.where("vec is not null").select("vec").sample(min(1.0, 1.2 * SAMPLE / max(n, 1)), 7).limit(SAMPLE).toPandas()["vec"]
    out = {}
    for size in {len(v) for v in rows}:
        m = np.stack([np.asarray(v, np.float64) for v in rows if len(v) == size])
        m = np.unique(m, axis=0)
        c = m[np.linspace(0, len(m) - 1, min(wanted, len(m))).astype(int)]
        for _ in range(ROUNDS):
            near = np.argmax(m @ c.T - (c * c).sum(1) / 2, axis=1)
            held = np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, m)
            c = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], c)
        out[size] = c
    return out


def celled(vectors: DataFrame, cells: int | None = None) -> Cells:
    """Deal ``vectors`` (id, vec) to cells, by default about the square root of their number, and write them."""
    kind = vectors.schema["id"].dataType.simpleString()
    centres = centres_of(vectors, cells or max(1, math.isqrt(max(vectors.count(), 1))))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["vec"].notna()]
            lengths = f["vec"].map(len).to_numpy() if len(f) else np.empty(0, int)
            for size in np.unique(lengths).tolist():
                own = f[lengths == size]
                m = np.stack(own["vec"].to_list()).astype(np.float32).astype(np.float64)
                c = centres.get(size, np.zeros((1, size)))  # a dimension that the sample missed is one cell
                near = np.argmax(m @ c.T - (c * c).sum(1) / 2, axis=1)
                yield pd.DataFrame({"id": own["id"], "vec": own["vec"], "size": size, "cell": near, "far": np.sqrt(((m - c[near]) ** 2).sum(1))})

    dealt = written(vectors.select("id", "vec").mapInPandas(giving_back(deal), f"id {kind}, vec array<float>, size int, cell int, far double"), "dealt")
    table = dealt.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    pieces = table.select("size", "cell", F.ceil(F.col("n") / PIECE).alias("pieces"))
    held = dealt.join(pieces, ["size", "cell"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")))
    held = written(held.repartition("size", "cell", "piece").sortWithinPartitions("size", "cell").select("id", "vec", "size", "cell"), "cells")
    rows = table.collect()  # one row per cell
    shape = {s: max(r.cell for r in rows if r["size"] == s) + 1 for s in {r["size"] for r in rows}}
    out = [{s: np.zeros(max(k, len(centres.get(s, [0])))) for s, k in shape.items()} for _ in range(2)]
    for r in rows:
        out[0][r["size"]][r.cell], out[1][r["size"]][r.cell] = r.radius, r.n
    return Cells(held, {s: centres.get(s, np.zeros((1, s))) for s in shape}, *out)


def search_cells(held: Cells, queries: DataFrame, k: int, least: float) -> tuple[DataFrame, float]:
    """((query_id, id, score, rank), share): what ``dense_search`` gives, and the share of question-vector products that were skipped."""
    rows = queries.select("query_id", "vec").where("vec is not null")
    parts = max(1, -(-rows.count() // search.BROADCAST_QUERIES))
    found, done, all_ = [], 0.0, 0.0
    for part in range(parts):
        for size, (names, matrix) in search.stacked(rows.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).items():
            if size not in held.counts:
                continue
            n, near = held.counts[size], matrix @ held.centres[size].T
            most = near + np.sqrt((matrix**2).sum(1))[:, None] * held.radii[size] + EPSILON
            most[:, n == 0] = -np.inf
            # the nearest cells, until they hold k vectors
            order = np.argsort(-np.where(n > 0, near, -np.inf), axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            first = np.zeros(most.shape, bool)
            np.put_along_axis(first, order, (before < k) | (np.arange(order.shape[1]) < FIRST), axis=1)
            first &= most >= least
            seeds = written(_within(held, size, names, matrix, first, k, least), "seeds")
            kth = {r.query_id: r.score for r in top(seeds, k).where(F.col("rank") == k).select("query_id", "score").collect()}  # one row per question of this part
            floor = np.array([max(least, kth.get(q, least)) for q in names.tolist()])
            rest = (most >= floor[:, None]) & ~first
            found += [seeds, _within(held, size, names, matrix, rest, k, least)]
            done += float(((first | rest) * n).sum())
            all_ += float(n.sum() * len(names))
    kinds = {f.name: f.dataType.simpleString() for f in [*held.vectors.schema, *queries.schema]}
    out = queries.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    for f in found:
        out = out.unionByName(f)
    return top(out, k), 1 - done / all_ if all_ else 0.0


def _within(held: Cells, size: int, names: np.ndarray, matrix: np.ndarray, open_: np.ndarray, k: int, least: float) -> DataFrame:
    """(query_id, id, score): the best ``k`` of each task, over the cells that are open for a question."""
    cells = np.flatnonzero(open_.any(axis=0)).tolist()
    sent = held.vectors.sparkSession.sparkContext.broadcast((names, matrix, open_))
    kind = dict(held.vectors.dtypes)["id"]
    asked = "string" if names.dtype == object else "long"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix, open_ = sent.value
        best = Leading(len(names), k, least, search.CELLS)
        for f in frames:
            for cell, own in f.groupby("cell"):
                asking = np.flatnonzero(open_[:, cell])
                step = max(1, search.CELLS // max(1, len(asking)))
                for a in range(0, len(own), step):
                    part = own.iloc[a : a + step]
                    best.add(part["id"].to_numpy(), np.round(matrix[asking] @ np.stack(part["vec"].to_list()).astype(np.float32).astype(np.float64).T, 9), asking)
        rows = best.rows(names)
        if rows is not None:
            yield rows

    vectors = held.vectors.where((F.col("size") == size) & F.col("cell").isin(cells)).select("id", "vec", "cell")
    return vectors.mapInPandas(giving_back(work), f"query_id {asked}, id {kind}, score double")
