"""A task's running best rows per question, so that what a task holds and sends doesn't grow with what it reads."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pandas as pd
import pyarrow as pa


class Leading:
    """The best ``k`` of each of ``n`` questions with a score of ``least`` or more; ties go to the smaller id.

    What stays below the kth score found so far is dropped at once; the rest is cut back whenever it holds ``spare`` rows more than it must.
    """

    def __init__(self, n: int, k: int, least: float, spare: int) -> None:
        self.k, self.most = k, 2 * k * n + spare
        self.floor = np.full(n, float(least))
        self.parts: list[pd.DataFrame] = []
        self.held = 0

    def add(self, ids: np.ndarray, scores: np.ndarray, asking: np.ndarray | None = None) -> None:
        """scores: a row per question (or per number in ``asking``), a column per id."""
        at, where = self.candidates(scores, asking=asking)
        self.put(at if asking is None else asking[at], ids[where], scores[at, where])

    def candidates(self, scores: np.ndarray, slack: np.ndarray | float = 0.0, asking: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The cells of ``scores`` that may be among the best, where each (of a row) is off by less than ``slack``."""
        floor = self.floor if asking is None else self.floor[asking]
        slack = np.broadcast_to(slack, floor.shape)
        near = scores >= (floor - slack)[:, None]
        full = np.flatnonzero(np.count_nonzero(near, axis=1) > self.k)
        if len(full):  # k cells of these reach their kth score less the slack, which no later cell need stay below
            own = scores[full]
            kth = np.partition(own, -self.k, axis=1)[:, -self.k] - slack[full]
            near[full] &= own >= (kth - slack[full])[:, None]
            who = full if asking is None else asking[full]
            self.floor[who] = np.maximum(self.floor[who], kth)
        return np.nonzero(near)

    def put(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Exact scores of single cells: the question of each and its id."""
        good = scores >= self.floor[at]
        if good.any():
            self.parts.append(pd.DataFrame({"at": at[good].astype(np.int32), "id": ids[good], "score": scores[good]}))
            self.held += len(self.parts[-1])
            if self.held > self.most:
                self.cut()

    def cut(self) -> pd.DataFrame | None:
        if not self.parts:
            return None
        rows = pd.concat(self.parts).sort_values(["at", "score", "id"], ascending=[True, False, True]).groupby("at", sort=False).head(self.k)
        at, score = rows["at"].to_numpy(), rows["score"].to_numpy(float)
        last = np.flatnonzero(np.append(at[1:] != at[:-1], True))
        full = np.diff(np.concatenate([[-1], last])) == self.k
        self.floor[at[last[full]]] = np.maximum(self.floor[at[last[full]]], score[last[full]])
        self.parts, self.held = [rows], len(rows)
        return rows

    def rows(self, names: np.ndarray) -> pd.DataFrame | None:
        """(query_id, id, score) at the end; names: the questions' ids."""
        rows = self.cut()
        return None if rows is None else pd.DataFrame({"query_id": names[rows["at"].to_numpy()], "id": rows["id"].to_numpy(), "score": rows["score"].to_numpy(float)})


def giving_back(work):
    """``work`` over batches or frames; at its end the worker's free memory goes back to the system, as an idle worker would hold it through later stages."""

    def run(batches):
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run
