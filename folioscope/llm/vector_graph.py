"""A robust-pruned directed graph over unit vectors, built and searched in blocks of near points with NumPy.

Points are halved along their widest split until a block holds at most ``block`` of them. The graph
begins with the nearest points of a block and of the blocks around it. Then one block after another is
searched greedily in the graph as it stands: the searches of a block share what they evaluate, so that
every expansion is one product of matrices, and each keeps a beam of its own. What a search meets is
proposed as neighbours; relaxed distance pruning keeps the diverse ones: a candidate is dropped if it is
``alpha`` times nearer to a kept neighbour than to the point. Edges are added backwards, all of them;
nodes that get more than ``slots`` are pruned the same way, as often as it takes.
"""

from __future__ import annotations

import numpy as np

NONE = -1


class VectorGraph:
    def __init__(self, vectors: np.ndarray, degree: int = 16, beam: int = 24, alpha: float = 1.2, block: int = 128, around: int = 12, seed: int = 7):
        x = np.ascontiguousarray(vectors, np.float32)
        self.n = len(x)
        self.degree, self.slots, self.beam, self.alpha2, self.block = degree, 2 * degree, beam, alpha * alpha, block
        self.original, self.bounds = self._halved(x, np.random.default_rng(seed))
        self.x = x[self.original]
        self.links = np.full((self.n, self.slots), NONE, np.int32)
        if self.n:
            ends = list(zip(self.bounds, self.bounds[1:], strict=False))
            self.means = np.stack([self.x[a:b].mean(axis=0) for a, b in ends])
            self.medoids = np.array([a + (self.x[a:b] @ m).argmax() for (a, b), m in zip(ends, self.means, strict=True)])
            self.close = np.argsort(-(self.means @ self.means.T), axis=1, kind="stable")[:, :around]
            self._begin()
            self._improve()

    def _halved(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """The order of the points by blocks, and where blocks begin and end."""
        done, todo = [], [np.arange(len(x))] if len(x) else []
        while todo:
            rows = todo.pop()
            if len(rows) <= self.block:
                done.append(rows)
                continue
            y = x[rows if len(rows) <= 512 else rng.choice(rows, 512, replace=False)]
            a, b = y[rng.integers(len(y))], y[rng.integers(len(y))]
            for _ in range(4):
                side = y @ (a - b) > 0
                if side.all() or not side.any():
                    break
                a, b = y[side].mean(axis=0), y[~side].mean(axis=0)
            half = len(rows) // 2
            order = np.argpartition(x[rows] @ (a - b), half)
            todo += [rows[order[:half]], rows[order[half:]]]
        return (np.concatenate(done) if done else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum([len(r) for r in done])]).astype(np.int64)

    def search(self, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of a block of near queries from ``entries``: ids and similarities [queries, at most beam], best first."""
        seen, expanded = np.zeros(self.n, bool), np.zeros(self.n, bool)
        ids, sims = np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0), np.float32)
        new = entries
        while len(new):
            seen[new] = True
            s = queries @ self.x[new].T
            if ids.shape[1] == beam:  # only what enters some beam
                enters = (s > sims.min(axis=1)[:, None]).any(axis=0)
                s, new = s[:, enters], new[enters]
            old = ids.shape[1]
            sims = np.concatenate([sims, s], axis=1)
            if sims.shape[1] > beam:
                best = np.argpartition(sims, sims.shape[1] - beam, axis=1)[:, -beam:]
                sims = np.take_along_axis(sims, best, 1)
                both = np.concatenate([ids, np.broadcast_to(new, s.shape)], axis=1) if old else None
                ids = np.take_along_axis(both, best, 1) if old else new[best]
            else:
                ids = np.concatenate([ids, np.broadcast_to(new, s.shape)], axis=1)
            open_ = np.zeros(self.n, bool)
            open_[ids.ravel()] = True
            open_ &= ~expanded
            expanded |= open_
            near = np.zeros(self.n + 1, bool)  # the last place takes the missing links
            near[self.links[open_].ravel()] = True
            new = np.flatnonzero(near[: self.n] & ~seen)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _prune(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Relaxed pruning of candidates [points, c] to ``degree`` neighbours; missing ones are NONE, at the end."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        alive = (ids >= 0) & (ids != points[:, None])
        alive[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        out = np.full((len(points), self.degree), NONE, np.int32)
        filled = np.zeros(len(points), np.int64)
        vectors = self.x[np.maximum(ids, 0)]
        covers = self.alpha2 * (2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))) <= (2 - 2 * sims)[:, None, :]
        for c in range(ids.shape[1]):
            take = alive[:, c] & (filled < self.degree)
            rows = np.flatnonzero(take)
            out[rows, filled[rows]] = ids[rows, c]
            filled += take
            alive[:, c + 1 :] &= ~(covers[:, c, c + 1 :] & take[:, None])
        return out

    def _pruned(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray, at_once: int = 2048) -> np.ndarray:
        return np.concatenate([self._prune(points[i : i + at_once], ids[i : i + at_once], sims[i : i + at_once]) for i in range(0, len(points), at_once)])

    def _add_backwards(self, points: np.ndarray, neighbours: np.ndarray) -> None:
        r, c = np.nonzero(neighbours >= 0)
        target, source = neighbours[r, c].astype(np.int64), points[r]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        while len(target):  # a hub takes ``slots`` more at a time
            nodes, start, size = np.unique(target, return_index=True, return_counts=True)
            column = np.arange(len(target)) - np.repeat(start, size)
            now = column < self.slots
            more = np.full((len(nodes), min(self.slots, int(size.max()))), NONE, np.int32)
            more[np.repeat(np.arange(len(nodes)), size)[now], column[now]] = source[now]
            ids = np.sort(np.concatenate([self.links[nodes], more], axis=1), axis=1)[:, ::-1].copy()
            again = ids[:, 1:] == ids[:, :-1]
            ids[:, 1:][again] = NONE
            ids = -np.sort(-ids, axis=1)
            fits = (ids >= 0).sum(axis=1) <= self.slots
            self.links[nodes[fits]] = ids[fits, : self.slots]
            full = np.flatnonzero(~fits)
            if len(full):
                of, at = nodes[full], ids[full]
                sims = np.einsum("bd,bkd->bk", self.x[of], self.x[np.maximum(at, 0)])
                sims[at < 0] = -np.inf
                self.links[of] = NONE
                self.links[of, : self.degree] = self._pruned(of, at, sims)
            target, source = target[~now], source[~now]

    def _begin(self) -> None:
        """Links among near blocks, and to the medoids of those further around."""
        for number, close in enumerate(self.close):
            a, b = self.bounds[number], self.bounds[number + 1]
            near = [j for j in close[:4] if j != number]
            candidates = np.concatenate([np.arange(a, b), *(np.arange(self.bounds[j], self.bounds[j + 1]) for j in near), self.medoids[close[4:]]])
            s = self.x[a:b] @ self.x[candidates].T
            most = min(self.beam, len(candidates))
            best = np.argpartition(s, len(candidates) - most, axis=1)[:, len(candidates) - most :]
            far = len(close[4:])
            ids = np.concatenate([candidates[best], np.broadcast_to(candidates[len(candidates) - far :], (b - a, far))], axis=1)
            sims = np.concatenate([np.take_along_axis(s, best, 1), s[:, len(candidates) - far :]], axis=1)
            self.links[a:b, : self.degree] = self._prune(np.arange(a, b), ids, sims)

    def _near(self, number: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Search for all points of a block, from themselves, their links and the medoids around."""
        a, b = self.bounds[number], self.bounds[number + 1]
        mark = np.zeros(self.n + 1, bool)
        mark[a:b] = True
        mark[self.links[a:b].ravel()] = True
        mark[self.medoids[self.close[number]]] = True
        return self.search(self.x[a:b], np.flatnonzero(mark[: self.n]), beam)

    def _improve(self, group: int = 16) -> None:
        blocks = len(self.bounds) - 1
        for first in range(0, blocks, group):
            last = min(blocks, first + group)
            found = [self._near(number, self.beam) for number in range(first, last)]
            wide = max(f[0].shape[1] for f in found)
            ids = np.concatenate([np.pad(f[0], ((0, 0), (0, wide - f[0].shape[1])), constant_values=NONE) for f in found])
            sims = np.concatenate([np.pad(f[1], ((0, 0), (0, wide - f[1].shape[1])), constant_values=-np.inf) for f in found])
            points = np.arange(self.bounds[first], self.bounds[last])
            kept = self._pruned(points, ids, sims)
            self.links[points] = NONE
            self.links[points, : self.degree] = kept
            self._add_backwards(points, kept)

    def neighbours_of_all(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For every indexed point, in the order given to the constructor: ids and similarities of others."""
        out_ids, out_sims = np.full((self.n, k), NONE, np.int64), np.full((self.n, k), -np.inf, np.float32)
        for number in range(len(self.bounds) - 1):
            a, b = self.bounds[number], self.bounds[number + 1]
            ids, sims = self._near(number, max(self.beam, k + 1))
            sims = np.where(ids == np.arange(a, b)[:, None], -np.inf, sims)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            out_ids[self.original[a:b], : ids.shape[1]] = np.where(np.isfinite(sims), self.original[ids], NONE)
            out_sims[self.original[a:b], : ids.shape[1]] = sims
        return out_ids, out_sims

    def query(self, queries: np.ndarray, k: int, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k points most similar to vectors from outside; queries near one block are searched together."""
        out_ids, out_sims = np.full((len(queries), k), NONE, np.int64), np.full((len(queries), k), -np.inf, np.float32)
        if not self.n or not len(queries):
            return out_ids, out_sims
        q = np.ascontiguousarray(queries, np.float32)
        home = np.concatenate([(q[i : i + 8192] @ self.means.T).argmax(axis=1) for i in range(0, len(q), 8192)])
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.diff(home[order])) + 1
        for run in np.split(order, cuts):
            number = home[run[0]]
            a, b = self.bounds[number], self.bounds[number + 1]
            entries = np.unique(np.concatenate([np.arange(a, b), self.medoids[self.close[number]]]))
            for at in range(0, len(run), self.block):
                rows = run[at : at + self.block]
                ids, sims = self.search(q[rows], entries, max(beam or self.beam, k))
                out_ids[rows, : min(k, ids.shape[1])] = self.original[ids[:, :k]]
                out_sims[rows, : min(k, ids.shape[1])] = sims[:, :k]
        return out_ids, out_sims
