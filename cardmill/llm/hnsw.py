"""A hierarchical navigable small-world graph in flat neighbour arrays, built and searched in batches with numpy.

Vectors are unit vectors, similarity is their product. Points are inserted in batches: each batch descends the upper
layers, searches the layers it belongs to with a beam, is linked to a diverse choice of what it finds, and its links
are added to the other ends, whose lists are pruned in the same way.
"""

from __future__ import annotations

import numpy as np


class Layer:
    """One layer: ``links`` (n, degree) of node numbers, -1 for none, and the similarity of each link."""

    def __init__(self, n: int, degree: int):
        self.links = np.full((n, degree), -1, np.int32)
        self.sims = np.full((n, degree), -np.inf, np.float32)


class Hnsw:
    def __init__(self, vectors: np.ndarray, degree: int = 12, beam: int = 32, seed: int = 7, batch: int = 512):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.degree, self.beam, self.batch = degree, beam, batch
        n = len(self.x)
        rng = np.random.default_rng(seed)
        self.order = rng.permutation(n)
        level = np.minimum(np.floor(-np.log(rng.random(n)) / np.log(degree)).astype(np.int8), 6)
        self.level = level
        self.layers: list[Layer] = []
        self.entry = np.empty(0, np.int32)  # a few nodes of the top layer
        self.top = -1
        done = 0
        while done < n:
            size = min(n - done, batch, max(32, done // 2))
            self._insert(self.order[done : done + size])
            done += size

    def _layer(self, k: int) -> Layer:
        while len(self.layers) <= k:
            self.layers.append(Layer(len(self.x), 2 * self.degree if not self.layers else self.degree))
        return self.layers[k]

    def _beam(self, k: int, queries: np.ndarray, entries: np.ndarray, width: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sims), best first, of a beam search on layer ``k``; ``entries`` (queries, any) are node numbers, -1 for none."""
        links, b, n = self.layers[k].links, len(queries), len(self.x)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n + 1), bool)  # the last column takes -1
        seen[:, n] = True
        width = max(width, entries.shape[1])
        ids, sims = np.full((b, width), -1, np.int32), np.full((b, width), -np.inf, np.float32)
        spent = np.ones((b, width), bool)
        e = entries.shape[1]
        ids[:, :e] = entries
        sims[:, :e] = np.where(entries >= 0, np.matmul(self.x[entries], queries[:, :, None])[:, :, 0], -np.inf)
        spent[:, :e] = entries < 0
        seen[rows, entries] = True
        live = np.arange(b)
        while len(live):
            r = np.arange(len(live))[:, None]
            s = np.where(spent[live], -np.inf, sims[live])
            pick = np.argpartition(-s, min(wide, width) - 1, axis=1)[:, :wide] if width > wide else np.tile(np.arange(width), (len(live), 1))
            good = s[r, pick] > -np.inf
            any_left = good.any(1)
            if not any_left.all():
                live, pick, good = live[any_left], pick[any_left], good[any_left]
                if not len(live):
                    break
                r = np.arange(len(live))[:, None]
            spent[live[:, None], pick] = True
            nodes = np.where(good, ids[live[:, None], pick], -1)
            near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
            near = np.where(seen[live[:, None], near], -1, near)
            order = np.sort(near, axis=1)  # a node named by two of the expanded ones counts once
            order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
            near = order
            seen[live[:, None], near] = True
            new = np.matmul(self.x[near], queries[live][:, :, None])[:, :, 0]
            new[near < 0] = -np.inf
            all_sims = np.concatenate([sims[live], new], 1)
            keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live] = np.concatenate([ids[live], near], 1)[r, keep]
            sims[live] = all_sims[r, keep]
            spent[live] = np.concatenate([spent[live], near < 0], 1)[r, keep]
        best = np.argsort(-sims, axis=1, kind="stable")
        return ids[rows, best], sims[rows, best]

    def _choose(self, ids: np.ndarray, sims: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates (best first) the diverse ones: not closer to a chosen one than to the point itself; then the best of the rest."""
        b, c = ids.shape
        between = np.matmul(own := self.x[ids], own.transpose(0, 2, 1))
        chosen = np.zeros((b, c), bool)
        count = np.zeros(b, int)
        for i in range(c):
            crowded = (np.where(chosen, between[:, i], -np.inf) > sims[:, i : i + 1]).any(1)
            take = (ids[:, i] >= 0) & ~crowded & (count < degree)
            chosen[:, i] = take
            count += take
        rank = np.where(ids >= 0, np.where(chosen, 0, 1), 2) * c + np.arange(c)
        first = np.argsort(rank, axis=1, kind="stable")[:, :degree]
        r = np.arange(b)[:, None]
        out, val = ids[r, first], sims[r, first]
        if c < degree:
            out = np.pad(out, ((0, 0), (0, degree - c)), constant_values=-1)
            val = np.pad(val, ((0, 0), (0, degree - c)), constant_values=-np.inf)
        return out, np.where(out >= 0, val, -np.inf)

    def _descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Entries for layer ``to``, from the top down."""
        entries = np.tile(self.entry, (len(queries), 1))
        for k in range(self.top, to, -1):
            entries = self._beam(k, queries, entries, 4)[0][:, :4]
        return entries

    def _insert(self, nodes: np.ndarray) -> None:
        tops = self.level[nodes]
        for k in range(int(tops.max()), -1, -1):
            layer = self._layer(k)
            own = nodes[tops >= k]
            q = self.x[own]
            # within the batch
            inner = q @ q.T
            np.fill_diagonal(inner, -np.inf)
            w = min(len(own) - 1, self.beam // 2)
            ids, sims = np.full((len(own), 0), -1, np.int32), np.full((len(own), 0), -np.inf, np.float32)
            if w > 0:
                part = np.argpartition(-inner, w - 1, axis=1)[:, :w]
                ids, sims = own[part].astype(np.int32), np.take_along_axis(inner, part, 1)
            if self.top >= k:
                found, near = self._beam(k, q, self._descend(q, k), self.beam)
                ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, near], 1)
            if not ids.shape[1]:
                continue
            order = np.argsort(-sims, axis=1, kind="stable")[:, : self.beam]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            degree = layer.links.shape[1]
            out, val = self._choose(ids, sims, self.degree)
            layer.links[own, : self.degree], layer.sims[own, : self.degree] = out, val
            self._back(layer, own, out, val, degree)
        high = int(tops.max())
        if high > self.top:
            self.top = high
            self.entry = nodes[tops == high][:4].astype(np.int32)

    def _back(self, layer: Layer, own: np.ndarray, out: np.ndarray, val: np.ndarray, degree: int) -> None:
        """Add the new links at their other ends."""
        source, target, sim = np.repeat(own, out.shape[1]), out.ravel(), val.ravel()
        ok = target >= 0
        source, target, sim = source[ok], target[ok], sim[ok]
        order = np.lexsort((-sim, target))
        source, target, sim = source[order], target[order], sim[order]
        ends, first, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, counts)
        width = min(int(counts.max(initial=1)), degree)
        ok = place < width  # a node's incoming links of one batch, nearest first
        row = np.repeat(np.arange(len(ends)), counts)[ok]
        add, add_sim = np.full((len(ends), width), -1, np.int32), np.full((len(ends), width), -np.inf, np.float32)
        add[row, place[ok]], add_sim[row, place[ok]] = source[ok], sim[ok]
        held = layer.links[ends]
        twice = (add[:, :, None] == held[:, None, :]).any(2)
        add[twice], add_sim[twice] = -1, -np.inf
        ids, sims = np.concatenate([held, add], 1), np.concatenate([layer.sims[ends], add_sim], 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        full = (ids >= 0).sum(1) > degree
        layer.links[ends[~full]], layer.sims[ends[~full]] = ids[~full, :degree], sims[~full, :degree]
        if full.any():
            layer.links[ends[full]], layer.sims[ends[full]] = self._choose(ids[full], sims[full], degree)

    def search(self, queries: np.ndarray, k: int, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sims) of about the ``k`` most similar nodes, best first, -1 where there are fewer."""
        return self._batches(np.asarray(queries, np.float32), k, width or self.beam, None)

    def neighbours(self, k: int, width: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """``search`` for every node of the graph itself, without the node; the search starts at the node."""
        ids, sims = self._batches(self.x, k + 1, max(width, k + 1), np.arange(len(self.x), dtype=np.int32))
        sims = np.where(ids == np.arange(len(self.x))[:, None], -np.inf, sims)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(sims > -np.inf, ids, -1), sims

    def _batches(self, queries: np.ndarray, k: int, width: int, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        ids, sims = np.full((len(queries), k), -1, np.int32), np.full((len(queries), k), -np.inf, np.float32)
        if not len(self.x):
            return ids, sims
        for at in range(0, len(queries), self.batch):
            q = queries[at : at + self.batch]
            entries = self._descend(q, 0) if start is None else start[at : at + len(q), None]
            i, s = self._beam(0, q, entries, max(width, k))
            ids[at : at + len(q)], sims[at : at + len(q)] = i[:, :k], s[:, :k]
        return ids, sims
