"""Random forests (M8) and extremely randomised trees (M9): all trees of all models and folds grown together, level by level.

A pass goes over the blocks of rows once and serves the open nodes of every tree. Rows are drawn per tree with a hashed Poisson(1)
multiplicity (``bootstrap``), each node looks at ``sqrt`` of the inputs, chosen by a hash, and splits by the Gini
impurity of class-weighted rows.

* Forest: histograms over at most ``BINS`` quantile bins of the fold's training rows, the best cut of each node.
* Random cuts: a first pass finds each node's least and greatest value per looked-at input; a hashed
  place between them is the input's only cut; a second pass sums both sides, and the best of the cuts splits. No bins.

A node is split only with ``split`` rows or more, and each side keeps ``leaf`` (drawn rows, repeats not counted).
Sums are integers (rows, drawn rows, drawn rows of class 1); class weights are applied to them, so results
don't depend on partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame

from candela.operators import trees as tr
from candela.operators.trees import Ensemble, Fold, Tree

BINS = 64
#: cumulated Poisson(1) probabilities
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class Forest:
    trees: int
    depth: int
    leaf: int = 1
    split: int = 2
    bootstrap: bool = True
    random_cuts: bool = False
    balanced: bool = False
    seed: int = 42


def looked_at(s: Forest, tree: int, nodes: np.ndarray, p: int) -> np.ndarray:
    """The inputs that each node looks at (nodes x sqrt(p), ascending)."""
    k = max(1, int(math.sqrt(p)))
    u = tr.uniform(s.seed, tree, nodes[:, None], np.arange(p)[None])
    return np.sort(np.argsort(u, axis=1, kind="stable")[:, :k], axis=1)


def multiplicity(s: Forest, tree: int, h: np.ndarray) -> np.ndarray:
    return np.searchsorted(_POISSON, tr.uniform(s.seed + 1, tree, h), "right") if s.bootstrap else np.ones(len(h), np.int64)


def gini_gain(left: np.ndarray, total: np.ndarray, weights: tuple, leaf: int) -> np.ndarray:
    """Decrease of the weighted impurity (times half the weight) for sums (rows, drawn, of class 1) in the last axis."""
    right = total - left

    def score(s):
        one, zero = weights[1] * s[..., 2], weights[0] * (s[..., 1] - s[..., 2])
        w = one + zero
        return np.divide(one * one + zero * zero, w, out=np.zeros_like(w), where=w > 0)

    gain = score(left) + score(right) - score(total)
    return np.where((left[..., 0] >= max(leaf, 1)) & (right[..., 0] >= max(leaf, 1)), gain, -np.inf)


def _value(sums, weights: tuple) -> float:
    one, zero = weights[1] * sums[2], weights[0] * (sums[1] - sums[2])
    return float(one / (one + zero)) if one + zero > 0 else 0.5


class _Growth:
    """What the driver keeps: trees and open nodes of the tasks (spec, fold, tree)."""

    def __init__(self, specs, folds, counts, p):
        self.specs, self.p = specs, p
        self.tasks = [(m, f, t) for m, s in enumerate(specs) for f in range(len(folds)) for t in range(s.trees)]
        self.trees, self.open = [], {}
        self.weights = [[(n / (2 * (n - pos)), n / (2 * pos)) if s.balanced and 0 < pos < n else (1.0, 1.0) for n, pos in counts] for s in specs]
        for k, (m, f, t) in enumerate(self.tasks):
            tree = Tree()
            tree.add(0.5, 0, 0)
            self.trees.append(tree)
            if counts[f][0] > 0:
                self.open[k] = [0]

    def weight(self, k):
        m, f, _ = self.tasks[k]
        return self.weights[m][f]

    def update(self, k: int, found: dict) -> None:
        """Takes ``gain, feature, cut, left, total`` of the task's open nodes."""
        m, f, _ = self.tasks[k]
        s, tree, w, nodes = self.specs[m], self.trees[k], self.weight(k), self.open.pop(k)
        opened = []
        for i, node in enumerate(nodes):
            total = found["total"][i]
            if node == 0:
                tree.value[0], tree.count[0] = _value(total, w), int(total[0])
                if total[0] < s.split or not 0 < total[2] < total[1]:
                    continue
            if not found["gain"][i] > LEAST_GAIN:
                continue
            left = found["left"][i]
            sides = left, total - left
            children = tree.split(node, found["feature"][i], found["cut"][i].item(), found["gain"][i], *[(_value(x, w), int(x[0])) for x in sides])
            for c, x in zip(children, sides):
                if tree.depth[c] < s.depth and x[0] >= max(s.split, 2 * s.leaf) and 0 < x[2] < x[1]:
                    opened.append(c)
        if opened:
            self.open[k] = opened


def _grown(items, work: dict, tasks: list, specs: list, ends: list, raw: bool):
    """Per block and task its training rows in open nodes: ``task, slot, inputs looked at, drawn, drawn of class 1``.

    A block with ``kept`` stays in its task from level to level: there a tree's open rows and their nodes are kept, and go one step on.
    """
    for b in items:
        kept = b.get("kept")
        for k, (tree, nodes, feats, *rest) in work.items():
            m, f, t = tasks[k]
            if kept is not None and k in kept:
                x, node, drawn, ones = kept[k]
                node = tr.walk(tree, x, node)
            else:
                rows = np.flatnonzero(b["d"] < ends[f])
                x = b["raw"][rows] if raw else b["x"][f][rows]
                drawn = multiplicity(specs[m], t, b["h"][rows])
                node, ones = tr.walk(tree, x), drawn * (b["y"][rows] > 0)
            slot_of = np.full(len(tree["feature"]), -1)
            slot_of[nodes] = np.arange(len(nodes))
            slot = slot_of[node]
            at = np.flatnonzero((slot >= 0) & (drawn > 0))
            slot, x, node, drawn, ones = slot[at], x[at], node[at], drawn[at], ones[at]
            if kept is not None:
                kept[k] = x, node, drawn, ones
            yield k, slot, x[np.arange(len(x))[:, None], feats[slot]], drawn, ones, rest


def _histograms(work, tasks, specs, ends):
    def run(items):
        out: dict = {}
        for k, slot, x, drawn, ones, _ in _grown(items, work, tasks, specs, ends, False):
            c = tr.cells(slot, x, [drawn, ones], len(work[k][1]), BINS)
            out[k] = tr.added(out[k], c) if k in out else c
        return iter(out.items())

    return run


def _best_bins(work, tasks, specs, weights):
    def run(item):
        k, c = item
        _, nodes, feats = work[k]
        s = specs[tasks[k][0]]
        left = np.moveaxis(np.cumsum(tr.dense(c, len(nodes), feats.shape[1], BINS), axis=3), 0, -1)  # node, input, bin, sum
        total = left[:, 0, -1]
        gain = gini_gain(left, total[:, None, None], weights[k], s.leaf).reshape(len(nodes), -1)
        at = gain.argmax(axis=1)
        i, j, cut = np.arange(len(nodes)), at // BINS, at % BINS
        return k, {"gain": gain[i, at], "feature": feats[i, j], "cut": cut, "left": left[i, j, cut], "total": total}

    return run


def _ranges(work, tasks, specs, ends):
    """Least and greatest finite value per node and input looked at."""
    def run(items):
        out: dict = {}
        for k, slot, x, _, _, _ in _grown(items, work, tasks, specs, ends, True):
            if k not in out:
                out[k] = np.stack([np.full((len(work[k][1]), x.shape[1]), np.inf), np.full((len(work[k][1]), x.shape[1]), -np.inf)])
            fine = np.isfinite(x)
            np.minimum.at(out[k][0], slot, np.where(fine, x, np.inf))
            np.maximum.at(out[k][1], slot, np.where(fine, x, -np.inf))
        return iter(out.items())

    return run


def _sides(work, tasks, specs, ends):
    """Sums of each node's rows, and of those left of each input's cut."""
    def run(items):
        out: dict = {}
        for k, slot, x, drawn, ones, (cuts,) in _grown(items, work, tasks, specs, ends, True):
            n, kf = cuts.shape
            go = x <= cuts[slot]
            sums = np.zeros((kf + 1, n, 3), np.int64)
            for j in range(kf + 1):
                at = slice(None) if j == kf else np.flatnonzero(go[:, j])
                for c, w in enumerate((None, drawn, ones)):
                    sums[j, :, c] = np.bincount(slot[at], weights=None if w is None else w[at], minlength=n)
            out[k] = out[k] + sums if k in out else sums
        return iter(out.items())

    return run


def _best_sides(work, tasks, specs, weights):
    def run(item):
        k, sums = item
        _, nodes, feats, cuts = work[k]
        left, total = np.moveaxis(sums[:-1], 0, 1), sums[-1]
        gain = np.where(np.isfinite(cuts), gini_gain(left, total[:, None], weights[k], specs[tasks[k][0]].leaf), -np.inf)
        i, j = np.arange(len(nodes)), gain.argmax(axis=1)
        return k, {"gain": gain[i, j], "feature": feats[i, j], "cut": cuts[i, j], "left": left[i, j], "total": total}

    return run


def _parts(open_nodes: dict, per_node: int) -> list[list]:
    """Tasks dealt to passes of at most ``MAX_CELLS`` cells (one task at least)."""
    out, room = [[]], tr.MAX_CELLS
    for k, nodes in open_nodes.items():
        size = per_node * len(nodes)
        if size > room and out[-1]:
            out.append([])
            room = tr.MAX_CELLS
        out[-1].append(k)
        room -= size
    return out


def _summed(pairs, added) -> dict:
    out: dict = {}
    for k, v in pairs:
        out[k] = added(out[k], v) if k in out else v
    return out


def _collected(pairs, f=None) -> list:
    """The pairs of an RDD or of a task's own sums, each after ``f``."""
    if isinstance(pairs, RDD):
        return (pairs.map(f) if f else pairs).collect()
    return [f(x) if f else x for x in pairs]


def _grow_all(g: _Growth, ends: list, summed) -> None:
    """Grows the open trees of ``g`` level by level; ``summed(tables, added, keys)`` runs a pass over the blocks and adds up by key."""
    specs, tasks, p = g.specs, g.tasks, g.p
    weights = [g.weight(k) for k in range(len(tasks))]
    kf = max(1, int(math.sqrt(p)))

    def nodes_of(some):
        out = {}
        for k in some:
            nodes = np.array(g.open[k])
            m, _, t = tasks[k]
            out[k] = (g.trees[k].arrays(), nodes, looked_at(specs[m], t, nodes, p))
        return out

    while g.open:
        plain = {k: v for k, v in g.open.items() if not specs[tasks[k][0]].random_cuts}
        wild = {k: v for k, v in g.open.items() if specs[tasks[k][0]].random_cuts}
        for some in _parts(plain, kf * BINS) if plain else []:
            work = nodes_of(some)
            for k, found in _collected(summed(_histograms(work, tasks, specs, ends), tr.added, len(work)), _best_bins(work, tasks, specs, weights)):
                g.update(k, found)
        for some in _parts(wild, kf * 4) if wild else []:
            work = nodes_of(some)
            lows = dict(_collected(summed(_ranges(work, tasks, specs, ends), lambda a, b: np.stack([np.minimum(a[0], b[0]), np.maximum(a[1], b[1])]), len(work))))
            for k, (tree, nodes, feats) in work.items():
                m, _, t = tasks[k]
                lo, hi = lows[k]
                u = tr.uniform(specs[m].seed + 2, t, nodes[:, None], feats)
                with np.errstate(invalid="ignore"):
                    work[k] = (tree, nodes, feats, np.where(lo < hi, lo + u * (hi - lo), np.nan))
            for k, found in _collected(summed(_sides(work, tasks, specs, ends), np.add, len(work)), _best_sides(work, tasks, specs, weights)):
                g.update(k, found)


def grow(df: DataFrame, predictors: list[str], specs: list[Forest], folds: list[Fold], keep: list[str], share: int | None = None):
    """Fits every spec on every fold: ``(trees[spec][fold], edges[fold], blocks)``, blocks being a persisted RDD.

    ``df`` holds the inputs, ``Target`` (0/1), ``d`` and ``keep``. Specs with random cuts and without are grown in turn.
    On a table of one block at most ``share`` tasks run at a time.
    """
    sc, p = df.sparkSession.sparkContext, len(predictors)
    own = not df.is_cached
    df = df.persist()
    # a table of at most BLOCK_ROWS rows is one block, dealt to tasks that each grow some of the trees
    small = df.count() <= tr.BLOCK_ROWS
    edges = tr.quantile_edges(df, predictors, folds, BINS)
    blocks = tr.persisted(tr.binned_blocks(df, predictors, folds, edges, keep, raw=any(s.random_cuts for s in specs), spread=1 if small else sc.defaultParallelism))
    ends = [f.train_end for f in folds]
    counts = blocks.map(lambda b: np.array([[(b["d"] < e).sum(), b["y"][b["d"] < e].sum()] for e in ends], float)).fold(
        np.zeros((len(folds), 2)), lambda a, b: a + b)
    if own:  # else other models may read it still
        df.unpersist()
    g = _Growth(specs, folds, counts, p)
    if small:
        parts = max(1, min(share or sc.defaultParallelism, len(g.open)))

        def some_trees(item):
            i, held = item
            held, own = list(held), _Growth(specs, folds, counts, p)
            mine = sorted(own.open)[i::parts]
            for k in mine:  # one after another, so that the rows of one tree at a time are kept
                own.open = {k: [0]}
                for b in held:
                    b["kept"] = {}
                _grow_all(own, ends, lambda tables, added, n: _summed(tables(held), added).items())
            return [(k, own.trees[k]) for k in mine]

        dealt = blocks.flatMap(lambda b: [(i, {c: v for c, v in b.items() if c != "rows"}) for i in range(parts)])
        for k, tree in dealt.groupByKey(parts, lambda i: i).flatMap(some_trees).collect():
            g.trees[k] = tree
    else:
        _grow_all(g, ends, lambda tables, added, n: blocks.mapPartitions(tables).reduceByKey(added, min(n, sc.defaultParallelism)))
    tasks = g.tasks
    out = [[[] for _ in folds] for _ in specs]
    for (m, f, _), tree in zip(tasks, g.trees):
        out[m][f].append(tree)
    return out, edges, blocks


def scores(trees, specs: list[Forest], blocks: RDD) -> RDD:
    """(block, mean class-1 share of the trees by spec and fold)."""
    arrays = [[[t.arrays() for t in fold] for fold in per] for per in trees]

    def run(b):
        rows = []
        for s, per in zip(specs, arrays):
            for f, ts in enumerate(per):
                x = b["raw"] if s.random_cuts else b["x"][f]
                total = np.zeros(len(b["y"]))
                for t in ts:
                    total += t["value"][tr.walk(t, x)]
                rows.append(total / max(len(ts), 1))
        return b, np.array(rows)

    return blocks.map(run)


def ensembles(trees, specs: list[Forest], edges, p: int) -> list[list[Ensemble]]:
    """``grow``'s trees as data, by spec and fold."""
    return [[Ensemble.of(ts, None if s.random_cuts else edges[f], p, 0.0, "identity", 1 / max(len(ts), 1)) for f, ts in enumerate(per)]
            for s, per in zip(specs, trees)]
