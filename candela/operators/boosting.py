"""Gradient boosting of all models and folds together (M10-M14): one histogram pass per tree level.

The pass goes over the blocks of binned rows once. For every model, fold, open node, input and bin it sums rows, gradients
and Hessians of the logistic loss; sums are combined per key by a shuffle, the best cut of each node is found
there, and only these cuts reach the driver. So the number of jobs is rounds x levels of the longest model, whatever
the number of models, folds and rows. A table of at most ``BLOCK_ROWS`` rows is one block: there each model and fold makes its passes
in a task of its own, all in one job (``_apart``).

Models differ by their ``Boost``:

* ``first_order``: splits by the variance of the gradients (the classic rule); else by the Newton gain
  ``T(G)^2 / (H + l2)`` of the sides over that of the node, T being the soft threshold of ``l1``; leaves are Newton steps;
* growth ``level`` (all open nodes of a level), ``leaf`` (best first, up to ``leaves``) or ``oblivious`` (one cut for a whole level);
* rows and columns may be sampled per round, by hashes.

Best-first growth takes no more passes than levels: a node is among the first k splits exactly if it is
among the k nodes with the highest least gain on their way from the root. So each level expands the nodes that can still be, and the
order is played through at the end, on recorded gains.

State is one margin per row, model and fold next to the row's bins. It is persisted per round, and every ``CHECKPOINT_EVERY``
rounds written to the shared folder by a reliable checkpoint, which bounds what a lost executor costs.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from candela.operators import trees as tr
from candela.operators.trees import Ensemble, Fold, Tree
from candela.session import checkpoint_dir

#: nodes whose cuts one reduce call finds
CHUNK = 64
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class Boost:
    rounds: int
    depth: int
    rate: float = 0.1
    growth: str = "level"           # level | leaf | oblivious
    leaves: int = 31                # leaf growth only
    l2: float = 0.0
    l1: float = 0.0
    gain: float = 0.0               # least gain of a split (half the difference of the scores)
    hessian: float = 0.0            # least Hessian sum of a leaf
    leaf: int = 1                   # least rows of a leaf
    split: int = 2                  # least rows of a split node
    first_order: bool = False
    prior: bool = True              # start from the training log-odds, else from 0
    rows: float = 1.0
    columns: float = 1.0
    seed: int = 42


def _soft(g, l1):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g


def leaf_value(b: Boost, g, h):
    """The Newton step of a leaf, times the rate."""
    h = np.asarray(h, float) + b.l2
    return b.rate * np.where(h > 1e-12, _soft(np.asarray(g, float), b.l1) / np.where(h > 1e-12, h, 1.0), 0.0)


def split_gains(b: Boost, left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Gains of cuts with these sums (rows, G, H) to the left and in all; -inf where a side is too small."""
    right = total - left
    (nl, gl, hl), (nr, gr, hr), (n, g, h) = left, right, total
    with np.errstate(divide="ignore", invalid="ignore"):
        if b.first_order:
            gains = (gl / nl - gr / nr) ** 2 * nl * nr / n
        else:
            score = lambda a, c: np.where(c + b.l2 > 0, _soft(a, b.l1) ** 2 / (c + b.l2), 0.0)
            gains = score(gl, hl) + score(gr, hr) - score(g, h)
    gains = np.nan_to_num(gains, nan=0.0)
    if b.growth == "oblivious":  # a cut may leave a side of some node empty
        return gains
    least = max(b.leaf, 1)
    return np.where((nl >= least) & (nr >= least) & (hl >= b.hessian) & (hr >= b.hessian), gains, -np.inf)


def best_cuts(b: Boost, cells: tuple, slots: int, used: np.ndarray) -> dict:
    """Per slot the best cut (of equal ones that of the first input, then bin): ``gain, feature, cut``, the sums ``left`` of it
    and ``total`` (rows, G, H). ``cells`` are a unit's filled histogram cells."""
    bins, p = tr.MAX_BINS + 1, len(used)
    scale = np.array([1.0, tr.ONE, tr.ONE])
    if b.growth == "oblivious":
        sums = tr.dense(cells, slots, p) / scale[:, None, None, None]
        left = np.cumsum(sums, axis=3)
        total = left[:, :, :1, -1:]
        one = split_gains(b, left, total).sum(axis=0)
        one[~used] = -np.inf
        one[:, -1] = -np.inf
        f, cut = divmod(int(one.argmax()), bins)
        return {"gain": np.full(slots, one.max()), "feature": np.full(slots, f), "cut": np.full(slots, cut), "left": left[:, :, f, cut].T, "total": total[:, :, 0, 0].T}
    # a cut at an empty bin is one at the filled bin before it, so filled cells are all there is to try
    at = cells[0]
    group = at // bins
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    run = np.cumsum(cells[1], axis=0)  # integers: exact
    before = np.concatenate([np.zeros((1, 3), np.int64), run])[first]
    left = (run - np.repeat(before, np.diff(np.append(first, len(at))), axis=0)) / scale
    slot, feature = np.divmod(group, p)
    start = np.searchsorted(slot, np.arange(slots))
    # each row fills a cell of every input, so the first input's cells make a slot's total
    end = np.searchsorted(group, np.arange(slots) * p, "right") - 1
    total = left[end]
    gains = np.where(used[feature], split_gains(b, left.T, total[slot].T), -np.inf)
    top = np.maximum.reduceat(gains, start)
    hit = np.flatnonzero(gains == top[slot])
    best = hit[np.searchsorted(slot[hit], np.arange(slots))]
    return {"gain": gains[best], "feature": feature[best], "cut": at[best] % bins, "left": left[best], "total": total}


class Grower:
    """One tree of one model and fold on the driver; it holds nodes, never rows."""

    def __init__(self, b: Boost):
        self.b, self.tree = b, Tree()
        self.tree.add(0.0, 0, 0)
        self.frontier = [0]
        self.path: dict = {}        # leaf growth: least gain from the root, of nodes with a cut
        self.parent: dict = {}

    def update(self, cuts: dict) -> None:
        """Takes the cuts of the frontier's nodes and opens the next one."""
        b, t = self.b, self.tree
        nodes, self.frontier = self.frontier, []
        good = []
        for i, node in enumerate(nodes):
            if node == 0:
                t.value[0], t.count[0] = float(leaf_value(b, *cuts["total"][0][1:])), int(cuts["total"][0][0])
            gain = float(cuts["gain"][i])
            if (gain if b.first_order else gain / 2 - b.gain) > LEAST_GAIN:
                good.append((i, node, gain))
        if b.growth == "leaf":
            for i, node, gain in good:
                self.path[node] = min(gain, self.path.get(self.parent.get(node), np.inf))
            ranked = sorted(self.path.values(), reverse=True)
            bar = ranked[b.leaves - 2] if len(ranked) >= b.leaves - 1 else -np.inf
            good = [x for x in good if self.path[x[1]] >= bar]
        for i, node, gain in good:
            left = cuts["left"][i]
            right = cuts["total"][i] - left
            sides = [(float(leaf_value(b, s[1], s[2])), int(s[0])) for s in (left, right)]
            for k in t.split(node, cuts["feature"][i], int(cuts["cut"][i]), gain, *sides):
                self.parent[k] = node
                if t.depth[k] < b.depth and (b.growth == "oblivious" or t.count[k] >= max(b.split, 2 * b.leaf)):
                    self.frontier.append(k)

    def done(self) -> Tree:
        t = self.tree
        if self.b.growth == "leaf":  # the best split first, as far as the leaves go
            heap, taken = [(-t.gain[0], 0)] if t.feature[0] >= 0 else [], set()
            while heap and len(taken) < self.b.leaves - 1:
                _, i = heapq.heappop(heap)
                taken.add(i)
                for k in (t.left[i], t.right[i]):
                    if t.feature[k] >= 0:
                        heapq.heappush(heap, (-t.gain[k], k))
            for i in range(len(t.feature)):
                if i not in taken:
                    t.feature[i] = -1
        return t.compact()


def _passes(open_nodes: dict, per_node: int, whole: set) -> list[dict]:
    """The open nodes of each task, dealt to passes that each fill ``MAX_CELLS`` at most (a unit of
    ``CHUNK`` nodes, or all of a task in ``whole``, is never cut): ``{task: (first, end)}``."""
    out, room = [{}], tr.MAX_CELLS
    for k, n in open_nodes.items():
        unit = n if k in whole else CHUNK
        for a in range(0, n, unit):
            size = per_node * min(unit, n - a)
            if size > room and out[-1]:
                out.append({})
                room = tr.MAX_CELLS
            first, _ = out[-1].get(k, (a, a))
            out[-1][k] = (first, min(a + unit, n))
            room -= size
    return out


def _units(work: dict, whole: set) -> dict:
    """``{(task, first node): number of nodes}`` of a pass."""
    return {(k, first + a): min(len(nodes) if k in whole else CHUNK, len(nodes) - a)
            for k, (_, nodes, first) in work.items() for a in range(0, len(nodes), len(nodes) if k in whole else CHUNK)}


def boost(df: DataFrame, predictors: list[str], specs: list[Boost], folds: list[Fold], keep: list[str], share: int | None = None):
    """Fits every spec on every fold: ``(trees[spec][fold], priors[spec][fold], edges[fold], state)``.

    ``df`` holds the inputs, ``Target`` (0/1), ``d`` and ``keep``. ``state`` is a persisted RDD of (block, margins by spec and fold).
    On a table of one block at most ``share`` tasks run at a time.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    own = not df.is_cached
    df = df.persist()  # read for quantiles, for its size and for the blocks
    edges = tr.quantile_edges(df, predictors, folds)
    p, tasks = len(predictors), [(m, f) for m in range(len(specs)) for f in range(len(folds))]
    blocks = tr.persisted(tr.binned_blocks(df, predictors, folds, edges, keep))
    ends = [f.train_end for f in folds]

    def label_counts(b):
        return np.array([[(b["d"] < e).sum(), b["y"][b["d"] < e].sum()] for e in ends], float)

    counts = blocks.map(label_counts).fold(np.zeros((len(folds), 2)), lambda a, b: a + b)
    if own:  # else other models may read it still
        df.unpersist()
    prior = [[float(np.log(pos / (n - pos))) if s.prior and 0 < pos < n else 0.0 for n, pos in counts] for s in specs]
    start = np.array([prior[m][f] for m, f in tasks])
    state = tr.persisted(blocks.map(lambda b: (b, np.repeat(start[:, None], len(b["y"]), axis=1))))
    out = [[[] for _ in folds] for _ in specs]
    # a fold without training rows or with one class keeps its prior
    live = [k for k, (m, f) in enumerate(tasks) if 0 < counts[f][1] < counts[f][0]]
    whole = {k for k in live if specs[tasks[k][0]].growth == "oblivious"}
    if blocks.getNumPartitions() == 1:
        state.unpersist()
        out, state = _apart(blocks, specs, folds, tasks, live, whole, start, p, out, share)
        return out, prior, edges, state
    older, parallel = blocks, max(1, min(spark.sparkContext.defaultParallelism, state.getNumPartitions()))
    for r in range(max((s.rounds for s in specs), default=0)):
        now = [k for k in live if r < specs[tasks[k][0]].rounds]
        if not now:
            break

        def summed(work, units, used):
            sums = state.mapPartitions(_histograms(work, tasks, specs, ends, r, units)).reduceByKey(tr.added, min(len(units), parallel))
            return sums.map(_best(specs, tasks, used, units)).collect()

        grown = _round(now, r, specs, tasks, whole, p, summed)
        for k, t in grown.items():
            out[tasks[k][0]][tasks[k][1]].append(t)
        older, state = _next(state, {k: t.arrays() for k, t in grown.items()}, tasks, older, r)
    state.count()
    older.unpersist()
    blocks.unpersist()
    return out, prior, edges, state


def _round(now: list, r: int, specs: list, tasks: list, whole: set, p: int, summed) -> dict:
    """The trees of one round by task; ``summed(work, units, used)`` gives the cuts of a pass."""
    growers = {k: Grower(specs[tasks[k][0]]) for k in now}
    used = {}
    for k in now:
        s = specs[tasks[k][0]]
        order = np.argsort(tr.uniform(s.seed, r, np.arange(p)), kind="stable")
        used[k] = np.isin(np.arange(p), order[: max(1, int(round(s.columns * p)))])
    while opened := {k: len(g.frontier) for k, g in growers.items() if g.frontier}:
        cuts: dict = {k: {} for k in opened}
        for part in _passes(opened, p * (tr.MAX_BINS + 1), whole):
            work = {k: (growers[k].tree.arrays(), np.array(growers[k].frontier[a:b]), a) for k, (a, b) in part.items()}
            for (k, at), found in summed(work, _units(work, whole), used):
                cuts[k][at] = found
        for k, found in cuts.items():
            parts = [found[a] for a in sorted(found)]
            if parts:
                growers[k].update({c: np.concatenate([x[c] for x in parts]) for c in parts[0]})
            else:  # the sample of rows was empty
                growers[k].frontier = []
    return {k: g.done() for k, g in growers.items()}


def _apart(blocks, specs: list, folds: list[Fold], tasks: list, live: list, whole: set, start: np.ndarray, p: int, out: list,
           share: int | None):
    """``boost`` on a table of one partition (at most ``BLOCK_ROWS`` rows): its block is dealt once to every model and fold, and each
    makes all its rounds in a task of its own. The passes are the same, and so are the trees; there is one job, not one per tree level."""
    ends = [f.train_end for f in folds]

    def deal(b):
        for k in live:
            f = tasks[k][1]
            yield k, {"x": {f: b["x"][f]}, "y": b["y"], "d": b["d"], "h": b["h"]}

    def grow(item):
        k, held = item
        held = list(held)
        m, f = tasks[k]
        margins = [{k: np.full(len(b["y"]), start[k])} for b in held]
        trees = []
        for r in range(specs[m].rounds):
            for b in held:
                b["kept"] = {}  # of one tree: its rows' gradients and nodes

            def summed(work, units, used, r=r):
                return map(_best(specs, tasks, used, units), _histograms(work, tasks, specs, ends, r, units)(zip(held, margins)))

            tree = _round([k], r, specs, tasks, whole, p, summed)[k]
            a = tree.arrays()
            for b, margin in zip(held, margins):
                margin[k] += a["value"][tr.walk(a, b["x"][f])]
            trees.append(tree)
        return k, trees, [margin[k] for margin in margins]

    parts = max(1, min(len(live), share or len(live)))
    place = {k: i % parts for i, k in enumerate(live)}
    grown = tr.persisted(blocks.flatMap(deal).groupByKey(parts, lambda k: place[k]).map(grow))
    for k, trees in grown.map(lambda g: g[:2]).collect():
        out[tasks[k][0]][tasks[k][1]] = trees

    def joined(item):
        held, found = item[1]
        found = dict(found)
        return [(b, np.array([found[k][i] if k in found else np.full(len(b["y"]), start[k]) for k in range(len(tasks))]))
                for i, b in enumerate(held)]

    state = tr.persisted(blocks.map(lambda b: (0, b)).cogroup(grown.map(lambda g: (0, (g[0], g[2]))), 1).flatMap(joined))
    state.count()
    grown.unpersist()
    blocks.unpersist()
    return out, state


def _next(state, grown: dict, tasks: list, older, r: int):
    """The state after a round; the one before the last is released, as no later one needs it."""
    def step(item):
        b, margin = item
        margin = margin.copy()
        for k, t in grown.items():
            margin[k] += t["value"][tr.walk(t, b["x"][tasks[k][1]])]
        return b, margin

    new = tr.persisted(state.map(step))
    if (r + 1) % tr.CHECKPOINT_EVERY == 0:
        new.checkpoint()
        new.count()
    older.unpersist()
    return state, new


def _histograms(work: dict, tasks: list, specs: list, ends: list, r: int, units: dict):
    """Map side of a pass: ``((task, first node), cells)`` per partition."""
    def run(items):
        total: dict = {}
        for b, margin in items:
            kept = b.get("kept")  # of a block that stays in its task for all levels of a tree
            for k, (tree, nodes, first) in work.items():
                m, f = tasks[k]
                if kept is not None and k in kept:
                    x, node, g, h = kept[k]
                    node = tr.walk(tree, x, node)
                else:
                    s, rows = specs[m], b["d"] < ends[f]
                    if s.rows < 1.0:
                        rows = rows & (tr.uniform(s.seed + 1, r, b["h"]) < s.rows)
                    rows = np.flatnonzero(rows)
                    x = b["x"][f][rows]
                    node = tr.walk(tree, x)
                    q = 1.0 / (1.0 + np.exp(-margin[k][rows]))
                    g, h = np.rint((b["y"][rows] - q) * tr.ONE), np.rint(q * (1.0 - q) * tr.ONE)
                if kept is not None:
                    kept[k] = x, node, g, h
                slot_of = np.full(len(tree["feature"]), -1)
                slot_of[nodes] = np.arange(len(nodes))
                slot = slot_of[node]
                inside = np.flatnonzero(slot >= 0)
                x, slot, g, h = x[inside], slot[inside], g[inside], h[inside]
                for a in range(len(nodes)):
                    n = units.get((k, first + a))
                    if n:
                        mine = slice(None) if n == len(nodes) else np.flatnonzero((slot >= a) & (slot < a + n))
                        c = tr.cells(slot[mine] - a, x[mine], [g[mine], h[mine]], n)
                        if len(c[0]):
                            key = (k, first + a)
                            total[key] = tr.added(total[key], c) if key in total else c
        return iter(total.items())

    return run


def _best(specs: list, tasks: list, used: dict, units: dict):
    """Reduce side of a pass: the cuts of a unit's nodes."""
    def run(item):
        key, c = item
        return key, best_cuts(specs[tasks[key[0]][0]], c, units[key], used[key[0]])

    return run


def ensembles(fitted, p: int) -> list[list[Ensemble]]:
    """``boost``'s trees as data, by spec and fold."""
    trees, prior, edges, _ = fitted
    return [[Ensemble.of(ts, edges[f], p, prior[m][f], "logistic") for f, ts in enumerate(per)] for m, per in enumerate(trees)]
