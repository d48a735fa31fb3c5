"""Regression trees grown in numpy on one bounded block of rows.

Three boosting families share one histogram and differ in how a tree grows:

* ``depth_wise``: every node of a level is split where it gains most;
* ``leaf_wise``: the leaf that gains most is split next, up to a number of leaves;
* ``symmetric``: all nodes of a level share the split that gains most over all of them.

``exact_tree`` is a forest's tree: every distinct value is a possible split and nodes
are split until their targets are equal.

Numeric columns split as x <= threshold.  A category splits into one level and all
others, which is what indicator columns of every level can express.  Nothing here
knows Spark; ``ensembles`` deals blocks to tasks and puts the results together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Family:
    """What tells the boosting families apart; everything else comes from the grid."""

    growth: str
    penalty: float  # added to a leaf's row count
    least_rows: int  # of a leaf
    leaves: int = 1 << 30


#: Defaults of the three families beyond the shared grid.
FAMILIES = {
    "xgboost": Family("depth_wise", 1.0, 1),
    "lightgbm": Family("leaf_wise", 0.0, 20, 31),
    "catboost": Family("symmetric", 3.0, 1),
}


@dataclass(frozen=True)
class Binned:
    """Columns as cells: the bins of all columns behind one another."""

    cells: np.ndarray  # rows x columns
    begin: np.ndarray  # first cell of each column, and their number
    column: np.ndarray  # of each cell
    cut: np.ndarray  # of each cell: largest value in a numeric bin, or the level
    category: np.ndarray  # of each column


def binned(columns: list[np.ndarray], category: list[bool], bins: int) -> Binned:
    """Numeric columns in ``bins`` bins of about equal rows, at most; a category has a bin for each level."""
    cells, begin, cuts = [], [0], []
    for values, levels in zip(columns, category, strict=True):
        distinct = np.unique(values)
        if not levels and len(distinct) > bins:
            edges = np.unique(np.quantile(values, np.arange(1, bins) / bins, method="inverted_cdf"))
            cut = edges if edges[-1] == distinct[-1] else np.append(edges, distinct[-1])
        elif levels:
            cut = distinct
        else:  # half way to the next value
            cut = np.append((distinct[:-1] + distinct[1:]) / 2, distinct[-1:])
        cells.append(np.searchsorted(cut, values, side="left") + begin[-1])
        begin.append(begin[-1] + len(cut))
        cuts.append(cut)
    widths = np.diff(begin)
    return Binned(
        np.stack(cells, axis=1), np.array(begin), np.repeat(np.arange(len(columns)), widths), np.concatenate(cuts), np.array(category)
    )


class _Histograms:
    """Sums of gradients and rows by node and cell, and the best split of a node."""

    def __init__(self, data: Binned, family: Family) -> None:
        self.data, self.family = data, family
        self.size, self.width = int(data.begin[-1]), data.cells.shape[1]
        self.levels = np.flatnonzero(data.category[data.column])

    def of(self, rows: np.ndarray, node: np.ndarray, nodes: int, gradient: np.ndarray) -> np.ndarray:
        at = (self.data.cells[rows] + (node * self.size)[:, None]).ravel()
        shape = (nodes, self.size)
        out = np.empty((2, *shape))
        out[0] = np.bincount(at, np.repeat(gradient[rows], self.width), nodes * self.size).reshape(shape)
        out[1] = np.bincount(at, minlength=nodes * self.size).reshape(shape)
        return out

    def gains(self, histogram: np.ndarray) -> np.ndarray:
        """Score of both sides of every split, by node and cell; -inf where a side has too few rows."""
        sums, counts = histogram
        total_sum, total = (h[:, : self.data.begin[1]].sum(axis=1, keepdims=True) for h in histogram)
        # every row is in one cell of each column, so that a column begins with the total of those before it
        first, rows = np.cumsum(sums, axis=1), np.cumsum(counts, axis=1)
        first -= total_sum * self.data.column
        rows -= total * self.data.column
        levels = self.levels
        first[:, levels], rows[:, levels] = total_sum - sums[:, levels], total - counts[:, levels]
        second, rest = total_sum - first, total - rows
        least = max(self.family.least_rows, 1) - 0.5
        barred = (rows < least) | (rest < least)
        rows += self.family.penalty
        rest += self.family.penalty
        rows[barred] = rest[barred] = 1.0
        first *= first
        first /= rows
        second *= second
        second /= rest
        first += second
        first[barred] = -np.inf
        return first

    def alone(self, histogram: np.ndarray) -> np.ndarray:
        """Score of every node without a split."""
        total_sum, total = (h[:, : self.data.begin[1]].sum(axis=1) for h in histogram)
        return total_sum**2 / np.maximum(total + self.family.penalty, 1e-300)

    def right(self, rows: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Whether rows go to the second side of the split at ``cell`` (one each)."""
        column = self.data.column[cell]
        own = self.data.cells[rows, column]
        return np.where(self.data.category[column], own == cell, own > cell)


@dataclass
class Tree:
    """Nodes: split column (-1: leaf), first child (the second follows it), threshold, level or value."""

    column: np.ndarray
    child: np.ndarray
    number: np.ndarray


_LEAST_GAIN = 1e-6


def _depth_wise(h: _Histograms, rows: np.ndarray, gradient: np.ndarray, depth: int, symmetric: bool) -> tuple[np.ndarray, np.ndarray]:
    """Splits (rows of node, cell and first child) and the leaf of every sampled row."""
    node = np.zeros(len(rows), np.int64)  # within the level
    ids, made, splits = np.zeros(1, np.int64), 1, []
    leaf = np.zeros(len(rows), np.int64)
    live = np.arange(len(rows))
    histogram = h.of(rows, node, 1, gradient)
    for level in range(depth):
        gains, alone = h.gains(histogram), h.alone(histogram)
        if symmetric:
            # a node that the shared split leaves whole keeps its score and gets one child without rows
            common = np.where(np.isneginf(gains), alone[:, None], gains).sum(axis=0)
            best = np.full(len(ids), int(np.argmax(common)))
            split = np.full(len(ids), bool(common.max() > alone.sum() + _LEAST_GAIN))
        else:
            best = np.argmax(gains, axis=1)
            split = gains[np.arange(len(ids)), best] > alone + _LEAST_GAIN
        if not split.any():
            break
        parents = np.flatnonzero(split)
        rank = np.cumsum(split) - 1
        splits.append(np.stack([ids[parents], best[parents], made + 2 * np.arange(len(parents))]))
        if len(parents) < len(ids):
            keep = split[node]
            live, node = live[keep], node[keep]
        node = 2 * rank[node] + h.right(rows[live], best[node])
        ids = made + np.arange(2 * len(parents))
        leaf[live] = ids[node]
        made += 2 * len(parents)
        if level + 1 < depth:
            # only the smaller child of each pair is counted, the other one is the rest
            count = np.bincount(node, minlength=len(ids)).reshape(-1, 2)
            small = 2 * np.arange(len(parents)) + (count[:, 1] < count[:, 0])
            chosen = np.zeros(len(ids), bool)
            chosen[small] = True
            part = chosen[node]
            fewer = h.of(rows[live[part]], node[part] // 2, len(parents), gradient)
            following = np.empty((2, len(ids), h.size))
            following[:, small] = fewer
            following[:, small ^ 1] = histogram[:, parents] - fewer
            histogram = following
    return np.concatenate(splits, axis=1) if splits else np.zeros((3, 0), np.int64), leaf


def _leaf_wise(h: _Histograms, rows: np.ndarray, gradient: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    leaf = np.zeros(len(rows), np.int64)
    splits, made, waiting = [], 1, {}

    def consider(first: int, members: list[np.ndarray], histogram: np.ndarray, level: int) -> None:
        """Leaves numbered from ``first``: the split at which each gains most."""
        if level >= depth or max(map(len, members)) < 2 * h.family.least_rows:
            return
        gains, alone = h.gains(histogram), h.alone(histogram)
        cells = np.argmax(gains, axis=1).tolist()
        for i, (cell, score) in enumerate(zip(cells, alone.tolist(), strict=True)):
            gain = float(gains[i, cell]) - score
            if gain > _LEAST_GAIN:
                waiting[first + i] = (gain, cell, members[i], histogram[:, i : i + 1], level)

    zero = lambda members: np.zeros(len(members), np.int64)
    consider(0, [np.arange(len(rows))], h.of(rows, zero(rows), 1, gradient), 0)
    while waiting and len(splits) + 1 < h.family.leaves:
        node = max(waiting, key=lambda k: (waiting[k][0], -k))
        _, cell, members, histogram, level = waiting.pop(node)
        right = h.right(rows[members], np.full(len(members), cell))
        sides = [members[~right], members[right]]
        leaf[sides[0]], leaf[sides[1]] = made, made + 1
        splits.append((node, cell, made))
        if level + 1 < depth:
            small = int(len(sides[1]) < len(sides[0]))
            both = np.empty((2, 2, h.size))
            both[:, small] = h.of(rows[sides[small]], zero(sides[small]), 1, gradient)[:, 0]
            both[:, 1 - small] = histogram[:, 0] - both[:, small]
            consider(made, sides, both, level + 1)
        made += 2
    return np.array(splits, np.int64).reshape(-1, 3).T, leaf


def grow(h: _Histograms, rows: np.ndarray, gradient: np.ndarray, depth: int, rate: float) -> tuple[Tree, np.ndarray]:
    """A tree on the sampled rows, and the leaf of every row of the block."""
    if h.family.growth == "leaf_wise":
        splits, leaf = _leaf_wise(h, rows, gradient, depth)
    else:
        splits, leaf = _depth_wise(h, rows, gradient, depth, h.family.growth == "symmetric")
    split, cell, first = splits
    nodes = 2 * len(split) + 1
    tree = Tree(np.full(nodes, -1, np.int16), np.zeros(nodes, np.int32), np.zeros(nodes))
    tree.column[split], tree.child[split], tree.number[split] = h.data.column[cell], first, h.data.cut[cell]
    sums, count = np.bincount(leaf, gradient[rows], nodes), np.bincount(leaf, minlength=nodes)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(count > 0, -rate * sums / (count + h.family.penalty), 0.0)
    is_leaf = tree.column < 0
    tree.number[is_leaf] = value[is_leaf]
    everything = len(h.data.cells)
    if len(rows) == everything:
        return tree, leaf
    # rows outside the sample walk down the tree
    where, cell_of = np.zeros(everything, np.int64), np.zeros(nodes, np.int64)
    where[rows], cell_of[split] = leaf, cell
    outside = np.ones(everything, bool)
    outside[rows] = False
    open_ = np.flatnonzero(outside) if len(split) else split
    while open_.size:
        where[open_] = tree.child[where[open_]] + h.right(open_, cell_of[where[open_]])
        open_ = open_[tree.column[where[open_]] >= 0]
    return tree, where


def boost(data: Binned, target: np.ndarray, family: Family, rate: float, iterations: int, depth: int, subsample: float, seed: int) -> tuple[float, list[Tree]]:
    """Least-squares boosting from the mean; a shorter run is a prefix of a longer one."""
    base = float(target.mean())
    fitted = np.full(len(target), base)
    h, trees = _Histograms(data, family), []
    everything = np.arange(len(target))
    for number in range(iterations):
        rows = everything
        if subsample < 1:
            rows = np.flatnonzero(np.random.default_rng((seed, number)).random(len(target)) < subsample)
        tree, leaf = grow(h, rows, fitted - target, depth, rate) if len(rows) else (Tree(np.full(1, -1, np.int16), np.zeros(1, np.int32), np.zeros(1)), np.zeros(len(target), np.int64))
        fitted += tree.number[leaf]
        trees.append(tree)
    return base, trees


def presorted(columns: list[np.ndarray]) -> np.ndarray:
    """Rows of every column by ascending value."""
    return np.stack([np.argsort(values, kind="stable") for values in columns])


def exact_tree(columns: np.ndarray, category: np.ndarray, order: np.ndarray, target: np.ndarray, weight: np.ndarray) -> Tree:
    """A tree on rows with bootstrap counts ``weight``, split until targets are equal.

    ``columns`` is columns x rows; all columns of a level are searched at once, each in
    the order of (node, value), which every level keeps by a stable sort.
    """
    width = len(columns)
    rows = order[weight[order] > 0].reshape(width, -1)
    node = np.zeros(len(target), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    made = 1  # nodes numbered so far, with the level's own
    while True:
        sorted_node = node[rows[0]]
        starts = np.flatnonzero(np.diff(sorted_node, prepend=-1))
        lengths = np.diff(np.append(starts, rows.shape[1]))
        count = len(starts)
        slot = np.repeat(np.arange(count), lengths)
        w, values = weight[rows], np.take_along_axis(columns, rows, axis=1)
        wy = w * target[rows]
        total_w, total_y = np.add.reduceat(w[0], starts), np.add.reduceat(wy[0], starts)
        y = target[rows[0]]
        pure = np.maximum.reduceat(y, starts) == np.minimum.reduceat(y, starts)
        cum_w, cum_y = np.cumsum(w, axis=1), np.cumsum(wy, axis=1)
        before_w, before_y = (np.concatenate([np.zeros((width, 1)), c[:, :-1]], axis=1) for c in (cum_w, cum_y))
        new_node = np.zeros(rows.shape[1], bool)
        new_node[starts] = True
        begins = np.diff(values, axis=1, prepend=np.nan) != 0
        begins |= new_node
        ends = np.concatenate([begins[:, 1:], np.ones((width, 1), bool)], axis=1)
        # a numeric side reaches from the node's first row to here, a level from its own first row
        first = np.where(category[:, None], np.maximum.accumulate(np.where(begins, np.arange(rows.shape[1]), 0), axis=1), starts[slot])
        side_w = cum_w - np.take_along_axis(before_w, first, axis=1)
        side_y = cum_y - np.take_along_axis(before_y, first, axis=1)
        rest_w, rest_y = total_w[slot] - side_w, total_y[slot] - side_y
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = side_y**2 / side_w + rest_y**2 / rest_w
        gain[~ends | (rest_w < 0.5)] = -np.inf
        best = np.maximum.reduceat(gain, starts, axis=1)
        column = np.argmax(best, axis=0)
        top = best[column, np.arange(count)]
        split = ~pure & np.isfinite(top)
        # the first place of the chosen column that has the best gain
        hit = (gain[column[slot], np.arange(rows.shape[1])] == top[slot]) & split[slot]
        place = np.full(count, rows.shape[1])
        np.minimum.at(place, slot[hit], np.flatnonzero(hit))
        chosen = np.flatnonzero(split)
        at, f = place[chosen], column[chosen]
        here = values[f, at]
        following = values[f, np.minimum(at + 1, rows.shape[1] - 1)]
        number = total_y / total_w
        middle = (here + following) / 2
        # between neighbouring doubles there is no middle
        number[chosen] = np.where(category[f] | (middle >= following), here, middle)
        child = np.zeros(count, np.int64)
        child[chosen] = made + 2 * np.arange(len(chosen))
        parts.append((np.where(split, column, -1), child, number))
        if not len(chosen):
            break
        members = rows[0]
        go_on = split[slot]
        x = columns[column[slot], members]
        threshold = number[slot]
        right = np.where(category[column[slot]], x == threshold, x > threshold)
        node[members] = np.where(go_on, 2 * (np.cumsum(split) - 1)[slot] + right, -1)
        made += 2 * len(chosen)
        rows = rows[node[rows] >= 0].reshape(width, -1)
        rows = np.take_along_axis(rows, np.argsort(node[rows], axis=1, kind="stable"), axis=1)
    return Tree(*(np.concatenate([p[i] for p in parts]).astype(t) for i, t in enumerate((np.int16, np.int32, float))))


def forest(columns: list[np.ndarray], category: list[bool], target: np.ndarray, numbers: range, seed: int) -> list[Tree]:
    """The trees with the given numbers, each on its own bootstrap sample."""
    stacked, order = np.stack(columns).astype(float), presorted(columns)
    trees = []
    for number in numbers:
        draw = np.random.default_rng((seed, number)).integers(0, len(target), len(target))
        weight = np.bincount(draw, minlength=len(target)).astype(float)
        trees.append(exact_tree(stacked, np.array(category), order, target, weight))
    return trees


@dataclass(frozen=True)
class Packed:
    """Trees behind one another; ``roots`` are their first nodes."""

    roots: np.ndarray
    column: np.ndarray
    child: np.ndarray
    number: np.ndarray

    def leaves(self, columns: np.ndarray, category: np.ndarray) -> np.ndarray:
        """Leaf values, rows x trees, for ``columns`` (columns x rows)."""
        node = np.repeat(self.roots[None, :], columns.shape[1], axis=0)
        row = np.repeat(np.arange(columns.shape[1])[:, None], len(self.roots), axis=1)
        while True:
            f = self.column[node]
            open_ = f >= 0
            if not open_.any():
                return self.number[node]
            at, f = node[open_], f[open_]
            x, t = columns[f, row[open_]], self.number[at]
            node[open_] = self.child[at] + np.where(category[f], x == t, x > t)


def packed(trees: list[Tree]) -> Packed:
    sizes = np.array([len(t.column) for t in trees])
    roots = np.cumsum(sizes) - sizes
    child = np.concatenate([t.child + r for t, r in zip(trees, roots, strict=True)])
    return Packed(roots, np.concatenate([t.column for t in trees]), child, np.concatenate([t.number for t in trees]))
