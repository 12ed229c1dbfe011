"""Edit distance between syntax trees, in tenths.

Zhang and Shasha's algorithm (SIAM J. Comput. 18, 1989) over postorder arrays.
Insertions and deletions cost 10, turning an atom into another 3, any other
change of label 10.
"""

from __future__ import annotations

import numpy as np

from parenlake.functions.reader import Tree

#: Costs in tenths; pairs of nodes, and cells over all tables,
#: that a comparison may take.
GAP, ATOM, OTHER = 10, 3, 10
CELLS = 4 * 1024 * 1024
OPERATIONS = 64 * 1024 * 1024
#: More than any distance.
FAR = 1 << 28


def encode(tree: Tree, root: int) -> tuple[list[str], list[int]]:
    """Labels in postorder and each node's leftmost leaf. Atoms are labelled
    'a' and their text, lists 'l', their delimiter and prefixes."""
    labels: list[str] = []
    leftmost: list[int] = []
    stack: list[tuple[int, bool, int]] = [(root, False, 0)]
    while stack:
        k, done, first = stack.pop()
        node = tree.nodes[k]
        if not node.children:
            first, done = len(labels), True
        if not done:
            stack.append((k, True, len(labels)))
            stack.extend((c, False, 0) for c in reversed(node.children))
            continue
        marks = ",".join(node.prefixes)
        labels.append(f"a{tree.text(k)}\0{marks}" if node.kind == "atom" else f"l{node.delimiter}\0{marks}")
        leftmost.append(first)
    return labels, leftmost


def relabelled(la: list[str], lb: list[str]) -> int:
    """Cost of changing the labels of one topology alone."""
    return sum(0 if x == y else ATOM if x[0] == y[0] == "a" else OTHER for x, y in zip(la, lb, strict=True))


def _leaf_costs(change: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distances of a leaf to each subtree, of its costs of change into each
    node: all nodes but the cheapest to change into are inserted."""
    at = np.arange(len(first))
    within = lambda cheap: np.maximum.accumulate(np.where(cheap, at, -1)) >= first
    return (at - first) * GAP + np.where(within(change == 0), 0, np.where(within(change <= ATOM), ATOM, OTHER))


def _key_roots(first: np.ndarray) -> np.ndarray:
    """The last node of each leftmost leaf, leaves of their own left out."""
    roots = np.array(sorted({f: k for k, f in enumerate(first.tolist())}.values()))
    return roots[first[roots] < roots]


def distance(a: tuple[list[str], list[int]], b: tuple[list[str], list[int]], most: float | None = None, limit: int = OPERATIONS) -> int | None:
    """Distance in tenths; None if the comparison is too large: more than CELLS
    pairs of nodes, or more than ``limit`` cells over all tables.

    Of distances above ``most`` (None: no bound) all that is promised is that
    they come out above it. ``most`` allows so many gaps, and a mapping of one
    node to another costs at least the differences in the number of nodes left
    of them, below them and after them (Touzet, DAM 155, 2007): pairs of
    subtrees and cells of a table that cost more are never worked out. A row of
    a table is one pass of array operations; what is left of the row is reached
    by a running minimum."""
    (la, fa), (lb, fb) = a, b
    n, m = len(la), len(lb)
    if la == lb and fa == fb:
        return 0
    if (n + 1) * (m + 1) > CELLS:
        return None
    if fa == fb:
        # The same topology: relabelling is best as long as it is cheap.
        cost = relabelled(la, lb)
        if cost <= 2 * GAP:
            return cost
    gaps = n + m if most is None else min(n + m, int(most // GAP))
    if abs(n - m) > gaps:
        return abs(n - m) * GAP
    first_a, first_b = np.array(fa), np.array(fb)
    known: dict[str, int] = {}
    ids_a, ids_b = (np.array([known.setdefault(x, len(known)) for x in labels]) for labels in (la, lb))
    atom_a, atom_b = (np.array([x[0] == "a" for x in labels]) for labels in (la, lb))
    change = np.where(atom_a[:, None] & atom_b, ATOM, OTHER).astype(np.int32)
    change[ids_a[:, None] == ids_b] = 0

    roots_a, roots_b = _key_roots(first_a), _key_roots(first_b)
    apart = np.abs(first_a[roots_a][:, None] - first_b[roots_b])
    near = apart + np.abs(n - m - (first_a[roots_a][:, None] - first_b[roots_b])) <= gaps
    rows, columns = (roots - first[roots] + 1 for roots, first in ((roots_a, first_a), (roots_b, first_b)))
    if int((near * rows[:, None] * np.minimum(columns, 2 * (gaps - apart) + 1)).sum()) > limit:
        return None

    whole = np.full((n, m), FAR, np.int32)
    for label in np.unique(ids_a[first_a == np.arange(n)]):
        leaves = np.flatnonzero((ids_a == label) & (first_a == np.arange(n)))
        whole[leaves] = _leaf_costs(change[leaves[0]], first_b)
    for label in np.unique(ids_b[first_b == np.arange(m)]):
        leaves = np.flatnonzero((ids_b == label) & (first_b == np.arange(m)))
        whole[:, leaves] = _leaf_costs(change[:, leaves[0]], first_a)[:, None]
    steps = np.arange(m + 1, dtype=np.int32) * GAP
    for i, root in enumerate(roots_a):
        p = fa[root]
        for j in np.flatnonzero(near[i]):
            q, last = fb[roots_b[j]], roots_b[j]
            wide = gaps - int(apart[i, j])
            starts = first_b[q : last + 1] - q
            begins = starts == 0
            table = np.full((root - p + 2, last - q + 2), FAR, np.int32)
            table[0, : wide + 1] = steps[: last - q + 2][: wide + 1]
            table[: wide + 1, 0] = np.arange(min(wide, root - p + 1) + 1) * GAP
            for x in range(1, root - p + 2):
                u = p + x - 1
                low, high = max(1, x - wide), min(last - q + 1, x + wide)
                if low > high:
                    break
                here = slice(low - 1, high)
                met = table[fa[u] - p, starts[here]] + whole[u, q + low - 1 : q + high]
                if fa[u] == p:
                    met = np.where(begins[here], table[x - 1, here] + change[u, q + low - 1 : q + high], met)
                reached = np.minimum(met, table[x - 1, low : high + 1] + GAP) - steps[low : high + 1]
                reached[0] = min(reached[0], table[x, low - 1] - steps[low - 1])
                table[x, low : high + 1] = np.minimum(np.minimum.accumulate(reached) + steps[low : high + 1], FAR)
                if fa[u] == p:
                    ends = q + np.flatnonzero(begins[here]) + low - 1
                    whole[u, ends] = table[x, ends - q + 1]
    return int(whole[n - 1, m - 1])
