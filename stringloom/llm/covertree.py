"""A cover tree over unit vectors in memory, and the dual traversal of two of them.

Levels nest: a node's own point is the point of its first child, and the covering radius halves from level to level. A node's
other children are picked farthest first until all of its points lie within half of its radius of one, so children are farther
than that apart. Nodes whose radius cannot separate a link from its copy any more, and nodes of one point, are leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Distances come from dot products; this is well beyond their error.
MARGIN = 1e-6
#: Nodes or points that meet others at a time.
SIDE = 256
#: Nodes to expand meet all others in one product if at least one in so many of their pairs is not pruned.
DENSE = 16


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between all rows of x and of y, which are unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


class Tree:
    """x: unit vectors, the root's point first. A node i has the points order[low[i]:high[i]], its own one is center[i], all are
    within radius[i] (as measured) of it; its children are kids[first[i]:first[i + 1]], a leaf has none."""

    def __init__(self, x: np.ndarray, smallest: float):
        n = len(x)
        self.x, self.order = x, np.arange(n)
        low, high, center, radius, kids = [0], [n], [0], [], {}
        reach = distances(x, x[:1])[:, 0] if n else np.zeros(0)
        radius.append(float(reach.max(initial=0.0)))
        scale = [2.0]
        todo = [0]
        while todo:
            i = todo.pop()
            a, b = low[i], high[i]
            if b - a < 2 or radius[i] <= smallest:
                continue
            half = scale[i] / 2
            while half >= radius[i]:  # levels at which the node would be its own only child
                half /= 2
            own = self.order[a:b]
            points, near = x[own], reach[own]
            picked, nearest = [center[i]], np.zeros(b - a, np.int64)
            while near.max() > half:
                k = int(near.argmax())
                d = distances(points, points[k : k + 1])[:, 0]
                d[k] = 0.0
                closer = d < near
                nearest[closer], near = len(picked), np.where(closer, d, near)
                picked.append(int(own[k]))
            reach[own] = near
            by = np.argsort(nearest, kind="stable")
            self.order[a:b] = own[by]
            ends = a + np.cumsum(np.bincount(nearest, minlength=len(picked)))
            far = np.zeros(len(picked))
            np.maximum.at(far, nearest, near)
            kids[i] = list(range(len(low), len(low) + len(picked)))
            for c, e, r, s in zip(picked, ends.tolist(), far.tolist(), [a, *ends[:-1].tolist()], strict=True):
                todo.append(len(low))
                low.append(s)
                high.append(e)
                center.append(c)
                radius.append(r)
                scale.append(half)
        self.low, self.high, self.center, self.radius, self.scale = (np.array(v) for v in (low, high, center, radius, scale))
        self.kids = {k: np.array(v) for k, v in kids.items()}
        self.single = self.high - self.low == 1

    def children(self, i: int) -> np.ndarray:
        """A leaf stands for itself."""
        return self.kids.get(i, np.array([i]))

    def points(self, i: int) -> np.ndarray:
        return self.order[self.low[i] : self.high[i]]


class Links:
    """What a traversal found: for each point of both trees the weight of the others it links with, and edges of a forest of
    the links; points of b count on from those of a, unless a is b."""

    def __init__(self, a: Tree, b: Tree, weight_a: np.ndarray, weight_b: np.ndarray):
        self.weight, self.same = (weight_a, weight_b), a is b
        self.count = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
        self.offset = 0 if self.same else len(a.x)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.compared = 0

    def block(self, i: np.ndarray, j: np.ndarray, link: np.ndarray, same: bool) -> None:
        """link says which of the points i of a and j of b link; same: both are the points of one node."""
        rows, cols = link.any(1), link.any(0)
        if not rows.any():
            return
        link, i, j = link[np.ix_(rows, cols)], i[rows], j[cols]
        self.count[0][i] += link @ self.weight[1][j]
        if not same:
            self.count[1][j] += self.weight[0][i] @ link
        label = np.arange(len(i))  # of each row the first one that it is joined with
        while True:
            down = np.where(link, label[:, None], len(i)).min(0)
            new = np.where(link, down[None, :], len(i)).min(1)
            if (new == label).all():
                break
            label = new
        self.edges += [(i, i[label]), (j + self.offset, i[down])]

    def forest(self) -> np.ndarray:
        """For each point the first one that it is joined with."""
        u, v = (np.concatenate(x) for x in zip(*self.edges, strict=True)) if self.edges else (np.zeros(0, np.int64),) * 2
        return spread(self.offset + len(self.count[1]), u, v)


def traverse(a: Tree, b: Tree, found: Links, cosine: float, exact) -> None:
    """Every pair of points of a and b with that cosine goes to `found`. Pairs of nodes are taken level by level: those whose
    points are all too far apart go, and what remains between leaves is compared, unless all of it is near enough to link.
    Of a pair the node with the larger radius is expanded, its children at once against all nodes that it still has to meet.
    exact(i, j) settles pairs at the threshold. If a is b, a pair of points counts once."""
    if not len(a.x) or not len(b.x):
        return
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    inner_a, inner_b = (np.isin(np.arange(len(t.low)), list(t.kids)) for t in (a, b))
    zero, wave = np.zeros(1, np.int64), []
    selves = [0] if found.same else []

    def near(mine: np.ndarray, theirs: np.ndarray, same: bool = False, asked=None) -> None:
        for at in range(0, len(mine), SIDE):
            part = mine[at : at + SIDE]
            apart = a.radius[part][:, None] + b.radius[theirs][None, :] + (reach + MARGIN)
            keep = a.x[a.center[part]] @ b.x[b.center[theirs]].T >= 1 - apart * apart / 2 - 1e-12
            if same:
                keep &= np.arange(at, at + len(part))[:, None] < np.arange(len(theirs))[None, :]
            r, s = np.nonzero(keep)
            r, s = part[r], theirs[s]
            if asked:
                ok = asked(r, s)
                r, s = r[ok], s[ok]
            wave.append((r, s))

    def meet(mine: np.ndarray, theirs: np.ndarray, asked=None) -> None:
        """Nodes of a against nodes of b, of those pairs only that `asked` names."""
        one, other = a.single[mine], b.single[theirs]
        p, q = mine[one], theirs[other]
        settle(a, b, a.center[p], b.center[q], found, cosine, exact, False, asked and (lambda r, s: asked(p[r], q[s])))
        near(p, theirs[~other], False, asked)
        near(mine[~one], theirs, False, asked)

    def expand(t: Tree, own: np.ndarray, met: np.ndarray, turn) -> None:
        """Pairs of nodes (own, met), whose own ones belong to t and are expanded. Where most of them meet, all do in one product."""
        nodes, others = np.unique(own), np.unique(met)
        if len(own) * DENSE < len(nodes) * len(others):
            for k, x in grouped(own, met):
                turn(t.kids[k], x, None)
            return
        kids = [t.kids[k] for k in nodes.tolist()]
        parent = np.zeros(len(t.low), np.int64)
        parent[np.concatenate(kids)] = np.repeat(nodes, [len(x) for x in kids])
        known = np.sort(own << 32 | met)

        def asked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            key = parent[x] << 32 | y
            return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key

        turn(np.concatenate(kids), others, asked)

    if not found.same:
        meet(zero, zero)
    while selves or wave:
        todo, wave = wave, []
        todo_selves, selves = selves, []
        for i in todo_selves:
            if not inner_a[i]:
                leaves(a, a, i, i, found, cosine, exact, True)
                continue
            kids = a.kids[i]
            one, more = kids[a.single[kids]], kids[~a.single[kids]]
            settle(a, a, a.center[one], a.center[one], found, cosine, exact, True)
            near(one, more)
            near(more, more, True)
            selves += more.tolist()
        if not todo:
            continue
        i, j = (np.concatenate(x) for x in zip(*todo, strict=True))
        size_a, size_b = np.where(inner_a[i], a.radius[i], -1.0), np.where(inner_b[j], b.radius[j], -1.0)
        last = ~inner_a[i] & ~inner_b[j]
        point, other = last & a.single[i], last & ~a.single[i] & b.single[j]
        for k, own in grouped(j[point], i[point]):
            settle(a, b, a.center[own], b.points(k), found, cosine, exact, False)
        for k, own in grouped(i[other], j[other]):
            settle(a, b, a.points(k), b.center[own], found, cosine, exact, False)
        rest = last & ~point & ~other
        for k, m in zip(i[rest].tolist(), j[rest].tolist(), strict=True):
            leaves(a, b, k, m, found, cosine, exact, False)
        first = ~last & (size_a >= size_b)
        second = ~last & ~first
        if first.any():
            expand(a, i[first], j[first], meet)
        if second.any():
            expand(b, j[second], i[second], lambda kids, x, asked: meet(x, kids, asked and (lambda r, s: asked(s, r))))


def grouped(key: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of each key."""
    if len(key):
        by = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.diff(key[by])) + 1
        yield from zip(key[by[np.append(0, at)]].tolist(), np.split(value[by], at), strict=True)


def heads(t: Tree) -> np.ndarray:
    """Per point, single precision numbers whose products are no less than the cosines, but for rounding: the point's part in
    3/8 of the dimensions, turned at random, and the length of what it has besides."""
    if not hasattr(t, "head"):
        size = t.x.shape[1]
        if size < 32:
            t.head = t.x.astype(np.float32)
        else:
            turned = t.x @ np.linalg.qr(np.random.default_rng(size).normal(size=(size, 3 * size // 8)))[0]
            rest = np.sqrt(np.maximum(0, 1 - (turned * turned).sum(1)))
            t.head = np.column_stack([turned, rest]).astype(np.float32)
    return t.head


def settle(a: Tree, b: Tree, p: np.ndarray, q: np.ndarray, found: Links, cosine: float, exact, same: bool, asked=None) -> None:
    """Links of the points p of a and q of b, of those pairs only that `asked` names. same: they are the same points, and a pair
    counts once. What the heads leave is compared in full."""
    if not len(p) or not len(q):
        return
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    least = min(1 - (reach + MARGIN) ** 2 / 2, cosine - 1e-9)
    mine, theirs, size = heads(a)[p], heads(b)[q], a.x.shape[1]
    rough = np.float32(least - 2e-6 - 2e-7 * mine.shape[1])
    for at in range(0, len(p), SIDE):
        part, low = p[at : at + SIDE], at if same else 0
        others = q[low:]
        may = mine[at : at + SIDE] @ theirs[low:].T >= rough
        if same:
            may[:, : len(part)] &= np.arange(len(part))[:, None] < np.arange(len(part))[None, :]
        r, s = np.nonzero(may)
        if len(r) * 8 < may.size:
            step = max(1, 2_000_000 // size)
            got = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a.x[part[r[k : k + step]]], b.x[others[s[k : k + step]]]) for k in range(0, len(r), step))])
        else:
            got = (a.x[part] @ b.x[others].T)[r, s]
        ok = got >= least
        r, s, got = r[ok], s[ok], got[ok]
        if asked and len(r):
            ok = asked(at + r, low + s)
            r, s, got = r[ok], s[ok], got[ok]
        found.compared += len(r)
        link, edge = got >= cosine, np.abs(got - cosine) < 1e-9
        if edge.any():
            link[edge] = exact(part[r[edge]], others[s[edge]]) >= cosine
        if link.any():
            (rows, r), (cols, s) = np.unique(r[link], return_inverse=True), np.unique(s[link], return_inverse=True)
            block = np.zeros((len(rows), len(cols)), bool)
            block[r, s] = True
            found.block(part[rows], others[cols], block, False)


def leaves(a: Tree, b: Tree, i: int, j: int, found: Links, cosine: float, exact, same: bool) -> None:
    p, q = a.points(i), b.points(j)
    if same and len(p) == 1:
        return
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    if distances(a.x[a.center[[i]]], b.x[b.center[[j]]])[0, 0] + a.radius[i] + b.radius[j] <= reach - MARGIN:
        found.block(p, q, ~np.eye(len(p), dtype=bool) if same else np.ones((len(p), len(q)), bool), same)
    else:
        settle(a, b, p, q, found, cosine, exact, same)


def spread(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one reachable over the edges (u, v)."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
