"""Annealers over labellings and memberships, matching, water-filling, bisection, bootstrap, polygon clipping."""

from __future__ import annotations

import numpy as np


def assignment(cost: np.ndarray) -> np.ndarray:
    """Columns of a minimum-cost one-to-one matching of a square matrix (shortest augmenting paths with potentials)."""
    n = len(cost)
    u, v, row_of = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, n)
    for r in range(n):
        row_of[n], at = r, n
        low, back, used = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[at] != n or at == n:
            used[at] = True
            i = row_of[at]
            free = ~used[:n]
            gain = cost[i] - u[i] - v[:n]
            better = free & (gain < low)
            low[better], back[better] = gain[better], at
            to = int(np.where(free, low, np.inf).argmin())
            d = low[to]
            u[row_of[used]] += d
            v[used] -= d
            low[free] -= d
            at = to
        while at != n:
            row_of[at] = row_of[back[at]]
            at = back[at]
    out = np.zeros(n, int)
    out[row_of[:n]] = np.arange(n)
    return out


def transfer_distance(table: np.ndarray) -> int:
    """Nodes that have to change their label, at best, to turn one labelling into the other; table: contingency counts."""
    k = max(table.shape)
    square = np.zeros((k, k))
    square[: table.shape[0], : table.shape[1]] = table
    return int(table.sum() - square[np.arange(k), assignment(-square)].sum())


def connected_without(labels: np.ndarray, node: int, near: list[np.ndarray]) -> bool:
    """Whether the node's zone stays in one piece without it."""
    inside = [j for j in near[node] if labels[j] == labels[node]]
    if len(inside) < 2:
        return len(inside) == 1
    seen, todo, goal = {node, inside[0]}, [inside[0]], set(inside[1:])
    while todo and goal:
        for j in near[todo.pop()]:
            if labels[j] == labels[node] and j not in seen:
                seen.add(j)
                goal.discard(j)
                todo.append(j)
    return not goal


def energy(w: np.ndarray, labels: np.ndarray, load: np.ndarray, k: int, floor: float, balance: float, anchor=None, rigid: float = 0.0) -> float:
    """- sum of weights inside zones, + squared shortfalls of zone shares below the floor, + capacity moved away from an anchor labelling."""
    same = labels[:, None] == labels[None, :]
    share = np.bincount(labels, weights=load, minlength=k) / load.sum()
    out = -(w * same).sum() / 2 + balance * (np.maximum(floor - share, 0) ** 2).sum() / floor**2
    if anchor is not None and rigid:
        differ = same != (anchor[:, None] == anchor[None, :])
        out += rigid * (load[:, None] * differ).sum() / (load.sum() * (len(labels) - 1))
    return float(out)


class Labelling:
    """Labels with the sums that make the energy change of a move cheap: loads by zone, and loads and nodes by zone and anchor zone."""

    def __init__(self, w, labels, load, k: int, floor: float, balance: float, anchor, rigid: float):
        self.w, self.labels, self.load, self.k = w, labels.copy(), load / load.sum(), k
        self.floor, self.balance = floor or 1e-9, balance
        self.near = [np.flatnonzero(row) for row in w]
        self.share = np.bincount(labels, weights=self.load, minlength=k)
        self.count = np.bincount(labels, minlength=k)
        self.anchor = anchor if anchor is not None and rigid else None
        self.rigid = rigid / max(1, len(labels) - 1)
        if self.anchor is not None:
            self.nodes, self.loads = np.zeros((k, anchor.max() + 1)), np.zeros((k, anchor.max() + 1))
            np.add.at(self.nodes, (labels, anchor), 1)
            np.add.at(self.loads, (labels, anchor), self.load)

    def _pull(self, i: int, zone: int) -> float:
        """What the zone's pairs with node i weigh against the anchor: those it shares a zone of the anchor with, less the others."""
        a = self.anchor[i]
        return self.load[i] * (2 * self.nodes[zone, a] - self.nodes[zone].sum()) + 2 * self.loads[zone, a] - self.loads[zone].sum()

    def move(self, i: int, to: int) -> float:
        """Moves node i; the change of energy."""
        at, j = self.labels[i], self.near[i]
        if at == to:
            return 0.0
        own = self.labels[j]
        out = self.w[i, j] @ ((own == at) & (j != i)) - self.w[i, j] @ (own == to)
        before, after = self.share[[at, to]], self.share[[at, to]] + np.array([-self.load[i], self.load[i]])
        short = lambda x: (np.maximum(self.floor - x, 0) ** 2).sum()
        out += self.balance * (short(after) - short(before)) / self.floor**2
        self.labels[i], self.share[[at, to]] = to, after
        self.count[at] -= 1
        self.count[to] += 1
        if self.anchor is not None:
            self.nodes[at, self.anchor[i]] -= 1
            self.loads[at, self.anchor[i]] -= self.load[i]
            out += self.rigid * (self._pull(i, at) - self._pull(i, to))
            self.nodes[to, self.anchor[i]] += 1
            self.loads[to, self.anchor[i]] += self.load[i]
        return float(out)

    def fragment(self, i: int, size: int) -> list[int]:
        """Node i and nodes of its zone next to it, up to size, nearest first."""
        out, seen = [i], {i}
        for x in out:
            for j in self.near[x].tolist():
                if len(out) < size and j not in seen and self.labels[j] == self.labels[i]:
                    seen.add(j)
                    out.append(j)
        return out

    def whole(self, zone: int) -> bool:
        """Whether the zone is one piece (an empty one is not)."""
        inside = np.flatnonzero(self.labels == zone)
        return len(inside) > 0 and len(self.fragment(int(inside[0]), len(inside))) == len(inside)


def anneal(w: np.ndarray, labels: np.ndarray, load: np.ndarray, k: int, seed: int, sweeps: int = 60, hot: float = 1.0, cold: float = 0.01, floor: float = 0.0, balance: float = 0.0, anchor=None, rigid: float = 0.0, frames: bool = False, block: int = 6):
    """(labels, energy, frames): moves of boundary nodes, and in every sweep of some fragments of up to ``block`` nodes, to a neighbouring zone,
    each zone kept in one piece; geometric cooling, then a quench. A move costs what its node's neighbours and two zones cost, not
    the network. The best labelling seen is returned."""
    rng, n = np.random.default_rng(seed), len(labels)
    now = best = energy(w, labels, load, k, floor or 1e-9, balance, anchor, rigid)
    state, out, shots = Labelling(w, labels, load, k, floor, balance, anchor, rigid), labels.copy(), []
    for sweep in range(sweeps + 10):
        temperature = hot * (cold / hot) ** (sweep / max(1, sweeps - 1)) if sweep < sweeps else 0.0
        singles = [(int(i), 1) for i in rng.permutation(n)]
        fragments = [(int(i), int(rng.integers(2, block + 1))) for i in rng.integers(n, size=n // 10)] if block > 1 else []
        for i, size in singles + fragments:
            old = int(state.labels[i])
            zones = np.unique(state.labels[state.near[i]])
            zones = zones[zones != old]
            if not len(zones) or state.count[old] < size + 1 or (size == 1 and not connected_without(state.labels, i, state.near)):
                continue
            to, nodes = int(rng.choice(zones)), state.fragment(i, size)
            change = sum(state.move(x, to) for x in nodes)
            fits = size == 1 or state.whole(old)
            if fits and (change <= 0 or (temperature > 0 and rng.random() < np.exp(-change / temperature))):
                now += change
                if now < best - 1e-9:
                    best, out = now, state.labels.copy()
            else:
                for x in reversed(nodes):
                    state.move(x, old)
        if frames:
            shots.append(state.labels.tolist())
    return out, best, shots


def anneal_membership(h, m: np.ndarray, seed: int, steps: int, hot: float, cold: float, start: int = 0, state: dict | None = None):
    """(membership, energy, state): flips and moves in a 0/1 matrix (groups may overlap) under a black-box energy h. The state holds
    the generator and the current matrix: a run that goes on from it equals one that was not interrupted."""
    rng = np.random.default_rng(seed)
    m = m.copy()
    if state:
        rng.bit_generator.state = state["rng"]
        m = np.array(state["m"])
    now = h(m)
    best, out = (now, m.copy()) if not state else (state["best"], np.array(state["out"]))
    for k in range(start, steps):
        t = hot * (cold / hot) ** (k / max(1, steps - 1))
        new = m.copy()
        i = rng.integers(len(m))
        if rng.random() < 0.5 or not m[i].any():
            j = rng.integers(m.shape[1])
            new[i, j] = 1 - new[i, j]
        else:
            a, b = rng.choice(np.flatnonzero(m[i])), rng.integers(m.shape[1])
            new[i, a], new[i, b] = 0, 1
        e = h(new)
        if e <= now or rng.random() < np.exp((now - e) / t):
            m, now = new, e
            if now < best:
                best, out = now, m.copy()
    return out, best, {"rng": rng.bit_generator.state, "m": m.tolist(), "best": best, "out": out.tolist()}


def relieve(flow: np.ndarray, limit: np.ndarray, sensitivity: np.ndarray, member: np.ndarray, available: np.ndarray, actions: int = 24, tol: float = 1e-6) -> dict:
    """Greedy relief of one snapshot. The worst overload picks the group that clears it with the least power; the group's nodes are cut
    pro rata; stops when nothing is over, nothing helps, or after ``actions``. sensitivity: state x node, flow per unit of power."""
    flow, left = flow.astype(float).copy(), available.astype(float).copy()
    cut = np.zeros(len(left))
    for _ in range(actions):
        over = np.abs(flow) - limit
        s = int(over.argmax())
        if over[s] <= tol:
            break
        need, choice = np.inf, None
        for g in range(member.shape[1]):
            room = left * member[:, g]
            if room.sum() <= tol:
                continue
            effect = float(np.sign(flow[s]) * (sensitivity[s] @ room)) / room.sum()
            if effect > tol and (mw := min(over[s] / effect, room.sum())) < need:
                need, choice = mw, room / room.sum()
        if choice is None:
            break
        step = need * choice
        cut, left = cut + step, left - step
        flow = flow - sensitivity @ step
    return {"cut": float(cut.sum()), "by_node": cut, "worst": float((np.abs(flow) - limit).max())}


def water_fill(total: float, cap: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Shares by weight, none above its cap, what is left shared again; exact by sorted breakpoints."""
    total = min(total, float(cap.sum()))
    ratio = np.where(weight > 0, cap / np.maximum(weight, 1e-300), np.inf)
    order = np.argsort(ratio, kind="stable")
    rest, w = total, weight.sum()
    level = 0.0
    for i in order:
        level = rest / w if w > 0 else 0.0
        if level <= ratio[i]:
            break
        rest, w = rest - cap[i], w - weight[i]
    return np.minimum(cap, level * weight)


def bisect(f, goal: float, low: float, high: float, rounds: int = 40) -> tuple[float, bool]:
    """(x, clipped) with f increasing and f(x) = goal; at a bound if the goal lies outside."""
    if f(low) >= goal:
        return low, True
    if f(high) <= goal:
        return high, True
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < goal else (low, mid)
    return (low + high) / 2, False


def block_bootstrap(num: np.ndarray, den: np.ndarray, n: int, seed: int, levels=(2.5, 97.5)) -> tuple[float, float, float]:
    """Ratio of sums and its percentile interval, by resampling blocks (weeks) that are already summed."""
    rng = np.random.default_rng(seed)
    pick = rng.integers(len(num), size=(n, len(num)))
    d = den[pick].sum(axis=1)
    ratios = num[pick].sum(axis=1) / np.where(d == 0, np.nan, d)
    low, high = np.nanpercentile(ratios, levels)
    return float(num.sum() / den.sum()), float(low), float(high)


def mid_ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def spearman_bootstrap(x: np.ndarray, y: np.ndarray, n: int, seed: int, least: int = 30) -> tuple[float, float, float]:
    """Rank correlation with a percentile interval; the interval is nan below ``least`` pairs."""
    rho = lambda a, b: float(np.corrcoef(mid_ranks(a), mid_ranks(b))[0, 1])
    if len(x) < least:
        return rho(x, y), np.nan, np.nan
    rng = np.random.default_rng(seed)
    found = [rho(x[i], y[i]) for i in (rng.integers(len(x), size=len(x)) for _ in range(n))]
    return rho(x, y), *map(float, np.nanpercentile(found, (2.5, 97.5)))


def clip_polygon(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Intersection of a polygon with a convex polygon given counter-clockwise."""
    out = [tuple(p) for p in subject]
    for a, b in zip(clip, np.roll(clip, -1, axis=0), strict=True):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: E731, B023
        points, out = out, []
        for p, q in zip(points, points[1:] + points[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                out.append((p[0] + (q[0] - p[0]) * sp / (sp - sq), p[1] + (q[1] - p[1]) * sp / (sp - sq)))
        if not out:
            break
    return np.array(out).reshape(-1, 2)


def area(polygon: np.ndarray) -> float:
    x, y = polygon[:, 0], polygon[:, 1]
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)
