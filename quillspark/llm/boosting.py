"""Gradient-boosted trees small enough to be written out as a column expression."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = float | tuple[int, int, "Tree", "Tree"]  #: a leaf, or (feature, last value that goes left, left, right)


@dataclass
class Boosted:
    start: float
    trees: list[Tree]
    #: Platt scaling of the summed score: probability = 1 / (1 + exp(-(a * score + b))).
    scale: tuple[float, float]

    def score(self, x: tuple[int, ...]) -> float:
        total = self.start
        for t in self.trees:
            while isinstance(t, tuple):
                t = t[2] if x[t[0]] <= t[1] else t[3]
            total += t
        return total

    def probability(self, x: tuple[int, ...]) -> float:
        a, b = self.scale
        return _sigmoid(a * self.score(x) + b)

    def expression(self, features: list[Column]) -> Column:
        """The probability as a column of integer feature columns."""

        def of(t: Tree) -> Column:
            return F.when(features[t[0]] <= t[1], of(t[2])).otherwise(of(t[3])) if isinstance(t, tuple) else F.lit(float(t))

        total = F.lit(float(self.start))
        for t in self.trees:
            total = total + of(t)
        a, b = self.scale
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * total + F.lit(b))))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _tree(rows: list[int], x: list[tuple[int, ...]], g: list[float], h: list[float], depth: int, rate: float) -> Tree:
    """Newton steps: the split with the largest gain at each node, leaves shrunk by ``rate``; ties go to the first feature and value."""
    G, H = sum(g[i] for i in rows), sum(h[i] for i in rows)
    leaf = rate * G / (H + 1.0)
    if depth == 0 or len(rows) < 8:
        return leaf
    best = (1e-6, None)
    for f in range(len(x[0])):
        by: dict[int, list[float]] = {}
        for i in rows:
            s = by.setdefault(x[i][f], [0.0, 0.0])
            s[0] += g[i]
            s[1] += h[i]
        gl = hl = 0.0
        for v in sorted(by)[:-1]:
            gl += by[v][0]
            hl += by[v][1]
            gain = gl * gl / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G * G / (H + 1)
            if gain > best[0]:
                best = (gain, (f, v))
    if best[1] is None:
        return leaf
    f, v = best[1]
    left, right = [i for i in rows if x[i][f] <= v], [i for i in rows if x[i][f] > v]
    return f, v, _tree(left, x, g, h, depth - 1, rate), _tree(right, x, g, h, depth - 1, rate)


def fit(x: list[tuple[int, ...]], y: list[int], trees: int = 24, depth: int = 3, rate: float = 0.3) -> Boosted:
    """Logistic boosting on two thirds of the rows; the last third calibrates the score."""
    learn, check = [i for i in range(len(x)) if i % 3 != 2], [i for i in range(len(x)) if i % 3 == 2]
    share = min(max(sum(y[i] for i in learn) / max(1, len(learn)), 0.01), 0.99)
    model = Boosted(math.log(share / (1 - share)), [], (1.0, 0.0))
    score = [model.start] * len(x)
    for _ in range(trees):
        p = [_sigmoid(s) for s in score]
        t = _tree(learn, x, [yi - pi for yi, pi in zip(y, p, strict=True)], [pi * (1 - pi) for pi in p], depth, rate)
        model.trees.append(t)
        one = Boosted(0.0, [t], (1.0, 0.0))
        score = [s + one.score(r) for s, r in zip(score, x, strict=True)]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt scaling with smoothed targets, by gradient steps
        ga = gb = 0.0
        n = max(1, len(check))
        for i in check:
            d = (0.98 if y[i] else 0.02) - _sigmoid(a * score[i] + b)
            ga += d * score[i] / n
            gb += d / n
        a, b = a + 0.2 * ga, b + 0.2 * gb
    model.scale = (max(a, 0.05), b)
    return model


def threshold(model: Boosted, x: list[tuple[int, ...]], y: list[int], precision: float) -> float:
    """The least calibrated probability at and above which at least ``precision`` of the rows are true; above 1 if none is."""
    scored = sorted(((model.probability(r), t) for r, t in zip(x, y, strict=True)), reverse=True)
    true = taken = 0
    least = 1.01
    for k, (p, t) in enumerate(scored):
        true, taken = true + t, taken + 1
        if true >= precision * taken and (k + 1 == len(scored) or scored[k + 1][0] < p):
            least = p
    return least
