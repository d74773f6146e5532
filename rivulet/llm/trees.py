"""Reading decision trees learnt by Spark into plain tuples."""

from __future__ import annotations

import numpy as np


def export(model) -> tuple:
    """A tree model's root: (feature, threshold, left, right) or (value,)."""

    def node(n):
        if n.getClass().getSimpleName() == "LeafNode":
            return (float(n.prediction()),)
        s = n.split()
        return int(s.featureIndex()), float(s.threshold()), node(n.leftChild()), node(n.rightChild())

    return node(model._call_java("rootNode"))


def evaluate(tree: tuple, rows: np.ndarray) -> np.ndarray:
    """The tree's value for each row of a feature matrix."""
    out = np.empty(len(rows))
    todo = [(tree, np.arange(len(rows)))]
    while todo:
        t, at = todo.pop()
        if len(t) == 1:
            out[at] = t[0]
        else:
            low = rows[at, t[0]] <= t[1]
            todo += [(t[2], at[low]), (t[3], at[~low])]
    return out
