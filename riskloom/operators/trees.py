"""Scores of fitted boosted trees from flat tables, without feature vectors.

A model is exported once. Each tree numbers its leaves from left to right and keeps, for each
feature that it asks about, a table of bit sets: the leaves that a value leaves possible, by the
number of thresholds below the value. The sets of a tree's features are intersected, and the first
leaf left is the one that the row falls into. So a tree costs a lookup for each of its features,
whatever its depth, on whole Arrow batches.

The export is as large as the model: at most a few thousand nodes a tree, never the data.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column
from pyspark.sql import functions as F

TREE = re.compile(r"Tree \d+ \(weight (\S+)\):")
SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")
WORD = 64


class Tree(NamedTuple):
    """splits: feature, threshold, and the leaves [first, end) to the left of each split; values:
    what each leaf adds to the margin."""

    splits: list[tuple[int, float, int, int]]
    values: list[float]


class Forest(NamedTuple):
    width: int
    trees: list[Tree]


def exported(model: PipelineModel) -> Forest:
    """The trees of a pipeline whose last stage is a fitted ensemble. Splits on categories have no
    thresholds: a ValueError. If its first stage makes bins, splits are told in what goes into them."""
    fitted = model.stages[-1]
    cuts = model.stages[0].getSplitsArray() if isinstance(model.stages[0], Bucketizer) else None
    trees: list[Tree] = []
    waiting: list[list] = []  # splits whose right side is still to come
    weight = 1.0
    for line in map(str.strip, fitted.toDebugString.splitlines()[1:]):
        if found := TREE.match(line):
            weight = float(found[1])
            trees.append(Tree([], []))
        elif found := SPLIT.match(line):
            feature, at = int(found[1]), float(found[2])
            waiting.append([feature, _below(cuts[feature], at) if cuts else at, len(trees[-1].values)])
        elif line.startswith("Else"):
            trees[-1].splits.append((*waiting.pop(), len(trees[-1].values)))
        elif line.startswith("Predict:"):
            trees[-1].values.append(weight * float(line.split()[-1]))
        elif line:
            raise ValueError(f"no threshold: {line}")
    return Forest(fitted.numFeatures, trees)


def _below(cuts: list[float], at: float) -> float:
    """The last value in the bins up to at; a bin ends before the cut that begins the next."""
    end = cuts[min(math.floor(at) + 1, len(cuts) - 1)]
    return end if math.isinf(end) else math.nextafter(end, -math.inf)


class _Tables:
    """Bit sets of a forest, built once in a task."""

    def __init__(self, forest: Forest):
        found: dict[int, set[float]] = {}
        for tree in forest.trees:
            for f, at, _, _ in tree.splits:
                found.setdefault(f, set()).add(at)
        self.cuts = {f: np.array(sorted(v)) for f, v in found.items()}
        self.trees = [self._sets(t) for t in forest.trees]

    def _sets(self, tree: Tree) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        words = -(-len(tree.values) // WORD)
        sets: dict[int, np.ndarray] = {}
        for f, at, first, end in tree.splits:
            gone = ((1 << end) - (1 << first)) ^ ((1 << words * WORD) - 1)
            kept = np.frombuffer(gone.to_bytes(words * WORD // 8, "little"), "<u8")
            table = sets.setdefault(f, np.full((words, len(self.cuts[f]) + 1), np.iinfo(np.uint64).max, np.uint64))
            table[:, np.searchsorted(self.cuts[f], at) + 1 :] &= kept[:, None]
        return np.array(tree.values), list(sets.items())

    def margins(self, columns: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(columns[0]))
        codes = {f: np.searchsorted(cuts, columns[f]) for f, cuts in self.cuts.items()}  # NaN is above all
        for values, sets in self.trees:
            if not sets:
                total += values[0]
                continue
            leaf = np.full(len(total), -1)
            for word in range(-(-len(values) // WORD)):
                left = sets[0][1][word].take(codes[sets[0][0]])
                for f, table in sets[1:]:
                    left &= table[word].take(codes[f])
                place = np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1)).astype(np.int64) + word * WORD
                leaf = place if len(values) <= WORD else np.where((leaf < 0) & (left != 0), place, leaf)
            total += values.take(leaf)
        return total


def margin(forest: Forest, features: list[str]) -> Column:
    """Weighted sum of the trees over the columns, in the order in which the model was fitted. NULL
    is taken as NaN, which goes right at every split, as Spark's own scoring has it."""
    if len(features) != forest.width:
        raise ValueError(f"the model has {forest.width} features, not {len(features)}")

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        tables = _Tables(forest)
        for batch in batches:
            yield pa.array(tables.margins([c.to_numpy(zero_copy_only=False) for c in batch]))

    return score(*(F.col(c).cast("double") for c in features))


def probability(margin: Column) -> Column:
    """Of the positive class, as the logistic loss of boosted trees has it."""
    return 1 / (1 + F.exp(-2 * margin))
