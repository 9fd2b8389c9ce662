"""A fitted boosted-tree model as plain expressions (M2).

A gradient-boosted classifier is a weighted sum of trees, and a tree is nested conditions.
:func:`from_pipeline` takes them out of a fitted pipeline; :class:`Trees` writes them as a
``Column``, which runs in generated code next to the features with no model object on the
executors, or as SQL text, so any engine that has the features gives the same
probabilities. A model is stored as one small JSON file.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from importlib import resources

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a leaf is its prediction; an inner node is [feature, threshold, node if <= threshold, node if above]
Node = float | list

STORED = "churn_trees.json"


@dataclass(frozen=True)
class Trees:
    """``features`` in the order that nodes number them, and (weight, root) of each tree."""

    features: tuple[str, ...]
    trees: tuple[tuple[float, Node], ...]

    def column(self, value: Callable[[str], Column] = F.col) -> Column:
        """Probability of class 1; ``value`` gives a feature as a double that isn't null."""

        def tree(node: Node) -> Column:
            if not isinstance(node, list):
                return F.lit(float(node))
            feature, threshold, left, right = node
            return F.when(value(self.features[feature]) <= F.lit(float(threshold)), tree(left)).otherwise(tree(right))

        margin = F.lit(0.0)
        for weight, root in self.trees:
            margin = margin + F.lit(float(weight)) * tree(root)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))

    def sql(self, value: Callable[[str], str] = str) -> str:
        """The same as an SQL expression; ``value`` gives a feature as SQL."""
        number = lambda x: f"CAST('{float(x)!r}' AS DOUBLE)"

        def tree(node: Node) -> str:
            if not isinstance(node, list):
                return number(node)
            feature, threshold, left, right = node
            return f"CASE WHEN {value(self.features[feature])} <= {number(threshold)} THEN {tree(left)} ELSE {tree(right)} END"

        margin = " + ".join([number(0), *(f"{number(weight)} * {tree(root)}" for weight, root in self.trees)])
        return f"{number(1)} / ({number(1)} + exp({number(-2)} * ({margin})))"

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "trees": self.trees}, separators=(",", ":")) + "\n"

    @staticmethod
    def from_json(text: str) -> Trees:
        spec = json.loads(text)
        return Trees(tuple(spec["features"]), tuple((weight, root) for weight, root in spec["trees"]))


def from_pipeline(model: PipelineModel, features: Sequence[str]) -> Trees:
    """The trees of a pipeline that ends in a boosted-tree classifier over ``features``, all of
    them numbers (a pipeline that hashes categories has no names for its features)."""
    classifier = model.stages[-1]
    if classifier.numFeatures != len(features):
        raise ValueError(f"the model has {classifier.numFeatures} features, not {len(features)}")

    def node(at) -> Node:  # noqa: ANN001 - a node of the JVM's tree
        if at.subtreeDepth() == 0:
            return at.prediction()
        split = at.split()
        return [split.featureIndex(), split.threshold(), node(at.leftChild()), node(at.rightChild())]

    roots = [tree._call_java("rootNode") for tree in classifier.trees]
    return Trees(tuple(features), tuple((weight, node(root)) for weight, root in zip(classifier.treeWeights, roots)))


def stored() -> Trees:
    """The model that comes with the library."""
    return Trees.from_json(resources.files("retenta.models").joinpath(STORED).read_text())


def scorer(model: Trees) -> Callable[[DataFrame], DataFrame]:
    """Adds ``proba``. Null and what is no number count as 0, as when the model was trained."""
    value = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return lambda df: df.withColumn("proba", model.column(value))
