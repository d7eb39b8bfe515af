"""Decision forests as node tables, compiled to Column expressions.

A node row is (tree, node, feature, kind, threshold, categories, default_positive, class_counts, mean, count);
``node`` is the path from the root: ``r``, ``r+``, ``r-+`` ...  A numeric decision is positive if value >= threshold, a
categorical one if the category is among ``categories``; a missing or unknown value takes the default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.vectors import scale

NODE_SCHEMA = "tree int, node string, feature int, kind string, threshold double, categories array<int>, default_positive boolean, class_counts array<double>, mean double, count int"


@dataclass
class Node:
    """A leaf has class counts or a mean; any other node a decision and two children."""

    path: str = "r"
    feature: int | None = None
    threshold: float | None = None
    categories: list[int] | None = None
    default_positive: bool = False
    positive: Node | None = None
    negative: Node | None = None
    class_counts: list[float] | None = None
    mean: float | None = None
    count: int = 0

    @property
    def leaf(self) -> bool:
        return self.positive is None


@dataclass
class Forest:
    trees: list[Node]
    weights: list[float] = field(default_factory=list)
    importances: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.weights = self.weights or [1.0] * len(self.trees)
        for tree in self.trees:
            _number(tree, "r")


def _number(node: Node, path: str) -> None:
    node.path = path
    if not node.leaf:
        _number(node.positive, path + "+")
        _number(node.negative, path + "-")


def nodes_of(tree: Node) -> list[Node]:
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        out.append(node)
        if not node.leaf:
            todo += [node.positive, node.negative]
    return out


def find(tree: Node, path: str) -> Node:
    """The node of a path; KeyError if there is none."""
    node = tree
    for step in path[1:]:
        if node.leaf:
            raise KeyError(path)
        node = node.positive if step == "+" else node.negative
    if node.path != path:
        raise KeyError(path)
    return node


def to_table(spark: SparkSession, forest: Forest) -> DataFrame:
    rows = [(t, n.path, n.feature, None if n.leaf else "numeric" if n.threshold is not None else "categorical", n.threshold, n.categories, n.default_positive, n.class_counts, n.mean, n.count) for t, tree in enumerate(forest.trees) for n in nodes_of(tree)]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def from_table(table: DataFrame, weights: list[float] | None = None, importances: list[float] | None = None) -> Forest:
    """A forest's nodes are a model, small enough for the driver.  A missing count is 0."""
    by: dict[tuple[int, str], Node] = {}
    rows = sorted(table.collect(), key=lambda r: (r.tree, len(r.node)))
    for r in rows:
        by[r.tree, r.node] = Node(r.node, r.feature, r.threshold, r.categories, bool(r.default_positive), None, None, r.class_counts, r.mean, r["count"] or 0)
    for (tree, path), node in by.items():
        if path != "r":
            setattr(by[tree, path[:-1]], "positive" if path[-1] == "+" else "negative", node)
    return Forest([by[t, "r"] for t in sorted({r.tree for r in rows})], weights or [], importances or [])


def decision(node: Node, features: list[Column]) -> Column:
    value = features[node.feature]
    test = value.cast("double") >= node.threshold if node.threshold is not None else value.isin(*node.categories) if node.categories else F.lit(False)
    return F.coalesce(test, F.lit(node.default_positive))


def leaf_path(tree: Node, features: list[Column]) -> Column:
    """The path of the leaf that a row reaches."""
    if tree.leaf:
        return F.lit(tree.path)
    return F.when(decision(tree, features), leaf_path(tree.positive, features)).otherwise(leaf_path(tree.negative, features))


def _leaf_value(tree: Node, features: list[Column], value) -> Column:
    if tree.leaf:
        return value(tree)
    return F.when(decision(tree, features), _leaf_value(tree.positive, features, value)).otherwise(_leaf_value(tree.negative, features, value))


def probabilities(counts: list[float]) -> list[float]:
    total = sum(counts)
    return [c / total if total else 0.0 for c in counts]


def distribution(forest: Forest, features: list[Column]) -> Column:
    """Class probabilities: the weighted mean of the reached leaves' shares."""
    total = sum(forest.weights)
    each = [(w / total, _leaf_value(t, features, lambda n: F.array(*[F.lit(p) for p in probabilities(n.class_counts)]))) for w, t in zip(forest.weights, forest.trees, strict=True)]
    out = None
    for w, p in each:
        part = scale(p, F.lit(w))
        out = part if out is None else F.zip_with(out, part, lambda a, b: a + b)
    return out


def classify(forest: Forest, features: list[Column]) -> Column:
    """The most probable class, the lowest of equals."""
    p = distribution(forest, features)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def regress(forest: Forest, features: list[Column], truncate: bool = False) -> Column:
    """Weighted mean of the reached leaves' means.  ``truncate``: leaves cut to whole numbers, a known quirk."""
    total = sum(forest.weights)
    out = None
    for w, t in zip(forest.weights, forest.trees, strict=True):
        part = _leaf_value(t, features, lambda n: F.lit(float(int(n.mean) if truncate else n.mean))) * F.lit(w)
        out = part if out is None else out + part
    return out / F.lit(total)


def paths(forest: Forest, features: list[Column]) -> Column:
    """(tree, leaf) of each tree."""
    return F.array(*[F.struct(F.lit(k).alias("tree"), leaf_path(t, features).alias("node")) for k, t in enumerate(forest.trees)])


def node_counts(rows: DataFrame, forest: Forest, features: list[Column]) -> DataFrame:
    """tree, node, count of rows that pass each node, leaves included.

    Rows are counted by leaf first; only then are leaves unfolded to the nodes on their way.
    """
    leaves = rows.select(F.explode(paths(forest, features)).alias("x")).groupBy("x.tree", "x.node").agg(F.count(F.lit(1)).alias("n"))
    above = leaves.select("tree", "n", "node", F.explode(F.sequence(F.lit(1), F.length("node"))).alias("k"))
    return above.groupBy("tree", F.expr("substring(node, 1, k)").alias("node")).agg(F.sum("n").alias("count"))


def importances(rows: DataFrame, forest: Forest, features: list[Column], n_features: int) -> DataFrame:
    """feature, importance: the share of all decisions that test it; 0 for those never tested."""
    spark = rows.sparkSession
    counts = node_counts(rows, forest, features)
    tests = spark.createDataFrame([(k, n.path, n.feature) for k, t in enumerate(forest.trees) for n in nodes_of(t) if not n.leaf], "tree int, node string, feature int")
    each = counts.join(F.broadcast(tests), ["tree", "node"]).groupBy("feature").agg(F.sum("count").alias("n"))
    total = each.agg(F.sum("n").alias("total"))
    return spark.range(n_features).select(F.col("id").cast("int").alias("feature")).join(each, "feature", "left").crossJoin(F.broadcast(total)).select("feature", F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("importance"))


def class_updates(rows: DataFrame, forest: Forest, features: list[Column], target: str) -> DataFrame:
    """tree, node, counts (map of class to count): what a micro-batch adds to leaves."""
    each = rows.where(F.col(target).isNotNull()).select(F.explode(paths(forest, features)).alias("x"), F.col(target).cast("int").alias("y"))
    by = each.groupBy("x.tree", "x.node", "y").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("tree", "node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("y", "n")))).alias("counts"))


def mean_updates(rows: DataFrame, forest: Forest, features: list[Column], target: str) -> DataFrame:
    """tree, node, mean, count of a micro-batch's targets by leaf."""
    each = rows.where(F.col(target).isNotNull()).select(F.explode(paths(forest, features)).alias("x"), F.col(target).cast("double").alias("y"))
    return each.groupBy("x.tree", "x.node").agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("count"))


def updated(forest: Forest, updates: list) -> Forest:
    """The forest after leaf updates (rows of class_updates or mean_updates)."""
    for u in updates:
        leaf = find(forest.trees[u["tree"]], u["node"])
        if leaf.class_counts is not None:
            for y, n in u["counts"].items():
                leaf.class_counts[int(y)] += n
        else:
            n = leaf.count + u["count"]
            leaf.mean, leaf.count = leaf.mean + u["count"] / n * (u["mean"] - leaf.mean), n
    return forest


def accuracy(rows: DataFrame, predicted: str, target: str) -> DataFrame:
    return rows.agg(F.coalesce(F.avg((F.col(predicted) == F.col(target)).cast("double")), F.lit(0.0)).alias("accuracy"))


def rmse(rows: DataFrame, predicted: str, target: str) -> DataFrame:
    return rows.agg(F.sqrt(F.avg(F.pow(F.col(predicted) - F.col(target), 2))).alias("rmse"))


def train(rows: DataFrame, features: list[str], target: str, *, classes: int | None, categories: dict[int, int] | None = None, trees: int = 20, depth: int = 8, bins: int = 100, impurity: str | None = None, seed: int = 1) -> Forest:
    """Fit a forest and carry it over to nodes.  ``classes``: number of target encodings, None for regression.

    ``categories``: number of encodings of categorical features by index.  The default child is the one that more
    training rows reach; of equals the negative one.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    table = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("label")).where("label is not null"))
    if categories:
        from pyspark.sql import types as T

        attrs = {"nominal": [{"idx": i, "name": features[i], "vals": [str(v) for v in range(n)]} for i, n in categories.items()], "numeric": [{"idx": i, "name": f} for i, f in enumerate(features) if i not in categories]}
        table = table.withColumn("features", F.col("features").alias("features", metadata={"ml_attr": {"attrs": attrs, "num_attrs": len(features)}}))
        assert isinstance(table.schema["features"], T.StructField)
    kind = RandomForestClassifier if classes else RandomForestRegressor
    most = max([2, *(categories or {}).values()])
    model = kind(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, maxBins=max(bins, most), impurity=impurity or ("entropy" if classes else "variance"), seed=seed).fit(table)
    out = []
    for tree in model.trees:
        out.append(_carried(tree._java_obj.rootNode(), classes))
    forest = Forest(out)
    seen = importances(rows, forest, [F.col(f) for f in features], len(features)).orderBy("feature").collect()
    forest.importances = [r.importance for r in seen]
    return forest


def _carried(j, classes: int | None) -> Node:
    stats = j.impurityStats()
    if j.getClass().getSimpleName() == "LeafNode":
        n = int(stats.count())
        return Node(class_counts=[float(v) for v in stats.stats()] if classes else None, mean=None if classes else float(j.prediction()), count=n)
    split, left, right = j.split(), _carried(j.leftChild(), classes), _carried(j.rightChild(), classes)
    default = right.count > left.count
    count = left.count + right.count
    if split.getClass().getSimpleName() == "ContinuousSplit":
        import math

        # Left is value <= threshold, so the positive (right) child begins at the next double.
        return Node(feature=split.featureIndex(), threshold=math.nextafter(split.threshold(), math.inf), default_positive=default, positive=right, negative=left, count=count)
    return Node(feature=split.featureIndex(), categories=[int(v) for v in split.rightCategories()], default_positive=default, positive=right, negative=left, count=count)
