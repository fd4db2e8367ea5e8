"""Random forests of many candidates and folds, grown together level by level.

Features become bin numbers once. After that one job grows one level of every tree of every candidate and
fold: tasks add up class weights per (tree, node, feature, bin) for the rows they hold, the sums of a tree meet
and give the best split of each of its nodes, and only those splits reach the driver. A search of any number
of candidates so takes as many jobs as its deepest tree has levels, and one more for the scores of all folds.

How often a row counts in a tree (Poisson draws of mean one), which features a node looks at, and which rows
the bins are cut from follow from hashes of the row's key, the seed, the tree and the node. So the trees are the
same on any number of partitions, and after any loss of executors. Sums of whole weights are exact.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, functions as F

from leafmill.functions.columns import quoted_all
from leafmill.session import staged

BINS = 32
#: Rows that the borders of the bins are taken from, about; fewer rows are all used.
BIN_ROWS = 20_000
#: Sums that a task holds at a time (8 bytes each); a level with more is grown in several jobs.
MOST_SUMS = 1 << 23
#: Nodes of a tree whose sums travel together.
NODE_BLOCK = 256
#: Chances of 0, 1, 2, ... draws, added up.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))
LEAST_GAIN = 1e-12


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64 bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(*parts: int) -> np.uint64:
    out = np.zeros(1, dtype=np.uint64)
    for part in parts:
        out = mixed(out + np.uint64(int(part) & (2**64 - 1)) + np.uint64(0x9E3779B97F4A7C15))
    return out[0]


def draws(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row counts in a tree."""
    uniform = (mixed(keys.view(np.uint64) ^ seeded(seed, tree)) >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(POISSON, uniform, side="right").astype(np.int64)


def looked_at(seed: int, tree: int, node: int, n_features: int, n: int) -> np.ndarray:
    """The features a node may split on, rising: those with the smallest hashes."""
    hashes = mixed(np.arange(n_features, dtype=np.uint64) + seeded(seed, tree, node, 7))
    return np.sort(np.argsort(hashes, kind="stable")[:n])


@dataclass
class Tree:
    """A tree as it grows. Nodes are numbered as they come; ``path`` names a node whatever the other trees do."""

    number: int
    max_depth: int
    least_rows: int
    #: Rows of this fold are not used; -1 for none.
    fold: int = -1
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    counts: list[np.ndarray | None] = field(default_factory=lambda: [None])
    path: list[int] = field(default_factory=lambda: [1])
    #: Nodes of the current level that may still be split.
    growing: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, side: int, counts: np.ndarray, depth: int) -> None:
        node = len(self.feature)
        self.feature.append(-1)
        self.bin.append(0)
        self.left.append(-1)
        self.counts.append(counts)
        self.path.append(2 * self.path[parent] + side)
        if depth < self.max_depth and counts.sum() >= 2 * self.least_rows and np.count_nonzero(counts) > 1:
            self.growing.append(node)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, dtype=np.int32), np.array(self.bin, dtype=np.int16), np.array(self.left, dtype=np.int32)

    def leaf_shares(self, n_classes: int) -> np.ndarray:
        """Class shares of every node; even ones where no row came."""
        counts = np.array([c if c is not None else np.zeros(n_classes) for c in self.counts], dtype=float)
        total = counts.sum(axis=1, keepdims=True)
        return np.where(total > 0, counts / np.where(total > 0, total, 1.0), 1.0 / n_classes)


def placed(bins: np.ndarray, feature: np.ndarray, split: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node of every row: down from the root until there is no split."""
    node = np.zeros(len(bins), dtype=np.int32)
    rows = np.arange(len(bins))
    while True:
        going = left[node] >= 0
        if not going.all():
            rows = rows[going[rows]]
        if not len(rows):
            return node
        at = node[rows]
        node[rows] = left[at] + (bins[rows, feature[at]] > split[at])


def best_splits(sums: np.ndarray, least_rows: int) -> list[tuple[int, int, np.ndarray, np.ndarray] | None]:
    """For sums by (node, looked-at feature, bin, class): the split of most Gini gain, or none.

    A split is (place of the feature, last bin to the left, class counts of the left side, and of the right).
    Ties go to the first feature, then to the first bin.
    """
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    total = sums.sum(axis=2)[:, :, None, :]
    right = total - left
    n_left, n_right, n = left.sum(axis=3), right.sum(axis=3), total.sum(axis=3)

    def impurity_times_n(counts, n):
        return n - (counts * counts).sum(axis=3) / np.where(n > 0, n, 1)

    gain = impurity_times_n(total, n) - impurity_times_n(left, n_left) - impurity_times_n(right, n_right)
    gain = np.where((n_left >= least_rows) & (n_right >= least_rows), gain / np.where(n > 0, n, 1), -1.0)
    out = []
    for node in range(len(sums)):
        if not gain.shape[2]:
            out.append(None)
            continue
        f, b = divmod(int(np.argmax(gain[node])), gain.shape[2])
        best = gain[node, f, b]
        out.append((f, b, left[node, f, b], right[node, f, b]) if best > LEAST_GAIN else None)
    return out


@dataclass
class Binned:
    """Training rows as bins: a written table (key, label, fold, bins), the borders of every feature, the classes."""

    rows: DataFrame
    borders: list[np.ndarray]
    n_classes: int

    @property
    def n_features(self) -> int:
        return len(self.borders)

    @property
    def looked_at(self) -> int:
        return max(1, int(np.ceil(np.sqrt(self.n_features))))


def cut(values: np.ndarray, borders: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of each value of each feature: bin b holds what lies above border b - 1, up to and with border b."""
    out = np.empty(values.shape, dtype=np.uint8)
    for f, edges in enumerate(borders):
        out[:, f] = np.searchsorted(edges, values[:, f], side="left")
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def binned(rows: DataFrame, keys: Sequence[str], n_classes: int | None = None, bins: int = BINS, bin_rows: int = BIN_ROWS) -> Binned:
    """Cuts the features of ``rows`` (features vector, label from 0 up, fold if there is one, keys) into bins.

    Borders are quantiles of about ``bin_rows`` rows, those with the smallest hashes of their keys.
    """
    fold = F.col("fold").cast("int") if "fold" in rows.columns else F.lit(-1)
    plain = rows.select(
        F.xxhash64(*quoted_all(keys)).alias("key"), F.col("label").cast("int").alias("label"), fold.alias("fold"),
        vector_to_array("features").alias("values"),
    )
    plain = staged(plain, "training")
    about = plain.agg(F.count("*").alias("n"), F.max("label").alias("label")).first()
    if not about["n"]:
        raise ValueError("no training rows")
    share = min(1.0, bin_rows / about["n"])
    some = plain.where(F.pmod(F.xxhash64("key", F.lit("bins")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    quantiles = [i / bins for i in range(1, bins)]
    edges = some.select(F.posexplode("values").alias("f", "v")).groupBy("f").agg(F.percentile("v", F.array(*[F.lit(q) for q in quantiles])).alias("q"))
    borders = [np.unique(np.array(q)) for _, q in sorted(tuple(r) for r in edges.collect())]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [row.tobytes() for row in cut(_matrix(batch.column("values")), borders)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), batch.column("fold"), pa.array(packed, pa.binary())], names=["key", "label", "fold", "bins"]
            )

    table = staged(plain.mapInArrow(cells, "key long, label int, fold int, bins binary"), "binned")
    return Binned(table, borders, max(n_classes or 0, about["label"] + 1))


def _rows(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    key, label, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "label", "fold"))
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, n_features)
    return key.astype(np.int64), label.astype(np.int64), fold, bins


def _grown_blocks(data: Binned, trees: Sequence[Tree], chosen: Sequence[tuple[int, int]], seed: int) -> list[tuple]:
    """One job: the best splits of the chosen blocks (tree, block of its growing nodes)."""
    n_features, n_bins, n_classes, m = data.n_features, max(len(b) for b in data.borders) + 1, data.n_classes, data.looked_at
    by_tree: dict[int, list[int]] = {}
    for t, block in chosen:
        by_tree.setdefault(t, []).append(block)
    jobs = [
        (t, trees[t].number, trees[t].fold, trees[t].arrays(), [trees[t].path[n] for n in trees[t].growing], np.array(trees[t].growing), blocks, trees[t].least_rows)
        for t, blocks in by_tree.items()
    ]
    spark = data.rows.sparkSession
    shared = spark.sparkContext.broadcast(jobs)

    def features_of(number: int, paths: list[int]) -> np.ndarray:
        return np.array([looked_at(seed, number, p, n_features, m) for p in paths], dtype=np.int64).reshape(-1, m)

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        features: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            key, label, fold, bins = _rows(batch, n_features)
            weights: dict[int, np.ndarray] = {}
            for t, number, left_out, arrays, paths, growing, blocks, _ in shared.value:
                if number not in weights:
                    weights[number] = draws(key, seed, number)
                weight = weights[number]
                rows = np.flatnonzero((weight > 0) & (fold != left_out)) if left_out >= 0 else np.flatnonzero(weight)
                part = bins[rows]
                node = placed(part, *arrays)
                local = np.searchsorted(growing, node)
                local[local == len(growing)] = 0
                here = growing[local] == node
                if t not in features:
                    features[t] = features_of(number, paths)
                for block in blocks:
                    low = block * NODE_BLOCK
                    size = min(NODE_BLOCK, len(growing) - low)
                    mine = np.flatnonzero(here & (local >= low) & (local < low + size))
                    at = local[mine]
                    cells = part[mine[:, None], features[t][at]].astype(np.int64)
                    cells += ((at - low)[:, None] * m + np.arange(m)) * n_bins
                    cells = cells * n_classes + label[rows[mine], None]
                    found = np.bincount(cells.ravel(), weights=np.repeat(weight[rows[mine]], m), minlength=size * m * n_bins * n_classes)
                    held[t, block] = held[t, block] + found if (t, block) in held else found
        if held:
            tree, block = zip(*held)
            packed = [v.astype(np.int64).tobytes() for v in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(block, pa.int32()), pa.array(packed, pa.binary())], names=["tree", "block", "sums"])

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = {t: (number, paths, least) for t, number, _, _, paths, _, _, least in shared.value}

        def closed(tree: int, block: int, sums: np.ndarray) -> pa.RecordBatch:
            shaped = sums.reshape(-1, m, n_bins, n_classes)
            number, paths, least = about[tree]
            features = features_of(number, paths[block * NODE_BLOCK : block * NODE_BLOCK + len(shaped)])
            out = []
            for i, best in enumerate(best_splits(shaped, least)):
                whole = shaped[i, 0].sum(axis=0)
                f, b, left, right = (int(features[i, best[0]]), best[1], best[2], best[3]) if best else (-1, 0, whole, whole * 0)
                out.append((tree, block * NODE_BLOCK + i, f, b, left.tolist(), right.tolist()))
            columns = list(zip(*out))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "place", "feature", "bin", "low", "high"])

        now, total = None, None
        for batch in batches:
            for tree, block, sums in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "sums"))):
                values = np.frombuffer(sums, dtype=np.int64)
                if (tree, block) == now:
                    total = total + values
                    continue
                if now is not None:
                    yield closed(*now, total)
                now, total = (tree, block), values
        if now is not None:
            yield closed(*now, total)

    parts = data.rows.mapInArrow(sums_of, "tree int, block int, sums binary")
    met = parts.repartition("tree", "block").sortWithinPartitions("tree", "block")
    found = met.mapInArrow(splits, "tree int, place int, feature int, bin int, low array<long>, high array<long>").collect()
    shared.unpersist()
    return [tuple(r) for r in found]


def grown(data: Binned, trees: Sequence[Tree], seed: int) -> None:
    """Grows all trees to their ends, a level of all of them at a time."""
    size = NODE_BLOCK * data.looked_at * (max((len(b) for b in data.borders), default=0) + 1) * data.n_classes
    at_once = max(1, MOST_SUMS // size)
    depth = 0
    while True:
        blocks = []
        for t, tree in enumerate(trees):
            blocks += [(t, b) for b in range((len(tree.growing) + NODE_BLOCK - 1) // NODE_BLOCK)]
        if not blocks:
            return
        weighed = [min(NODE_BLOCK, len(trees[t].growing) - b * NODE_BLOCK) / NODE_BLOCK for t, b in blocks]
        found, low = [], 0
        while low < len(blocks):
            high, load = low, 0.0
            while high < len(blocks) and (high == low or load + weighed[high] <= at_once):
                load += weighed[high]
                high += 1
            found += _grown_blocks(data, trees, blocks[low:high], seed)
            low = high
        ready = {(t, place): (f, b, left, right) for t, place, f, b, left, right in found}
        for t, tree in enumerate(trees):
            nodes, tree.growing = tree.growing, []
            for place, node in enumerate(nodes):
                f, b, left, right = ready.get((t, place), (-1, 0, None, None))
                if left is None:
                    continue
                left, right = np.array(left), np.array(right)
                if tree.counts[node] is None:
                    tree.counts[node] = left + right
                if f < 0 or depth >= tree.max_depth:
                    continue
                tree.feature[node], tree.bin[node], tree.left[node] = f, b, len(tree.feature)
                tree.add(node, 0, left, depth + 1)
                tree.add(node, 1, right, depth + 1)
        depth += 1


def planted(params: dict, fold: int = -1) -> list[Tree]:
    """The trees of one candidate, before they grow."""
    return [
        Tree(number, int(params.get("max_depth", 5)), int(params.get("min_samples_leaf", 1)), fold) for number in range(int(params.get("n_estimators", 20)))
    ]


def fold_votes(data: Binned, forests: dict[tuple[int, int], Sequence[Tree]]) -> DataFrame:
    """Class shares for the rows of every fold by the forests of that fold: candidate, fold, label, shares.

    ``forests`` are by (candidate, fold); every row is predicted once per candidate, all in one pass.
    """
    n_features, n_classes = data.n_features, data.n_classes
    shared = data.rows.sparkSession.sparkContext.broadcast(
        {at: [(tree.arrays(), tree.leaf_shares(n_classes)) for tree in trees] for at, trees in forests.items()}
    )

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, label, fold, bins = _rows(batch, n_features)
            for (candidate, f), trees in shared.value.items():
                rows = np.flatnonzero(fold == f)
                if len(rows):
                    part = bins[rows]
                    shares = sum(leaf[placed(part, *arrays)] for arrays, leaf in trees) / len(trees)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([candidate] * len(rows), pa.int32()), pa.array([f] * len(rows), pa.int32()), pa.array(label[rows], pa.int32()),
                            pa.array(list(shares), pa.list_(pa.float64())),
                        ],
                        names=["candidate", "fold", "label", "shares"],
                    )

    return data.rows.mapInArrow(votes, "candidate int, fold int, label int, shares array<double>")


def likeliest(shares: Column) -> Column:
    """The class with the greatest share, the first of equals, as a double."""
    return (F.array_position(shares, F.array_max(shares)) - 1).cast("double")


class _ForestParams(Params):
    n_trees = Param(Params._dummy(), "n_trees", "number of trees", TypeConverters.toInt)
    max_depth = Param(Params._dummy(), "max_depth", "levels below the root", TypeConverters.toInt)
    min_rows = Param(Params._dummy(), "min_rows", "least rows of a leaf", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of all draws", TypeConverters.toInt)
    keys = Param(Params._dummy(), "keys", "columns that name a row", TypeConverters.toListString)
    n_classes = Param(Params._dummy(), "n_classes", "number of classes, 0 for those seen", TypeConverters.toInt)


class KeyedForest(Estimator, _ForestParams):
    """Estimator over columns features, label (and the key columns): the same forest on any partitioning."""

    @keyword_only
    def __init__(self, *, n_trees=20, max_depth=5, min_rows=1, seed=42, keys=(), n_classes=0):
        super().__init__()
        self._set(n_trees=n_trees, max_depth=max_depth, min_rows=min_rows, seed=seed, keys=list(keys), n_classes=n_classes)

    def _fit(self, dataset: DataFrame) -> "KeyedForestModel":
        data = binned(dataset.drop("fold"), self.getOrDefault("keys"), self.getOrDefault("n_classes"))
        trees = planted({"n_estimators": self.getOrDefault("n_trees"), "max_depth": self.getOrDefault("max_depth"), "min_samples_leaf": self.getOrDefault("min_rows")})
        grown(data, trees, self.getOrDefault("seed"))
        return KeyedForestModel.of(trees, data)


class KeyedForestModel(Model, MLWritable, MLReadable):
    """Adds ``probability`` (vector) and ``prediction`` to rows with a ``features`` vector; stored as a table of nodes."""

    def __init__(self, nodes: pd.DataFrame | None = None, numClasses: int = 0):
        super().__init__()
        #: tree, node, feature, border (values up to it go left), left, shares; children are left and left + 1.
        self.nodes, self.numClasses = nodes, numClasses

    @classmethod
    def of(cls, trees: Sequence[Tree], data: Binned) -> "KeyedForestModel":
        rows = []
        for t, tree in enumerate(trees):
            shares = tree.leaf_shares(data.n_classes)
            for i, (f, b, left) in enumerate(zip(tree.feature, tree.bin, tree.left)):
                border = float(data.borders[f][b]) if left >= 0 else 0.0
                rows.append((t, i, f, border, left, shares[i].tolist()))
        return cls(pd.DataFrame(rows, columns=["tree", "node", "feature", "border", "left", "shares"]), data.n_classes)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # The model goes to the tasks once, whatever the number of batches.
        packed = []
        for _, tree in self.nodes.sort_values(["tree", "node"]).groupby("tree", sort=True):
            packed.append((tree["feature"].to_numpy(np.int64), tree["border"].to_numpy(float), tree["left"].to_numpy(np.int64), np.array(tree["shares"].tolist())))
        shared = dataset.sparkSession.sparkContext.broadcast(packed)

        @F.pandas_udf("array<double>")
        def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for values in batches:
                matrix = np.array(values.tolist(), dtype=float)
                if not len(matrix):
                    yield pd.Series([], dtype=object)
                    continue
                total = sum(leaf[placed(matrix, feature, border, left)] for feature, border, left, leaf in shared.value)
                yield pd.Series(list(total / len(shared.value)))

        found = dataset.withColumn("_shares", shares(vector_to_array("features")))
        return found.withColumns({"probability": array_to_vector("_shares"), "prediction": likeliest(F.col("_shares"))}).drop("_shares")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


NODE_SCHEMA = "tree int, node int, feature int, border double, left int, shares array<double>"


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"numClasses": self.instance.numClasses})
        table = self.sparkSession.createDataFrame(self.instance.nodes, NODE_SCHEMA)
        table.write.mode("overwrite").parquet(f"{path}/nodes")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> KeyedForestModel:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        nodes = self.sparkSession.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").toPandas()
        model = self.cls(nodes, about["numClasses"])
        model._resetUid(about["uid"])
        return model
