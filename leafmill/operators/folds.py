"""Group folds: groups are never split, and the largest group goes to the lightest fold."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from leafmill.functions.columns import quoted
from leafmill.operators.ranking import exact_split, with_rank
from leafmill.session import BROADCAST_ROWS, staged

# Up to this many groups, counted first, are ranked in one task.
FEW_GROUPS = 100_000
# A group above this share of all rows counts as hot. At most HOT_SHARE groups can be.
HOT_SHARE = 1000


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("group_size"))


def group_folds(df: DataFrame, group: str, n_folds: int) -> DataFrame:
    """One row per group: (group, group_size, fold).

    Same result as the greedy loop over groups, largest first (ties: name descending), each
    to the lightest fold (ties: lowest number). The loop runs over distinct *sizes* only.
    Within one size the choices follow a fixed pattern: fold f with load L takes its i-th
    group when ``(L + i * size, f)`` is next in order. So each size needs a few pattern rows,
    and every group finds its fold from its rank within its size.
    """
    sizes = staged(group_sizes(df, group), "group-sizes")
    n_groups, n_sizes = sizes.agg(F.count("*"), F.count_distinct("group_size")).first()
    if n_groups < n_folds:
        raise ValueError(f"cannot make {n_folds} folds from {n_groups} groups")
    order = [F.col("group_size").desc(), F.col(group).desc()]
    if n_groups <= FEW_GROUPS:
        ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(*order)) - 1)
    else:
        ranked = with_rank(sizes, order, "_rank", unique=True)
    # Distinct sizes: at most sqrt(2 * rows), and in practice a few thousand.
    histogram = sizes.groupBy("group_size").agg(F.count("*").alias("_groups"))
    patterns = (
        histogram.coalesce(1)
        .sortWithinPartitions(F.col("group_size").desc())
        .mapInPandas(
            _fold_patterns(n_folds),
            "_size long, _begin long, _from_position long, _to_position long, _turn array<int>",
        )
    )
    # A size has at most one pattern row per fold.
    joined = ranked.join(
        F.broadcast(patterns) if n_sizes * n_folds <= BROADCAST_ROWS else patterns,
        (F.col("group_size") == F.col("_size"))
        & (F.col("_rank") - F.col("_begin") >= F.col("_from_position"))
        & (F.col("_rank") - F.col("_begin") < F.col("_to_position")),
    )
    turn = (F.col("_rank") - F.col("_begin") - F.col("_from_position")) % F.size("_turn")
    return joined.select(group, "group_size", F.get("_turn", turn.cast("int")).alias("fold"))


def _fold_patterns(n_folds: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per size: stretches of positions, each served by a fixed cycle of folds.

    The returned function is a closure, so executors need no copy of this package.
    """

    def patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads, begin = [0] * n_folds, 0
        for batch in batches:
            rows = []
            for size, n in zip(batch["group_size"].tolist(), batch["_groups"].tolist()):
                # A fold's load is a whole number of rounds plus a rest that orders it in a round.
                rounds = [load // size for load in loads]
                by_turn = sorted(range(n_folds), key=lambda f: (loads[f] % size, f))
                levels, position = sorted(set(rounds)), 0
                for level, following in zip(levels, [*levels[1:], None]):
                    turn = [f for f in by_turn if rounds[f] <= level]
                    left = n - position
                    length = left if following is None else min(left, (following - level) * len(turn))
                    if length <= 0:
                        break
                    rows.append((size, begin, position, position + length, turn))
                    for i, f in enumerate(turn):
                        loads[f] += size * ((length - i + len(turn) - 1) // len(turn))
                    position += length
                begin += n
            yield pd.DataFrame(rows, columns=["_size", "_begin", "_from_position", "_to_position", "_turn"])

    return patterns


def attach_folds(df: DataFrame, folds: DataFrame, group: str, broadcast_rows: int | None = None) -> DataFrame:
    """Give every row the fold of its group; the null group is a group like any other.

    Up to ``broadcast_rows`` groups (default ``BROADCAST_ROWS``) are looked up in place. Beyond, only hot
    groups are, and the others shuffle; the result is the same.
    """
    # The folds are read several times, so they are written down once.
    wanted = staged(folds.select(F.col(quoted(group)).alias("_group"), "group_size", "fold"), "folds")
    count, total = wanted.agg(F.count("*"), F.sum("group_size")).first()
    same = F.col(quoted(group)).eqNullSafe(F.col("_group"))
    if count <= (BROADCAST_ROWS if broadcast_rows is None else broadcast_rows):
        return df.join(F.broadcast(wanted.drop("group_size")), same).drop("_group")
    # Hot groups, at most HOT_SHARE of them, are looked up in place; only the others shuffle.
    hot = F.broadcast(wanted.where(F.col("group_size") * HOT_SHARE > total).select("_group", "fold"))
    cold = wanted.where(F.col("group_size") * HOT_SHARE <= total).select("_group", "fold")
    in_place = df.join(hot, same).drop("_group")
    shuffled = df.join(hot.select("_group"), same, "left_anti").join(cold, same).drop("_group")
    return in_place.unionByName(shuffled)


def fold_sizes(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold").agg(
        F.count("*").alias("n_groups"), F.sum("group_size").alias("n_rows")
    )


def group_aware_split(df: DataFrame, group: str, fraction: float, seed: int = 42, name: str = "is_train"):
    """Split whole groups: ``int(n_groups * fraction)`` groups train, the rest test.

    Offered next to the row split, which lets one group sit on both sides.
    """
    groups = group_sizes(df, group)
    chosen = exact_split(staged(groups, "groups"), [group], fraction, seed, name="fold")
    return attach_folds(df, chosen, group).withColumnRenamed("fold", name)
