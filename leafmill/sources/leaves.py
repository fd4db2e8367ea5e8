"""Scans of raw leaf files: ``root/source/level_1/.../data.csv``."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from leafmill import DEFAULT_KEYS
from leafmill.functions.columns import other_columns, quoted
from leafmill.sources.headers import CORRUPT, Headers
from leafmill.sources.paths import literal, path_keys, subfolders

# Texts that stand for a missing value in a CSV cell.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
BAD_CELLS = "bad_cells"


def leaf_pattern(root: str, sources: Sequence[str] | None, keys: Sequence[str], file_name: str) -> str:
    """A path pattern that lists only folders of the given sources."""
    first = "*" if sources is None else "{" + ",".join(literal(s) for s in sources) + "}"
    return "/".join([root.rstrip("/"), first, *["*"] * (len(keys) - 1), file_name])


def present_sources(spark: SparkSession, root: str, sources: Sequence[str]) -> tuple[list[str], list[str]]:
    """The asked sources that have a folder, and those that have none."""
    folders = set(subfolders(spark, root))
    return [s for s in sources if s in folders], [s for s in sources if s not in folders]


def read_leaf_text(
    spark: SparkSession,
    root: str,
    sources: Sequence[str] | None = None,
    keys: Sequence[str] = DEFAULT_KEYS,
    file_name: str = "data.csv",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """All leaf files of the sources as one table of text columns, keys first.

    Only folders of the asked sources are listed. Absent sources are skipped
    (``present_sources`` reports them). Every file is read by its own header, all in one scan: a column that it
    lacks is null there, others than the asked ``columns`` are left out, and their order does not matter. Files
    without any asked column, or with a column named twice, are left out (``bad_leaf_files`` lists them).
    Without ``columns`` all columns of all files are read. ``_corrupt_row`` holds the text of a row with
    more cells than its header.
    """
    headers = _headers(spark, root, sources, keys, file_name)
    return headers.rows(headers.columns() if columns is None else columns, path_keys(keys))


def bad_leaf_files(
    spark: SparkSession,
    root: str,
    columns: Sequence[str],
    sources: Sequence[str] | None = None,
    keys: Sequence[str] = DEFAULT_KEYS,
    file_name: str = "data.csv",
) -> DataFrame:
    """(_file, header) of leaf files that ``read_leaf_text`` leaves out."""
    return _headers(spark, root, sources, keys, file_name).bad_files(columns)


def _headers(spark: SparkSession, root: str, sources: Sequence[str] | None, keys: Sequence[str], file_name: str) -> Headers:
    found, _ = present_sources(spark, root, subfolders(spark, root) if sources is None else sources)
    if not found:
        raise ValueError(f"no leaf files for any of {sources or 'the sources'} below {root}")
    return Headers(spark, leaf_pattern(root, found, keys, file_name))


def typed_cells(text: DataFrame, schema: T.StructType, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Cast text cells to the declared types.

    Missing-value texts become null. A cell that cannot be cast becomes null too, and its
    column name is listed in ``bad_cells``. So is ``_corrupt_row`` for a row with too many cells; a row
    with too few has nulls at its end.
    """
    cells, bad = [], []
    if CORRUPT in text.columns:
        bad.append(F.when(F.col(CORRUPT).isNotNull(), F.lit(CORRUPT)))
    for field in schema:
        cell = F.when(~F.trim(quoted(field.name)).isin(*MISSING_TEXTS), F.col(quoted(field.name)))
        value = cell.try_cast(field.dataType) if not isinstance(field.dataType, T.StringType) else cell
        cells.append(value.alias(field.name))
        bad.append(F.when(cell.isNotNull() & value.isNull(), F.lit(field.name)))
    return text.select(*keys, *cells, F.array_compact(F.array(*bad)).alias(BAD_CELLS))


def read_leaves(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    sources: Sequence[str] | None = None,
    keys: Sequence[str] = DEFAULT_KEYS,
    file_name: str = "data.csv",
) -> DataFrame:
    """Leaf files as one typed table with a ``bad_cells`` column."""
    text = read_leaf_text(spark, root, sources, keys, file_name, columns=schema.names)
    return typed_cells(text, schema, keys)


def accepted(cells: DataFrame) -> DataFrame:
    """Rows for statistics: bad cells are null in them, rows with too many cells are left out."""
    return cells.where(~F.array_contains(BAD_CELLS, CORRUPT)).drop(BAD_CELLS)


def rejects(cells: DataFrame) -> DataFrame:
    """Rows with at least one bad cell or too many cells, for a table of their own."""
    return cells.where(F.size(BAD_CELLS) > 0)


def measured_schema(text: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> T.StructType:
    """A schema for unknown files: a column is a measure when every present cell is a number.

    One aggregation over the whole table, so every leaf gets the same types.
    """
    names = other_columns(text, keys, [CORRUPT])
    checks = []
    for i, name in enumerate(names):
        cell = F.when(~F.trim(quoted(name)).isin(*MISSING_TEXTS), F.col(quoted(name)))
        checks.append(F.count(F.when(cell.isNotNull() & cell.try_cast("double").isNull(), 1)).alias(str(i)))
    misfits = text.agg(*checks).first()
    return T.StructType(
        [T.StructField(n, T.StringType() if misfits[i] else T.DoubleType()) for i, n in enumerate(names)]
    )
