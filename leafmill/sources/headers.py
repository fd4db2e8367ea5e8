"""CSV files read by their own headers in one scan: files may order their columns differently or lack some."""

import csv
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from leafmill.session import BROADCAST_ROWS, staged
from leafmill.sources.paths import literal

#: Holds the text of a row with too many cells.
CORRUPT = "_corrupt_row"
FILE = "_file"
#: More different headers than this are a mistake in the path, not variants of one table.
MOST_HEADERS = 500
QUOTED_CELL = '"(?:[^"]|"")*"'


def text_lines(text: DataFrame) -> DataFrame:
    """Lines of a text scan with their file and the start of their block there."""
    return text.select("value", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("_start"))


class Headers:
    """First lines of the files that a pattern matches, or of the files that ``lines`` come from.

    ``first`` has one row (_file, header) per file with a line; ``variants`` maps each header text to its
    columns and its number of files, the commonest first; ``unusable`` lists headers that name a column twice.
    """

    def __init__(self, spark: SparkSession, pattern: str | Sequence[str] | None = None, lines: DataFrame | None = None, **options: str):
        self.spark, self.pattern, self.options = spark, pattern, options
        if lines is None:
            lines = text_lines(spark.read.options(**options).text(pattern))
        placed = lines.withColumn("_place", F.monotonically_increasing_id()).where("_start = 0 AND trim(value) <> ''")
        # A partial aggregate: one row per task and file leaves a task.
        self.first = staged(placed.groupBy(FILE).agg(F.min_by("value", "_place").alias("header")), "headers")
        counts = self.first.groupBy("header").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "header").limit(MOST_HEADERS + 1).collect()
        if len(counts) > MOST_HEADERS:
            raise ValueError(f"more than {MOST_HEADERS} different headers below {pattern}")
        self.variants: dict[str, tuple[list[str], int]] = {}
        self.unusable: list[str] = []
        self.n_files = sum(row["n"] for row in counts)
        for row in counts:
            # A column without a name is called by its place, as Spark's reader does.
            names = [name or f"_c{i}" for i, name in enumerate(next(csv.reader([row["header"]]), []))]
            if not names or len(set(names)) < len(names):
                self.unusable.append(row["header"])
            else:
                self.variants[row["header"]] = (names, row["n"])
        if pattern is None:
            self.pattern = [literal(unquote(r[FILE])) for r in self.first.collect()]

    def columns(self) -> list[str]:
        """All column names, those of the commonest header first."""
        return list(dict.fromkeys(name for names, _ in self.variants.values() for name in names))

    def rows(self, wanted: Sequence[str], carried: Sequence[Column] = (), index: Callable[[str], bool] | None = None) -> DataFrame:
        """One scan of all files: the carried columns, the wanted ones as text, and ``_corrupt_row``.

        Cells are read by position; a lookup of each file says where a wanted column is. Files whose header is
        unusable or has no wanted column are left out. ``_corrupt_row`` holds the text of a row with more cells
        than its header. ``carried`` are expressions over the scan, such as keys from paths or places in files.
        A first column whose name ``index`` accepts is no column of that file.
        """
        wanted = list(wanted)
        places = {header: {n: i for i, n in enumerate(names) if i or index is None or not index(n)} for header, (names, _) in self.variants.items()}
        known = {header: at for header, at in places.items() if set(at) & set(wanted)}
        if not known:
            raise ValueError(f"no file of {self.pattern} has any of the columns {wanted}")
        width = max(len(self.variants[header][0]) for header in known)
        usual = next(iter(known))
        alone = len(known) == len(self.variants) + len(self.unusable) == 1
        # A row that has exactly the cells of the schema comes without its text. Where headers differ the
        # schema has one cell more than any of them, so that only rows too long for all headers do.
        cells = [f"_cell_{i}" for i in range(width if alone else width + 1)]
        scan = self._scan(cells).select(*carried, F.col("_metadata.file_path").alias(FILE), F.array(*cells).alias("_cells"), CORRUPT)
        names = [c for c in scan.columns if c not in (FILE, "_cells", CORRUPT)]
        if alone:
            found = [F.get("_cells", F.lit(known[usual][c])).alias(c) if c in known[usual] else F.lit(None).cast("string").alias(c) for c in wanted]
            return scan.select(*names, *found, F.when(_longer(F.lit(width)), F.col(CORRUPT)).alias(CORRUPT))
        looked_up = scan.join(self._lookup(known, usual, wanted), FILE, "left")
        # Files that are not in the lookup have the usual header.
        at, n_cells = [known[usual].get(c, -1) for c in wanted], len(self.variants[usual][0])
        placed = looked_up.where("_at IS NULL OR size(_at) > 0").withColumns(
            {"_at": F.coalesce("_at", F.array(*[F.lit(i) for i in at])), "_width": F.coalesce("_width", F.lit(n_cells))}
        )
        found = [F.get("_cells", F.get("_at", F.lit(i))).alias(c) for i, c in enumerate(wanted)]
        too_long = F.when(F.col(CORRUPT).isNull(), F.to_csv(F.struct(*[F.get("_cells", F.lit(i)).alias(c) for i, c in enumerate(cells)])))
        too_long = too_long.when(_longer(F.col("_width")), F.col(CORRUPT))
        return placed.select(*names, *found, too_long.alias(CORRUPT))

    def _scan(self, cells: Sequence[str]) -> DataFrame:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cells, CORRUPT]])
        # Unpruned: only then does the parser see that a row has more cells than the schema.
        reader = self.spark.read.schema(schema).option("header", True).option("columnPruning", False)
        return reader.option("columnNameOfCorruptRecord", CORRUPT).options(**self.options).csv(self.pattern)

    def _lookup(self, known: dict[str, dict[str, int]], usual: str, wanted: Sequence[str]) -> DataFrame:
        """(_file, _at, _width) of the files without the usual header; ``_at`` is empty where a file is left out."""
        unlike = [h for h in [*self.variants, *self.unusable] if h != usual]
        # A negative place gives null.
        table = [(h, [known[h].get(c, -1) for c in wanted] if h in known else [], len(self.variants[h][0]) if h in known else 0) for h in unlike]
        places = self.spark.createDataFrame(table, "header string, _at array<int>, _width int")
        lookup = self.first.join(F.broadcast(places), "header").select(FILE, "_at", "_width")
        return F.broadcast(lookup) if self.n_files - self.variants[usual][1] <= BROADCAST_ROWS else lookup

    def bad_files(self, wanted: Sequence[str] = ()) -> DataFrame:
        """(_file, header) of files whose header is unusable or has none of the wanted columns."""
        bad = [*self.unusable, *[h for h, (names, _) in self.variants.items() if wanted and not set(wanted) & set(names)]]
        return self.first.where(F.col("header").isin(bad)) if bad else self.first.where("false")


def _longer(width: Column) -> Column:
    """Whether the kept text of a row has more cells than ``width``; commas in quotes do not count."""
    text = F.col(CORRUPT)
    commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
    return (commas >= width) & (F.size(F.split(F.regexp_replace(text, QUOTED_CELL, ""), ",")) > width)
