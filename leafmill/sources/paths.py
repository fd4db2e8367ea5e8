"""Paths on any file system Spark can reach, and key values taken from them."""

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Characters with a meaning in path patterns.
PATTERN_CHARACTERS = "\\{}[]*?,"


def literal(part: str) -> str:
    """``part`` as a path pattern that matches only itself."""
    return "".join("\\" + c if c in PATTERN_CHARACTERS else c for c in part)


def matching(spark: SparkSession, pattern: str) -> list[tuple[str, bool]]:
    """(name, is_directory) of every path the pattern matches; empty when there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [] if found is None else [(f.getPath().getName(), f.isDirectory()) for f in found]


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def created_alone(spark: SparkSession, path: str) -> bool:
    """Create an empty file, with the folders above it; false if it is there already.

    Of any number of jobs that try, one succeeds.
    """
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop_path.getParent())
    if system.getScheme() == "file":
        # Hadoop's local file system looks first and creates then.
        try:
            open(hadoop_path.toUri().getPath(), "x").close()
        except FileExistsError:
            return False
        return True
    try:
        system.create(hadoop_path, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the direct sub-folders; plain files do not count."""
    if not exists(spark, folder):
        return []
    return sorted(name for name, is_folder in matching(spark, f"{folder}/*") if is_folder)


def named_by_folder(spark: SparkSession, written: str, tag: str, target: str) -> None:
    """Moves the data file of each folder ``{tag}{name}`` below ``written`` to ``target/name``.

    For readers that take keys from file names, which Spark does not choose itself. One file per folder; one
    move per file on the driver.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(target))
    for folder in subfolders(spark, written):
        if folder.startswith(tag):
            files = [name for name, _ in matching(spark, f"{literal(f'{written}/{folder}')}/part-*")]
            if len(files) != 1:
                raise ValueError(f"{folder} has {len(files)} data files, not one")
            system.rename(hadoop.Path(f"{written}/{folder}/{files[0]}"), hadoop.Path(f"{target}/{folder.removeprefix(tag)}"))


def with_text_partitions(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """A Parquet table whose partition values stay as they are in the folder names: ``01`` is not ``1``."""
    reader = spark.read if base is None else spark.read.option("basePath", base)
    inferred = reader.parquet(path)
    stored = set(spark.read.option("recursiveFileLookup", True).parquet(path).columns)
    as_text = [f if f.name in stored else T.StructField(f.name, T.StringType()) for f in inferred.schema]
    return reader.schema(T.StructType(as_text)).parquet(path)


def path_part(from_end: int) -> Column:
    """A decoded part of the file path; 1 is the file name, 2 its folder, and so on."""
    return _decoded(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -from_end))


def _decoded(part: Column) -> Column:
    # ``+`` stands for itself in a path, but url_decode would take it for a space.
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def path_keys(keys: Sequence[str], below: int = 1) -> list[Column]:
    """The key columns as expressions over a file scan: the folders above each file.

    Folders may be named by the value alone or as ``key=value``. ``below`` is the number of
    path parts below the last key folder.
    """
    depth = len(keys) + below
    values = []
    for i, key in enumerate(keys):
        part, tag = path_part(depth - i), f"{key}="
        # Spark escapes the value in a key=value folder once more.
        tagged = _decoded(F.substring(part, F.lit(len(tag) + 1), F.length(part)))
        values.append(F.when(part.startswith(tag), tagged).otherwise(part).alias(key))
    return values


def with_path_keys(df: DataFrame, keys: Sequence[str], below: int = 1) -> DataFrame:
    """Put key columns, taken from the folders above each file, before the other columns."""
    return df.select(*path_keys(keys, below), "*")
