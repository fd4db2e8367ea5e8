"""Secrets: base patterns, and tokens that pass a battery of randomness tests.

Every token of ``LEAST`` or more characters of ``[A-Za-z0-9+/_-]``, padding included, is read in the smallest
encoding that its characters allow (hexadecimal, base 32, lower-case letters and digits, base 62, base 64). An
``=`` with more behind it ends a token, so that NAME=VALUE is two. What no encoding holds is cut at ``/``, and a
part that still has both ``+`` and one of ``-_`` at ``+``. Three tests ask whether it could be uniform random text of that encoding: chi-squared over the
alphabet, runs above and below the middle of the alphabet, and serial correlation of neighbours. The
smallest p, times three, is the token's p.

Random tokens spread their p evenly over (0, 1), words and paths crowd near 0. In each stratum of encoding
and length the different tokens with p over one half tell how many random ones there are; the threshold is the
lowest p above which the others make up at most ``RATE`` of what is reported. Copies of a token count once for
the threshold, which then holds for all of them. Long tokens separate well and get a
low threshold; a stratum of short ones that does not separate reports few or none.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmill.llm.common import documents, staged, text_of
from leafmill.llm.pii import per_document, without_overlaps
from leafmill.llm.spans import located, normal_tail, pieces

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "random"]
LEAST = 20
RATE = 0.05
BINS = 20

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++"""
_ASSIGN_VALUE = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
#: A run of token characters in one alphabet; else a part between slashes; else one between plus signs. Then
#: padding at the end, which is up to two of ``LEAST`` characters in base 64.
_RANDOM = (
    rf"(?:(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{{{LEAST - 2},}}+(?![_-])"
    rf"|(?<![A-Za-z0-9+_-])[A-Za-z0-9+]{{{LEAST - 2},}}+(?![_-])"
    rf"|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{{LEAST - 2},}}+)"
    r"(?:=++(?![A-Za-z0-9+/_-]))?+"
)
PATTERNS = {
    "assign": _ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "random": _RANDOM,
}

#: Alphabets by encoding, smallest first; padding is cut off before.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def inferred(core: Column) -> Column:
    """Name of the smallest alphabet that holds all characters; null if none does."""
    tests = {
        "hex": "^[0-9a-f]++$",
        "HEX": "^[0-9A-F]++$",
        "base32": "^[A-Z2-7]++$",
        "lower36": "^[0-9a-z]++$",
        "upper36": "^[0-9A-Z]++$",
        "base62": "^[0-9A-Za-z]++$",
        "base64": "^[0-9A-Za-z+/]++$",
        "base64url": "^[0-9A-Za-z_-]++$",
    }
    name = F.lit(None).cast("string")
    for encoding, test in reversed(tests.items()):
        name = F.when(core.rlike(test), encoding).otherwise(name)
    return name


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = F.col("t")
    likely = {
        "assign": t.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]"""),
        "access": t.contains("AKIA"),
        "hex": t.rlike("[0-9a-f]{24}"),
        "random": t.rlike(rf"[A-Za-z0-9+/_=-]{{{LEAST}}}"),
    }
    found = [pieces(t, kind, PATTERNS[kind], likely[kind], context=0) for kind in KINDS]
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("t")).select(
        "id", "row", F.concat(*found).alias("pieces")
    )


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, n, p_chi, p_runs, p_serial and p to tokens with a column ``value``."""
    core = F.regexp_replace("value", "=+$", "")
    read = tokens.withColumn("core", core).withColumn("encoding", inferred(F.col("core")))
    letters = F.lit(None).cast("string")
    for name, alphabet in ALPHABETS.items():
        letters = F.when(F.col("encoding") == name, F.lit(alphabet)).otherwise(letters)
    read = read.withColumn("alphabet", letters)
    # Places in the alphabet from 0; a token holds ASCII only, so one character is one element.
    read = read.withColumn(
        "v",
        F.transform(F.filter(F.split("core", ""), lambda c: F.length(c) > 0), lambda c: F.call_function("instr", F.col("alphabet"), c) - 1),
    )
    size, n = F.length("alphabet").cast("double"), F.size("v").cast("double")
    read = read.withColumn("a", size).withColumn("n", n)
    # Sum of squared counts, over the alphabet.
    squares = F.aggregate(
        F.sequence(F.lit(0), (F.col("a") - 1).cast("int")),
        F.lit(0.0),
        lambda total, s: total + F.pow(F.size(F.filter("v", lambda x: x == s)).cast("double"), F.lit(2.0)),
    )
    half = (F.col("a") / 2).cast("int")
    above = F.size(F.filter("v", lambda x: x >= half)).cast("double")
    pairs = F.zip_with(F.slice("v", F.lit(1), F.size("v") - 1), F.slice("v", F.lit(2), F.size("v") - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    read = read.withColumn("squares", squares).withColumn("above", above).withColumn("pairs", pairs)
    read = read.withColumn("runs", 1 + F.size(F.filter("pairs", lambda p: (p["x"] >= half) != (p["y"] >= half))).cast("double"))
    centre = (F.col("a") - 1) / 2
    spread = (F.col("a") * F.col("a") - 1) / 12
    read = read.withColumn("lag", F.aggregate("pairs", F.lit(0.0), lambda t, p: t + (p["x"] - centre) * (p["y"] - centre)))
    a, n, up = F.col("a"), F.col("n"), F.col("above")
    chi = squares_z(F.col("squares"), n, a)
    down = n - up
    expected = 1 + 2 * up * down / n
    variance = (expected - 1) * (expected - 2) / (n - 1)
    runs = F.when(variance > 0, F.abs(F.col("runs") - expected) / F.sqrt(variance)).otherwise(F.lit(8.0))
    serial = F.abs(F.col("lag")) / (spread * F.sqrt(n - 1))
    tail = lambda z: F.when(z >= 0, normal_tail(z)).otherwise(1 - normal_tail(-z))
    tested = (
        read.withColumn("p_chi", tail(chi))
        .withColumn("p_runs", 2 * normal_tail(runs))
        .withColumn("p_serial", 2 * normal_tail(serial))
    )
    p = F.least(F.lit(1.0), 3 * F.least("p_chi", "p_runs", "p_serial"))
    return tested.withColumn("p", F.when(F.col("encoding").isNull(), F.lit(0.0)).otherwise(p)).drop(
        "core", "alphabet", "v", "a", "squares", "above", "pairs", "runs", "lag"
    )


def squares_z(squares: Column, n: Column, a: Column) -> Column:
    """Chi-squared for uniform counts as a normal deviate, with the exact mean and variance for ``n`` draws."""
    statistic = squares * a / n - n
    return (statistic - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)


def stratum() -> Column:
    n = F.col("n")
    length = F.when(n < 24, 20).when(n < 32, 24).when(n < 48, 32).when(n < 96, 48).otherwise(96)
    return F.concat_ws("|", F.coalesce("encoding", F.lit("none")), length.cast("string"))


def thresholds(counts: list[tuple[str, int, int]], rate: float = RATE, bins: int = BINS) -> dict[str, float]:
    """Lowest p to report for each stratum, from counts by (stratum, bin of p). A stratum may have none."""
    strata: dict[str, list[int]] = {}
    for name, at, n in counts:
        strata.setdefault(name, [0] * bins)[min(at, bins - 1)] += n
    chosen = {}
    for name, n in strata.items():
        upper = sum(n[bins // 2 :])
        # The combined p of random tokens is never below even, so this does not overstate by much.
        random = min(upper / 0.5, sum(n))
        for at in range(bins):
            reported = sum(n[at:])
            expected = random * (1 - at / bins)
            if reported and max(0.0, reported - expected) / reported <= rate:
                chosen[name] = max(at / bins, 0.001)
                break
    return chosen


def distinct_counts(tested: DataFrame, bins: int = BINS) -> DataFrame:
    """(stratum, bin, n): different tokens by stratum and bin of p; equal values have equal p."""
    token = F.sha2(F.regexp_replace("value", "=+$", ""), 256).alias("token")
    once = tested.select("stratum", token, F.floor(F.col("p") * bins).cast("int").alias("bin")).distinct()
    return once.groupBy("stratum", "bin").agg(F.count("*").alias("n"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): rows (id, row) of all documents, and one row per secret.

    Spans: row, kind, start, end, value, base, p; positions count code points, end exclusive. A null text is
    empty. Base spans always stay (p 1); kind ``random`` is added where it meets no base span. An empty table
    gives two empty results.
    """
    table = staged(candidates(docs, id_col, text_col), "secret-candidates")
    spans = located(table.where(F.size("pieces") > 0)).drop("before", "after")
    kind, value = F.col("kind"), F.col("value")
    strong = (kind != "assign") | (F.length(F.regexp_extract(value, _ASSIGN_VALUE, 1)) >= 6)
    base = spans.where(kind.isin(BASE) & strong).select("row", "kind", "start", "end", "value", F.lit(True).alias("base"), F.lit(1.0).alias("p"))
    tested = staged(battery(spans.where((kind == "random") & (F.length(value) >= LEAST))).withColumn("stratum", stratum()), "secret-tokens")
    # At most encodings x lengths x bins counts.
    counts = distinct_counts(tested).collect()
    least = thresholds([tuple(r) for r in counts], rate)
    limit = F.lit(None).cast("double")
    for name, p in least.items():
        limit = F.when(F.col("stratum") == name, F.lit(p)).otherwise(limit)
    added = tested.where(F.col("p") >= limit).select("row", "kind", "start", "end", "value", F.lit(False).alias("base"), "p")
    return table.select("id", "row"), without_overlaps(base.unionByName(added))


def op8_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans = secret_spans(documents(spark, sf_dir))
    return per_document(found, spans, KINDS, BASE)
