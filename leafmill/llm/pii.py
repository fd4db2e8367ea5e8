"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates come from the base patterns and from wider ones (obfuscated mail addresses, telephone numbers
without a country code, national numbers, account numbers). Four labelers vote on each candidate yes, no or
not at all: its strict form and checksum, a gazetteer, the words before it, its borders. Expectation-
maximisation over the counts of vote patterns (a table of bounded size) estimates how reliable each labeler
is for each kind. The posteriors then train a naive Bayes classifier on features of the span itself, which
decides about the wider candidates. Spans of the base patterns always stay.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmill.llm.common import documents, staged, text_of
from leafmill.llm.spans import located, pieces, rank_of, written

BASE = ["email", "ip", "card", "phone"]
WIDER = ["masked_email", "local_phone", "national_id", "account"]
KINDS = BASE + WIDER

_LOCAL = "[A-Za-z0-9._%+-]"
#: A start inside a run that failed at its beginning fails too, so a match begins at the run or at the last match's end.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "masked_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{1,64}+(?:\x20?(?:\.|[\[(](?i:dot)[\])])\x20?[A-Za-z0-9-]{1,64}+){1,8}+",
    "local_phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z.-])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}

#: Words before a span that speak for its kind, in four languages.
CUES = {
    "email": "mail|contact|write|reach|courriel|correo|kontakt",
    "ip": "ip|host|server|address|adresse|login|client",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|anruf|appel|llam",
    "masked_email": "mail|contact|write|reach|courriel|correo|kontakt",
    "local_phone": "phone|tel|call|fax|mobile|cell|anruf|appel|llam",
    "national_id": "ssn|social|security|insurance|national",
    "account": "iban|account|bank|konto|compte|cuenta",
}
#: Words before a span that speak against any personal data.
COUNTER = "version|isbn|order|invoice|ticket|revision|build|page|figure|table|chapter|sku"
TOP_DOMAINS = "com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|us|eu|ch|at|nl"
COUNTRIES = "DE|FR|ES|IT|GB|NL|BE|CH|AT|PT|IE|LU|DK|SE|NO|FI|PL|CZ"
ADD_AT = 0.9


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True for digits whose Luhn sum is a multiple of ten."""
    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    each = F.transform(F.split(F.reverse(number), ""), part)
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """True for an account number whose check digits fit."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0), lambda a, c: F.when(F.length(c) == 0, a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c)) % 97)
    )
    return rest == 1


def valid(kind: Column, value: Column) -> Column:
    """The base checks; wider kinds: the strict form of their kind."""
    number = digits(value)
    n = F.length(number)
    small = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    octets = F.forall(small, lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", octets)
        .when(kind == "card", F.when((n < 14) | (n > 19), False).otherwise(luhn(number)))
        .when(kind == "phone", (n >= 10) & (n <= 15))
        # A sentence that ends behind "(at)" has a blank at its full stop; a domain has none, and ends in letters.
        .when(kind == "masked_email", value.rlike("[A-Za-z]{2,24}$") & ~value.rlike(r"\.\x20|\x20\."))
        .when(kind == "local_phone", number.rlike("^[2-9][0-9]{2}[2-9]"))
        .when(kind == "national_id", value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"))
        .otherwise(mod97(value))
    )


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, row, pieces of all kinds. Each pattern runs only where a cheap test is true."""
    t = F.col("t")
    digit = t.rlike("[0-9]")
    likely = {
        "email": t.contains("@"),
        "ip": digit & t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": digit & t.rlike(r"[0-9](?:[\x20-]?[0-9]){9}"),
        "phone": t.contains("+"),
        "masked_email": t.rlike(r"[\[(](?i:at)[\])]"),
        "local_phone": digit & t.rlike(r"[0-9]{3}[.\x20-][0-9]{4}"),
        "national_id": digit & t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        "account": digit & t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    }
    found = [pieces(t, kind, PATTERNS[kind], likely[kind]) for kind in KINDS]
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("t")).select(
        "id", "row", F.concat(*found).alias("pieces")
    )


VOTES = ["form", "gazetteer", "context", "border"]


def voted(spans: DataFrame) -> DataFrame:
    """Votes of the labelers: 1 yes, 0 no, -1 none."""
    kind, value, number = F.col("kind"), F.col("value"), digits(F.col("value"))
    before = F.lower("before")
    cue = F.lit(False)
    for name, words in CUES.items():
        cue = cue | ((kind == name) & before.rlike(rf"(?:{words})[a-z]*[\x20:.=-]*$"))
    known = (
        F.when(kind == "email", value.rlike(rf"(?i)(?:{TOP_DOMAINS})$").cast("int"))
        # No list of domains is complete: an unknown one says nothing.
        .when(kind == "masked_email", F.when(value.rlike(rf"(?i)(?:{TOP_DOMAINS})$"), 1).otherwise(-1))
        .when(kind == "ip", F.when(value.rlike(r"^(?:0|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."), 0).otherwise(1))
        .when(kind == "card", number.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))").cast("int"))
        .when(kind == "phone", number.rlike("^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])").cast("int"))
        .when(kind == "account", value.rlike(f"^(?:{COUNTRIES})").cast("int"))
        .otherwise(-1)
    )
    edge = F.col("before").rlike(r"[A-Za-z0-9_/=]$") | F.col("after").rlike(r"^[A-Za-z0-9_/=]")
    return spans.select(
        "*",
        F.col("valid").cast("int").alias("form"),
        known.alias("gazetteer"),
        F.when(cue, 1).when(before.rlike(rf"(?:{COUNTER})[a-z]*[\x20:.#=-]*$"), 0).otherwise(-1).alias("context"),
        F.when(edge, 0).otherwise(1).alias("border"),
    )


def reliabilities(patterns: list[tuple], rounds: int = 50) -> dict[tuple, float]:
    """Posterior that a span is personal data for each (kind, votes...) pattern; counts come last.

    Two classes and conditionally independent labelers. Silence is an outcome like any other. Counts are
    smoothed towards a labeler that is right four times out of five.
    """
    posterior = {}
    for *key, _ in patterns:
        votes = key[1:]
        yes, no = votes.count(1), votes.count(0)
        posterior[tuple(key)] = 0.9 if yes and not no else 0.1 if no > yes or votes[0] == 0 else 0.6
    for _ in range(rounds):
        prior: dict = {}
        outcome: dict = {}
        for *key, n in patterns:
            p = posterior[tuple(key)]
            for truth, weight in ((1, p), (0, 1 - p)):
                prior[key[0], truth] = prior.get((key[0], truth), 1.0) + n * weight
                for j, vote in enumerate(key[1:]):
                    outcome[key[0], j, vote, truth] = outcome.get((key[0], j, vote, truth), 0.0) + n * weight
        new = {}
        for *key, _ in patterns:
            score = {}
            for truth in (0, 1):
                total = prior[key[0], truth]
                score[truth] = math.log(total)
                for j, vote in enumerate(key[1:]):
                    pseudo = 4.0 if vote == truth else 1.0 if vote == 1 - truth else 2.5
                    score[truth] += math.log((outcome.get((key[0], j, vote, truth), 0.0) + pseudo) / (total + 7.5))
            new[tuple(key)] = 1 / (1 + math.exp(max(-500, min(500, score[0] - score[1]))))
        moved = max((abs(new[k] - posterior[k]) for k in new), default=0)
        posterior = new
        if moved < 1e-9:
            break
    return posterior


def features() -> Column:
    """What the final classifier looks at: an array of texts, one per feature."""
    value = F.col("value")
    n = F.length("value")
    share = F.floor(10 * F.length(digits(value)) / F.greatest(n, F.lit(1)))
    shape = lambda c: (
        F.when(F.length(c) == 0, "none").when(c.rlike("[0-9]"), "digit").when(c.rlike("[A-Za-z]"), "letter").when(c.rlike(r"\s"), "space").otherwise("mark")
    )
    told = [
        F.least(F.floor(n / 4), F.lit(12)),
        share,
        shape(F.right("before", F.lit(1))),
        shape(F.left("after", F.lit(1))),
        F.col("context"),
        F.col("form"),
        F.when(value.contains("("), 2).when(value.rlike(r"[\x20.-]"), 1).otherwise(0),
    ]
    return F.array(*[F.concat_ws("|", F.col("kind"), F.lit(str(i)), f.cast("string")) for i, f in enumerate(told)])


def _lookup(values: dict[str, float]) -> Column:
    """A map literal; ``values`` has a bounded number of entries."""
    if not values:
        return F.create_map().cast("map<string,double>")
    return F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[F.lit(float(v)) for v in values.values()]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", add_at: float = ADD_AT) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): rows (id, row) of all documents, and one row per span that is personal data.

    Spans: row, kind, start, end, value, base, score; positions count code points, end exclusive. A null
    text is empty. Spans of the base patterns have score 1; a wider span is added where the classifier alone
    gives at least ``add_at`` (its strict form is one vote and one feature) and it meets no base span. An empty table gives two empty results.
    """
    table = staged(candidates(docs, id_col, text_col), "pii-candidates")
    spans = located(table.where(F.size("pieces") > 0))
    judged = staged(voted(spans.withColumn("valid", F.coalesce(valid(F.col("kind"), F.col("value")), F.lit(False)))), "pii-votes")
    # At most kinds x 3 ** labelers patterns.
    patterns = [tuple(r) for r in judged.groupBy("kind", *VOTES).agg(F.count("*").alias("n")).collect()]
    posterior = reliabilities(patterns)
    key = F.concat_ws("|", "kind", *[F.col(v).cast("string") for v in VOTES])
    table_of = _lookup({"|".join(map(str, k)): v for k, v in posterior.items()})
    soft = judged.withColumn("p", F.coalesce(F.element_at(table_of, key), F.lit(0.0))).withColumn("features", features())
    counts = soft.select("kind", "p", F.explode("features").alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    priors = {r["kind"]: (r["yes"], r["no"]) for r in soft.groupBy("kind").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()}
    weight = {}
    for r in counts.collect():  # kinds x features x their few values
        yes, no = priors[r["f"].split("|")[0]]
        weight[r["f"]] = math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1))
    start = {k: math.log((yes + 0.5) / (no + 0.5)) for k, (yes, no) in priors.items()}
    logit = F.aggregate(
        F.col("features"), F.element_at(_lookup(start), F.col("kind")), lambda a, f: a + F.coalesce(F.element_at(_lookup(weight), f), F.lit(0.0))
    )
    scored = soft.withColumn("base", F.col("kind").isin(BASE) & F.col("valid")).withColumn(
        "score", F.when(F.col("base"), F.lit(1.0)).otherwise(1 / (1 + F.exp(-logit)))
    )
    chosen = scored.where(F.col("base") | (F.col("kind").isin(WIDER) & (F.col("score") >= add_at)))
    return table.select("id", "row"), without_overlaps(chosen).select("row", "kind", "start", "end", "value", "base", "score")


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Added spans that meet no base span, and no added span before them."""
    from pyspark.sql import Window

    before = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(1, Window.unboundedFollowing)
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(before)
    any_end = F.max("end").over(before)
    next_base = F.min(F.when(F.col("base"), F.col("start"))).over(after)
    free = (
        (F.coalesce(F.greatest(base_end, any_end), F.lit(0)) <= F.col("start")) & (F.coalesce(next_base, F.col("end")) >= F.col("end"))
    )
    return spans.withColumn("free", free).where("base or free")


def per_document(found: DataFrame, spans: DataFrame, kinds: list[str], base: list[str]) -> DataFrame:
    """Counts of base spans by kind, digest of the base spans and the text of all spans."""
    entry = F.struct("start", rank_of(F.col("kind"), kinds).alias("rank"), "end")
    grouped = spans.groupBy("row").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in base],
        F.collect_list(F.when(F.col("base"), entry)).alias("base_spans"),
        F.collect_list(entry).alias("all_spans"),
    )
    empty = F.lit("")
    return found.join(grouped, "row", "left").select(
        F.col("id").alias("doc_id"),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(F.coalesce(written(F.col("base_spans"), kinds), empty), 256).alias("base_sha256"),
        F.coalesce(written(F.col("all_spans"), kinds), empty).alias("spans"),
    )


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, spans = personal_data(documents(spark, sf_dir))
    return per_document(found, spans, KINDS, BASE)
