"""Mixing towards target weights with soft domains and projected-gradient least squares.

A Gaussian naive Bayes classifier, fitted on the labelled rows by one aggregation, gives every document its
probabilities over the domains ``good``, ``poor`` and ``toxic``. Among its measures is the evidence of the words:
two thirds of the labelled rows, by a hash of the id, yield the word beginnings that stand out in a domain, with
their log-odds in whole steps; a text's evidence is the sum of the steps of those that it holds, for its length.
The other third fits the classifier. Document rates ``r >= 0`` then solve

    min over r of  1/2 * sum over domains d of (sum over documents i of r_i * t_i * p_id  -  target_d) ** 2

by projected gradient from ``r = 1``, with ``t_i`` the tokens of a document. Rates are measured in tokens (a
rate of a long document weighs as much as those of many short ones), which makes the step of a document
``r_i <- max(0, r_i - step * sum over d of p_id * residual_d)``. One iteration is one aggregation to as many
sums as there are domains; the driver sees those, never rates. Steps follow the last change (Barzilai and
Borwein), and fall back to the safe step when the misfit has not come down.

Everything here is DataFrame functions. Rates are a chain of short expressions over a written table of
probabilities, and are written down every ``WRITE_EVERY`` steps. Once the steps are known, a rate follows from the
probabilities of its own document alone, so that texts need not travel to meet their rates.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmill.llm.common import SPACE, documents, read_table, staged, text_of

DOMAINS = ["good", "poor", "toxic"]
#: Shares of all tokens.
TARGETS = {"good": 0.9, "poor": 0.09, "toxic": 0.01}
#: Domains whose words are learned, and the domains that they are told from.
EVIDENCE = {"poor": ["good"], "toxic": ["good", "poor"]}
#: Columns of the probabilities.
P = [f"p{d}" for d in range(len(DOMAINS))]
MEASURES = ["length", "word_length", "symbols", "capitals", "marks", "new_words", "new_lines", *[f"{d}_words" for d in EVIDENCE]]
#: Letters of a word beginning; labelled rows that words are learned from, at most about; word beginnings of a domain.
BEGINNING = 7
SAMPLE = 24_000
ENTRIES = 1_000
#: A word beginning counts when so many texts of its domain hold it, so many deviations more than its share, at
#: log-odds of one or more, in steps up to STEP.
LEAST_TEXTS = 4
DEVIATIONS = 5
STEP = 4
STEPS = 60
WRITE_EVERY = 10
CLOSE = 1e-6


def domain() -> Column:
    """Domain of a labelled row; null where a label is missing."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when((F.col("quality") == 0) & (F.col("toxic") == 0), "poor")


def beginnings() -> Column:
    """The beginnings of the ``words`` of a text, in the order of the words."""
    return F.transform("words", lambda w: F.substring(F.lower(w), 1, BEGINNING))


def besides_text(rows: DataFrame) -> list[str]:
    """Columns besides the text."""
    return [name for name in rows.columns if name != "text"]


def with_words(rows: DataFrame) -> DataFrame:
    """Rows (id, text and any others) with ``t`` in place of the text, a null one being empty, and its ``words``."""
    read = rows.select(*besides_text(rows), text_of("text").alias("t"))
    return read.withColumn("words", F.array_remove(F.split("t", SPACE), ""))


def domains_of(labels: DataFrame) -> DataFrame:
    """(id, domain, learns) of labelled ids; of a repeated id the last domain in alphabetical order counts."""
    named = labels.select(F.col("doc_id").alias("id"), domain().alias("domain")).where("id is not null and domain is not null")
    return named.groupBy("id").agg(F.max("domain").alias("domain")).withColumn("learns", F.pmod(F.xxhash64(F.lit("words"), "id"), F.lit(3)) > 0)


def evidence(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, list[list[str]]]:
    """For each domain of ``EVIDENCE`` the word beginnings of every step of log-odds, one and up.

    From at most about ``sample`` labelled rows, picked by hash, so that their ids may be broadcast.
    """
    known = domains_of(labels).where("learns")
    n = known.count()
    kept = min(1.0, sample / n) if n else 0.0
    picked = known.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1_000_000)) < int(kept * 1_000_000))
    picked = F.broadcast(picked.select("id", "domain"))
    marked = with_words(rows.join(picked, "id", "left_semi")).join(picked, "id").select("domain", F.array_distinct(beginnings()).alias("parts"))
    marked = staged(marked, "labelled-words")
    totals = {r["domain"]: r["n"] for r in marked.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    counts = marked.select("domain", F.explode("parts").alias("part")).groupBy("part").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS])
    counts = staged(counts.where(" OR ".join(f"{d} >= {LEAST_TEXTS}" for d in EVIDENCE)), "word-beginnings")
    out = {}
    for name, others in EVIDENCE.items():
        n_in, n_out = totals.get(name, 0), sum(totals.get(o, 0) for o in others)
        met, elsewhere = F.col(name), sum((F.col(o) for o in others), F.lit(0))
        odds = F.log((met + 0.5) / (n_in + 1.0)) - F.log((elsewhere + 0.5) / (n_out + 1.0))
        # How far above its share of all texts that hold the word, in deviations.
        share = max(n_in, 0.5) / (max(n_in, 0.5) + n_out + 0.5)
        expected = (met + elsewhere) * F.lit(share)
        stands_out = (met - expected) / F.sqrt(expected * (1 - share))
        found = counts.where((met >= LEAST_TEXTS) & (odds >= 1) & (stands_out >= DEVIATIONS))
        found = found.select("part", F.least(F.floor(odds), F.lit(STEP)).cast("int").alias("step"), stands_out.alias("weight"))
        steps: list[list[str]] = [[] for _ in range(STEP)]
        for part, step, _ in found.orderBy(F.desc("weight"), "part").limit(ENTRIES).collect():
            steps[step - 1].append(part)
        out[name] = [sorted(parts) for parts in steps]
    return out


def among(parts: Column | str, listed: list[str]) -> Column:
    """Those ``parts`` that are listed."""
    return F.filter(parts, lambda part: part.isin(listed))


def measured(rows: DataFrame, words: dict[str, list[list[str]]]) -> DataFrame:
    """The columns of ``rows`` (id, text and any others) besides the text, its tokens and its measures."""
    # A lookup a word, in one set of all learned beginnings; what is left of a text is short.
    learned = sorted({part for steps in words.values() for parts in steps for part in parts})
    held = F.array_distinct(among(beginnings(), learned))
    read = with_words(rows).withColumn("lines", F.split("t", "\n")).withColumn("held", held)
    # Texts are long and have few of these characters; one pass takes them out.
    read = read.withColumn("signs", F.regexp_replace("t", r"[^#*$%&|<>A-Z.,;:!?]+", ""))
    n, size = F.size("words"), F.length("t")
    share = lambda x, of: F.coalesce(x / F.when(of > 0, of), F.lit(0.0)).cast("double")
    counted = lambda pattern: F.length("signs") - F.length(F.regexp_replace("signs", pattern, ""))

    def spoken(steps: list[list[str]]) -> Column:
        hits = [F.size(among("held", parts)) * (i + 1) for i, parts in enumerate(steps) if parts]
        return F.sqrt(share(sum(hits, F.lit(0)), n))

    return read.select(
        *besides_text(rows),
        n.cast("long").alias("tokens"),
        F.log1p(n).alias("length"),
        share(size, n).alias("word_length"),
        F.sqrt(share(counted(r"[#*$%&|<>]+"), size)).alias("symbols"),
        F.sqrt(share(counted("[A-Z]+"), size)).alias("capitals"),
        F.sqrt(share(counted("[.,;:!?]+"), size)).alias("marks"),
        share(F.size(F.array_distinct("words")), n).alias("new_words"),
        share(F.size(F.array_distinct("lines")), F.size("lines")).alias("new_lines"),
        *[spoken(words[d]).alias(f"{d}_words") for d in EVIDENCE],
    )


def fitted(table: DataFrame, labels: DataFrame) -> dict[str, tuple[float, list[tuple[float, float]]]]:
    """Prior and (mean, variance) of every measure by domain, from the labelled rows that no words were learned from."""
    known = table.join(domains_of(labels), "id")
    sums = [f for m in MEASURES for f in (F.avg(m).alias(f"mean_{m}"), F.var_pop(m).alias(f"var_{m}"))]
    rows = known.where("NOT learns").groupBy("domain").agg(F.count("*").alias("n"), *sums).collect()
    if len(rows) < known.select("domain").distinct().count():  # too few labels to keep the parts separate
        rows = known.groupBy("domain").agg(F.count("*").alias("n"), *sums).collect()
    total = sum(r["n"] for r in rows)
    return {r["domain"]: (r["n"] / total, [(r[f"mean_{m}"], max(r[f"var_{m}"], 1e-4)) for m in MEASURES]) for r in rows}


def posteriors(table: DataFrame, model: dict) -> DataFrame:
    """Adds ``p``, an array of probabilities in the order of ``DOMAINS``; even ones if nothing is labelled."""
    if not model:
        return table.withColumn("p", F.array(*[F.lit(1.0 / len(DOMAINS)) for _ in DOMAINS]))

    def log_density(name: str) -> Column:
        if name not in model:
            return F.lit(-700.0)
        prior, moments = model[name]
        out = F.lit(math.log(prior))
        for measure, (mean, var) in zip(MEASURES, moments):
            out = out - (F.col(measure) - F.lit(mean)) ** 2 / F.lit(2 * var) - F.lit(0.5 * math.log(2 * math.pi * var))
        return out

    logs = table.withColumn("logs", F.array(*[log_density(d) for d in DOMAINS]))
    # Measures are not independent; half the evidence keeps the probabilities soft.
    raised = logs.withColumn("e", F.transform("logs", lambda x: F.exp(F.greatest(F.lit(-350.0), 0.5 * (x - F.array_max("logs"))))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return raised.withColumn("total", total).withColumn("p", F.transform("e", lambda x: x / F.col("total"))).drop("logs", "e", "total")


def probable(table: DataFrame, model: dict) -> DataFrame:
    """Adds the probabilities of the domains as p0, p1, ..."""
    return posteriors(table, model).withColumns({name: F.col("p")[d] for d, name in enumerate(P)}).drop("p")


def goals(soft: DataFrame, targets: dict[str, float], size: float, rest: str | None) -> dict[str, float]:
    """Tokens to reach by domain; ``soft`` has tokens and p0, p1, ..."""
    tokens = soft.agg(F.sum("tokens")).first()[0] or 0
    if rest is not None and tokens:
        now = soft.agg(*[F.sum(F.col("tokens") * F.col(p)) for p in P]).first()
        targets = {d: min(targets[d], now[i] / tokens) for i, d in enumerate(DOMAINS) if d != rest}
        targets[rest] = 1 - sum(targets.values())
    return {d: targets[d] * size * tokens for d in DOMAINS}


def stepped(pulls: list[list[float]]) -> Column:
    """The rate of a document (p0, p1, ...) after the steps that subtract ``pulls`` times its probabilities."""
    rate = F.lit(1.0)
    for pull in pulls:
        down = F.lit(0.0)
        for name, x in zip(P, pull):
            down = down + F.col(name) * F.lit(x)
        rate = F.greatest(F.lit(0.0), rate - down)
    return rate


def solved(table: DataFrame, targets: dict[str, float], steps: int = STEPS) -> tuple[DataFrame, list[list[float]]]:
    """Adds ``rate`` to a table with tokens and p0, p1, ...: projected gradient to ``targets`` in tokens.

    The table is written already; a step reads only its numbers. Also returns the steps that led to the rates, as
    ``stepped`` takes them.
    """
    k = len(DOMAINS)
    p = [F.col(name) for name in P]
    goal = [targets[d] for d in DOMAINS]
    rate = F.lit(1.0)
    before: Column = rate

    def sums(rate: Column, before: Column) -> tuple[list[float], float]:
        r = table.agg(
            *[F.sum(F.col("tokens") * rate * p[d]).alias(f"s{d}") for d in range(k)],
            F.sum(F.col("tokens") * (rate - before) ** 2).alias("moved"),
        ).first()
        return [r[f"s{d}"] or 0.0 for d in range(k)], r["moved"] or 0.0

    gram = table.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not gram["t"]:
        return table.withColumn("rate", F.lit(1.0)), []
    # The largest eigenvalue of sum of t p p' is at most sum of t, as p sums to one.
    safe = 1.0 / gram["t"]
    made, _ = sums(rate, rate)
    residual = [m - g for m, g in zip(made, goal)]
    misfits = [sum(x * x for x in residual)]
    best, best_rate = misfits[0], rate
    pulls: list[list[float]] = []
    taken = 0
    step, scale = safe, max(1.0, sum(g * g for g in goal))
    for i in range(1, steps + 1):
        if misfits[-1] <= CLOSE**2 * scale:
            break
        before = rate
        pulls.append([step * residual[d] for d in range(k)])
        pull = F.lit(0.0)
        for d in range(k):
            pull = pull + p[d] * F.lit(pulls[-1][d])
        rate = F.greatest(F.lit(0.0), before - pull)
        if i % WRITE_EVERY == 0:
            table = staged(table.withColumn("next_rate", rate).withColumn("next_before", before).drop("rate", "before").withColumnsRenamed({"next_rate": "rate", "next_before": "before"}), "rates")
            rate, before = F.col("rate"), F.col("before")
            best_rate = None
        new, moved = sums(rate, before)
        change = sum((a - b) ** 2 for a, b in zip(new, made))
        made, residual = new, [m - g for m, g in zip(new, goal)]
        misfits.append(sum(x * x for x in residual))
        if best_rate is None or misfits[-1] <= best:
            best, best_rate, taken = misfits[-1], rate, i
        # Barzilai and Borwein, unless the misfit rose over the last five.
        step = moved / change if change > 0 and misfits[-1] <= max(misfits[-6:-1]) else safe
    return table.withColumn("rate", best_rate), pulls[:taken]


def copies_of(rate: Column) -> Column:
    """The rate rounded up or down by a hash of the id."""
    u = F.pmod(F.xxhash64(F.lit("mix"), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("int")


def mixed(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS, size: float = 1.0,
    rest: str | None = None,
) -> DataFrame:
    """Columns id, row, tokens, p_good, p_poor, p_toxic, rate, copies: one row per row of ``docs``.

    ``targets``: shares of ``size`` times the tokens of ``docs``. With ``rest``, the shares of the other
    domains are upper bounds: none is raised above what it has now, and ``rest`` gets what is left. ``copies`` is the rate rounded up or down by
    a hash of the id, so that copies add up to rates: 0 drops a document, 2 doubles it. Ids may be null or
    repeated. Texts without words have rates like any other. Without labels all domains are equally likely.
    An empty table gives an empty result. ``row`` numbers the rows of the result; a second scan of ``docs`` need
    not number them alike.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    table = staged(measured(rows, evidence(rows, labels)), "measures")
    soft = staged(probable(table, fitted(table, labels)).select("id", "row", "tokens", *P), "posteriors")
    rated = solved(soft, goals(soft, targets, size, rest))[0].withColumn("rate", F.round("rate", 6))
    return rated.select(
        "id", "row", "tokens", *[F.round(p, 6).alias(f"p_{name}") for p, name in zip(P, DOMAINS)], "rate",
        copies_of(F.col("rate")).alias("copies"),
    )


def remixed(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] = TARGETS, size: float = 1.0,
    rest: str | None = None,
) -> DataFrame:
    """The rows of ``docs``, each as many times as its rate says, all columns; options as in ``mixed``.

    Rows are written once, with their measures beside them; neither rows nor texts are shuffled. ``docs`` is read twice, once
    for its labelled rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct("*").alias("own"))
    table = staged(measured(rows, evidence(rows, labels)), "measures")
    model = fitted(table, labels)
    soft = staged(probable(table.drop("own"), model).select("tokens", *P), "posteriors")
    pulls = solved(soft, goals(soft, targets, size, rest))[1]
    # No filter: pushed down, it would work out the probabilities anew for every step.
    copies = F.array_repeat(F.lit(1), copies_of(F.round(stepped(pulls), 6)))
    return probable(table, model).select("own", F.explode(copies)).select("own.*")


def op3_soft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir), read_table(spark, sf_dir, "labels")).select(
        F.col("id").alias("doc_id"), "tokens", "p_good", "p_poor", "p_toxic", "rate", "copies"
    )
