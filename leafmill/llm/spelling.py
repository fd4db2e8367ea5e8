"""Spelling variants by asymmetric chunks: words that differ by one edit, and the form that a variant belongs to.

Of two words one edit apart the shorter (or, of equally long ones, the smaller) gives two disjoint chunks, its
halves; the other gives its positional grams. One edit touches one half at most, so the other half is a gram of
the longer word: the first half at its own place, the second one shifted by the difference of the lengths, that
is by none or one. Grams at other places can meet no chunk and are not made. Pairs that share a chunk are
verified by their edit distance.

A chunk that very many words share would pair them all. Beyond ``CROWD`` pairs a key, the part of the word that
is still open is halved again: the edit leaves one of those halves alone too, which joins the key. This goes on
down to one open letter, where the alphabet bounds what can meet. No pair is lost, at any size of a group.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmill.llm.common import LOWER, UPPER, documents, staged, text_of

LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: One in so many runs loses a letter.
SLIP = 97
#: Pairs of chunks and grams under one key from which on the key is made longer.
CROWD = 1_024


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP) -> DataFrame:
    """(word, n): the words of all whole texts; a run whose hash says so has lost a letter."""
    lowered = F.translate(text_of(text_col), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"),
    )
    # A shorter run gives no word, whether it loses a letter or not.
    runs = runs.select("run", F.length("run").alias("size"), "id").where(F.col("size") >= LEAST_LENGTH)
    hashed = runs.select("run", "size", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.col("size")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    made = hashed.select(F.when(F.col("h") % slip == 0, without).otherwise(F.col("run")).alias("word"))
    counts = made.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def opened(words: DataFrame) -> DataFrame:
    """Both halves left open in turn, as chunk of the shorter word and as gram of the longer: word, n, chunk, size, apart, a, b.

    ``size``: length of the word that gives the chunk; ``apart``: how much longer the other one is. Of the first
    word the letters from a to b are open, of the second one those from a to b + apart.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(chunk).alias("chunk"), F.lit(apart).alias("apart")) for chunk in (True, False) for apart in (0, 1)]))
    rows = words.select("word", "n", F.length("word").alias("length"), sides.alias("s")).select("word", "n", "length", "s.*")
    rows = rows.withColumn("size", F.when(F.col("chunk"), F.col("length")).otherwise(F.col("length") - F.col("apart")))
    whole = rows.where(F.col("size") >= 2).select("word", "n", "chunk", "size", "apart", F.lit(0).alias("a"), F.col("size").alias("b"))
    return halved(whole)


def halved(rows: DataFrame) -> DataFrame:
    """Each open part becomes two: its first half closed, and its second half closed."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    parts = F.array(F.struct(middle.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), middle.alias("b")))
    return rows.select("word", "n", "chunk", "size", "apart", F.explode(parts).alias("open")).select("word", "n", "chunk", "size", "apart", "open.*")


def key() -> Column:
    """Hash of what is closed, and of where; pairs are verified, so a collision costs a comparison only."""
    end = F.col("b") + F.when(F.col("chunk"), F.lit(0)).otherwise(F.col("apart"))
    before = F.substring("word", F.lit(1), F.col("a"))
    behind = F.substring("word", end + 1, F.length("word"))
    return F.xxhash64("size", "apart", "a", "b", before, behind)


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(u, n_u, v, n_v): every two words of ``words`` (word, n; written) that are one edit apart, once, u the chunk's word."""
    rows, found = opened(words), None
    while True:
        keyed = staged(rows.withColumn("key", key()), "word-chunks")
        sized = keyed.groupBy("key").agg(F.count_if("chunk").alias("chunks"), F.count_if(~F.col("chunk")).alias("grams"), F.max(F.col("b") - F.col("a")).alias("open"))
        met = staged(sized.where("chunks > 0 AND grams > 0").withColumn("crowded", (F.col("chunks") * F.col("grams") > crowd) & (F.col("open") > 1)), "met-chunks")
        joined = keyed.join(met.select("key", "crowded"), "key")
        plain = joined.where("NOT crowded")
        chunks = plain.where("chunk").select("key", "apart", F.col("word").alias("u"), F.col("n").alias("n_u"))
        grams = plain.where("NOT chunk").select("key", F.col("word").alias("v"), F.col("n").alias("n_v"))
        pairs = chunks.join(grams, "key").where(((F.col("apart") == 1) | (F.col("u") < F.col("v"))) & (F.levenshtein("u", "v", 1) == 1))
        pairs = staged(pairs.select("u", "n_u", "v", "n_v").distinct(), "near-words")
        found = pairs if found is None else found.unionByName(pairs)
        if met.where("crowded").isEmpty():
            return found.distinct()
        rows = halved(joined.where("crowded").select("word", "n", "chunk", "size", "apart", "a", "b"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form (word, form): forms followed to the end, in doubling steps.

    A form is at least twice as frequent as its word, so a way has at most 62 steps and no circle.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Columns word, form, root, n, n_near, form_n: one row per word of at least 5 letters and 3 occurrences.

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of them (ties: the first in
    code-point order) if it is at least twice as frequent as the word, else null, and ``form_n`` its count;
    ``root`` follows forms to the last one, and is the word itself without a form. A null text has no words; a null
    id counts as empty text. Rows that are repeated count as often as they are there. Columns of other names play
    no part; an empty table gives an empty result.
    """
    words = staged(words_of(docs, id_col, text_col), "words")
    pairs = near_pairs(words, crowd)
    sides = pairs.select(F.col("u").alias("word"), F.col("v").alias("other"), F.col("n_v").alias("other_n")).unionByName(
        pairs.select(F.col("v").alias("word"), F.col("u").alias("other"), F.col("n_u").alias("other_n"))
    )
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other"))).alias("best"))
    counted = words.join(best, "word", "left")
    is_form = -F.col("best.rank") >= 2 * F.col("n")
    formed = staged(
        counted.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.rank")).alias("form_n"),
        ),
        "formed",
    )
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir).select("doc_id", "text"))


#: Letters beyond ASCII become single bytes, since this dialect's edit distance counts bytes; words hold no capitals.
_WIDE = "".join(chr(c) for c in range(0xC0, 0x100))
_NARROW = "".join(chr(c) for c in range(33, 127) if not chr(c).islower() and chr(c) != "'")[: len(_WIDE)]

OP13_SQL = rf"""
WITH RECURSIVE steps AS (
  SELECT c, 0 AS i, c AS v FROM range(256) t(c)
  UNION ALL
  SELECT c, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE i < 8
), crc AS (
  SELECT list(v ORDER BY c) AS tab FROM steps WHERE i = 8
), runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[{LETTERS}]+')) AS run FROM documents)
  WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run
), bytes AS (
  SELECT doc_id, run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, k, xor(list_reduce(
           list_prepend(4294967295, list_transform(range(CAST(length(x) // 2 AS BIGINT)),
             lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
           lambda s, b: xor(s >> 8, tab[1 + (xor(s, b) & 255)])), 4294967295) AS h
  FROM bytes, crc
), made AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, k FROM hashed
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n, translate(word, '{_WIDE}', '{_NARROW}') AS w
  FROM made WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n
  FROM words a JOIN words b ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND a.word <> b.word
  WHERE levenshtein(a.w, b.w) = 1
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word
), first AS (
  SELECT near.word, min(other) AS other FROM near JOIN best ON near.word = best.word AND other_n = most GROUP BY near.word
), formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN most >= 2 * words.n THEN first.other END AS form, CASE WHEN most >= 2 * words.n THEN most END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word LEFT JOIN first ON words.word = first.word
), way AS (
  SELECT word, word AS last, 0 AS i FROM formed
  UNION ALL
  SELECT way.word, formed.form, i + 1 FROM way JOIN formed ON way.last = formed.word WHERE formed.form IS NOT NULL
), ends AS (
  SELECT word, arg_max(last, i) AS root FROM way GROUP BY word
)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN ends ON formed.word = ends.word
"""
