"""The registered queries in plain SQL, as an independent engine would answer them."""

from catalog.queries import ASKED_SOURCES, LEAF_KEYS, LEAF_MEASURES, LONG_TEXT, N_DRAWS, SEED, SUMMARY_DIGITS, THRESHOLDS


def rounded(value: str, digits: int) -> str:
    return f"floor(({value}) * 1e{digits} + 0.5) / 1e{digits}"


def summary(measures: list[str]) -> str:
    """The six statistics over base aggregates of each measure, rounded as the query rounds."""

    def each(pattern: str) -> str:
        return "[" + ", ".join(pattern.format(m) for m in measures) + "]"

    means, stds, variances = each("avg({})"), each("stddev_samp({})"), each("var_samp({})")
    values = {
        "mean_of_means": f"list_avg({means})",
        "std_of_means": f"list_stddev_samp({means})",
        "mean_of_stds": f"list_avg({stds})",
        "overall_range": f"list_max({each('max({})')}) - list_min({each('min({})')})",
        "correlation_matrix_trace": " + ".join(f"CASE WHEN var_samp({m}) > 0 THEN 1e0 ELSE 0e0 END" for m in measures),
        "total_variance": f"coalesce(list_sum({variances}), 0.0)",
    }
    return ", ".join(f"{rounded(v, SUMMARY_DIGITS[n])} AS {n}" for n, v in values.items())


def leaf_sql(source: str, keys: list[str], measures: list[str]) -> str:
    names = ", ".join(keys)
    return f"SELECT {names}, {summary(measures)} FROM {source} GROUP BY {names}"


# Draws: the same md5 bits, written in SQL.


def draw(*parts: str, seed: int = SEED) -> str:
    return f"concat_ws('|', '{seed}', {', '.join(parts)})"


def uniform(text: str, half: int = 0) -> str:
    return f"((('0x' || substr(md5({text}), {1 + 16 * half}, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496e0)"


def normal(text: str) -> str:
    return f"(sqrt(-2e0 * ln({uniform(text)})) * cos(2e0 * pi() * {uniform(text, 1)}))"


def numbered(text: str, i: int) -> str:
    """Uniform draw number ``i`` of a row."""
    return uniform(f"concat_ws('|', {text}, '{i // 2}')", i % 2)


def gamma(uniforms: list[str], scale: float = 1.0) -> str:
    return f"(-{scale:e} * ln({' * '.join(uniforms)}))"


def beta(left: list[str], right: list[str]) -> str:
    return f"(1e0 / (1e0 + {gamma(right)} / {gamma(left)}))"


EVENT_LEAVES = """(
    SELECT event_type AS source, strftime(ts, '%a') AS hierarchy_1,
           CASE WHEN hour(ts) < 12 THEN 'a m' ELSE 'p+m' END AS hierarchy_2,
           event_id::DOUBLE AS position, value FROM events)"""

DOC_KEYS = "lang, source, doc_id"
DOC_FEATURES = "(SELECT doc_id, n_chars AS text_n_chars, lang AS text_lang FROM documents)"
TYPES = """
    c AS (SELECT c_custkey AS custkey, c_nationkey AS customer_c_nationkey, c_acctbal AS customer_c_acctbal
          FROM customer),
    o AS (SELECT o_custkey AS custkey, count(*) AS orders_n, max(o_totalprice) AS orders_top_price
          FROM orders GROUP BY 1),
    e AS (SELECT user_id AS custkey, count(*) AS events_n, max(value) AS events_top_value FROM events GROUP BY 1)"""


def greedy_folds(source: str, group: str, n_folds: int) -> str:
    """CTEs ending in ``folds(grp, group_size, fold)``: the plain loop, largest group first."""
    loads = [f"load_{i}" for i in range(n_folds)]
    lightest = f"least({', '.join('w.' + name for name in loads)})"
    choice = "CASE " + " ".join(f"WHEN w.{name} = {lightest} THEN {i}" for i, name in enumerate(loads)) + " END"
    grown = ", ".join(f"w.{name} + CASE WHEN {choice} = {i} THEN r.group_size ELSE 0 END" for i, name in enumerate(loads))
    return f"""
    sizes AS (SELECT {group} AS grp, count(*) AS group_size FROM {source} GROUP BY 1),
    ranked AS (SELECT *, row_number() OVER (ORDER BY group_size DESC, grp DESC NULLS LAST) AS rn FROM sizes),
    walk(rn, {', '.join(loads)}, fold) AS (
        SELECT 0::BIGINT, {', '.join(['0::BIGINT'] * n_folds)}, -1::INTEGER
        UNION ALL
        SELECT r.rn, {grown}, ({choice})::INTEGER
        FROM walk w JOIN ranked r ON r.rn = w.rn + 1),
    folds AS (SELECT grp, group_size, fold FROM ranked JOIN walk USING (rn))"""


def hash_split(source: str, columns: str, text: str, fraction: str = "0.8e0", order: str | None = None) -> str:
    order = order or f"md5({text})"
    return f"""
    SELECT {columns}, row_number() OVER (ORDER BY {order}) <= floor(count(*) OVER () * {fraction}) AS is_train
    FROM {source}"""


REPORT = """
    counts AS (SELECT quality::DOUBLE AS label, (1 - toxic)::DOUBLE AS prediction, count(*) AS n FROM labels GROUP BY 1, 2),
    classes AS (SELECT label AS class FROM counts UNION SELECT prediction FROM counts),
    tallies AS (
        SELECT class,
               coalesce((SELECT sum(n) FROM counts WHERE label = class), 0)::BIGINT AS support,
               coalesce((SELECT sum(n) FROM counts WHERE prediction = class), 0)::BIGINT AS predicted,
               coalesce((SELECT sum(n) FROM counts WHERE label = class AND prediction = class), 0)::BIGINT AS hits
        FROM classes),
    report AS (
        SELECT *, coalesce(hits / nullif(predicted, 0)::DOUBLE, 0) AS precision,
                  coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall,
                  coalesce(2e0 * hits / nullif(support + predicted, 0), 0) AS f1
        FROM tallies)"""

LABELLED = "(SELECT doc_id, n_chars, source, quality FROM documents JOIN labels USING (doc_id))"
TRIALS = f"""
    {greedy_folds(LABELLED, 'source', 5)},
    trials AS (
        SELECT number, threshold, {rounded('avg(score)', 9)} AS value
        FROM (SELECT t.number, t.threshold, f.fold,
                     avg(CASE WHEN (d.n_chars > t.threshold)::INTEGER = d.quality THEN 1e0 ELSE 0e0 END) AS score
              FROM {LABELLED} d JOIN folds f ON f.grp = d.source
              JOIN (VALUES {', '.join(f'({i}, {t}::DOUBLE)' for i, t in enumerate(THRESHOLDS))}) t(number, threshold) ON true
              GROUP BY ALL)
        GROUP BY number, threshold)"""


def metric_rows() -> str:
    values = {
        "accuracy": "sum(hits) / sum(support)",
        "balanced_accuracy": "avg(recall) FILTER (WHERE support > 0)",
        "f1": "coalesce(max(f1) FILTER (WHERE class = 1), 0)",
        "f1_macro": "avg(f1)",
        "f1_weighted": "sum(f1 * support) / sum(support)",
        "precision_weighted": "sum(precision * support) / sum(support)",
    }
    rows = [f"SELECT '{n}' AS metric, {rounded(v, 9)} AS score FROM report" for n, v in values.items()]
    return f"WITH {REPORT} " + " UNION ALL ".join(rows)


def rollup() -> str:
    sets, parts = [], []
    for level in range(len(LEAF_KEYS)):
        known = LEAF_KEYS[: level + 1]
        sets.append("(" + ", ".join(known) + ")")
        parts.append(f"WHEN grouping({', '.join(LEAF_KEYS)}) = {2 ** (len(LEAF_KEYS) - 1 - level) - 1} THEN {level}")
    names = ", ".join(LEAF_KEYS)
    return (
        f"SELECT (CASE {' '.join(parts)} END)::INTEGER AS level, {names}, {summary(LEAF_MEASURES)} "
        f"FROM lineitem GROUP BY GROUPING SETS ({', '.join(sets)})"
    )


def correlations() -> str:
    cells = []
    for i, a in enumerate(LEAF_MEASURES):
        for b in LEAF_MEASURES[i:]:
            cells.append(
                f"SELECT l_returnflag, l_linestatus, '{a}' AS measure_a, '{b}' AS measure_b, "
                f"{rounded(f'coalesce(corr({a}, {b}), 0)', 8)} AS correlation FROM lineitem GROUP BY 1, 2"
            )
    return " UNION ALL ".join(cells)


def normal_columns(keys: list[str], n: int, prefix: str) -> str:
    return ", ".join(f"{rounded(normal(draw(*keys, repr(str(i)))), 7)} AS {prefix}{i}" for i in range(1, n + 1))


def synthetic() -> str:
    keys = ["source", "hierarchy_1", "hierarchy_2"]
    leaf = [numbered(draw(*keys), i) for i in range(4)]
    u = [f"u{i}" for i in range(29)]
    drawn = ", ".join(f"{numbered(draw(*keys, 'step'), i)} AS u{i}" for i in range(29))
    rates = ", ".join(f"0.02e0 + {leaf[i]} * (0.05e0 - 0.02e0) AS rate_{i}" for i in (1, 2, 3))

    def mask(i: int, value: str) -> str:
        return rounded(f"CASE WHEN u{24 + i} >= rate_{i} THEN {value} END", 6)

    def bell(i: int) -> str:
        return f"sqrt(-2e0 * ln(u{i})) * cos(2e0 * pi() * u{i + 1})"

    return f"""
    WITH leaves AS (
        SELECT n_name AS source, n_regionkey::VARCHAR AS hierarchy_1, s_suppkey::VARCHAR AS hierarchy_2
        FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    steps AS (SELECT *, {rates}, unnest(range((100 + floor({leaf[0]} * 200))::BIGINT)) AS step FROM leaves),
    draws AS (SELECT *, {drawn} FROM steps)
    SELECT source, hierarchy_1, hierarchy_2,
           CASE WHEN u28 < 0.8e0 THEN 'normal' WHEN u28 < 0.8e0 + 0.15e0 THEN 'warning' ELSE 'alert' END AS status_flag,
           strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(30 * step), '%Y-%m-%d %H:%M:%S') AS time,
           {mask(1, '50e0 + 10e0 * ' + bell(0))} AS measurement_1,
           {mask(2, gamma([u[2]], 5.0))} AS measurement_2,
           {rounded('100e0 * ' + beta(u[3:5], u[5:10]), 6)} AS measurement_3,
           {mask(3, gamma(u[10:13], 2.0))} AS sensor_reading_a,
           {rounded('exp(2e0 + 0.5e0 * ' + bell(13) + ')', 6)} AS sensor_reading_b,
           {rounded('100e0 * ' + beta(u[15:23], u[23:25]), 6)} AS quality_metric
    FROM draws"""


def span_sql() -> str:
    return "SELECT event_type, user_id, max(value) - min(value) AS span, count(value) AS n_values FROM events GROUP BY 1, 2"


MIXED = f"""
        WITH e AS (
            SELECT CASE WHEN event_id % 2 = 0 THEN '01' ELSE '1' END AS source, hierarchy_1, hierarchy_2, position,
                   CASE WHEN event_id % 10 <> 3 THEN value END AS value, event_id % 100 = 7 AS too_long
            FROM (SELECT *, position::BIGINT AS event_id FROM {EVENT_LEAVES})
        ), s AS ({leaf_sql('(SELECT * FROM e WHERE NOT too_long)', ['source', 'hierarchy_1', 'hierarchy_2'], ['position', 'value'])}
        ), r AS (
            SELECT source, hierarchy_1, hierarchy_2, sum((value IS NULL)::INTEGER + too_long::INTEGER)::BIGINT AS n_rejects
            FROM e WHERE value IS NULL OR too_long GROUP BY ALL
        )
        SELECT * FROM s FULL OUTER JOIN r USING (source, hierarchy_1, hierarchy_2)"""

POSITIVE = "(1e0 / (1e0 + exp(-(l_quantity - 25e0) / 10e0 - l_discount)))"


def study_report() -> str:
    """The split by md5, the greedy folds of its training side, and accuracies of the two rules that trees of depth 0 and 1 are."""
    docs = f"""(SELECT lang || '_' || source AS grp, lang, source, doc_id, (n_chars > {LONG_TEXT})::INTEGER AS long,
                       ((n_chars > {LONG_TEXT}) <> (doc_id % 10 = 0))::INTEGER AS label FROM documents)"""
    hits = "count(*) FILTER (WHERE long = {0} AND label = {0})::DOUBLE"
    ratio = lambda c, of: f"coalesce({hits.format(c)} / nullif(count(*) FILTER (WHERE {of} = {c}), 0), 0)"
    f1 = lambda c: f"coalesce(2e0 * {hits.format(c)} / nullif(count(*) FILTER (WHERE long = {c}) + count(*) FILTER (WHERE label = {c}), 0), 0)"
    right = "avg((long = label)::INTEGER::DOUBLE)"
    values = {
        "n_trials": "2", "best_value": "(SELECT max(value) FROM t)", "best_depth": "(SELECT arg_max(depth, value) FROM t)",
        "train_accuracy": f"(SELECT {right} FROM train)", "train_samples": "(SELECT count(*) FROM train)", "n_features": "1",
        "test_accuracy": f"(SELECT {right} FROM test)", "test_samples": "(SELECT count(*) FROM test)",
        "precision_macro": f"(SELECT ({ratio(0, 'long')} + {ratio(1, 'long')}) / 2e0 FROM test)",
        "recall_macro": f"(SELECT ({ratio(0, 'label')} + {ratio(1, 'label')}) / 2e0 FROM test)",
        "f1_macro": f"(SELECT ({f1(0)} + {f1(1)}) / 2e0 FROM test)",
        "trial_depth_0": "(SELECT value FROM t WHERE depth = 0)", "trial_depth_1": "(SELECT value FROM t WHERE depth = 1)",
    }
    rows = " UNION ALL ".join(f"SELECT '{n}' AS metric, {rounded(f'({v})::DOUBLE', 9)} AS value" for n, v in values.items())
    return f"""
        WITH RECURSIVE s AS ({hash_split(docs, 'grp, long, label', draw('lang', 'source', 'doc_id'))}),
        train AS (SELECT * FROM s WHERE is_train), test AS (SELECT * FROM s WHERE NOT is_train),
        {greedy_folds('train', 'grp', 3)},
        common AS (SELECT mode(label) AS usual FROM train),
        f AS (SELECT fold, {right} AS by_feature, avg((label = usual)::INTEGER::DOUBLE) AS by_class
              FROM train JOIN folds USING (grp), common GROUP BY fold),
        t AS (SELECT 0 AS depth, avg(by_class) AS value FROM f UNION ALL SELECT 1, avg(by_feature) FROM f)
        {rows}"""


ASKED = ", ".join(f"('{s}')" for s in ASKED_SOURCES)

ORACLES = {
    "leaf_statistics": leaf_sql("lineitem", LEAF_KEYS, LEAF_MEASURES),
    "leaf_statistics_all_numeric": leaf_sql("lineitem", LEAF_KEYS, ["l_orderkey", "l_partkey", "l_linenumber", *LEAF_MEASURES]),
    "hierarchy_rollup": rollup(),
    "correlation_matrix": correlations(),
    "correlation_matrix_wide": correlations(),
    "leaf_without_measures": "SELECT lang, source, "
    + ", ".join(f"NULL::DOUBLE AS {n}" for n in SUMMARY_DIGITS)
    + " FROM documents GROUP BY lang, source",
    "hierarchy_leaves": """
        SELECT DISTINCT lang, NULL::VARCHAR AS source, 0 AS level FROM documents
        UNION ALL SELECT DISTINCT lang, source, 1 FROM documents""",
    "source_filter": f"SELECT {DOC_KEYS}, n_chars FROM documents WHERE source IN (SELECT * FROM (VALUES {ASKED}))",
    "absent_sources": f"SELECT asked AS source FROM (VALUES {ASKED}) t(asked) WHERE asked NOT IN (SELECT source FROM documents)",
    "sample_select": f"SELECT {DOC_KEYS}, n_chars FROM documents WHERE lang = 'en' AND source = 'src7'",
    "artifact_semi_join": """
        SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
    "leaf_csv_scan": leaf_sql(EVENT_LEAVES, ["source", "hierarchy_1", "hierarchy_2"], ["position", "value"]),
    "leaf_csv_mixed": MIXED,
    "incremental_mixed": MIXED,
    "typed_cells": f"""
        SELECT event_type, count(reading) AS n_readings, count(*) FILTER (WHERE event_type = 'error') AS n_rejects,
               {rounded('coalesce(sum(reading), 0)', 3)} AS total
        FROM (SELECT event_type, CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS reading FROM events)
        GROUP BY event_type""",
    "artifact_roundtrip": leaf_sql(EVENT_LEAVES, ["source", "hierarchy_1", "hierarchy_2"], ["position", "value"]),
    "json_artifacts": leaf_sql(EVENT_LEAVES, ["source", "hierarchy_1", "hierarchy_2"], ["position", "value"]),
    "label_files": """
        SELECT lang, source, lpad(doc_id::VARCHAR, 12, '0') AS doc_id, quality, toxic / 4e0 AS share
        FROM documents JOIN labels USING (doc_id)""",
    "feature_files": """
        SELECT 'A' AS source, (user_id % 7)::VARCHAR AS hierarchy_1, event_type AS hierarchy_2,
               CASE WHEN user_id % 7 % 2 = 0 THEN count(*) END::DOUBLE AS shape_n, max(event_id)::DOUBLE AS shape_last
        FROM events GROUP BY user_id % 7, event_type""",
    "feature_roundtrip": f"SELECT {DOC_KEYS}, n_chars AS length_chars, length(source)::INTEGER AS shape_source FROM documents",
    "split_csv_roundtrip": "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "merge_feature_types": f"WITH {TYPES} SELECT * FROM c FULL OUTER JOIN o USING (custkey)",
    "merge_three_types": f"WITH {TYPES} SELECT * FROM c FULL OUTER JOIN o USING (custkey) FULL OUTER JOIN e USING (custkey)",
    "merge_repeated_keys": """
        SELECT custkey, o_orderkey, event_id
        FROM (SELECT o_custkey AS custkey, o_orderkey FROM orders) o
        FULL OUTER JOIN (SELECT user_id AS custkey, event_id FROM events) e USING (custkey)""",
    "union_sources": """
        SELECT 'customer' AS source, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
        UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""",
    "label_join": f"SELECT * FROM {DOC_FEATURES} JOIN labels USING (doc_id)",
    "unlabelled": f"SELECT * FROM {DOC_FEATURES} f WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id)",
    "labelled_mark": f"""
        SELECT f.*, l.quality, l.toxic, l.doc_id IS NOT NULL AS has_label
        FROM {DOC_FEATURES} f LEFT JOIN labels l ON l.doc_id = f.doc_id""",
    "labelled_mark_repeated": """
        SELECT c_custkey, c_acctbal, o_orderstatus, o_custkey IS NOT NULL AS has_label
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey""",
    "duplicate_label_keys": "SELECT o_custkey AS custkey, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(*) > 1",
    "arranged_set": """
        SELECT d.lang, d.source, d.doc_id::VARCHAR AS doc_id, d.n_chars, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "dataset_descriptor": """
        SELECT count(*) AS n_samples, 2 AS n_features, true AS has_labels, false AS is_inference,
               'labels' AS label_file_path, 'doc_id' AS hierarchy_structure, 'documents' AS sources,
               'text' AS feature_types, 'doc_id,text_n_chars,text_lang' AS feature_columns, 'doc_id' AS index_columns
        FROM documents JOIN labels USING (doc_id)""",
    "source_names": """
        SELECT lang, array_to_string(list_sort(list(DISTINCT source)), '_') AS set_name, count(*) AS n_samples
        FROM documents GROUP BY lang""",
    "version_next": """
        SELECT p_brand, (coalesce(max(TRY_CAST(split_part(name, '_', 2) AS BIGINT))
                                  FILTER (WHERE name LIKE 'features\\_%' ESCAPE '\\'), 0) + 1)::BIGINT AS next_version
        FROM (SELECT p_brand, unnest(['features_' || p_size, 'features_' || p_name, 'ver_9' || p_size]) AS name FROM part)
        GROUP BY p_brand""",
    "row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("lineitem", "events", "documents", "labels")
    ),
    "train_test_split": hash_split("labels", "*", draw("doc_id")),
    "split_repeated_keys": f"""
        SELECT event_type, is_train, count(*) AS n_rows
        FROM ({hash_split('events', 'event_type', draw('event_type'), '0.7e0')}) GROUP BY 1, 2""",
    "split_in_key_order": hash_split("labels", "*", "", order="doc_id"),
    "group_aware_split": f"""
        SELECT user_id, is_train, count(*) AS n_rows
        FROM events JOIN ({hash_split('(SELECT DISTINCT user_id FROM events)', 'user_id', draw('user_id'))}) USING (user_id)
        GROUP BY 1, 2""",
    "group_key": "SELECT doc_id, lang || '_' || source AS pair, lang || '_' || source || '_' || doc_id AS \"full\" FROM documents",
    "sample_id": f"SELECT {DOC_KEYS}, row_number() OVER (ORDER BY {DOC_KEYS}) - 1 AS sample_id FROM documents",
    "row_position": "SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM labels",
    "positional_join": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "group_folds": f"WITH RECURSIVE {greedy_folds('events', 'user_id', 5)} SELECT grp AS user_id, group_size, fold FROM folds",
    "fold_sizes": f"""
        WITH RECURSIVE {greedy_folds('(SELECT CASE WHEN user_id % 17 <> 0 THEN user_id END AS known_user FROM events)', 'known_user', 5)}
        SELECT fold, sum(group_size)::BIGINT AS n_rows, count(*) AS n_groups FROM folds GROUP BY fold""",
    "confusion_counts": f"WITH {REPORT} SELECT label, prediction, n AS n_rows FROM counts",
    "class_report": f"""
        WITH {REPORT} SELECT class, support, predicted, hits, {rounded('precision', 9)} AS precision,
               {rounded('recall', 9)} AS recall, {rounded('f1', 9)} AS f1 FROM report""",
    "classification_report": f"""
        WITH {REPORT} SELECT {rounded('sum(hits) / sum(support)', 9)} AS accuracy, sum(support)::BIGINT AS n_samples,
               {rounded('avg(precision)', 9)} AS precision_macro, {rounded('avg(recall)', 9)} AS recall_macro,
               {rounded('avg(f1)', 9)} AS f1_macro FROM report""",
    "metric_by_name": metric_rows(),
    "roc_auc_by_group": f"""
        WITH r AS (SELECT lang, quality, n_chars // 50 AS score FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
        k AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2e0 AS place FROM r),
        t AS (SELECT lang, sum(place) FILTER (WHERE quality = 1) AS places, sum(quality)::DOUBLE AS p, sum(1 - quality)::DOUBLE AS n FROM k GROUP BY lang)
        SELECT lang, {rounded('(places - p * (p + 1) / 2e0) / nullif(p * n, 0)', 9)} AS roc_auc FROM t""",
    "threshold_search": f"WITH RECURSIVE {TRIALS} SELECT * FROM trials",
    "best_trial": f"WITH RECURSIVE {TRIALS} SELECT * FROM trials ORDER BY value DESC, number LIMIT 1",
    "normal_features": f"""
        SELECT user_id, {normal_columns(['user_id'], N_DRAWS, 'random_feature_')}
        FROM (SELECT DISTINCT user_id FROM events)""",
    "clip_and_mask": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_quantity, 5e0), 45e0) AS quantity,
               CASE WHEN {uniform(draw('l_orderkey', 'l_linenumber', 'l_partkey'))} >= 0.03e0
                    THEN greatest(l_extendedprice, 20000e0) END AS price
        FROM lineitem""",
    "synthetic_series": synthetic(),
    "preprocess_job": f"""
        SELECT {', '.join(LEAF_KEYS)}, {', '.join(f'{n} AS feature_engineer_{n}' for n in SUMMARY_DIGITS)},
               {normal_columns(LEAF_KEYS, 3, 'feature_engineer_random_feature_')}
        FROM ({leaf_sql('lineitem', LEAF_KEYS, LEAF_MEASURES)})""",
    "custom_leaf_stage": span_sql(),
    "whole_leaf_stream": f"""
        WITH t AS (
            SELECT event_type, value, row_number() OVER w - 1 AS i, max(value) OVER w - value AS down
            FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
        SELECT event_type, {rounded('max(down)', 6)} AS fall, arg_max(i, (down, -i)) AS rows_before, count(*) AS n_rows
        FROM t GROUP BY event_type""",
    "custom_model": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, ({POSITIVE} > 1e0 - {POSITIVE})::INTEGER AS prediction,
               {rounded('1e0 - ' + POSITIVE, 9)} AS probability_class_0, {rounded(POSITIVE, 9)} AS probability_class_1
        FROM lineitem""",
    "forest_predictions_checks": """
        SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, floor(count(*) * 0.8e0)::BIGINT AS n_train,
               count(*) AS n_sums, count(*) AS n_likeliest FROM embeddings""",
    "scored_source_checks": """
        SELECT count(*) AS n_rows, 0::BIGINT AS first_id, count(*) - 1 AS last_id, count(*) AS n_ids,
               count(DISTINCT vec_id) AS n_groups, count(*) AS n_sums, count(*) AS n_likeliest FROM embeddings""",
    "study_report": study_report(),
    "incremental_stats": leaf_sql("(SELECT user_id, value, event_id::DOUBLE AS position FROM events)", ["user_id"], ["value", "position"]),
}
