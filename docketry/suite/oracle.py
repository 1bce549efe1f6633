"""SQL counterparts of the queries, for an independent engine."""

from __future__ import annotations

from docketry.functions.stop_words import ENGLISH
from docketry.suite.view_sql import with_views

ORACLE: dict[str, str] = {}


def sql(name: str, views: str, body: str) -> None:
    ORACLE[name] = with_views(views, body) if views else body


def _stop_list() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)


TOKENS = "regexp_extract_all(lower(claim_text), '[\\p{L}\\p{N}_]{2,}')"

# --- identifiers, dates, classes
sql("numeric_ids", "apps", "SELECT application_number, app_id, patent_num, status FROM apps")
sql("date_coercion", "apps",
    "SELECT application_number, appl_status_date_dt AS status_date, patent_issue_date_dt AS issue_date FROM apps")
sql("norm_class_counts", "apps", 'SELECT uspc_class_str, count(*) AS "count" FROM apps GROUP BY 1')
sql("publication_numbers", "applications", """
    SELECT application_number,
           regexp_replace(regexp_replace(earliest_pgpub_number, '^US', ''), '[a-zA-Z]\\d{0,1}$', '')
             AS publication_number FROM applications""")
sql("document_keys", "office_actions", """
    SELECT regexp_replace(split_part(ifw_number, '.', 1), '^0*', '') AS ifw_number, count(*) AS "count"
    FROM office_actions GROUP BY 1""")
sql("year_quarter_counts", "patents", """
    SELECT CAST(year(CAST(patent_date AS DATE)) AS INTEGER) AS issue_year,
           CAST(quarter(CAST(patent_date AS DATE)) AS INTEGER) AS issue_quarter, count(*) AS "count"
    FROM patents GROUP BY 1, 2""")
sql("quarter_end_buckets", "patents", """
    SELECT q AS quarter_issue_date_dt, count(*) AS "count", CAST(q > DATE '1998-06-19' AS INTEGER) AS post
    FROM (SELECT CAST(last_day(date_trunc('quarter', CAST(patent_date AS DATE) + 1) + INTERVAL 2 MONTH) AS DATE) AS q
          FROM patents) GROUP BY 1""")

# --- claim texts
sql("claim_number_strip", "pregrant_claims", """
    SELECT document_number, claim_sequence,
           regexp_replace(regexp_replace(claim_text, '^\\d{1,3}\\.{0,1}\\s', ''), '^\\s+|\\s+$', '', 'g') AS issued_form,
           regexp_replace(regexp_replace(claim_text, '^\\d{1,3}\\s{0,}\\.{0,1}\\s', ''), '^\\s+|\\s+$', '', 'g')
             AS pregrant_form,
           regexp_replace(claim_text, '^\\d{1,3}\\.{0,1}\\s', '') AS final_form
    FROM pregrant_claims""")
sql("dependent_reference", "claims", """
    SELECT source, CAST(sum(CAST(regexp_matches(claim_text, '\\bclaims?\\s+\\d+\\b') AS INTEGER)) AS BIGINT)
             AS with_reference, count(*) AS n_claims
    FROM claims GROUP BY 1""")
sql("cancelled_claims", "claims", """
    SELECT patent_id, claim_sequence, claim_text FROM claims
    WHERE contains(regexp_replace(claim_text, '[^A-Za-z]', '', 'g'), 'canceled')
      AND length(regexp_replace(claim_text, '[^A-Za-z]', '', 'g')) < 20""")
sql("independent_claims", "independent_issued", "SELECT patent_id, claim_sequence, claim_text FROM independent_issued")
sql("pregrant_independent_claims", "independent_pregrant",
    "SELECT document_number, claim_sequence, claim_text FROM independent_pregrant")
sql("application_claim_extract", "app_claims", "SELECT * FROM app_claims")
GRANTED = "SELECT DISTINCT patent_num FROM apps WHERE status = 150 AND patent_num IS NOT NULL"
sql("patent_claim_extract", "independent_issued apps", f"""
    SELECT CAST(patent_id AS BIGINT) AS patent_id, claim_sequence, claim_text FROM independent_issued
    WHERE CAST(patent_id AS BIGINT) IN ({GRANTED})""")
sql("unique_claim_ids", "claims", "SELECT patent_id || '_' || claim_sequence AS unique_claim_id FROM claims")
sql("orphan_claims", "claims apps", f"""
    SELECT CAST(patent_id AS BIGINT) AS patent_id, claim_sequence FROM claims
    WHERE CAST(patent_id AS BIGINT) NOT IN ({GRANTED})""")

# --- rejections, treated claims
sql("rejection_grounds", "rejections", """
    SELECT count(*) FILTER (alice_in = 1) AS one_ground,
           count(*) FILTER (alice_in = 1 OR bilski_in = 1 OR mayo_in = 1 OR myriad_in = 1) AS any_ground,
           count(*) AS n_rows FROM rejections""")
sql("pure_subject_matter_rejections", "pure",
    "SELECT app AS app_id, ifw AS ifw_number, mail_dt, claim_numbers FROM pure")
sql("rejected_applications", "apps rejections", """
    SELECT CAST(year(filing_date_dt) AS INTEGER) AS filing_year, uspc_class_str, count(*) AS "count"
    FROM apps JOIN rejections r ON apps.app_id = CAST(r.app_id AS BIGINT) GROUP BY 1, 2""")
sql("affected_claim_membership", "named_claims", "SELECT app_id, claim_int, claim_numbers, claim_text FROM named_claims")
sql("publication_match", "named_with_app", """
    SELECT app_id, claim_int, pgpub_number, earliest_pgpub_number FROM named_with_app WHERE right_publication""")
sql("date_logic", "named_with_app", """
    SELECT app_id, claim_int, mail_dt, filing_date, appl_status_date, earliest_pgpub_date
    FROM named_with_app WHERE logical_dates""")
sql("treated_claims", "treated_rows",
    "SELECT app_id, claim_int, claim_text, uspc_class_str, filing_date_dt FROM treated_rows")
sql("attrition_funnel", "named_with_app", """
    SELECT CAST(0 AS INTEGER) AS step, 'named_claims' AS step_name, count(*) AS n_rows, count(DISTINCT app_id) AS n_ids
    FROM named_with_app
    UNION ALL SELECT 1, 'right_publication', count(*), count(DISTINCT app_id) FROM named_with_app WHERE right_publication
    UNION ALL SELECT 2, 'final_status', count(*), count(DISTINCT app_id) FROM named_with_app
      WHERE right_publication AND final_status
    UNION ALL SELECT 3, 'logical_dates', count(*), count(DISTINCT app_id) FROM named_with_app
      WHERE right_publication AND final_status AND logical_dates
    UNION ALL SELECT 4, 'not_cancelled', count(*), count(DISTINCT app_id) FROM treated_rows""".replace(
        "treated_rows", "(SELECT * FROM named_with_app WHERE right_publication AND final_status AND logical_dates"
                        " AND not_cancelled)"))
_FLAGS = ["rejection_fp_mismatch", "rejection_102", "rejection_103", "rejection_112", "rejection_dp"]
sql("action_funnel", "office_actions", " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS step, '{name}' AS step_name, count(*) AS n_rows, count(DISTINCT app_id) AS n_ids"
    f" FROM office_actions WHERE true" + "".join(f" AND {f} IS DISTINCT FROM 1" for f in _FLAGS[:i])
    for i, name in enumerate(["all", *_FLAGS])))

# --- controls and the training table
COHORT = """
    rejected AS (SELECT a.filing_date_dt, a.uspc_class_str FROM apps a
                 JOIN rejections r ON a.app_id = CAST(r.app_id AS BIGINT) WHERE true),
    main AS (SELECT uspc_class_str FROM rejected WHERE uspc_class_str IS NOT NULL GROUP BY 1
             ORDER BY count(*) DESC, 1 LIMIT 10),
    cohort AS (SELECT * FROM apps WHERE status = 150
               AND year(filing_date_dt) IN (SELECT year(filing_date_dt) FROM rejected)
               AND uspc_class_str IN (SELECT uspc_class_str FROM main))"""


def cohort_sql(body: str, views: str = "apps rejections office_actions") -> str:
    return with_views(views, "").rstrip() + ",\n" + COHORT + "\n" + body


NO_ACTION = "app_id NOT IN (SELECT CAST(app_id AS BIGINT) FROM office_actions)"
ORACLE["control_cohort_anti"] = cohort_sql(
    f"SELECT app_id, uspc_class_str, filing_date_dt, status FROM cohort WHERE {NO_ACTION}")
for _name, _grounds, _classes in (
    ("control_cohort_four_grounds", "alice_in = 1 OR bilski_in = 1 OR mayo_in = 1 OR myriad_in = 1", 100),
    ("control_cohort_one_ground", "alice_in = 1", 50),
):
    ORACLE[_name] = ORACLE["control_cohort_anti"].replace("WHERE true)", f"WHERE {_grounds})").replace(
        "LIMIT 10", f"LIMIT {_classes}")
ORACLE["control_cohort_101"] = cohort_sql("""
    SELECT app_id, patent_num, uspc_class_str, patent_issue_date_dt FROM cohort
    WHERE patent_issue_date_dt > DATE '1998-06-19' AND patent_num IS NOT NULL
      AND app_id NOT IN (SELECT CAST(app_id AS BIGINT) FROM office_actions WHERE rejection_101 = 1)""")
ORACLE["control_documents"] = cohort_sql(f"""
    SELECT DISTINCT document_number, app_id, filing_date_dt, filing_year FROM publications
    WHERE app_id IN (SELECT app_id FROM cohort WHERE {NO_ACTION})""",
    "apps rejections office_actions publications")
ISSUED_CONTROLS = """
    SELECT a.*, CAST(c.claim_sequence AS BIGINT) AS claim_int, c.claim_text
    FROM apps a JOIN independent_issued c ON a.patent_num = CAST(c.patent_id AS BIGINT)"""
PREGRANT_CONTROLS = """
    SELECT a.*, c.pgpub_number, c.claim_int, c.claim_text FROM apps a JOIN app_claims c ON a.app_id = c.app_id
    WHERE NOT (contains(regexp_replace(c.claim_text, '[^A-Za-z]', '', 'g'), 'canceled')
               AND length(regexp_replace(c.claim_text, '[^A-Za-z]', '', 'g')) < 20)
      AND (regexp_replace(split_part(c.pgpub_number, '.', 1), '^0*', '')
             = regexp_replace(regexp_replace(a.earliest_pgpub_number, '^US', ''), '[a-zA-Z]\\d{0,1}$', '')
           OR regexp_replace(split_part(c.pgpub_number, '.', 1), '^0*', '') = '')"""
sql("control_claims_issued", "apps independent_issued",
    f"SELECT app_id, patent_num, claim_int, claim_text FROM ({ISSUED_CONTROLS})")
sql("control_claims_pregrant", "apps app_claims",
    f"SELECT app_id, pgpub_number, claim_int, claim_text FROM ({PREGRANT_CONTROLS})")
sql("top_classes", "apps", """
    SELECT uspc_class_str, count(*) AS "count" FROM apps GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4""")
sql("class_cumulative_share", "apps", """
    SELECT uspc_class_str, c AS "count", round(c / n, 6) AS share, round(sum(c / n) OVER (ORDER BY c DESC, uspc_class_str
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cum_share
    FROM (SELECT uspc_class_str, count(*) AS c, CAST((SELECT count(*) FROM apps) AS DOUBLE) AS n FROM apps GROUP BY 1
          ORDER BY 2 DESC, 1 LIMIT 10)""")
sql("class_shares", "apps", """
    SELECT uspc_class_str, count(*) AS "count", round(count(*) / CAST((SELECT count(*) FROM apps) AS DOUBLE), 6) AS share
    FROM apps GROUP BY 1""")
CELLS = """
    SELECT uspc_class_str, filing_year, count(*) AS "count",
           count(*) / CAST((SELECT count(*) FROM training WHERE treated = 1) AS DOUBLE) AS relative_freq
    FROM training WHERE treated = 1 GROUP BY 1, 2"""
sql("cell_frequencies", "training", f"""
    SELECT c.uspc_class_str, c.filing_year, c."count", count(*) AS controls, round(c.relative_freq, 6) AS relative_freq
    FROM training t JOIN ({CELLS}) c ON t.uspc_class_str = c.uspc_class_str AND t.filing_year = c.filing_year
    WHERE t.treated = 0 GROUP BY ALL""")
U = "((({k} % 2147483648 + 2147483648) % 2147483648 * 2654435761) % 4294967296 + 0.5) / 4294967296.0"
sql("weighted_sample", "training", f"""
    SELECT t.app_id, t.uspc_class_str, t.filing_year
    FROM training t JOIN ({CELLS}) c ON t.uspc_class_str = c.uspc_class_str AND t.filing_year = c.filing_year
    WHERE t.treated = 0
    ORDER BY -ln(CAST({U.format(k='t.app_id')} AS DOUBLE)) / c.relative_freq, t.app_id
    LIMIT (SELECT count(*) FROM training WHERE treated = 1)""")
sql("uniform_sample", "", f"SELECT doc_id, lang FROM documents ORDER BY {U.format(k='doc_id')}, doc_id LIMIT 100")
sql("stratified_split", "split", "SELECT app_id, treated, is_test FROM split")
sql("dedup_first", "", """
    SELECT doc_id, lang, source, text FROM (
      SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
sql("repeated_claims", "scored_claims", """
    SELECT patent_id || '_' || claim_sequence AS unique_claim_id, count(*) AS "count" FROM scored_claims
    GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10""")
sql("distinct_counts", "office_actions", """
    SELECT count(DISTINCT app_id) AS distinct_app_id, count(DISTINCT ifw_number) AS distinct_ifw_number
    FROM office_actions""")
sql("year_bounds", "claims", "SELECT min(year) AS min_year, max(year) AS max_year FROM claims")
sql("clamped_years", "claims", """
    SELECT year, count(*) AS "count" FROM claims
    WHERE year BETWEEN greatest((SELECT min(year) FROM claims), 2012) AND least((SELECT max(year) FROM claims), 2020)
    GROUP BY 1""")


def training_sql(controls: str, weight: str, classes: str = "") -> str:
    unique = """
      (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_text, app_id, earliest_pgpub_number
                      ORDER BY claim_int) AS r FROM ({rows})) WHERE r = 1)"""
    return with_views("treated_rows apps independent_issued app_claims", "").rstrip() + f""",
    t AS {unique.format(rows="SELECT * FROM treated_rows")},
    main AS ({classes or "SELECT uspc_class_str FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20"}),
    chosen AS (SELECT *, year(filing_date_dt) AS fy FROM t WHERE uspc_class_str IN (SELECT * FROM main)),
    cells AS (SELECT uspc_class_str, fy, count(*) / CAST((SELECT count(*) FROM chosen) AS DOUBLE) AS f
              FROM chosen GROUP BY 1, 2),
    c AS {unique.format(rows=f"SELECT * FROM ({controls}) WHERE patent_issue_date_dt > DATE '1998-06-19'")},
    pool AS (SELECT c.*, f, count(*) OVER (PARTITION BY c.uspc_class_str, fy) AS size
             FROM c JOIN cells ON c.uspc_class_str = cells.uspc_class_str AND year(c.filing_date_dt) = fy),
    drawn AS (SELECT * FROM pool
              ORDER BY -ln(CAST({U.format(k='(app_id * 1000 + claim_int)')} AS DOUBLE)) / ({weight}),
                       app_id, claim_int
              LIMIT (SELECT count(*) FROM chosen))
    SELECT app_id, regexp_replace(claim_text, '^\\d{{1,3}}\\.{{0,1}}\\s', '') AS claim_text,
           CAST(treated AS INTEGER) AS treated
    FROM (SELECT app_id, claim_text, 1 AS treated FROM chosen UNION ALL SELECT app_id, claim_text, 0 FROM drawn)"""


ORACLE["balanced_training"] = training_sql(ISSUED_CONTROLS, "f")
ORACLE["balanced_training_of_classes"] = training_sql(ISSUED_CONTROLS, "f", "SELECT unnest(['3', '7', '12']) AS uspc_class_str")
ORACLE["balanced_training_pregrant"] = training_sql(PREGRANT_CONTROLS, "f / size")
sql("union_of_extracts", "independent_issued app_claims", """
    SELECT 'control' AS role, 'issued' AS origin, count(*) AS "count" FROM independent_issued
    UNION ALL SELECT 'control', 'pregrant', count(*) FROM app_claims""")

# --- affected patents and applications
AFFECTED = """
    main AS (SELECT uspc_class_str FROM apps GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4),
    ids AS (SELECT DISTINCT patent_id FROM (
              SELECT TRY_CAST(patent_id AS BIGINT) AS patent_id FROM uspc
              WHERE regexp_replace(split_part(mainclass_id, '.', 1), '^0*', '') IN (SELECT * FROM main)
              UNION ALL SELECT patent_num FROM apps WHERE uspc_class_str IN (SELECT * FROM main))
            WHERE patent_id IS NOT NULL),
    grp AS (SELECT group_id, count(*) AS "count" FROM inventional WHERE patent_id IN (SELECT * FROM ids)
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"""


def affected_sql(body: str, views: str = "") -> str:
    return with_views(f"apps uspc inventional {views}", "").rstrip() + ",\n" + AFFECTED + "\n" + body


ORACLE["union_of_ids"] = affected_sql("SELECT patent_id FROM ids")
ORACLE["cpc_concordance"] = affected_sql("SELECT * FROM grp")
ORACLE["affected_patents"] = affected_sql(
    "SELECT DISTINCT patent_id FROM inventional WHERE group_id IN (SELECT group_id FROM grp)")
ORACLE["affected_patents_one_class"] = ORACLE["affected_patents"].replace(
    "SELECT uspc_class_str FROM apps GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4", "SELECT '3' AS uspc_class_str").replace(
    "LIMIT 5", "LIMIT 3")
ORACLE["group_shares"] = affected_sql("""
    SELECT group_id, c AS "count", round(c / n, 6) AS share, round(sum(c / n) OVER (ORDER BY c DESC, group_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cum_share
    FROM (SELECT group_id, count(*) AS c,
                 CAST((SELECT count(*) FROM inventional WHERE patent_id IN (SELECT * FROM ids)) AS DOUBLE) AS n
          FROM inventional WHERE patent_id IN (SELECT * FROM ids) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""")
sql("distinct_rows", "inventional", "SELECT patent_id, group_id FROM inventional")
CURRENT = """SELECT pgpub_id, cpc_subclass FROM cpc_pregrant
             WHERE cpc_type = 'inventional' AND cpc_version_indicator = '2013-01-01'"""
sql("application_targets_left_join", "publications uspc_pregrant cpc_pregrant", f"""
    SELECT document_number, count(*) AS n_rows, count(u.uspc_mainclass_id) AS with_class,
           count(c.cpc_subclass) AS with_group
    FROM publications p LEFT JOIN uspc_pregrant u ON p.document_number = u.pgpub_id
    LEFT JOIN ({CURRENT}) c ON p.document_number = c.pgpub_id GROUP BY 1""")
ORACLE["application_targets_by_class"] = affected_sql("""
    SELECT DISTINCT p.app_id, regexp_replace(split_part(u.uspc_mainclass_id, '.', 1), '^0*', '') AS uspc_class,
           p.document_number, p.filing_date_dt, p.filing_year
    FROM publications p JOIN uspc_pregrant u ON p.document_number = u.pgpub_id
    WHERE regexp_replace(split_part(u.uspc_mainclass_id, '.', 1), '^0*', '') IN (SELECT * FROM main)""",
    "publications uspc_pregrant")
ORACLE["application_targets_by_group"] = affected_sql(f"""
    SELECT DISTINCT p.app_id, c.cpc_subclass AS group_id, p.document_number, p.filing_date_dt, p.filing_year
    FROM publications p JOIN ({CURRENT}) c ON p.document_number = c.pgpub_id
    WHERE c.cpc_subclass IN (SELECT group_id FROM grp)""", "publications cpc_pregrant")
_IN = ">= DATE '1996-01-01' AND CAST({c} AS DATE) < DATE '1998-01-01'"


def _window(c: str) -> str:
    return f"CAST({c} AS DATE) " + _IN.format(c=c)


_PUB = f"(SELECT pgpub_id FROM publications_raw WHERE {_window('filing_date')})"
_PAT = f"(SELECT patent_id FROM patents WHERE {_window('patent_date')})"
_APP = f"(SELECT application_number FROM applications WHERE {_window('filing_date')})"
sql("raw_subset_cascade",
    "publications_raw patents cpc_pregrant cpc uspc uspc_pregrant applications office_actions rejections",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {t} WHERE {c}" for n, t, c in [
        ("publications", "publications_raw", _window("filing_date")), ("patents", "patents", _window("patent_date")),
        ("cpc_pregrant", "cpc_pregrant", f"pgpub_id IN {_PUB}"), ("cpc", "cpc", f"patent_id IN {_PAT}"),
        ("uspc", "uspc", f"patent_id IN {_PAT}"), ("uspc_pregrant", "uspc_pregrant", f"pgpub_id IN {_PUB}"),
        ("applications_2017", "applications", _window("filing_date")),
        ("applications_2020", "applications", _window("filing_date")),
        ("office_actions", "office_actions", f"app_id IN {_APP}"), ("rejections", "rejections", f"app_id IN {_APP}"),
    ]))

# --- panel and regressions
sql("first_claim_treatment", "treatment", "SELECT * FROM treatment")
sql("did_panel", "series", """
    SELECT group_id, quarter_issue_date_dt, "Treated", "Count", "Post", round("log_Count", 6) AS "log_Count",
           round(normalized_count, 6) AS "normalized_Count" FROM series""")
sql("mean_series", "series", """
    SELECT quarter_issue_date_dt, "Treated", round(avg(normalized_count), 6) AS mean, count(*) AS groups
    FROM series GROUP BY 1, 2""")


def _coefs(value: str) -> str:
    return f"""
    SELECT term, round(coef, 6) + 0.0 AS coef FROM (
      SELECT unnest(['Intercept', 'Treated', 'Post', 'Treated:Post']) AS term,
             unnest([m00, m10 - m00, m01 - m00, m11 - m10 - m01 + m00]) AS coef
      FROM (SELECT {', '.join(value.format(t=t, p=p) + f' AS m{t}{p}' for t in (0, 1) for p in (0, 1))} FROM panel))"""


sql("did_coefficients", "panel", _coefs('avg("log_Count") FILTER ("Treated" = {t} AND "Post" = {p})'))
sql("poisson_cell_means", "panel", _coefs('ln(avg("Count") FILTER ("Treated" = {t} AND "Post" = {p}))'))
# Cell sums give the Poisson covariance; inverse cell sums add up along the contrasts.
sql("poisson_regression", "panel", """
    SELECT term, round(coef, 6) + 0.0 AS coef, round(se, 6) + 0.0 AS std_err FROM (
      SELECT unnest(['Intercept', 'Treated', 'Post', 'Treated:Post']) AS term,
             unnest([ln(a00), ln(a10) - ln(a00), ln(a01) - ln(a00), ln(a11) - ln(a10) - ln(a01) + ln(a00)]) AS coef,
             unnest([sqrt(1 / s00), sqrt(1 / s00 + 1 / s10), sqrt(1 / s00 + 1 / s01),
                     sqrt(1 / s00 + 1 / s10 + 1 / s01 + 1 / s11)]) AS se
      FROM (SELECT """ + ", ".join(
    f"""avg("Count") FILTER ("Treated" = {t} AND "Post" = {p}) AS a{t}{p},
        CAST(sum("Count") FILTER ("Treated" = {t} AND "Post" = {p}) AS DOUBLE) AS s{t}{p}"""
    for t in (0, 1) for p in (0, 1)) + " FROM panel))")
# In the saturated design a coefficient's score per group is a contrast of residual sums over cell sizes.
sql("did_clustered_errors", "panel", """
    SELECT term, round(sqrt(v * g / (g - 1) * (n - 1) / (n - 4)), 6) + 0.0 AS std_err FROM (
      SELECT unnest(['Intercept', 'Treated', 'Post', 'Treated:Post']) AS term,
             unnest([sum(e00 * e00), sum((e10 - e00) ** 2), sum((e01 - e00) ** 2),
                     sum((e11 - e10 - e01 + e00) ** 2)]) AS v,
             count(*) AS g, (SELECT count(*) FROM panel) AS n
      FROM (SELECT group_id, """ + ", ".join(
    f"""coalesce(sum(r / k) FILTER ("Treated" = {t} AND "Post" = {p}), 0) AS e{t}{p}"""
    for t in (0, 1) for p in (0, 1)) + """
            FROM (SELECT *, "log_Count" - avg("log_Count") OVER w AS r, count(*) OVER w AS k FROM panel
                  WINDOW w AS (PARTITION BY "Treated", "Post")) GROUP BY 1))""")

# --- terms
sql("term_frequency", "word_tf",
    "SELECT treated, term, CAST(sum(tf) AS BIGINT) AS tf FROM word_tf GROUP BY 1, 2")
CLEAN = """list_filter(string_split_regex(
    regexp_replace(regexp_replace(regexp_replace(lower(claim_text), '<([^>]+)>', '', 'g'),
      '[!"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]+', ' ', 'g'), '[0-9]+', '', 'g'), '\\s+'),
    lambda t: length(t) >= 3 AND t NOT IN (STOPS))"""
sql("clean_token_counts", "training",
    f"SELECT treated, term, count(*) AS tf FROM (SELECT treated, unnest({CLEAN}) AS term FROM training) GROUP BY 1, 2"
    .replace("STOPS", _stop_list()))
sql("stop_word_filter", "training", f"""
    SELECT app_id, len(l) AS n_tokens, len(list_filter(l, lambda t: t NOT IN ({_stop_list()}))) AS n_kept,
           len(l) AS n_parity
    FROM (SELECT app_id, list_filter({TOKENS}, lambda t: length(t) > 2) AS l FROM training)""")
sql("document_frequency", "word_df", """
    SELECT term, df FROM word_df WHERE df >= 10 AND df <= 0.5 * (SELECT count(*) FROM training)""")
sql("ngram_counts", "training", f"""
    SELECT term, count(*) AS tf FROM (
      SELECT unnest(list_concat(l, list_concat(
               [l[i] || ' ' || l[i + 1] for i in range(1, len(l))],
               [l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] for i in range(1, len(l) - 1)]))) AS term
      FROM (SELECT {TOKENS} AS l FROM training)) GROUP BY 1""")
sql("tfidf_weights", "word_tfidf", "SELECT app_id, term, tf, round(weight, 6) AS weight FROM word_tfidf")
sql("tf_weights_without_idf", "word_tf word_df", """
    SELECT app_id, term, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY app_id)), 6) AS weight
    FROM (SELECT t.app_id, t.term, CAST(t.tf AS DOUBLE) AS tf FROM word_tf t JOIN word_df d ON t.term = d.term
          WHERE df >= 10 AND df <= 0.5 * (SELECT count(*) FROM training))""")


def contrast_sql(views: str, rows: str, label: str) -> str:
    head = with_views(views, "").rstrip()
    return head + f""",
    counts AS MATERIALIZED (SELECT term, count(*) FILTER ({label} = 1) AS treated_count, count(*) FILTER ({label} = 0) AS control_count
               FROM (SELECT {label}, unnest({TOKENS}) AS term FROM {rows})
               WHERE term NOT IN ({_stop_list()}) GROUP BY 1),
    diff AS MATERIALIZED (SELECT *, treated_count / sqrt((SELECT sum(CAST(treated_count AS DOUBLE) ** 2) FROM counts))
                     - control_count / sqrt((SELECT sum(CAST(control_count AS DOUBLE) ** 2) FROM counts)) AS d FROM counts)
    SELECT term, treated_count, control_count,
           round(greatest(d, 0.0::DOUBLE) / sqrt((SELECT sum(greatest(d, 0.0::DOUBLE) ** 2) FROM diff)), 6) + 0.0
             AS treated_weight,
           round(greatest(-d, 0.0::DOUBLE) / sqrt((SELECT sum(greatest(-d, 0.0::DOUBLE) ** 2) FROM diff)), 6) + 0.0
             AS control_weight FROM diff"""


ORACLE["differential_terms"] = contrast_sql("training", "training", "treated")
LINES = "(SELECT DISTINCT claim_text, claim_sequence % 2 AS treated FROM claims)"


def swept_sql(rounds: int = 60) -> str:
    """Two-way means taken off in turn; with so many rounds the rest is below the digits compared."""
    parts = ["""swept_0 AS MATERIALIZED (SELECT group_id AS e, quarter_issue_date_dt AS t, "log_Count" AS y,
        CAST("Treated" AS DOUBLE) AS x1, CAST("Treated" * "Post" AS DOUBLE) AS x2 FROM panel)"""]
    for i in range(2 * rounds):
        less = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {'te'[i % 2]}) AS {c}" for c in ("y", "x1", "x2"))
        parts.append(f"swept_{i + 1} AS MATERIALIZED (SELECT e, t, {less} FROM swept_{i})")
    return with_views("panel", "").rstrip() + ",\n" + ",\n".join(parts) + f""",
    sums AS (SELECT sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS c, sum(x1 * y) AS p, sum(x2 * y) AS q
             FROM swept_{2 * rounds})
    SELECT 'Treated' AS term, round((p * c - q * b) / (a * c - b * b), 6) + 0.0 AS coef FROM sums
    UNION ALL SELECT 'Treated:Post', round((q * a - p * b) / (a * c - b * b), 6) + 0.0 FROM sums"""


ORACLE["fixed_effects_coefficients"] = swept_sql()
ORACLE["negative_binomial_coefficients"] = ORACLE["poisson_cell_means"]
ORACLE["predicted_word_contrast"] = contrast_sql("claims", LINES, "treated")
sql("predicted_word_table", "claims", f"""
    SELECT CAST(treated AS INTEGER) AS treated, term, count(*) AS tf
    FROM (SELECT treated, unnest({TOKENS}) AS term FROM {LINES}) WHERE term NOT IN ({_stop_list()}) GROUP BY 1, 2""")
sql("lime_aggregate", "word_weights",
    'SELECT word, round(avg(weight), 6) + 0.0 AS mean, count(*) AS "count" FROM word_weights GROUP BY 1')
sql("lime_top_words", "word_weights", """
    , agg AS (SELECT word, round(avg(weight), 6) AS mean, count(*) AS "count" FROM word_weights GROUP BY 1)
    SELECT 'treated' AS side, word, "count" FROM (SELECT * FROM agg WHERE mean > 0 ORDER BY "count" DESC, word LIMIT 200)
    UNION ALL
    SELECT 'control', word, "count" FROM (SELECT * FROM agg WHERE mean < 0 ORDER BY "count" DESC, word LIMIT 200)""")

# --- classifiers
BAYES = """
    , mass AS (SELECT term, coalesce(sum(weight) FILTER (treated = 0), 0) AS w0,
                      coalesce(sum(weight) FILTER (treated = 1), 0) AS w1 FROM word_tfidf GROUP BY 1),
    theta AS (SELECT term, ln((w0 + 1) / ((SELECT sum(w0) FROM mass) + (SELECT count(*) FROM mass))) AS t0,
                     ln((w1 + 1) / ((SELECT sum(w1) FROM mass) + (SELECT count(*) FROM mass))) AS t1 FROM mass),
    raw AS (SELECT t.app_id, coalesce(s0, 0) + (SELECT ln(avg(CAST(treated = 0 AS INTEGER))) FROM training) AS score_0,
                   coalesce(s1, 0) + (SELECT ln(avg(CAST(treated = 1 AS INTEGER))) FROM training) AS score_1
            FROM training t LEFT JOIN (SELECT app_id, sum(weight * t0) AS s0, sum(weight * t1) AS s1
                                       FROM word_tfidf w JOIN theta USING (term) GROUP BY 1) s ON t.app_id = s.app_id)
    SELECT app_id, round(score_0, 6) AS score_0, round(score_1, 6) AS score_1,
           CAST(score_1 > score_0 AS INTEGER) AS predicted_label FROM raw"""
sql("naive_bayes_scores", "word_tfidf", BAYES)
sql("reloaded_model_scores", "word_tfidf", BAYES)
sql("knn_vote", "word_tfidf split", """
    , pairs AS (SELECT q.app_id, t.app_id AS neighbour, t.treated FROM split q, split t
                WHERE q.is_test = 1 AND t.is_test = 0),
    sims AS (SELECT a.app_id, b.app_id AS neighbour, sum(a.weight * b.weight) AS s
             FROM word_tfidf a JOIN word_tfidf b ON a.term = b.term GROUP BY 1, 2),
    ranked AS (SELECT p.*, row_number() OVER (PARTITION BY p.app_id
                 ORDER BY coalesce(round(s, 6), 0) DESC, p.neighbour) AS r
               FROM pairs p LEFT JOIN sims ON p.app_id = sims.app_id AND p.neighbour = sims.neighbour)
    SELECT app_id, round(avg(treated), 6) + 0.0 AS p1, CAST(avg(treated) > 0.5 AS INTEGER) AS predicted_label
    FROM ranked WHERE r <= 5 GROUP BY 1""")

# --- evaluation
C4 = """, c AS (SELECT count(*) FILTER (label = 0 AND prediction = 0)::DOUBLE AS tn,
                       count(*) FILTER (label = 0 AND prediction = 1)::DOUBLE AS fp,
                       count(*) FILTER (label = 1 AND prediction = 0)::DOUBLE AS fn,
                       count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp FROM predictions),
    s AS (SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, tn + fp AS s0,
                 tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fn + fp) AS f1, tp + fn AS s1,
                 (tn + tp) / (tn + fp + fn + tp) AS acc,
                 (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc FROM c)"""
sql("confusion_matrix", "predictions", C4 + """
    SELECT CAST(label AS INTEGER) AS label, CAST(predicted AS INTEGER) AS predicted, CAST(n AS BIGINT) AS n,
           round(share, 6) + 0.0 AS share
    FROM (SELECT unnest([0, 0, 1, 1]) AS label, unnest([0, 1, 0, 1]) AS predicted, unnest([tn, fp, fn, tp]) AS n,
                 unnest([tn / s0, fp / s0, fn / s1, tp / s1]) AS share FROM s)""")
_METRICS = [(k, m) for k in ("0", "1", "macro avg", "weighted avg") for m in ("precision", "recall", "f1-score", "support")]
_VALUES = ["p0", "r0", "f0", "s0", "p1", "r1", "f1", "s1", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "s0 + s1",
           "(p0 * s0 + p1 * s1) / (s0 + s1)", "(r0 * s0 + r1 * s1) / (s0 + s1)", "(f0 * s0 + f1 * s1) / (s0 + s1)",
           "s0 + s1"]
_ALL = [("all", m) for m in ("accuracy", "precision_score", "recall_score", "f1_score", "mcc")]
sql("classification_report", "predictions", C4 + " UNION ALL ".join(
    f"SELECT '{k}' AS class, '{m}' AS metric, round({e}, 6) + 0.0 AS value FROM s"
    for (k, m), e in zip(_METRICS + _ALL, _VALUES + ["acc"] * 4 + ["mcc"])))
sql("report_by_class", "predictions", C4 + " UNION ALL ".join(
    "SELECT '{}' AS class, round({}, 6) AS \"precision\", round({}, 6) AS recall, round({}, 6) AS f1_score,"
    " round({}, 6) AS support FROM s".format(k, *_VALUES[4 * i:4 * i + 4])
    for i, k in enumerate(("0", "1", "macro avg", "weighted avg"))))
sql("model_scores", "predictions", C4 + """
    SELECT round(acc, 6) AS precision_score, round(acc, 6) AS recall_score, round(acc, 6) AS f1_score,
           round(acc, 6) AS accuracy_score, round(mcc, 6) + 0.0 AS mcc FROM s""")
CURVE = """, per AS (SELECT score, count(*) FILTER (label = 1) AS ntp, count(*) FILTER (label = 0) AS nfp
                     FROM predictions GROUP BY 1),
    curve AS (SELECT *, CAST(sum(ntp) OVER w AS DOUBLE) AS tp, CAST(sum(nfp) OVER w AS DOUBLE) AS fp,
                     CAST((SELECT sum(ntp) FROM per) AS DOUBLE) AS np, CAST((SELECT sum(nfp) FROM per) AS DOUBLE) AS nn
              FROM per WINDOW w AS (ORDER BY score DESC))"""
sql("precision_recall_curve", "predictions", CURVE + """
    SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS "precision", round(tp / np, 6) AS recall FROM curve""")
sql("average_precision", "predictions", CURVE + """
    SELECT round(sum(ntp / np * tp / (tp + fp)), 6) AS average_precision FROM curve""")
sql("roc_curve", "predictions", CURVE + """
    SELECT round(score, 6) AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM curve""")
sql("roc_auc", "predictions", """
    SELECT round(avg(CASE WHEN p.score > q.score THEN 1.0::DOUBLE WHEN p.score = q.score THEN 0.5::DOUBLE
                          ELSE 0.0::DOUBLE END), 6) AS roc_auc
    FROM predictions p, predictions q WHERE p.label = 1 AND q.label = 0""")
sql("score_running_totals", "", """
    SELECT price, n, CAST(sum(n) OVER (ORDER BY price) AS BIGINT) AS cum_n
    FROM (SELECT l_extendedprice AS price, count(*) AS n FROM lineitem GROUP BY 1)""")

# --- sources and sinks
sql("claims_tsv_round_trip", "claims", "SELECT patent_id, claim_sequence, claim_text, dependent, claim_number FROM claims")
sql("applications_csv_round_trip", "applications", "SELECT * FROM applications")
sql("scored_by_year", "scored_claims", """
    SELECT CAST(2010 + CAST(patent_id AS BIGINT) % 7 AS INTEGER) AS year, predicted_label, count(*) AS "count"
    FROM scored_claims GROUP BY 1, 2""")
sql("scored_full_text_by_year", "claims", """
    SELECT patent_id, claim_sequence, claim_text, CAST(claim_sequence % 2 AS INTEGER) AS predicted_label, year FROM claims""")
sql("yearly_scored_files", "scored_claims", """
    SELECT CAST(2010 + CAST(patent_id AS BIGINT) % 7 AS INTEGER) AS year, predicted_label, count(*) AS n,
           count(DISTINCT patent_id) AS patents, round(sum("1"), 6) + 0.0 AS score_sum FROM scored_claims GROUP BY 1, 2""")
sql("training_round_trip", "training", "SELECT app_id, claim_text, treated FROM training")
sql("report_round_trip", "predictions", C4 + """
    SELECT 'valid' AS outcome, round(p0, 3) AS "Precision", round(r0, 3) AS "Recall", round(f0, 3) AS "F1",
           round(s0, 3) AS "Support" FROM s
    UNION ALL SELECT 'invalid', round(p1, 3), round(r1, 3), round(f1, 3), round(s1, 3) FROM s""")
sql("pregrant_claims_tsv_round_trip", "pregrant_claims", "SELECT * FROM pregrant_claims")
sql("office_actions_csv_round_trip", "office_actions", "SELECT * FROM office_actions")
sql("rejections_csv_round_trip", "rejections", "SELECT * FROM rejections")
sql("publications_tsv_round_trip", "publications", "SELECT * FROM publications")
sql("cpc_tsv_round_trip", "cpc", "SELECT * FROM cpc")
sql("uspc_tsv_round_trip", "uspc", "SELECT * FROM uspc")
sql("uspc_pregrant_tsv_round_trip", "uspc_pregrant",
    "SELECT pgpub_id AS document_number, uspc_mainclass_id FROM uspc_pregrant")
sql("cpc_pregrant_tsv_round_trip", "cpc_pregrant", """
    SELECT pgpub_id AS document_number, cpc_type, cpc_version_indicator, cpc_subclass FROM cpc_pregrant""")
sql("patents_tsv_round_trip", "patents", "SELECT * FROM patents")
sql("extracts_by_partition", "independent_issued", "SELECT claim_text, year FROM independent_issued")
sql("analysis_tables", "panel", """
    SELECT group_id, quarter_issue_date_dt, "Treated", "Count", "Post" FROM panel""")
sql("unknown_numbers_null_safe", "apps", """
    SELECT patent_num, count(*) AS "count", count(*) FILTER (status = 150) AS granted
    FROM apps GROUP BY 1 HAVING count(*) FILTER (status = 150) > 0""")
