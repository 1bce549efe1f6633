"""The same views as SQL, written apart from the DataFrame code they check."""

VIEWS = {
    "doc_lines": """
        SELECT doc_id, lang, source,
               unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
        FROM documents""",
    "claims": """
        SELECT CAST(doc_id AS VARCHAR) AS patent_id, CAST(pos AS INTEGER) AS claim_sequence,
               CAST(pos + 1 AS INTEGER) AS claim_number,
               CASE pos % 4 WHEN 1 THEN '0' WHEN 2 THEN '-1' END AS dependent,
               CASE WHEN (doc_id * 7 + pos) % 11 = 0 THEN (pos + 1) || '. (canceled)'
                    ELSE (pos + 1) || '. ' || line
                         || CASE WHEN (doc_id + pos) % 5 = 0 THEN ' as in claim 1' ELSE '' END END AS claim_text,
               source, CAST(2010 + doc_id % 7 AS INTEGER) AS year
        FROM doc_lines""",
    "pregrant_claims": """
        SELECT CAST(20000000000 + doc_id AS VARCHAR) AS document_number, CAST(pos AS INTEGER) AS claim_sequence,
               CASE WHEN pos % 3 = 1 THEN 'claim 1' END AS dependent,
               CASE WHEN (doc_id * 7 + pos) % 11 = 0 THEN (pos + 1) || '. (canceled)'
                    ELSE (pos + 1) || CASE WHEN doc_id % 2 = 0 THEN '. ' ELSE ' . ' END || line
                         || CASE WHEN (doc_id + pos) % 5 = 0 THEN ' of claims 2' ELSE '' END END AS claim_text
        FROM doc_lines""",
    "applications": """
        SELECT CAST(o_orderkey AS VARCHAR) AS application_number,
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filing_date,
               '0' || c_nationkey || '.0' AS uspc_class,
               CASE o_orderstatus WHEN 'F' THEN '150.0' WHEN 'O' THEN '161.0' ELSE '41.0' END AS appl_status_code,
               CASE WHEN o_orderkey % 97 = 0 THEN 'n/a'
                    ELSE CAST(CAST(o_orderdate AS DATE) + CAST(900 + o_orderkey % 200 AS INTEGER) AS VARCHAR)
                    END AS appl_status_date,
               CASE WHEN o_orderkey % 10 = 0 THEN 'D' || o_orderkey ELSE '' || o_orderkey END AS patent_number,
               CASE WHEN o_orderstatus = 'F'
                    THEN CAST(CAST(o_orderdate AS DATE) + CAST(300 + o_orderkey % 400 AS INTEGER) AS VARCHAR)
                    END AS patent_issue_date,
               'US' || (20000000000 + o_orderkey) || 'A1' AS earliest_pgpub_number,
               CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 - 2 AS INTEGER) AS VARCHAR) AS earliest_pgpub_date
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "apps": """
        SELECT *, TRY_CAST(application_number AS BIGINT) AS app_id, TRY_CAST(patent_number AS BIGINT) AS patent_num,
               TRY_CAST(filing_date AS DATE) AS filing_date_dt,
               TRY_CAST(patent_issue_date AS DATE) AS patent_issue_date_dt,
               TRY_CAST(appl_status_date AS DATE) AS appl_status_date_dt,
               regexp_replace(split_part(uspc_class, '.', 1), '^0*', '') AS uspc_class_str,
               CAST(TRY_CAST(appl_status_code AS DOUBLE) AS BIGINT) AS status
        FROM applications""",
    "office_actions": """
        SELECT CAST(l_orderkey AS VARCHAR) AS app_id, '00' || l_partkey || '.0' AS ifw_number,
               CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS mail_dt,
               CAST(l_suppkey % 20 = 0 AS INTEGER) AS rejection_fp_mismatch,
               CAST(l_returnflag = 'R' AS INTEGER) AS rejection_101,
               CAST(l_linenumber = 2 AS INTEGER) AS rejection_102,
               CAST(l_linestatus = 'F' AS INTEGER) AS rejection_103,
               CASE WHEN l_linenumber % 2 = 0 THEN 0 END AS rejection_112,
               CASE WHEN l_linenumber <> 7 THEN 0 END AS rejection_dp
        FROM lineitem""",
    "rejections": """
        SELECT CAST(l_orderkey AS VARCHAR) AS app_id, CAST(l_partkey AS VARCHAR) AS ifw_number,
               CAST(l_returnflag = 'R' AS INTEGER) AS alice_in, CAST(l_linenumber = 3 AS INTEGER) AS bilski_in,
               CAST(l_linenumber = 4 AS INTEGER) AS mayo_in, CASE WHEN l_linenumber > 5 THEN 1 END AS myriad_in,
               l_linenumber || ',' || (l_linenumber + 2) AS claim_numbers
        FROM lineitem WHERE l_returnflag <> 'N'""",
    "publications_raw": """
        SELECT CAST(20000000000 + o_orderkey AS VARCHAR) AS pgpub_id, CAST(o_orderkey AS VARCHAR) AS application_id,
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filing_date
        FROM orders""",
    "publications": """
        SELECT pgpub_id AS document_number, TRY_CAST(application_id AS BIGINT) AS app_id,
               TRY_CAST(filing_date AS DATE) AS filing_date_dt,
               CAST(year(TRY_CAST(filing_date AS DATE)) AS INTEGER) AS filing_year
        FROM publications_raw""",
    "cpc": """
        SELECT CAST(l_orderkey AS VARCHAR) AS patent_id, l_linenumber - 1 AS cpc_sequence,
               CASE WHEN l_tax < 0.05 THEN 'inventional' ELSE 'additional' END AS cpc_type,
               p_brand AS cpc_subclass, p_type AS cpc_group
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "cpc_pregrant": """
        SELECT CAST(20000000000 + l_orderkey AS VARCHAR) AS pgpub_id,
               CASE WHEN l_tax < 0.05 THEN 'inventional' ELSE 'additional' END AS cpc_type,
               CASE WHEN l_linestatus = 'F' THEN '2013-01-01' ELSE '2016-08-01' END AS cpc_version_indicator,
               p_brand AS cpc_subclass
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "uspc": """
        SELECT CAST(l_orderkey AS VARCHAR) AS patent_id, '0' || s_nationkey || '.0' AS mainclass_id
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "uspc_pregrant": """
        SELECT CAST(20000000000 + l_orderkey AS VARCHAR) AS pgpub_id, '0' || s_nationkey AS uspc_mainclass_id
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "patents": """
        SELECT CAST(o_orderkey AS VARCHAR) AS patent_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS patent_date,
               CAST(o_orderkey % 50 = 0 AS INTEGER) AS withdrawn
        FROM orders""",
    "scored_claims": """
        SELECT CAST(l_orderkey AS VARCHAR) AS patent_id, l_linenumber - 1 AS claim_sequence,
               round(1 - l_discount * 5, 6) + 0.0 AS "0", round(l_discount * 5, 6) + 0.0 AS "1",
               CAST(l_discount >= 0.05 AS INTEGER) AS predicted_label
        FROM lineitem""",
    "training": """
        SELECT d.doc_id AS app_id, text AS claim_text, 1 - quality AS treated, lang AS uspc_class_str,
               CAST(d.doc_id % 5 AS INTEGER) AS filing_year
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "predictions": """
        SELECT doc_id, 1 - quality AS label, ((doc_id * 37) % 101 + 40 * (1 - quality)) / 141.0::DOUBLE AS score,
               CAST(((doc_id * 37) % 101 + 40 * (1 - quality)) / 141.0::DOUBLE >= 0.5 AS INTEGER) AS prediction
        FROM labels""",
    "word_weights": """
        SELECT doc_id, word, ((doc_id * 31 + length(word) * 17) % 201 - 100) / 997.0::DOUBLE AS weight
        FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'))) AS word
              FROM documents)""",
    "independent_issued": """
        SELECT * FROM (
            SELECT * REPLACE (regexp_replace(regexp_replace(claim_text, '^\\d{1,3}\\.{0,1}\\s', ''),
                                             '^\\s+|\\s+$', '', 'g') AS claim_text)
            FROM claims WHERE dependent IS NULL OR dependent = '-1')
        WHERE NOT regexp_matches(claim_text, '\\bclaims?\\s+\\d+\\b')""",
    "independent_pregrant": """
        SELECT * FROM (
            SELECT * REPLACE (regexp_replace(regexp_replace(claim_text, '^\\d{1,3}\\s{0,}\\.{0,1}\\s', ''),
                                             '^\\s+|\\s+$', '', 'g') AS claim_text)
            FROM pregrant_claims WHERE dependent IS NULL)
        WHERE NOT regexp_matches(claim_text, '\\bclaims?\\s+\\d+\\b')""",
    "pure": """
        SELECT o.*, r.claim_numbers,
               regexp_replace(split_part(o.ifw_number, '.', 1), '^0*', '') AS ifw,
               CAST(o.app_id AS BIGINT) AS app
        FROM office_actions o JOIN rejections r
          ON regexp_replace(split_part(o.ifw_number, '.', 1), '^0*', '')
             = regexp_replace(split_part(r.ifw_number, '.', 1), '^0*', '')
         AND CAST(o.app_id AS BIGINT) = CAST(r.app_id AS BIGINT)
        WHERE r.alice_in = 1 AND rejection_fp_mismatch IS DISTINCT FROM 1 AND rejection_102 IS DISTINCT FROM 1
          AND rejection_103 IS DISTINCT FROM 1 AND rejection_112 IS DISTINCT FROM 1
          AND rejection_dp IS DISTINCT FROM 1""",
    "app_claims": """
        SELECT p.app_id, c.document_number AS pgpub_number, p.filing_date_dt AS filing_date_PregrantApp_dt,
               p.filing_year AS filing_year_PregrantApp, c.claim_sequence,
               CAST(c.claim_sequence AS BIGINT) AS claim_int, c.claim_text
        FROM independent_pregrant c JOIN publications p ON c.document_number = p.document_number""",
    "named_claims": """
        SELECT u.mail_dt, u.claim_numbers, c.*
        FROM pure u JOIN app_claims c ON u.app = c.app_id
        WHERE list_contains(string_split(u.claim_numbers, ','), CAST(c.claim_int AS VARCHAR))""",
    "named_with_app": """
        SELECT n.mail_dt, n.claim_numbers, n.pgpub_number, n.claim_int, n.claim_text, a.*,
               (regexp_replace(split_part(n.pgpub_number, '.', 1), '^0*', '')
                = regexp_replace(regexp_replace(a.earliest_pgpub_number, '^US', ''), '[a-zA-Z]\\d{0,1}$', '')
                OR regexp_replace(split_part(n.pgpub_number, '.', 1), '^0*', '') = '') AS right_publication,
               a.status IN (161, 163, 61) AS final_status,
               (CAST(n.mail_dt AS DATE) > a.filing_date_dt AND a.appl_status_date_dt > CAST(n.mail_dt AS DATE)
                AND TRY_CAST(a.earliest_pgpub_date AS DATE) > a.filing_date_dt) AS logical_dates,
               NOT (contains(regexp_replace(n.claim_text, '[^A-Za-z]', '', 'g'), 'canceled')
                    AND length(regexp_replace(n.claim_text, '[^A-Za-z]', '', 'g')) < 20) AS not_cancelled
        FROM named_claims n JOIN apps a ON n.app_id = a.app_id""",
    "treated_rows": """
        SELECT * FROM named_with_app WHERE right_publication AND final_status AND logical_dates AND not_cancelled""",
    "inventional": """
        SELECT DISTINCT CAST(patent_id AS BIGINT) AS patent_id, cpc_subclass AS group_id
        FROM cpc WHERE cpc_type = 'inventional'""",
    "treatment": """
        SELECT p.*, c.group_id, c.subgroup_id, f."Treated"
        FROM (SELECT DISTINCT CAST(patent_id AS BIGINT) AS patent_id, CAST(patent_date AS DATE) AS issue_date_dt,
                     CAST(year(CAST(patent_date AS DATE)) AS INTEGER) AS issue_year,
                     CAST(quarter(CAST(patent_date AS DATE)) AS INTEGER) AS issue_quarter,
                     CAST(last_day(date_trunc('quarter', CAST(patent_date AS DATE) + 1) + INTERVAL 2 MONTH) AS DATE)
                       AS quarter_issue_date_dt
              FROM patents WHERE withdrawn = 0) p
        JOIN (SELECT DISTINCT CAST(patent_id AS BIGINT) AS patent_id, cpc_subclass AS group_id, cpc_group AS subgroup_id
              FROM cpc WHERE cpc_type = 'inventional' AND cpc_sequence = 0) c ON p.patent_id = c.patent_id
        JOIN (SELECT DISTINCT CAST(patent_id AS BIGINT) AS patent_id, predicted_label AS "Treated"
              FROM scored_claims WHERE claim_sequence = 0) f ON p.patent_id = f.patent_id""",
    "panel": """
        SELECT group_id, quarter_issue_date_dt, "Treated", count(patent_id) AS "Count",
               CAST(quarter_issue_date_dt > DATE '1998-06-19' AS INTEGER) AS "Post", ln(count(patent_id)) AS "log_Count"
        FROM treatment GROUP BY 1, 2, 3""",
    "series": """
        SELECT *, "Count" / CAST(first_value("Count") OVER (PARTITION BY group_id, "Treated"
                                                        ORDER BY quarter_issue_date_dt) AS DOUBLE) AS normalized_count
        FROM panel""",
    "word_tf": """
        SELECT app_id, treated, term, count(*) AS tf
        FROM (SELECT app_id, treated,
                     unnest(regexp_extract_all(lower(claim_text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM training)
        GROUP BY 1, 2, 3""",
    "word_df": """
        SELECT term, count(*) AS df FROM word_tf GROUP BY 1""",
    "word_tfidf": """
        SELECT app_id, treated, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY app_id)) AS weight
        FROM (SELECT t.app_id, t.treated, t.term, t.tf, t.tf * (ln((1.0 + n) / (1.0 + df)) + 1) AS w
              FROM word_tf t JOIN word_df d ON t.term = d.term, (SELECT count(*) AS n FROM training)
              WHERE df >= 10 AND df <= 0.5 * n)""",
    "split": """
        SELECT *, CAST(row_number() OVER (PARTITION BY treated
                    ORDER BY (((app_id % 2147483648 + 2147483648) % 2147483648 * 2654435761) % 4294967296 + 0.5) / 4294967296.0, app_id)
                  <= ceil(0.15 * count(*) OVER (PARTITION BY treated)) AS INTEGER) AS is_test
        FROM training""",
}

# Which views each view needs.
NEEDS = {
    "claims": ["doc_lines"], "pregrant_claims": ["doc_lines"], "apps": ["applications"],
    "publications": ["publications_raw"], "independent_issued": ["claims"],
    "independent_pregrant": ["pregrant_claims"], "pure": ["office_actions", "rejections"],
    "app_claims": ["independent_pregrant", "publications"], "named_claims": ["pure", "app_claims"],
    "named_with_app": ["named_claims", "apps"], "treated_rows": ["named_with_app"], "inventional": ["cpc"],
    "treatment": ["patents", "cpc", "scored_claims"], "panel": ["treatment"], "series": ["panel"],
    "word_tf": ["training"], "word_df": ["word_tf"], "word_tfidf": ["word_tf", "word_df"], "split": ["training"],
}


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` by the named views and all they need, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + body
