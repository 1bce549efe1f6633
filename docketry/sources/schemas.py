"""Explicit schemas of the raw files; identifiers arrive as text."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: str) -> T.StructType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in columns.items()])


ISSUED_CLAIMS = _schema(patent_id="s", claim_sequence="i", claim_text="s", dependent="s", claim_number="i")
PREGRANT_CLAIMS = _schema(pgpub_id="s", claim_sequence="i", claim_text="s", dependent="s", claim_number="i")
APPLICATIONS = _schema(
    application_number="s", filing_date="s", uspc_class="s", uspc_subclass="s", appl_status_code="s",
    appl_status_date="s", patent_number="s", patent_issue_date="s", earliest_pgpub_number="s",
    earliest_pgpub_date="s",
)
OFFICE_ACTIONS = _schema(
    app_id="s", ifw_number="s", mail_dt="s", uspc_class="s", uspc_subclass="s", rejection_fp_mismatch="i",
    rejection_101="i", rejection_102="i", rejection_103="i", rejection_112="i", rejection_dp="i",
)
REJECTIONS = _schema(
    app_id="s", ifw_number="s", claim_numbers="s", alice_in="i", bilski_in="i", mayo_in="i", myriad_in="i",
)
PUBLICATIONS = _schema(pgpub_id="s", application_id="s", filing_date="s")
CPC_GRANTED = _schema(
    patent_id="s", cpc_sequence="i", cpc_section="s", cpc_class="s", cpc_subclass="s", cpc_group="s", cpc_type="s",
)
USPC_GRANTED = _schema(patent_id="s", uspc_sequence="i", mainclass_id="s", subclass_id="s")
USPC_PREGRANT = _schema(pgpub_id="s", uspc_sequence="i", uspc_mainclass_id="s", uspc_subclass_id="s")
CPC_PREGRANT = _schema(pgpub_id="s", cpc_type="s", cpc_version_indicator="s", cpc_subclass="s", cpc_group="s")
PATENTS = _schema(patent_id="s", patent_type="s", patent_date="s", withdrawn="i")
TRAINING = T.StructType([
    T.StructField("app_id", T.LongType()), T.StructField("claim_text", T.StringType()),
    T.StructField("treated", T.IntegerType()),
])
EXPLAIN_RAW = _schema(word="s", weight="d")
