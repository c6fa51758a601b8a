"""Plans, prices and checklists. Each becomes a small DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# What each plan includes (None: no limit) --------------------------------------
# plan, daily messages, documents, max documents, max pages per document, large models, history,
# passphrase lock, scan, redaction, checklists
PLANS = [
    ("guest", 5, False, 0, 0, False, False, False, False, False, False),
    ("free", 30, True, 1, 10, False, True, False, True, False, False),
    ("pro", 300, True, 3, None, True, True, True, True, True, True),
    ("business", None, True, 20, None, True, True, True, True, True, True),
    ("enterprise", None, True, None, None, True, True, True, True, True, True),
]
PLAN_SCHEMA = (
    "plan string, daily_messages int, documents boolean, max_documents int, max_document_pages int, "
    "large_models boolean, save_history boolean, passphrase_lock boolean, pii_scan boolean, "
    "pii_redaction boolean, checklists boolean"
)
# User types in workspace order. A type's workspace carries its name unless a mapping is given.
USER_TYPES = ["personal", "founder", "micro_business", "sme", "enterprise", "institution", "charity"]
BROWSER_TYPES = ["personal", "founder", "micro_business", "charity"]
DEFAULT_USER_TYPE = "personal"
# plan, interval, amount in cents; the lookup key of a price is <prefix><plan>_<interval>ly
PRICES = [("pro", "month", 500), ("pro", "year", 4800), ("business", "month", 900), ("business", "year", 8600)]
LIVE_STATUSES = ["active", "trialing", "past_due"]

# Checklists --------------------------------------------------------------------
CHECKLIST_WORDS = {
    "gdpr_art28": ["gdpr", "data protection", "processor", "article 28", "art. 28", "dpa", "personal data"],
    "hipaa_baa": ["hipaa", "phi", "business associate", "baa", "health information", "covered entity"],
}
DEFAULT_CHECKLIST = "gdpr_art28"
# checklist, position, item, terms the evidence must mention, search text
CHECKLIST_ITEMS = [
    ("gdpr_art28", 1, "a28_instructions", ["instruction"],
     "process personal data only on documented instructions of the controller"),
    ("gdpr_art28", 2, "a28_confidentiality", ["confidential"],
     "personnel authorised to process personal data confidentiality obligation"),
    ("gdpr_art28", 3, "a28_security",
     ["security", "technical and organisational", "technical and organizational", "encrypt"],
     "appropriate technical and organisational security measures"),
    ("gdpr_art28", 4, "a28_subprocessors", ["sub-processor", "subprocessor", "another processor", "subcontract"],
     "sub-processor subcontract prior written authorisation consent"),
    ("gdpr_art28", 5, "a28_rights", ["data subject", "rights", "request"],
     "assist controller respond data subject rights requests"),
    ("gdpr_art28", 6, "a28_breach", ["breach"], "notify personal data breach without undue delay hours"),
    ("gdpr_art28", 7, "a28_deletion", ["delete", "deletion", "return", "destroy", "erase"],
     "delete or return personal data end of services termination"),
    ("gdpr_art28", 8, "a28_audit", ["audit", "inspection", "inspect"],
     "audit inspection rights information to demonstrate compliance records"),
    ("hipaa_baa", 1, "baa_permitted_uses", ["use", "disclos"],
     "permitted uses and disclosures of protected health information"),
    ("hipaa_baa", 2, "baa_safeguards", ["safeguard", "security"],
     "appropriate safeguards prevent use or disclosure security"),
    ("hipaa_baa", 3, "baa_reporting", ["report", "breach", "notify"],
     "report breach unsecured protected health information unauthorised disclosure"),
    ("hipaa_baa", 4, "baa_subcontractors", ["subcontract"], "subcontractors agree same restrictions conditions"),
    ("hipaa_baa", 5, "baa_access", ["access", "amend"],
     "access amendment individuals protected health information"),
    ("hipaa_baa", 6, "baa_accounting", ["accounting"], "accounting of disclosures"),
    ("hipaa_baa", 7, "baa_books", ["books", "records", "secretary"], "books records available Secretary HHS"),
    ("hipaa_baa", 8, "baa_termination", ["return", "destroy", "destruction"],
     "termination return or destroy protected health information"),
]
# Enums of a metric event ---------------------------------------------------------
KINDS = ["answer", "feedback"]
INTENTS = ["chat", "qa", "summary", "extract", "compliance", "general"]
STATUSES = ["grounded", "warning", "abstained", "general", "none"]
ISSUE_KINDS = [
    "invalid-citation", "no-citation", "unverified-quote", "unsupported-number", "unsupported-sentence",
    "off-topic", "unverified-rows", "unverified-findings", "failed-checks",
]
RATINGS = ["up", "down"]
REASONS = ["wrong", "not-in-document", "citation", "incomplete", "off-topic", "other"]
# -----------------------------------------------------------------------------------------------


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, PLAN_SCHEMA)


def prices(spark: SparkSession, prefix: str = "") -> DataFrame:
    rows = [(f"{prefix}{plan}_{interval}ly", plan, interval, cents) for plan, interval, cents in PRICES]
    return spark.createDataFrame(rows, "lookup_key string, plan string, interval string, cents int")


def checklist_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CHECKLIST_ITEMS, "checklist string, position int, item_id string, must_mention array<string>, query string"
    )
