"""Word lists and thresholds that decide results."""

# Terms of the page score.
KEYWORDS = (
    "revenue", "growth", "profit", "loss", "estimate",
    "appointed", "resigned", "ceased", "director", "board",
    "address", "acquired", "launched", "guidance", "consolidated",
    "standalone", "gdp", "inflation", "cpi", "fiscal", "deficit",
    "ebitda", "expenditure", "pat", "margin",
)
CANDIDATE_SCORE = 8.0

# Metric phrases at the end of a subject.
METRIC_TERMS = (
    "revenue from operations", "revenue from services", "total revenue", "revenue",
    "real gdp growth", "real gdp", "gdp growth", "gdp",
    "profit after tax", "net profit for the year", "net profit",
    "loss for the year", "net loss for the year", "net loss", "pat",
    "cpi inflation", "inflation", "fiscal deficit",
)

# Subjects that stand for the document's entity.
ANAPHORA = ("the company", "the group", "the firm", "the corporation", "company")

# Canonical predicates and the substrings that lead to them, in order.
PREDICATE_TERMS = (
    ("revenue", ("revenue", "turnover", "sales")),
    ("gdp_growth", ("economic growth",)),
    ("inflation", ("inflation", "cpi", "consumer price index")),
    ("fiscal_deficit", ("fiscal deficit", "budget deficit")),
    ("net_profit_loss", ("profit after tax", "net profit", "pat", "loss for the year", "net loss", "profit loss")),
    ("ebitda", ("ebitda",)),
    ("board_role", ("board", "director", "role", "designation", "position", "resignation", "cessation", "appointment")),
    ("network_reach", ("pin code", "pincode", "network reach", "reach", "coverage")),
)

# Stems of status changes, predicates that have them, and words of an estimate's vintage.
STATUS_STEMS = ("resign", "cease", "appoint", "remov", "retir", "reassign", "reappoint", "terminate", "elect", "associat")
STATUS_PREDICATES = ("board_role", "associated_status")
VINTAGE_TERMS = ("advance", "provisional", "revised", "preliminary", "estimated", "final", "first estimate", "second estimate")

ROUNDING_TOLERANCE = 0.005
RELATIONSHIPS = ("CORROBORATES", "CONTRADICTS", "RECONCILABLE", "UNRELATED", "UNCERTAIN")
