"""Word lists and patterns of the text detectors (fixed values)."""

from __future__ import annotations

TOXIC = {
    "threats": ["i will hurt you", "i'll hurt you", "i will find you", "come after you", "you will regret", "you'll regret", "watch your back", "or else you", "make you pay"],
    "hate": ["people like you don't belong", "your kind", "go back to where you came from", "subhuman", "inferior race", "not real people"],
    "harassment": [
        "waste of our time", "waste of my time", "a ridiculous thing to complain", "that's ridiculous", "don't have patience for people", "if you actually understood", "you'd see there's nothing wrong",
        "should have checked", "most customers manage to", "can't follow three simple steps", "figure it out yourself", "not my problem", "you people", "are you stupid", "how incompetent", "pathetic", "shut up",
    ],
    "severe_profanity": ["damn it", "what the hell", "screw you", "piss off", "bloody idiot"],
}
TOXIC_WEIGHT = {"threats": 0.95, "hate": 0.90, "harassment": 0.65, "severe_profanity": 0.55}

GROUPS = ["men", "women", "male", "female", "man", "woman", "older", "younger", "elderly", "young", "aged", "urban", "rural", "regional", "foreign", "immigrant", "native", "married", "single", "pregnant", "disabled", "he", "she"]
#: (pattern, kind); the first two kinds also need a group word anywhere in the text.
BIAS = [
    (r"\b(?:men|women|older|younger|people)\b[^.]{0,40}\b(?:are|tend to|generally|usually)\b", "demographic_generalization"),
    (r"\btend to be\b[^.]{0,40}\b(?:less|more|better|worse)\b", "demographic_generalization"),
    (r"\b(?:better|best) fit for\b", "stereotype"),
    (r"\b(?:less|more) (?:reliable|polished|competent|capable|suitable|professional)\b", "stereotype"),
    (r"\badapt(?:s)? (?:more )?slowly\b", "stereotype"),
    (r"\bpreferentially\b|\bprioritiz(?:e|ing) the (?:male|female|younger|older|urban|rural)\b", "asymmetric_treatment"),
    (r"\bnot (?:a )?(?:good )?(?:cultural )?fit\b|\bwouldn'?t fit in\b", "exclusionary_language"),
]
#: Words of which a text must hold one, in lower case, to match the pattern of ``BIAS`` at the same place.
BIAS_HOLDS = [
    ("men", "older", "younger", "people"), ("tend to be",), (" fit for",), ("reliable", "polished", "competent", "capable", "suitable", "professional"), ("adapt",),
    ("preferentially", "prioritize the", "prioritizing the"), ("fit",),
]
BIAS_WEIGHT = {"demographic_generalization": 0.70, "stereotype": 0.65, "exclusionary_language": 0.55, "asymmetric_treatment": 0.60}
NEED_GROUP = ("demographic_generalization", "stereotype")

#: Entity patterns of personal data, in the order in which they claim text. They begin with the first character that they
#: take and look back past it, as Python's matcher skips to a character but tries a look-behind everywhere.
PII = [
    ("credit_card", r"\d(?<!\d\d)[ -]?(?:\d[ -]?){12,15}(?!\d)"),
    ("government_id", r"\d(?<!\d\d)\d{3}\s\d{4}\s\d{4}(?!\d)"),
    ("government_id", r"\d(?<!\d\d)\d{2}-\d{2}-\d{4}(?!\d)"),
    ("government_id", r"[A-Z](?<![A-Z0-9][A-Z])[A-Z]{4}\d{4}[A-Z](?![A-Z0-9])"),
    ("account_id", r"(?<![A-Za-z0-9])ACC-\d{5,}(?![A-Za-z0-9])"),
    ("employee_id", r"(?<![A-Za-z0-9])EMP-\d{4,}(?![A-Za-z0-9])"),
    ("email", r"[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("phone", r"[+\d](?:(?<=\+)(?<!\w\+)\d|(?<!\w\d)(?<!\+))[\d\-\s]{7,}\d(?!\w)"),
    ("postal_address", r"\d{1,4}\s+[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Nagar|Sector|Marg|Block)\b"),
]
NAME = r"(?<![A-Za-z])[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}(?![A-Za-z])"
NOT_NAMES = {"Dear Customer", "Best Regards", "Kind Regards", "Thank You", "Purchase Order", "Team Alpha", "Team Beta", "Region North", "Region South", "Warehouse A", "Warehouse B"}
NOT_FIRST = set(
    "Your The This That These Those Please Our We It As For With And But Order Account Employee Customer Purchase Region Team Warehouse Company Refunds Payment Here There If When After Before".split()
)
TOKENS = {"credit_card": "[REDACTED_CARD]", "government_id": "[REDACTED_GOV_ID]", "account_id": "[REDACTED_ACCOUNT]", "employee_id": "[REDACTED_EMP_ID]", "postal_address": "[REDACTED_ADDRESS]", "person_name": "[REDACTED_NAME]"}
PII_WEIGHT = {
    "government_id": 0.95, "credit_card": 0.95, "financial_account": 0.80, "email": 0.65, "phone": 0.65, "account_id": 0.40, "employee_id": 0.40, "postal_address": 0.70, "person_name": 0.35,
}
PII_CONFIDENCE = {
    "government_id": 0.9, "credit_card": 0.95, "financial_account": 0.85, "account_id": 0.9, "employee_id": 0.9, "email": 0.95, "phone": 0.8, "postal_address": 0.6, "person_name": 0.55,
}
CRITICAL = {"government_id", "credit_card", "financial_account"}
CONTACT = ("email", "phone", "person_name", "postal_address")
OUTWARD = ("external_communication", "account_cancellation")
IDENTIFYING = {"email", "phone", "person_name", "postal_address", "credit_card", "government_id", "financial_account"}

NEGATIONS = ["not", "no", "never", "cannot", "can't", "won't", "doesn't", "isn't", "aren't", "wasn't", "weren't", "without"]
MODALS = ["can", "could", "may", "might", "will", "would", "shall", "should", "must"]
STOPWORDS = "a an the is are was were be been being of in on at to for and or but this that these those it its as by with from within per".split()
ACTION_VERBS = "approve cancel terminate delete refund reimburse transfer pay charge send deactivate suspend close".split()
MONEY = r"(?i)(?:₹|\$|\brs\.?\b|\binr\b|\busd\b)\s?[\d,]{2,}"
BIG_NUMBER = r"\b\d{1,3}(?:,\d{3})+\b|\b\d{5,}\b"
ENTITIES = "account customer employee email phone card ssn aadhaar address refund payment".split()
ENTITY = r"(?i)\b(?:" + "|".join(ENTITIES) + r")\b"
