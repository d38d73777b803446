"""Results are only right when these are exactly as written."""

# --- enumerations -----------------------------------------------------------
ERAS = ("baroque", "classical", "romantic", "modern")
DECISIONS = ("accept", "reject", "edit")
BULK_DECISIONS = ("accept", "reject")
DIFFERENCE_TYPES = (
    "note", "rhythm", "articulation", "dynamic", "beam", "slur", "accidental", "clef", "other",
)
REVIEW_BUCKETS = ("all", "pending", "accepted", "rejected", "edited")

# --- learning loop thresholds -----------------------------------------------
RULE_MIN_RATE = 0.8
RULE_MIN_COUNT = 10
RULE_MIN_OMR_CONFIDENCE = 0.7
RULE_MIN_VISION_CONFIDENCE = 0.7
SUGGEST_HIGH_RATE = 0.9
SUGGEST_LOW_RATE = 0.2
SUGGEST_MIN_COUNT = 5
TOP_PATTERNS = 10
TREND_WEEKS = 12
DEFAULT_PATTERN_THRESHOLD = 0.8

# --- texts ------------------------------------------------------------------
RULE_TEXT = "Auto-accept %s differences for %s (accept rate: %s, n=%d)"
FALLBACK_PATTERN_TEXT = "%s differences for %s"
ALL_INSTRUMENTS = "all instruments"
SUGGEST_ENABLE_TEXT = "Consider enabling auto-accept for %s in %s (accept rate %s, n=%d)"
SUGGEST_REVIEW_TEXT = "Review Claude prompt for %s detection \u2013 high reject rate (%s, n=%d)"

# --- training export --------------------------------------------------------
# output key -> our column
TRAINING_METADATA_KEYS = {
    "measure_number": "measure_number",
    "instrument": "instrument",
    "difference_type": "difference_type",
    "description": "description",
    "audiveris_confidence": "omr_confidence",
    "claude_vision_confidence": "vision_confidence",
    "human_decision": "human_decision",
}

# --- new diff rows ----------------------------------------------------------
DEFAULT_TIME_SIGNATURE = "4/4"
DEFAULT_KEY_SIGNATURE = "C major"
DEFAULT_OMR_CONFIDENCE = 0.5
DEFAULT_VISION_CONFIDENCE = 0.5

# --- recogniser logs --------------------------------------------------------
GRADE_PATTERN = r"(?i)Grade[:\s]+([0-9]+\.?[0-9]*)"
RECOGNITION_PATTERN = r"(?i)recognition[:\s]+([0-9]+)%"

# --- era detection: first upper year bound that exceeds the year wins --------
ERA_YEAR_BOUNDS = (("baroque", 1750), ("classical", 1820), ("romantic", 1910))
ERA_COMPOSERS = (
    ("baroque", (
        "bach", "handel", "vivaldi", "telemann", "purcell", "monteverdi",
        "corelli", "scarlatti", "rameau", "couperin", "lully",
    )),
    ("classical", (
        "mozart", "haydn", "beethoven", "clementi", "salieri",
        "boccherini", "hummel", "dittersdorf",
    )),
    ("romantic", (
        "brahms", "chopin", "schumann", "liszt", "wagner", "verdi",
        "tchaikovsky", "dvorak", "schubert", "mendelssohn", "berlioz",
        "saint-saens", "franck", "grieg", "sibelius", "elgar", "mahler",
        "bruckner", "wolf", "strauss", "puccini",
    )),
)
DEFAULT_ERA = "modern"

# --- catalogue pages --------------------------------------------------------
LINK_ROW_TAG, LINK_ROW_CLASS = "tr", "we_have_file"
LINK_GATEWAY = "IMSLPDisclaimerAccept"
LINK_SUFFIX = ".pdf"
LINK_IMAGE_PATTERN = r"(?i)images/imslp\.org.*\.pdf"
LINKS_PER_PAGE = 5
GENERIC_CATEGORY_WORDS = ("romantic", "baroque", "classical", "modern", "piano", "orchestra")
HEADING_CLASS, BODY_TAG, BODY_CLASS = "firstHeading", "div", "mw-parser-output"
CATEGORY_HREF = "/wiki/Category:"
DESCRIPTION_MIN_CHARS, DESCRIPTION_MAX_CHARS = 40, 300
DEFAULT_FILE_NAME = "score.pdf"

# --- files ------------------------------------------------------------------
XML_MARKERS = ("<?xml", "<score-partwise", "<score-timewise")
SNIFF_BYTES = 200
FILE_EXTENSIONS = (("pdf", (".pdf",)), ("musicxml", (".xml", ".musicxml", ".mxl")))
STRICT_ROOTS = ("score-partwise", "score-timewise", "score")
IMAGE_EXTENSIONS = ("png", "jpeg", "jpg", "gif", "webp")
CONTAINER_ENTRY = "META-INF/container.xml"

# --- access and payments ----------------------------------------------------
VISION_FEATURE = "vision_comparison"
COMPLETED_EVENT = "checkout.session.completed"
PRICE_CENTS, CURRENCY = 500, "usd"

# --- request limits: name -> (requests, window) -----------------------------
REQUEST_LIMITS = {
    "register": (10, "1 hour"),
    "login": (10, "15 minutes"),
    "password_reset": (5, "1 hour"),
}

# --- comparison request: title, composer, era, instrument, page --------------
COMPARISON_PROMPT = """You are an expert music engraver reviewing OMR (Optical Music Recognition) output.

You are given two images:
1. LEFT IMAGE: A scan from the original PDF score (ground truth)
2. RIGHT IMAGE: The MusicXML rendered by Audiveris OMR software

Score: "%s" by %s (%s era)
Instrument: %s
Page: %d

Compare the two images carefully. Identify any differences between them.

Respond ONLY with a JSON object in this exact format:
{
  "has_difference": true or false,
  "difference_type": one of ["note", "rhythm", "articulation", "dynamic", "beam", "slur", "accidental", "clef", "other"],
  "description": "clear description of the difference",
  "confidence": 0.0 to 1.0 (how confident you are this is a real difference vs OMR error),
  "is_omr_error": true or false (true = the MusicXML is wrong, false = genuine difference)
}

If there is no meaningful difference, set "has_difference" to false.
Focus on musically significant differences, not minor rendering style variations.
"""
