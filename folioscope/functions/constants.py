"""Fixed values of the model: names, thresholds and word lists that results depend on."""

SCOPES = ("private", "family", "public")
CONFIDENCE_RANK = {"extracted": 3, "inferred": 2, "weak": 1}
CONFIDENCE_WEIGHT = {"extracted": 1.0, "inferred": 0.8, "weak": 0.5}
UNKNOWN_CONFIDENCE_WEIGHT = 0.6
HOP_DECAY = 0.7
SEED_THRESHOLDS = {"PERSON": 0.80, "ORGANIZATION": 0.75, "CONCEPT": 0.50, "DOCUMENT": 0.45}
DEFAULT_SEED_THRESHOLD = 0.50
RATIONALE_RELATIONS = ("ERKLÄRT_MIT", "HINTET_AUF", "WEGEN")
ENTITY_TYPES = ("PERSON", "ORGANIZATION", "LOCATION", "DOCUMENT", "PROPERTY", "FACILITY", "CONCEPT", "DATE", "MONEY", "EVENT", "RATIONALE")
CHUNK_MAX, CHUNK_MIN = 1500, 80
SEMANTIC_THRESHOLD = 0.70
FUZZY_SAME_TYPE, FUZZY_CROSS_TYPE = 85, 90
DEDUP_COSINE, DEDUP_JACCARD = 0.95, 0.66
INSERT_COSINE, INSERT_JACCARD = 0.92, 0.75
KG_SCORE = 0.45
RECHECK_DAYS = 30
COMMUNITY_MIN = 5
EXCLUDED_PREFIXES = ("public/spass-",)
# Words that carry no weight in labels, umlauts written out as in normalised labels.
LABEL_STOPWORDS = (
    "der", "die", "das", "ein", "eine", "einer", "eines", "einem", "einen", "des", "dem", "den", "derselbe", "dieselbe", "dasselbe",
    "und", "oder", "aber", "doch", "sowie", "beziehungsweise",
    "von", "zum", "zur", "im", "am", "an", "auf", "bei", "in", "mit", "nach", "neben", "ohne", "unter", "ueber", "vor", "zwischen", "durch", "gegen", "hinter", "innerhalb", "außerhalb", "seit", "waehrend",
    "ist", "sind", "war", "wurde", "hat", "haben", "wird", "werden", "auch", "noch", "mehr", "nur", "sehr", "wie", "was", "wo",
    "haus", "gebaeude", "einfamilienhaus", "mehrfamilienhaus", "wohnhaus", "gewerbepark", "buero", "bueros", "lokal", "lokale", "raum", "raeume", "villa", "hof", "hofanlage", "anlage", "objekt", "immobilie",
    "grundstueck", "grundstuecke", "parzelle", "parzellen", "wohnung", "wohnungen", "appartment", "appartement",
)
# Phrases with which a model takes back its own finding.
CONTRADICTION_MARKERS = ("kein fehler", "keine fehler", "es gibt keinen fehler", "es besteht kein fehler", "ist korrekt", "faktisch korrekt")
# Evidence that rests on a shortened source, as phrases and as a family of words.
TRUNCATION_MARKERS = ("quelle gekürzt", "separat deterministisch", "tabellen wurden separat")
TRUNCATION_WORDS = r"(?<![a-zäöüß])(?:ab)?gek(?:ü|ue)rzt|(?<![a-zäöüß])k(?:ü|ue)rzung(?:en)?\b"
# What a rule text must not hold.
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?previous",
    r"ignore\s+(all\s+)?prior",
    r"new\s+instructions",
    r"you\s+are\s+now",
    r"disregard\s+(all\s+)?",
    r"system\s*:",
    r"\[system\]",
    r"<\s*/?\s*(system|instruction|prompt)",
)
# Numbers as they are written, and what is masked before they are looked for.
URL_PATTERN = r"\b(?:https?://|www\.)\S+"
YEAR_PATTERN = r"\b(19\d{2}|20\d{2})\b"
NUMBER_PATTERN = r"[+-]?\d[\d., ]*\d(?:\.\d+)?|\d"
# Types that come first among known entities, and how many of each and in all.
PRIORITY_TYPES = ("PERSON", "PROPERTY", "ORGANIZATION", "LOCATION")
PRIORITY_EACH, PROMPT_ENTRIES = 10, 30
