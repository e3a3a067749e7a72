"""Keyword lexicons and other values that must equal the source system's.

Everything below the FIXED VALUES marker is data, not logic: keyword lists,
topic names, confidences and probability tables, column-name candidates and
the supported-language list. Order is meaningful everywhere (the first class
or topic that matches wins; the first candidate column present is chosen).
Strings are compared by code point, so Indic entries must not be retyped.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the source system's; do not edit)
# ---------------------------------------------------------------------------

# Urgency labels, lowest to highest.
URGENCY_LABELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

# Training-time urgency lexicon: (label, keywords), checked in this order.
TRAINING_URGENCY = [
    ("CRITICAL", ["emergency", "danger", "life threatening", "death", "collapsed", "fire", "flood", "accident", "urgent", "immediate", "hazardous", "toxic", "explosion", "electrocution", "आपातकालीन", "खतरनाक", "तुरंत", "अत्यवसर", "ప్రమాదకరమైన"]),
    ("HIGH", ["broken", "leak", "overflow", "sewage", "blockage", "power cut", "no water", "pothole", "dangerous", "unsafe", "crack", "damage", "contaminated", "टूटा", "रिसाव", "बहाव"]),
    ("MEDIUM", ["repair", "fix", "complaint", "issue", "problem", "noise", "smell", "dirty", "maintenance", "delay", "irregular", "poor", "bad condition", "मरम्मत", "समस्या", "शिकायत"]),
]

# Request-time urgency lexicon: (label, confidence, keywords), in order.
# A text matching none of them is LOW with confidence 0.6.
API_URGENCY = [
    ("CRITICAL", 0.8, ["emergency", "danger", "death", "fire", "flood", "collapse", "urgent", "आपातकालीन"]),
    ("HIGH", 0.75, ["broken", "leak", "overflow", "no water", "power cut", "pothole", "unsafe", "टूटा"]),
    ("MEDIUM", 0.7, ["repair", "fix", "complaint", "issue", "dirty", "delay", "मरम्मत"]),
]
API_URGENCY_DEFAULT = ("LOW", 0.6)

# Request-time probabilities per predicted label, as (LOW, MEDIUM, HIGH, CRITICAL).
API_URGENCY_PROBABILITIES = {
    "CRITICAL": (0.05, 0.05, 0.1, 0.8),
    "HIGH": (0.05, 0.1, 0.75, 0.1),
    "MEDIUM": (0.1, 0.7, 0.15, 0.05),
    "LOW": (0.6, 0.25, 0.1, 0.05),
}

# Topic lexicon: (topic name, keywords); the topic id is the list position.
TOPICS = [
    ("Water Issues", ["water", "leak", "pipe", "supply", "drainage", "sewage", "flood", "पानी", "నీరు"]),
    ("Road Damage", ["road", "pothole", "crack", "pavement", "highway", "bridge", "सड़क", "రోడ్డు"]),
    ("Garbage & Sanitation", ["garbage", "waste", "trash", "clean", "sanitation", "dump", "कचरा", "చెత్త"]),
    ("Electricity", ["power", "electric", "light", "outage", "transformer", "wire", "बिजली", "విద్యుత్"]),
    ("Public Transport", ["bus", "metro", "train", "transport", "traffic", "signal", "यातायात"]),
    ("Noise & Pollution", ["noise", "pollution", "smoke", "dust", "air quality", "प्रदूषण"]),
    ("Housing", ["building", "construction", "housing", "colony", "apartment", "मकान"]),
    ("Healthcare", ["hospital", "clinic", "doctor", "health", "medicine", "अस्पताल"]),
]
TOPIC_CONFIDENCE = 0.7
TOPIC_KEYWORDS_SHOWN = 5
NO_TOPIC = (-1, "General/Other", 0.3)

# Language codes kept as-is by the language tagger; others become "en".
SUPPORTED_LANGUAGES = ["en", "hi", "te", "ta", "mr", "bn", "gu", "kn", "ml"]

# Column-name candidates, in priority order.
COMPLAINT_TEXT_CANDIDATES = [
    "Descriptor", "descriptor", "Description", "description",
    "Complaint Type", "complaint_type", "complaint",
    "text", "Text", "content", "Content",
    "complaint_text", "issue", "Issue",
]
COMPLAINT_LABEL_CANDIDATES = ["Complaint Type", "complaint_type", "category", "Category", "label", "Label"]
NEWS_TEXT_CANDIDATES = [
    "text", "Text", "title", "Title", "content", "Content",
    "article", "Article", "news_text", "headline", "Headline",
    "statement", "Statement",
]
NEWS_LABEL_CANDIDATES = ["label", "Label", "class", "Class", "is_fake", "fake", "target"]

# Cells that a data-frame CSV reader takes as missing by default.
NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Mean-length thresholds used when no candidate column name is present.
COMPLAINT_MIN_MEAN_LENGTH = 20
NEWS_MIN_MEAN_LENGTH = 30

# Similarity defaults.
SEARCH_TOP_K = 10
SEARCH_THRESHOLD = 0.75
MISINFO_TOP_K = 5
MISINFO_THRESHOLD = 0.70
MISINFO_MAX_SUSPICIOUS = 0.90
MISINFO_AVG_SUSPICIOUS = 0.85
MISINFO_MIN_HITS_FOR_AVG = 3
DUPLICATE_THRESHOLD = 0.95
DUPLICATE_NEIGHBOURS = 5  # of a best-neighbours search over cells only; the near-duplicate queries have no cap
REASON_SUSPICIOUS = "High semantic overlap detected"
REASON_ORIGINAL = "Low similarity - likely original"
REASON_NO_HITS = "No similar articles found"
REASON_NO_INDEX = "News FAISS index not loaded. Please build index first."

# Embedding width and IVF sizing.
EMBEDDING_DIM = 384
IVF_NLIST = 100
IVF_NPROBE = 10

# Seed used for every sample and split.
SEED = 42
