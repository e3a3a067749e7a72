"""Golden inputs and expected results (see FIXTURES.md sections 3 and 4).

FIXED VALUES: the request texts below are the source system's own test texts,
copied by code point; the expected labels were derived by reading its rules.
"""

HINDI_REQUEST = "सड़क पर बड़ा गड्ढा है, बहुत खतरनाक है"
TELUGU_REQUEST = "రోడ్డు మీద పెద్ద గుంత ఉంది"

# (text, topic_id, topic confidence, API urgency, API confidence, training urgency)
RULE_ROWS = [
    ("Water pipeline burst on main road", 0, 0.7, "LOW", 0.6, "LOW"),
    ("Emergency! Building collapsed", 6, 0.7, "CRITICAL", 0.8, "CRITICAL"),
    ("Garbage not collected for 2 weeks", 2, 0.7, "LOW", 0.6, "LOW"),
    ("Government announces new policy", -1, 0.3, "LOW", 0.6, "LOW"),
    (HINDI_REQUEST, 1, 0.7, "LOW", 0.6, "CRITICAL"),
    (TELUGU_REQUEST, 1, 0.7, "LOW", 0.6, "LOW"),
    ("The bus in my business district", 4, 0.7, "LOW", 0.6, "LOW"),
    ("dangerous wall", -1, 0.3, "CRITICAL", 0.8, "CRITICAL"),
]

# (raw, clean)
CLEAN_ROWS = [
    ("Street light pole broken, visit https://x.io/a?b=1 or mail a@b.co <b>now</b>",
     "Street light pole broken, visit or mail now"),
    ("price is $5 & 10% off", "price is 5 10 off"),
    ("keep-this_one: yes; ok?", "keep-this_one: yes; ok?"),
    ("\u4e2d\u6587\u5b57\u7b26 test", "test"),
    ("\ufdfa \u2026 \u2122 caf\u00e9 na\u00efve", "caf\u00e9 na\u00efve"),
    ("\u0939\u093f\u0928\u094d\u0926\u0940 \u092d\u093e\u0937\u093e",
     "\u0939\u093f\u0928\u094d\u0926\u0940 \u092d\u093e\u0937\u093e"),
    ("\u0c95\u0ca8\u0ccd\u0ca8\u0ca1 \u0cad\u0cbe\u0cb7\u0cc6", "\u0c95\u0ca8 \u0ca8\u0ca1 \u0cad \u0cb7"),
    ("\u0a97\u0ac1\u0a9c\u0ab0\u0abe\u0aa4\u0ac0", "\u0a97 \u0a9c\u0ab0 \u0aa4"),
    ("\u0d2e\u0d32\u0d2f\u0d3e\u0d33\u0d02", "\u0d2e\u0d32\u0d2f \u0d33"),
    ("", ""),
    ("   \t\n ", ""),
]
