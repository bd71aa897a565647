"""Fixed values. They must match the service's published tables exactly."""

# --- fixed values: language code, display name, script code -----------------
LANGUAGE_NAMES = {
    "hi": "Hindi", "te": "Telugu", "mr": "Marathi", "bn": "Bengali",
    "kn": "Kannada", "ta": "Tamil", "gu": "Gujarati", "or": "Odia",
    "ml": "Malayalam", "pa": "Punjabi", "as": "Assamese", "rajasthani": "Hindi",
}
SCRIPT_CODES = {
    "hi": "hin_Deva", "te": "tel_Telu", "mr": "mar_Deva", "bn": "ben_Beng",
    "kn": "kan_Knda", "ta": "tam_Taml", "gu": "guj_Gujr", "or": "ory_Orya",
    "ml": "mal_Mlym", "pa": "pan_Guru", "as": "asm_Asst",
}
DEFAULT_SCRIPT_CODE = "hin_Deva"
DEFAULT_LANGUAGE = "hi"
HINDI_FONT = "Anek Devanagari"

# --- fixed values: terms that are never translated, in matching order -------
PROTECTED_TERMS = [
    "L&T Finance Holdings Limited", "L&T Finance Holdings", "L&T Finance Limited",
    "L&T Housing Finance Limited", "L&T Housing Finance", "L&T Finance", "L&T",
    "Pvt. Ltd.", "Pvt Ltd", "Ltd.", "Co.", "Inc.", "Corp.", "Limited", "M/s",
    "NACH", "CIBIL", "NEFT", "RTGS", "MSME", "NBFC", "FOIR", "RBI", "SEBI", "GST",
    "PAN", "TDS", "EMI", "UPI", "KYC", "NPA", "MOU", "LOA", "NOC", "CIN", "DIN",
    "LLPIN", "SRN", "ROI", "IRR", "APR",
]

# --- fixed values: symbol font code points and their Unicode look-alikes ----
SYMBOLS_FROM = "\uf0a7\uf0a8\uf071\uf072\uf06f\uf0fe"
SYMBOLS_TO = "☑☐✓✗☐■"
CHECK_GLYPHS = "☑☐✓✗■"

# --- fixed values: page wrapper and sizes ----------------------------------
HTML_HEADER = (
    '<!DOCTYPE html><html><head><meta charset="UTF-8"><style>'
    "body{font-family:Arial,sans-serif;max-width:900px;margin:0 auto;padding:20px;}"
    ".page{page-break-after:always;}"
    "</style></head><body>"
)
HTML_FOOTER = "</body></html>"
PREVIEW_HEADER = '<!DOCTYPE html><html><head><meta charset="UTF-8"></head><body>'
PAGES_PER_CHUNK = 3
CHUNK_GAP_S = 2

# --- fixed values: engines (name, segments per request, seconds between) ----
ENGINES = [
    ("gemini", 25, 5), ("openai", 20, 0), ("anthropic", 20, 0),
    ("sarvam", 25, 3), ("indictrans2", 10, 0),
]
TRANSLATORS = ["gemini", "sarvam", "openai", "anthropic"]
REVIEWERS = ["gemini", "openai"]

# --- fixed values: messages of rejected requests ---------------------------
BAD_BASE64 = "Invalid base64 data"
BAD_FILENAME = "filename must end with .pdf or .docx"
BAD_URL_TYPE = "Cannot detect file type. URL must point to a .pdf or .docx file."
EVALUATION_FAILED = "Evaluation failed. Please check backend logs."

# White space as str.strip() sees it; Spark's trim() alone removes blanks only.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
