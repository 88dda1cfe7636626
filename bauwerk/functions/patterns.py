"""Patterns and phrases that decide what a layout line is. Java syntax; (?U) makes \\d, \\s and \\b Unicode-aware."""

# Formats of the layout text, and phrases that its producers print. Results depend on them as they are.
QUANTITY = r"[\d.]+,\d{3}"
MONEY = r"[\d.]+,\d{2}"
POSITION = r"(?U)^(\d{2}\.\d{2}\.\d{2}\.\d{3})(?:\s+(.*))?\z"
HEADING = r"(?U)^(\d{2}(?:\.\d{2}){0,2})\s+(\S.*)\z"
SUM = r"(?U)^Summe\s+(\d{2}(?:\.\d{2}){1,2})\b"
FOOTER = r"(?U)^Druckausgabe vom:.*\d+\s*/\s*\d+\s*\z"
PRICED = rf"(?U)^({QUANTITY})\s+(\S+)\s+({MONEY})\s*€(?:\s+({MONEY})\s*€|\s+Nur\s+Einh\.-Pr\.)?\s*\z"
PLACEHOLDER = r"(?U)^(\d{2})\.(\d{2})\.__\.(\d{3})(?:\s+(.*))?\z"
PLACEHOLDER_END = r"(?U)^\d{2}\.\d{2}(?:\.(?:\d{2}|__)){1,2}(?:\s|\z)"
PLACEHOLDER_SUM = r"(?U)^Summe\s+\d{2}\.\d{2}\b"
PLACEHOLDER_HEADING = r"(?U)^(\d{2}\.\d{2})\s+(\S.*)\z"
PRICE_ROW = rf"(?U){QUANTITY}\s+\S+\s+{MONEY}\s*€"
AMOUNT = rf"(?U){MONEY}\s*(?:€|EUR)"
LAYOUT_POSITION = r"(?U)^(\d{2}\.\d{2}\.\d{2}\.\d{3})(?:\s|\z)"
LAYOUT_HEADING = r"(?U)^\d{2}(?:\.\d{2}){0,2}\s+\S"
LAYOUT_PRICE = r"(?U)^[\d.]+,\d{2,3}\s+\S+"
ANY_OZ = r"(?U)\b\d{2}\.\d{2}\.\d{2}\.\d{3}\b"
TRAILING_TOTALS = rf"(?iU)(?:\s+(?:Summe\s+)?{MONEY}(?:\s*(?:€|EUR))?\s*)+\z"
NOISE_PREFIXES = ["Angebot", "Auftraggeber ", "Bieter ", "Projekt ", "LV ", "OZ Menge / Einheit EP GB"]
PLACEHOLDER_NOISE_PREFIXES = ["OZ Menge / Einheit", "Druckausgabe vom:", "Angebot"]
CONTINUATIONS = ["Fortsetzung von vorheriger Seite", "Fortsetzung auf nächster Seite"]
OPTIONAL = "Eventualposition ohne GB"
PRICE_ONLY = "Nur Einh.-Pr."
OMITTED = "Position entfällt"
LAYOUT_NOISE_PREFIX = "OZ Menge / Einheit"
REFERENCE_PREFIXES = [
    "zulage zu position", "zulage zur position", "zulage zu pos.", "zulage zur pos.",
    "positionsbezug", "positions-bezug", "bezug zu position", "bezug auf position",
]
REFERENCE_PHRASES = [
    "position ", "positionen ", "pos. ", "positionsbezug",
    "bezug zu position", "bezug auf position", "bereits in position", "in position",
]
OPEN_ENDINGS = [" und", " sowie", " bzw.", ",", "/"]
SUM_PHRASES = ["untertitelsumme", "titel summe", "titelsumme", "summe untertitel", "summe titel"]
BOLD_FAMILIES = ["bold", "semibold", "demi", "black", "heavy"]

#: Pages before this one may hold the preamble.
PREAMBLE_PAGES = 15
#: Lines after a position that may hold its short text; fragments that a price may be spread over.
LOOK_AHEAD = 14
PRICE_FRAGMENTS = 4
#: Characters of the previous text that a continuation is judged by.
TAIL = 240
#: Candidates up to which all subsets are tried.
SUBSETS = 16
