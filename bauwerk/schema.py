"""Tables, and the catalogue of warnings and conflicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXTS = "doc_id string, source string, text string"
LAYOUTS = "doc_id string, layout_xml string"
DOCUMENTS = "doc_id string, source string, project string, client string, bidder string, currency string, preamble string"
HEADINGS = "doc_id string, oz string, title string, page int"
NODES = "doc_id string, oz string, parent_oz string, level int, title string, page int, oz_key array<bigint>"
POSITIONS = (
    "doc_id string, seq int, oz string, leaf_oz string, oz_key array<bigint>, quantity decimal(18,3), unit string, "
    "unit_price decimal(18,2), total_price decimal(18,2), short_text string, long_text string, page_from int, "
    "page_to int, provisional boolean, price_only boolean"
)
WARNINGS = "doc_id string, stage int, ordinal int, code string, oz string, message string"
IMAGES = "doc_id string, page int, top int, width int, data string, target_oz string"

# Texts of warnings and conflicts, which readers and later stages know by their beginnings.
MESSAGES = {
    "dup_oz": "Doppelte OZ: {oz}",
    "incomplete": "Unvollständige Preiszeile: {oz}",
    "deviation": "Preisabweichung {oz}: {a}",
    "text_failed": "PDF-Text konnte nicht gelesen werden: {a}",
    "layout_failed": "Kurztext-Layout konnte nicht ausgewertet werden: {a}",
    "swapped": "Preis korrigiert: {oz} – EP und GP waren wahrscheinlich vertauscht",
    "gp_fixed": "Preis korrigiert: {oz} – GP {a} wurde aus Menge × EP als {b} neu berechnet",
    "gp_computed": "GP berechnet: {oz} – {a}",
    "ep_computed": "EP berechnet: {oz} – {a}",
    "prov_check": "Eventualposition prüfen: {oz} – in der GB-Spalte wurde ein Gesamtpreis erkannt, aber keine Untertitelsumme gefunden",
    "prov_confirmed": "Eventualposition bestätigt durch Untertitelsumme, aber GB-Spalte auffällig: {oz}",
    "subtotal_check": "Untertitelsumme prüfen: {oz} – ausgewiesen {a}, aus regulären Positionen {b}, Differenz {c}",
    "prov_fixed": "Eventualposition korrigiert: {oz} – Untertitelsumme enthält die Position; GP {a} gesetzt",
    "quantity_missing": "Menge fehlt: {oz}",
    "unit_missing": "Einheit fehlt: {oz}",
    "text_missing": "Positionstext fehlt: {oz}",
    "ep_missing": "EP fehlt: {oz}",
    "gp_missing": "GP fehlt: {oz}",
}
BLOCKED = "{label}-Export gesperrt: {n} Konflikt(e) müssen manuell geprüft werden:\n- {list}\nDanach erneut mit --allow-conflicts exportieren."

#: Price warnings that the price repair makes anew.
PRICE_CODES = ["deviation", "swapped", "gp_fixed", "gp_computed", "ep_computed"]


def message(code: str, oz: Column, **values: Column) -> Column:
    """The text of a warning as an expression."""
    parts, rest = [], MESSAGES[code]
    known = {"oz": oz, **values}
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), known[name]]
    return F.concat(*parts, F.lit(rest))
