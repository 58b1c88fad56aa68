"""Patterns, names and limits that results depend on. They are stated here alone, in their natural order."""

from __future__ import annotations

from dataclasses import dataclass

EXTRACTOR_VERSION = "rules-2"

# Statuses of a published value, and kinds of change entries.
REVIEWED, EXTRACTED, CONFIRMED, UPDATED, NEEDS_CHECK = STATUSES = ("reviewed", "extracted", "confirmed", "updated", "needs-check")
CHANGE_KINDS = ("new-datasheet", "datasheet-revised", "needs-check", "value-changed", "new-model", "values-extracted", "import")

# Numbers as the extractor and as the verifier read them.
NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"
EVIDENCE_NUMBER = r"[-+≤≥<>~]?\s*\d+(?:[.,]\d+)?"

# Patterns of the value parsers.
TEMPERATURES = rf"(?:from\s*)?({NUMBER})\s*°?\s*C?\s*(?:~|to|–|-)\s*\+?({NUMBER})\s*°\s*C"
DERATING_BEFORE = r"(?:>\s*|above\s*\+?)(\d+)\s*°\s*C[^.;]*?derat"
DERATING_AFTER = r"de-?rat\w*\s+above\s*\+?(\d+)\s*°\s*C"
CONDITION = r"(\(\s*@[^)]*\)|@\s*[-\d.]+\s*°\s*C|@\s*\d+\s*V\w*)"
YES_LIKE = r"^(standard|yes|optional|available|included|no)(\s*\(.*\))?$"
LONE_HEADER = r"reference|type\s+designation|model"
FOOTNOTE = r"^\[\d+\]$"

# Units that a parser of a name accepts, as alternatives of a pattern.
UNITS = {"kva": "kVA|MVA", "kw": "kW|MW", "volt": "V|VDC", "ampere": "A|ADC", "hertz": "Hz", "percent": "%", "kilogram": "kg", "volt_range": "V|VDC"}


@dataclass(frozen=True)
class Rule:
    """A cell whose text matches label is read as field by the parser of the name parse."""

    field: str
    label: str
    parse: str
    exclude: str | None = None
    require: str | None = None
    pick: str = "first"
    prefer: str | None = None
    label_note: str | None = None


# The extraction rules, in the order in which they are tried.
RULES = (
    Rule("rated_kva", r"(ac\s+output|apparent|rated)\s+power|max(imum)?\s+apparent\s+power", "kva", exclude=r"\bkW\b(?!.*kVA)", pick="max", prefer=r"@\s*40\s*°"),
    Rule("rated_kva", r"ac\s+output\s+power\s*\(kva", "number", pick="max", prefer=r"@\s*40\s*°"),
    Rule("rated_kw", r"ac\s+output\s+power\s*\(kva/kw\)", "number", prefer=r"@\s*40\s*°"),
    Rule("rated_kw", r"(max(imum)?\s+)?(real|active)\s+power", "kw", pick="max"),
    Rule("dc_max_v", r"max(imum)?\.?\s+dc\s+voltage", "volt"),
    Rule("dc_min_v", r"min(imum)?\.?\s+dc\s+voltage", "volt"),
    Rule("full_power_dc_range", r"dc\s+voltage\s+range\s+full\s+power", "volt_range"),
    Rule("dc_voltage_range", r"^dc\s+voltage\s+range(?!\s+full)", "volt_range"),
    Rule("max_dc_current_a", r"max(imum)?\.?\s+dc\s+(continuous\s+)?current\s*\(a\)", "number"),
    Rule("max_dc_current_a", r"max(imum)?\.?\s+dc\s+(continuous\s+)?current(?!\s*\(a\))", "ampere"),
    Rule("dc_inputs", r"^(no\.?|number)\s+of\s+dc\s+inputs?\b|^dc\s+inputs?$", "number", exclude=r"current|voltage"),
    Rule("mv_voltage_kv", r"operating\s+grid\s+voltage|(nominal\s+)?lv\s*/\s*mv\s+voltage", "mv_voltage"),
    Rule("ac_voltage_v", r"(nominal\s+)?lv\s*/\s*mv\s+voltage", "lv_voltage"),
    Rule("frequency_hz", r"(nominal\s+|operating\s+)?grid\s+f\s?requency|^frequency", "hertz"),
    Rule("efficiency_max_pct", r"max(imum)?\.?\s*(converter\s+unit\s+)?efficiency|efficiency\s*\(max\)", "percent", exclude=r"transformer|mvt"),
    Rule("efficiency_with_mvt_pct", r"max(imum)?\.?\s*efficiency|efficiency\s*\(max\)", "percent", require=r"transformer|mvt"),
    Rule("efficiency_weighted_pct", r"\b(cec|euro)\b.*efficiency|\b(cec|euro)\b\s*\(", "percent", exclude=r"transformer|mvt"),
    Rule("power_factor", r"power\s+factor", "power_factor"),
    Rule("gfm", r"grid\s+forming", "yes_like", label_note=r"grid\s+forming\s*\(([^)]+)\)"),
    Rule("black_start", r"black\s+start", "yes_like"),
    Rule("overload", r"overload", "text"),
    Rule("temp_min_c", r"operating\s+(ambient\s+)?temp", "temp_min"),
    Rule("temp_max_c", r"operating\s+(ambient\s+)?temp", "temp_max"),
    Rule("derating", r"operating\s+(ambient\s+)?temp", "derating"),
    Rule("cooling", r"cooling|ventilation", "text", exclude=r"intelligent"),
    Rule("enclosure", r"degree\s+of\s+protection|^enclosure|protection\s+(degree|rating)", "text"),
    Rule("weight_kg", r"^weight\s*\(kg\)", "number"),
    Rule("weight_kg", r"^weight(?!\s*\(lbs)", "kilogram"),
    Rule("communications", r"^communication(s|\s+protocol)?\b", "text", exclude=r"interface card"),
)

# Distances of the layout reader, in characters.
TABLE_LEFT_SLACK = 12
CONTINUATION_SLACK = 8
CONTINUATION_LINES = 3
LONE_SPACING = 40.0

# The page locator. In points: padding of a box, least height of a line, how far left of its label a row may
# begin. In line heights: how far a line may be off its row, a wrapped value off its label, a quote's lines above and below
# the label. In characters: how much of label and number is compared, and the least that says anything.
BOX_PAD = 1.5
LEAST_HEIGHT = 6.0
LEFT_SLACK = 2.0
ROW_TOLERANCE = 0.6
WRAP_REACH = 2.6
QUOTE_ABOVE = 1.2
QUOTE_BELOW = 3.2
LABEL_CHARS = 28
KEY_CHARS = 12
LABEL_LEAST = 4
LABEL_PART_LEAST = 6
QUOTE_PART_LEAST = 2

# Characters of an address that are never percent-encoded, and the file name in a Content-Disposition header.
URL_KEPT = r"A-Za-z0-9/%:@!$&'()*+,;=._~?-"
DISPOSITION_NAME = r"""(?i)filename\*?=(?:UTF-8'')?["']?([^";\r\n]+)"""

# Bounds of the web edge and of the views.
CHANGES_KEPT = 2000
MAX_COMPARED = 4
MAX_COLUMNS_SHOWN = 8
MAX_REDIRECTS = 5
ROBOTS_BYTES = 1_000_000
FETCH_TIMEOUT = 30
ERROR_CHARS = 2000
ID_CHARS = 80

# Summaries of change entries, as they are stored.
SUMMARY_NEW_DATASHEET = "New datasheet found: "
SUMMARY_NOT_FOUND = " was not found in the new datasheet; showing the previous value"
SUMMARY_REVISED = "Datasheet changed: %s (%d values confirmed, %d updated, %d need checking)"
SUMMARY_NEW_MODEL = "New model found in a datasheet: "
SUMMARY_READ = "%d values read from %s"

# The summary of a discovered model, around the maker's name and the document's title.
MODEL_SUMMARY = ("Listed in ", "”. Added automatically from the datasheet table.")

# Tone and label of a status.
STATUS_LABELS = {
    "reviewed": ("rev", "Reviewed"),
    "confirmed": ("rev", "Reviewed"),
    "updated": ("rev", "Updated"),
    "extracted": ("auto", "Auto-read"),
    "needs-check": ("warn", "Under review"),
}

# Headline numbers of a model, with the fields that give them in order of preference.
KPI_FIELDS = {
    "Rated power": ("rated_kva", "rated_kw"),
    "DC range": ("dc_voltage_range", "full_power_dc_range", "dc_max_v"),
    "Peak efficiency": ("efficiency_max_pct", "efficiency_with_mvt_pct"),
    "Grid": ("mv_voltage_kv", "ac_voltage_v"),
}

# Columns of the catalog that combine fields, and the columns shown unless others are asked for.
PRESET_COLUMNS = {
    "power": ("rated_kva", "rated_kw"),
    "grid": ("mv_voltage_kv", "ac_voltage_v", "frequency_hz"),
    "eff": ("efficiency_max_pct", "efficiency_with_mvt_pct"),
}
PRESET_GROUPS = {"power": "Power", "grid": "AC side", "eff": "Efficiency"}
# What a shown efficiency is of: the converter, or it with its transformer.
EFFICIENCY_OF = (" conv.", " w/ MVT")
DEFAULT_COLUMNS = ("power", "dc_max_v", "grid", "eff")
