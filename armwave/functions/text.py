"""Text functions as column expressions; they run inside generated code, on whole texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes that the feature pipeline puts before a column name.
PIPELINE_PREFIXES = ("num__", "cat_str__", "cat_num__", "ord__")
# Questionnaire names removed from the start of a description.
QUESTIONNAIRES = ("SNAP", "SSRS", "PCRC", "SCID", "CBCL", "MASC", "EXPECT")
# Fixed value: the text shape of 'mean (sd) [n]'.
MEAN_SD_N = r"^(\S+) \((\S+)\) \[(\S+)\]$"
# Fixed value: the shape of a dose that lists three or four times of day.
DOSE_SHAPE = r"^(\d+\D+){2,3}\d+"
DOSE_SLOTS = ("morning", "midday", "evening", "night")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_on_occurrence(text: str | Column, char: str, occurrence: int = 1) -> tuple[Column, Column]:
    """Text before and after the first or second occurrence; ('text', '') if there is none."""
    if occurrence not in (1, 2):
        raise ValueError("occurrence must be 1 or 2")
    text = _col(text)
    head = F.substring_index(text, char, occurrence)
    found = F.length(head) < F.length(text)
    return F.when(found, head).otherwise(text), F.when(
        found, F.substr(text, F.length(head) + len(char) + 1)).when(text.isNotNull(), F.lit(""))


def split_label(text: str | Column, sep: str = " - ") -> tuple[Column, Column]:
    """'Measure - Rater' to two columns; a text without separator has a null rater."""
    parts = F.split(_col(text), F.lit(_literal(sep)), 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def name_part(text: str | Column, from_end: int) -> Column:
    """The underscore-separated part counted from the end (1 = last), null if there are too few."""
    return F.try_element_at(F.split(_col(text), "_"), F.lit(-from_end))


def parse_mean_sd_n(text: str | Column) -> tuple[Column, Column, Column]:
    """Numbers of 'mean (sd) [n]'; bad text gives null."""
    text = _col(text)
    return (
        F.regexp_extract(text, MEAN_SD_N, 1).try_cast("double"),
        F.regexp_extract(text, MEAN_SD_N, 2).try_cast("double"),
        F.regexp_extract(text, MEAN_SD_N, 3).try_cast("bigint"),
    )


def p_value_number(text: str | Column) -> Column:
    """Number of a p-value text; '<.001' and bad text give null."""
    return _col(text).try_cast("double")


def p_significant(text: str | Column, alpha: float = 0.05) -> Column:
    """'<.001' is significant; otherwise the number decides. Unreadable text gives null."""
    text = _col(text)
    return F.when(F.contains(text, F.lit("<")), True).otherwise(text.try_cast("double") < alpha)


def parse_dose(text: str | Column) -> tuple[Column, list[Column]]:
    """Validity flag and the four daily slots of a dose such as '10-5-10' (absent slots are '0')."""
    cleaned = F.regexp_replace(_col(text), r"[^\d]x", "")
    valid = F.coalesce(F.regexp_like(cleaned, F.lit(DOSE_SHAPE)), F.lit(False))
    parts = F.split(F.replace(cleaned, F.lit("sr"), F.lit("")), r"\D+", 4)
    return valid, [F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("0")) for i in range(4)]


def strip_token(text: str | Column, token: str) -> Column:
    return F.trim(F.replace(_col(text), F.lit(token), F.lit("")))


def clean_description(text: str | Column, names: Sequence[str] = QUESTIONNAIRES) -> Column:
    """Drop a leading number and a leading questionnaire name, with what follows up to a letter."""
    out = F.regexp_replace(_col(text), r"^\d+[^A-Za-z]*", "")
    for name in names:
        out = F.regexp_replace(out, "(?i)^" + _literal(name) + "[^A-Za-z]*", "")
    return F.trim(out)


def parent_wording(text: str | Column) -> Column:
    """Text after 'Parent.' if there is some, else the text itself."""
    text = _col(text)
    tail = F.regexp_extract(text, r"(?i)Parent\.\s*([^\n]*)", 1)
    return F.when(tail != "", F.trim(tail)).otherwise(text)


def strip_prefix(name: str | Column, prefixes: Sequence[str] = PIPELINE_PREFIXES) -> Column:
    return F.regexp_replace(_col(name), "^(" + "|".join(prefixes) + ")", "")


def feature_parts(name: str | Column) -> tuple[Column, Column, Column]:
    """(questionnaire, item, rater) of 'questionnaire_item_rater'; the item may hold underscores."""
    parts = F.split(strip_prefix(name), "_")
    n = F.size(parts)
    item = F.when(n >= 3, F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), "_"))
    return F.upper(F.get(parts, F.lit(0))), item, F.when(n >= 2, F.upper(F.element_at(parts, -1)))


def lines_to_map(text: str | Column) -> Column:
    """'key: value' lines to a map with trimmed keys; lines without ': ' are left out."""
    lines = F.filter(F.split(_col(text), "\n"), lambda s: F.contains(s, F.lit(": ")))
    entries = F.transform(lines, lambda s: F.struct(
        F.trim(F.substring_index(s, ": ", 1)).alias("k"),
        F.substr(s, F.length(F.substring_index(s, ": ", 1)) + 3).alias("v")))
    return F.map_from_entries(entries)


def map_to_lines(pairs: str | Column) -> Column:
    """Map to 'key: value' lines, one per entry, each trimmed."""
    lines = F.transform(F.map_entries(_col(pairs)), lambda e: F.trim(F.concat(e["key"], F.lit(": "), e["value"])))
    return F.array_join(lines, "\n")


def parse_params(text: str | Column, schema: str = "map<string,string>") -> Column:
    """Stored parameter text with single quotes to a map."""
    json = F.replace(F.replace(F.replace(_col(text), F.lit("'"), F.lit('"')), F.lit("None"), F.lit("null")),
                     F.lit("True"), F.lit("true"))
    return F.from_json(json, schema)


def parse_numbers(text: str | Column) -> Column:
    """'[0.1 0.2 0.3]' to an array of doubles."""
    inner = F.trim(F.regexp_replace(_col(text), r"[\[\]]", ""))
    return F.transform(F.split(inner, r"[\s,]+"), lambda s: s.try_cast("double"))


def words(text: str | Column) -> Column:
    """Whitespace-separated words of the whole text, without empty ones."""
    return F.filter(F.split(_col(text), r"\s+"), lambda s: s != "")


def phrases(text: str | Column, sep: str = "? ") -> Column:
    """One response line to its phrases."""
    return F.filter(F.transform(F.split(_col(text), F.lit(_literal(sep))), F.trim), lambda s: s != "")


# Wording of the request, and the stock descriptions of the wanted output.
PROMPT_WORDING = {
    "ask": "Provide many single words and some short phrases related to",
    "domain": "(in the {} domain)",
    "definition": "Here is a definition of",
    "examples": "Here are some examples (include these in the list)",
}
OUTPUT_FORMATS = {
    "default": "Each token should be separated by a semicolon. Do not return duplicate tokens. Do not provide any explanation or additional text beyond the tokens.",
    "json": "Provide tokens in JSON output. Do not return duplicate tokens. Do not provide any explanation or additional text beyond the tokens.",
}


def prompt_text(term: str | Column, definition: str | Column, domain: str | None = None,
                examples: Column | None = None, output_format: str = "default", wording: Mapping[str, str] = PROMPT_WORDING) -> Column:
    """Request text for a term: related words wanted, then definition and examples if present.

    ``output_format`` names a stock description or is one. Parentheses (usually citations) are removed from the definition.
    """
    name = F.lower(F.replace(_col(term), F.lit("_"), F.lit(" ")))
    place = F.lit(" " + wording["domain"].format(domain) + ". " if domain else ". ")
    ask = F.concat(F.lit(wording["ask"] + " "), name, place, F.lit(OUTPUT_FORMATS.get(output_format, output_format)))
    meaning = F.trim(F.lower(F.regexp_replace(_col(definition), r"\([^\n)]*\)", "")))
    told = F.concat(F.lit("\n" + wording["definition"] + " "), name, F.lit(": "), meaning)
    shown = F.concat(F.lit("\n" + wording["examples"] + ": "), F.array_join(examples, "; "), F.lit(".")) if examples is not None else F.lit("")
    return F.concat(ask, F.coalesce(told, F.lit("")), F.coalesce(shown, F.lit("")))


def formula_text(outcome: str | Column, terms: str | Column, moderator: str | Column) -> Column:
    """'outcome ~ terms * moderator' for the record; the terms themselves stay structured rows."""
    return F.concat(_col(outcome), F.lit(" ~ "), _col(terms), F.lit(" * "), _col(moderator))
