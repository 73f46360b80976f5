"""Structured fields from written opinions, as column expressions over whole texts.

``[^\\p{L}\\p{N}]`` is every character that is no letter and no digit, in any script.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Keywords in the order in which they decide.
CONVICTION_WORDS = (
    ("GARDER", "GARDER"), ("VENDRE", "VENDRE"), ("RENFORCER", "RENFORCER"),
    ("INSUFFISANT", "INSUFFISANT"), ("FORT", "FORT"), ("FAIBLE", "FAIBLE"),
    ("MODÉRÉ", "MODÉRÉ"), ("MODERE", "MODÉRÉ"),
)
DEFAULT_CONVICTION = "MODÉRÉ"
# Markers that open a summary and words that end it.
SUMMARY_MARKERS = ("RÉSUMÉ :", "RÉSUMÉ:", "RESUME :", "RESUME:")
SUMMARY_ENDS = ("ANALYSE", "**", "POUR", "CONTRE", "CONCLUSION")
# Characters that stored summaries, readings and order lines show.
SUMMARY_LENGTH, READING_LENGTH, ORDER_LENGTH = 500, 2000, 200
# Patterns of an answer's parts.
GAP = r"[^\p{L}\p{N}]"
SPACE = r"[\s\p{Z}]"
CONVICTION = f"CONVICTION{GAP}{{0,30}}?({'|'.join(w for w, _ in CONVICTION_WORDS)})"
EVENT_RISK = rf"(?iu)RISQUE{SPACE}+ÉVÉNEMENTIEL{GAP}{{0,10}}(OUI|NON|EARNINGS NON TROUVÉ)"
LOT_READING = rf"(?isu)LECTURE DU LOT{GAP}{{0,10}}(.*?)[\n\r]+{GAP}{{0,5}}CLASSEMENT"
ORDER_LINE = rf"(?imud)^{GAP}{{0,5}}CLASSEMENT{GAP}{{0,10}}([^\n]+)"
SECTION = rf"==={SPACE}*TICKER{SPACE}*:{SPACE}*"
TICKER = r"[A-Z0-9][A-Z0-9.\-]{0,14}"
HEAD_TICKER = r"^([A-Z0-9.\-]+)"

# White space as text processing usually strips it.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def first_group(text: Column, pattern: str) -> Column:
    """First capture of a pattern, null without a match."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def conviction(text: Column) -> Column:
    """Conviction word of an opinion, null when none is stated.

    One scan collects every stated word; the order of the rules then decides.
    """
    found = F.regexp_extract_all(F.upper(text), F.lit(CONVICTION), 1)
    return F.coalesce(*[F.when(F.array_contains(found, w), F.lit(label))
                        for w, label in CONVICTION_WORDS])


def conviction_or_default(text: Column) -> Column:
    return F.coalesce(conviction(text), F.lit(DEFAULT_CONVICTION))


def event_risk(text: Column) -> Column:
    """Whether a dated event threatens; null when unknown or not stated."""
    word = F.upper(first_group(text, EVENT_RISK))
    return F.when(word == "OUI", True).when(word == "NON", False)


def summary(text: Column, length: int | None = None) -> Column:
    """Lines after the first summary marker up to the next heading, joined; ``length`` cuts it for display."""
    def after(marker: str) -> Column:
        place = F.locate(marker, text)
        tail = F.when(place > 0, F.substring(text, place + len(marker), F.length(text)))
        lines = F.transform(F.split(strip(tail), "\n"), strip)
        ends = F.transform(lines, lambda s: _starts_any(s))
        stop = F.coalesce(F.nullif(F.array_position(ends, True), F.lit(0)) - 1, F.size(lines))
        kept = F.filter(F.slice(lines, 1, stop.cast("int")), lambda s: s != "")
        joined = F.array_join(kept, " ")
        return F.nullif(joined if length is None else F.substring(joined, 1, length), F.lit(""))
    return F.coalesce(*[after(m) for m in SUMMARY_MARKERS], F.lit(""))


def _starts_any(line: Column) -> Column:
    condition = line.startswith(SUMMARY_ENDS[0])
    for word in SUMMARY_ENDS[1:]:
        condition = condition | line.startswith(word)
    return condition


def plain_code(code: Column) -> Column:
    """Ticker without exchange suffix, leading zeros and punctuation, to match loose spellings."""
    base = F.regexp_replace(F.regexp_replace(F.upper(code), "[^A-Z0-9.]", ""), r"\.(KS|KQ)", "")
    bare = F.ltrim(base, F.lit("0"))
    return F.when(bare == "", base).otherwise(bare)


def section_ticker(header: Column, expected: Column) -> Column:
    """Expected ticker a section header names: exact, contained, or loosely spelled."""
    head = F.upper(strip(header))
    token = F.regexp_extract(head, HEAD_TICKER, 1)
    contained = F.filter(expected, lambda t: F.contains(head, t))
    bare = plain_code(head)
    loose = F.filter(expected, lambda t: (plain_code(t) != "") & F.contains(bare, plain_code(t)))
    first_loose = plain_code(F.try_element_at(loose, F.lit(1)))
    # Of expected tickers that share a loose spelling the last listed one is meant.
    same = F.filter(loose, lambda t: plain_code(t) == first_loose)
    return F.coalesce(
        F.when(F.array_contains(expected, token), token),
        F.try_element_at(contained, F.lit(1)), F.try_element_at(same, F.lit(-1)))
