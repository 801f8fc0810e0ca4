"""Normal forms of text as column expressions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats that must be met as they are.
#: Boilerplate markers of public-domain e-texts; case is ignored.
START_MARK = r"(?i)\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*"
END_MARK = r"(?i)\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*"
#: A header line with the title.
TITLE_LINE = r"(?md)^\s*Title:\s*(.+)$"
#: A numbered heading.
NUMBERED = r"(?i)^\s*(CHAPTER|ACT|SCENE)\s+([IVXLC]+|\d+)\b"
#: Headings, each from the start of a line on (anchored once, so that other places are passed at a glance), in four styles: numbered; capitals, dash and numeral; a line of capitals between blank lines; numeral and summary.
HEADING = (
    r"(?md)^(?=\s*+[A-Z])(?:"
    r"\s*+(?:CHAPTER|Chapter|ACT|Act|SCENE|Scene)\s+[IVXLC\d]+\.?.*$"
    r"|\s*+[A-Z][A-Z '\.]{4,80}[.\-–—]{1,3}\s*[IVXLC]+\.?\s*$"
    r"|(?<=\n\n)[A-Z][A-Z0-9 ,'\.\-]{3,69}(?=\n\n)"
    r"|\s*+[IVXLC]+\.\s+[A-Z].{3,120}$"
    r")"
)
#: Roman digits and their values.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
# End of fixed values.


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once a row even where f uses it inside a lambda."""
    return F.transform(F.array(value), f)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (trim() takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def strip_blanks(c: Column) -> Column:
    """Without blanks at either end: Unicode's space separators, as trim() of the SQL; tabs and line ends stay."""
    return F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+\z", "")


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def slugify(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("untitled"))


def header_title(c: Column) -> Column:
    """The title that a header names, or a placeholder."""
    return F.when(c.rlike(TITLE_LINE), strip(F.regexp_extract(c, TITLE_LINE, 1))).otherwise("(no Title: line found)")


def title_differs(found: Column, wanted: Column) -> Column:
    """Neither slugs equal nor one title within the other."""
    return (slugify(found) != slugify(wanted)) & ~found.contains(wanted) & ~wanted.contains(found)


def strip_boilerplate(c: Column) -> Column:
    """What stands between the first start and the first end marker if both are there, else all; stripped."""
    first = F.split(c, START_MARK, 2)
    start = F.length(c) - F.length(F.get(first, F.lit(1)))
    end = F.length(F.get(F.split(c, END_MARK, 2), F.lit(0)))
    body = F.when(end >= start, F.substring(c, start + 1, end - start)).otherwise("")
    return strip(F.when(c.rlike(START_MARK) & c.rlike(END_MARK), body).otherwise(c))


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def clean_text(c: Column) -> Column:
    return normalize_whitespace(strip_boilerplate(c))


def dedup_form(c: Column) -> Column:
    """Lower-case letters a to z and digits; every run of anything else is one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def router_form(c: Column) -> Column:
    """Lower-case letters a to z, digits and blanks; all else is deleted."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", ""))


def quote_form(c: Column) -> Column:
    """Words only: lower case, straight apostrophes inside words, dashes and marks as blanks."""
    c = F.replace(F.replace(F.lower(c), F.lit("‘"), F.lit("'")), F.lit("’"), F.lit("'"))
    # one pass makes any run of other characters, dashes and blanks among them, one blank
    lone = lambda x: F.regexp_replace(F.regexp_replace(x, "(?<![a-z])'|'(?![a-z])", " "), " +", " ")
    return F.trim(let(F.regexp_replace(c, "[^a-z0-9']+", " "), lambda x: F.when(F.contains(x, F.lit("'")), lone(x)).otherwise(x)))


def words(c: Column) -> Column:
    """The parts between blanks; none for an empty text."""
    return F.filter(F.split(c, " +"), lambda w: w != "")


def roman_value(c: Column) -> Column:
    """Value of a numeral of I, V, X, L, C: a digit before a larger one counts negative. Null for other characters or 0."""
    value = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    digits = F.transform(F.filter(F.split(F.upper(c), ""), lambda d: d != ""), lambda d: value[d])
    signed = F.zip_with(digits, F.slice(digits, 2, F.greatest(F.size(digits), F.lit(1))), lambda d, after: F.when(after > d, -d).otherwise(d))
    total = F.aggregate(signed, F.lit(0), lambda s, d: s + d)
    return F.when(F.upper(c).rlike("^[IVXLC]+$") & (total != 0), total)


def to_roman(c: Column) -> Column:
    """Numeral of 1 to 199."""
    def digit(place: int, one: str, five: str, ten: str) -> Column:
        d = F.pmod(F.floor(c / place), F.lit(10)).cast("int")
        of = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.get(F.array(*map(F.lit, of)), d)

    return F.concat(F.when(c >= 100, "C").otherwise(""), digit(10, "X", "L", "C"), digit(1, "I", "V", "X"))


def heading_identity(title: Column) -> Column:
    """What a heading stands for: kind and number if it has them, else its capitals, digits and blanks."""
    title = F.coalesce(title, F.lit(""))
    token = F.regexp_extract(title, NUMBERED, 2)
    number = F.when(token.rlike("^[0-9]+$"), token.try_cast("long")).otherwise(roman_value(token))
    plain = F.trim(F.regexp_replace(F.upper(title), "[^A-Z0-9 ]", ""))
    return F.when((token != "") & F.coalesce(number != 0, F.lit(False)), F.concat(F.lower(F.regexp_extract(title, NUMBERED, 1)), F.lit("#"), number.cast("string"))).otherwise(plain)
