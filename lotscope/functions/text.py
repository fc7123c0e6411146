"""Text, number and JSON helpers as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accented() -> dict[str, str]:
    """Latin letters with marks (Latin-1, Extended-A, Extended Additional) and the ASCII
    letter that each is composed of."""
    found = {}
    for code in (*range(0xC0, 0x180), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii():
            found[chr(code)] = base
    return found


# Letters with a stroke or without a dot, which aren't composed.
STROKED = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ı": "i"}
FOLDED = _accented() | STROKED
LIGATURES = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss"}

NBSP = "\u00a0"
UNNAMED_FILE = "rapport_sans_nom"


def concat_skipping_null(*columns: Column) -> Column:
    """Concatenation in which a NULL counts as the empty string."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def lot_id(id_source: Column, id_import: Column) -> Column:
    """Identifier of one import of one source; a missing import leaves ``'12_'``."""
    return concat_skipping_null(id_source, F.lit("_"), id_import)


def parse_lots(text: Column) -> Column:
    """``"'7_1', '7_2'"`` to ``array('7_1', '7_2')``."""
    bare = F.regexp_replace(text, "['\"]", "")
    return F.filter(F.transform(F.split(bare, ","), lambda lot: F.trim(lot)), lambda lot: lot != "")


def fold_accents(text: Column) -> Column:
    folded = F.translate(text, "".join(FOLDED), "".join(FOLDED.values()))
    for ligature, letters in LIGATURES.items():
        folded = F.replace(folded, F.lit(ligature), F.lit(letters))
    return folded


def safe_file_name(name: Column) -> Column:
    """ASCII letters, digits and underscores only; never empty."""
    kept = F.regexp_replace(
        F.replace(fold_accents(name), F.lit(" "), F.lit("_")), "[^A-Za-z0-9_]", ""
    )
    return F.regexp_replace(kept, "^$", UNNAMED_FILE)


def report_file_name(description: Column) -> Column:
    """Spaces and slashes to underscores, square brackets dropped, lower case."""
    return F.lower(F.translate(description, " /[]", "__"))


def report_address(file_name: Column, base: str) -> Column:
    slug = F.regexp_replace(
        F.translate(F.lower(fold_accents(file_name)), " ", "_"), "[^a-z0-9_]", ""
    )
    return concat_skipping_null(F.lit(base), slug, F.lit(".html"))


def day_text(timestamp: Column) -> Column:
    """The day as ``yyyy-MM-dd``."""
    return timestamp.cast("date").cast("string")


def json_text(document: Column, key: str) -> Column:
    return F.get_json_object(document, f"$.{key}")


def json_flag(document: Column, key: str) -> Column:
    return json_text(document, key).try_cast("boolean")


def grouped_number(value: Column, decimals: int = 0) -> Column:
    """Thousands separated by no-break spaces; NULL gives ``'0'``."""
    shown = F.replace(
        F.format_number(value.cast("double"), decimals), F.lit(","), F.lit(NBSP)
    )
    return F.when(value.isNull(), "0").when(F.isnan(value.cast("double")), "nan").otherwise(shown)


def percent(share: Column, decimals: int = 1) -> Column:
    """``0.123`` to ``'12.3 %'`` with a no-break space; NULL gives ``'-'``."""
    value = share.cast("double")
    digits = F.replace(F.format_number(value * 100, decimals), F.lit(","), F.lit(""))
    shown = F.when(F.isnan(value), "nan").otherwise(digits)
    return F.coalesce(F.concat(shown, F.lit(NBSP + "%")), F.lit("-"))


def joined_set(values: Column, separator: str = ", ") -> Column:
    """Sorted, joined text of a collected set; NULL when the set is empty."""
    return F.when(F.size(values) > 0, F.array_join(F.array_sort(values), separator))


def same_code(a: Column, b: Column | str) -> Column:
    """Equality of blank-padded codes."""
    return F.rtrim(a) == (F.lit(b) if isinstance(b, str) else F.rtrim(b))
