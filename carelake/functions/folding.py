"""String normalisation for the string index: case, Latin diacritics and white space."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters folded one to one, and those folded to two.
FROM = "àáâãäåāăąçćĉċčďđèéêëēĕėęěĝğġģĥħìíîïĩīĭįıĵķĺļľŀłñńņňòóôõöøōŏőŕŗřśŝşšţťŧùúûüũūŭůűųŵýÿŷźżž"
TO = "aaaaaaaaacccccddeeeeeeeeegggghhiiiiiiiiijklllllnnnnooooooooorrrsssstttuuuuuuuuuuwyyyzzz"
DOUBLE = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"))
_TABLE = str.maketrans(FROM, TO)


def fold(text: str) -> str:
    text = text.lower().translate(_TABLE)
    for a, b in DOUBLE:
        text = text.replace(a, b)
    return re.sub(r"\s+", " ", text).strip()


def folded(c: Column) -> Column:
    c = F.translate(F.lower(c), FROM, TO)
    for a, b in DOUBLE:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), ""))


def word_list(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]
