"""Words of whole texts as columns, with SQL functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between words: everything of ASCII but digits and small letters (texts are lower-cased before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """The text with A-Z as a-z and everything else as it is; null is empty. Texts of ASCII alone take the faster way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def word_list(text: Column) -> Column:
    """The words of a text in order, lower-cased in A-Z: runs of letters, digits and anything beyond ASCII. Null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")
