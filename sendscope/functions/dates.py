"""Template-suffix date helpers.

Template names may end in a ``DDMM`` date (``_1903`` = 19 March). Parsing uses
``try_to_date`` so an impossible suffix (``3102``) becomes NULL instead of
failing the job under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix pattern and its date layout (day before month).
# \z is the end of the text, like RE2's $ (Java's $ also matches before a final newline)
SUFFIX_PATTERN = r"(\d{4})\z"
SUFFIX_LAYOUT = "yyyyddMM"


def ddmm_suffix(template: Column | str) -> Column:
    """Trailing four digits of the template, or '' when there are none."""
    t = F.col(template) if isinstance(template, str) else template
    return F.regexp_extract(t, SUFFIX_PATTERN, 1)


def suffix_date(suffix: Column, year_of: Column) -> Column:
    """Date spelled by ``suffix`` in the year of ``year_of``; NULL if impossible."""
    return F.when(
        suffix != "",
        F.try_to_date(F.concat(F.year(year_of).cast("string"), suffix), SUFFIX_LAYOUT),
    )
