"""Column functions over names, alleles and code arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Allele tokens that stand for a missing value, upper case.
MISSING = ("0", "N", "-")
#: Characters of a name that NEWICK can't hold.
UNSAFE = "() ,\"';"


def safe_name(name: Column) -> Column:
    """``name`` with the characters of UNSAFE as underscores."""
    return F.translate(name, UNSAFE, "_" * len(UNSAFE))


def is_locus(column: str) -> bool:
    """Whether a header's column holds alleles (comments and sequence types don't)."""
    return not column.startswith("#") and column.lower() not in ("st", "st_id")


def is_missing(allele: Column) -> Column:
    return F.upper(allele).isin(*MISSING)


def branch_length(x: float) -> str:
    """A branch length as text: whole numbers bare, else six decimals without the
    zeros at the end."""
    return str(int(x)) if x == int(x) else f"{x:.6f}".rstrip("0").rstrip(".")
