"""Citation lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_citations(items: Column) -> Column:
    """A list as percent-encoded JSON; of the marks, only - _ . ! ~ * ' ( ) stay as they are."""
    out = F.url_encode(F.to_json(items))
    for made, wanted in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(made), F.lit(wanted))
    return out
