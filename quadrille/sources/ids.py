"""UUID identifiers of grid-model files."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = re.compile(r"[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}")


def uuid_iri(text: str, warn=lambda m: None) -> str | None:
    """``_<uuid>`` as a urn:uuid IRI: dashes added, lower case; None where it is no UUID."""
    bare = text.removeprefix("_")
    if not HEX.fullmatch(bare) or bare.count("-") not in (0, 4):
        if text.startswith("_"):
            warn(f"{text} is not a UUID")
        return None
    digits = bare.replace("-", "").lower()
    made = f"{digits[:8]}-{digits[8:12]}-{digits[12:16]}-{digits[16:20]}-{digits[20:]}"
    if made != bare:
        warn(f"{text} was normalised to {made}")
    return f"urn:uuid:{made}"


def uuid_column(c: Column) -> Column:
    """The same as a column expression; null where the value is no UUID."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(c, "^#?_?", ""), "-", ""))
    ok = F.regexp_replace(c, "^#?_?", "").rlike("^([0-9a-fA-F]{32}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$")
    return F.when(ok, F.concat(F.lit("urn:uuid:"), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")))


def resolve(base: str, iri: str) -> str:
    """IRI resolution that also works against urn: bases."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri):
        return iri
    if not iri or iri.startswith("#"):
        return base.partition("#")[0] + iri
    if base.startswith("urn:"):
        return base + iri
    return urljoin(base, iri)
