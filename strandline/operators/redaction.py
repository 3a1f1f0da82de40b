"""Secrets out of texts that are logged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.rules import BEARER, EMAIL, PAIR, REDACTED


def redact(text: Column, emails: bool = False, prefix: str = "key_") -> Column:
    """Keys of the service (its prefix and 20 characters at least) down to their first eight characters, bearer tokens, values of
    secrets in pairs, and e-mails on demand."""
    shown = max(0, 8 - len(prefix))
    out = F.regexp_replace(text, f"(?i)({prefix}[a-zA-Z0-9]{{{shown}}})[a-zA-Z0-9]{{{20 - shown},}}", f"$1{REDACTED}")
    out = F.regexp_replace(out, f"(?i){BEARER}", f"Bearer {REDACTED}")
    out = F.regexp_replace(out, f"(?i){PAIR}", f"$1={REDACTED}")
    return F.regexp_replace(out, EMAIL, REDACTED) if emails else out


def log_preview(text: Column, most: int = 50) -> Column:
    """Length and digest of a text and its redacted beginning."""
    cut = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
    shown = F.concat(F.lit("["), F.length(text).cast("string"), F.lit(" chars, hash:"), F.substr(F.sha2(text, 256), F.lit(1), F.lit(8)), F.lit("] "), redact(cut))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "[empty]").otherwise(shown)
