"""The JWT predicate: tokens signed with a shared secret (HS...) are worthless alone and aren't reported."""

from __future__ import annotations

import base64
import binascii
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_HMAC = r'^(?:(?!"alg")[\s\S])*"alg"[:\s]*"*HS'


def keep_jwt(token: str) -> bool:
    """False if the header says that the token is signed by HMAC, or if there is no header; what can't be read is kept."""
    head, dot, _ = token.partition(".")
    if not dot:
        return False
    head = head.rstrip("=")
    try:
        raw = base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))
        if base64.urlsafe_b64encode(raw).rstrip(b"=") != head.encode():
            return True
        return re.match(_HMAC, raw.decode()) is None
    except (binascii.Error, ValueError):
        return True


def is_kept_jwt(token: str | Column) -> Column:
    """The same as a column expression."""
    c = F.col(token) if isinstance(token, str) else token
    head = F.regexp_replace(F.substring_index(c, ".", 1), "=+$", "")
    raw = F.try_to_binary(F.translate(head, "-_", "+/"), F.lit("BASE64"))
    return F.contains(c, F.lit(".")) & ~F.coalesce(F.rlike(F.try_validate_utf8(raw.cast("string")), F.lit(_HMAC)), F.lit(False))
