"""Checks of user definitions: periods of rolling functions and checksums of parameters."""

from __future__ import annotations

import hashlib
import json

LEAST, MOST = 1, 500


def period(n: int, least: int = LEAST) -> int:
    """n as a whole number of rows within the bounds; deviations need two."""
    if isinstance(n, bool) or n != int(n) or not least <= n <= MOST:
        raise ValueError(f"a period lies between {least} and {MOST}: {n}")
    return int(n)


def checksum(definition: dict) -> str:
    """Sixteen hex digits that equal definitions share: blanks count as missing, numbers as floats, keys in any order."""
    plain = {k: None if v in ("", None) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for k, v in definition.items()}
    return hashlib.sha256(json.dumps(plain, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
