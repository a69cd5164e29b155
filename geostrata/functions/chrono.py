"""Date patterns of the strftime kind in Spark's letters."""

from __future__ import annotations

import re

# strftime's letters and Spark's.
LETTERS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "b": "MMM", "h": "MMM", "B": "MMMM", "d": "dd", "e": "d", "a": "EEE", "A": "EEEE", "j": "DDD", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "f": "SSSSSS", "3f": "SSS", "6f": "SSSSSS",
    ".3f": ".SSS", ".6f": ".SSSSSS", "z": "xx", ":z": "xxx", "Z": "z", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "%": "%",
}
_PART = re.compile(r"%(\.?[36]f|:z|[A-Za-z%])|([A-Za-z']+)|([^%A-Za-z']+|%)", re.S)


def java_pattern(pattern: str) -> str:
    """'%Y-%m-%d at %H' as "yyyy-MM-dd 'at' HH". Unknown letters raise ValueError."""
    out = []
    for code, letters, rest in _PART.findall(pattern):
        if code:
            if code not in LETTERS:
                raise ValueError(f"date pattern: %{code}")
            out.append(LETTERS[code])
        else:
            out.append("'" + letters.replace("'", "''") + "'" if letters else rest)
    return "".join(out)
