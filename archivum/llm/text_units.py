"""Independent units of a text under byte-level BPE pre-tokenisation.

Every token that the public pre-tokenisation pattern finds holds white space at its start only, or nothing else.  So a
text may be cut before each white-space run, and its tokens are those of the units.  Units repeat far more often than
texts do, which is what the callers' bounded caches use.
"""

from __future__ import annotations

import re

#: The characters that Unicode calls white space.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A word's text as most tokens are: read without the slow path of a negated class.
_UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Longest unit that is kept in a cache.
LONGEST = 64


def units(text: str) -> list[str]:
    """The units of a text, in order; joined they are the text."""
    return _UNIT.findall(text)
