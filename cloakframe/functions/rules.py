"""Detection rules: validated patterns that become column expressions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from cloakframe.schemas import MENTION_STRENGTH, MENTION_TYPE

# Patterns, confidence and strength of the standard rules.  Word edges are
# written out, because Java's \b follows Unicode.
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
ID_CARD = r"(?<![A-Za-z0-9_])[0-9]{17}[0-9Xx](?![A-Za-z0-9_])"
PHONE = r"(?<![0-9])(?:\+?86[- ]?)?1[3-9][0-9]{9}(?![0-9])"
CONFIDENCE = 0.99
STRENGTH = "EXPLICIT"


@dataclass(frozen=True)
class Rule:
    """A mention type and the pattern of its mentions.

    ``needle`` is a string that every match holds; texts without it are not searched.
    """

    type: str
    pattern: str
    strength: str = STRENGTH
    confidence: float = CONFIDENCE
    needle: str = ""

    def __post_init__(self) -> None:
        if not self.pattern or re.search(self.pattern, "", re.ASCII):
            raise ValueError("a rule must not match empty text")
        if not math.isfinite(self.confidence) or not 0 <= self.confidence <= 1:
            raise ValueError("a rule's confidence must be between 0 and 1")
        if self.type not in MENTION_TYPE:
            raise ValueError("unknown mention type")
        if self.strength not in MENTION_STRENGTH:
            raise ValueError("unknown mention strength")


STANDARD = (Rule("EMAIL", EMAIL, needle="@"), Rule("ID_CARD", ID_CARD), Rule("PHONE", PHONE))
