"""Flags of what a typed query asks for (X18), as regular expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The phrases by which a query's intent is told.
FIRST_PERSON = r"\b(i|i'm|im|i’m|i am|i've|ive|me|my|myself)\b"
DISTRESS_WORDS = r"\b(depressed|depressing|hopeless|worthless|suicidal|self[- ]?harm\w*|cutting myself|can'?t cope|can’t cope|cannot cope|can'?t go on|can’t go on|so alone|empty inside|hate myself|panic attacks?|give up on (life|everything)|no point (in )?living|want to disappear)\b"
DISTRESS_INTENT = r"\b(kill (myself|me)|end (my life|it all)|take my (own )?life|want to die|wanna die|hurt(ing)? myself|cut(ting)? myself|better off dead|no reason to live|suicide (method|note)s?|how to (commit suicide|overdose|kill))\b"
SELF_HARM = r"\b(kill (myself|me)|suicid\w*|self[- ]?harm\w*|end my life|hurt myself|want to die)\b"
ADVICE = (
    r"\bshould (i|we)\b|\bshould (my|our) (kid|kids|child|children|son|daughter|teen\w*)\b|\bcan i (eat|drink|have)\b|\bis [\w\s'’-]{1,30}? (safe|ok|okay|healthy|harmful|bad|good)( for)?\b"
    r"|\bhow (much|many|long) [\w\s'’-]{0,35}(safe|healthy|should|ok|okay|per day|a day|is too much)\b|\b(healthy|safe) (amount|dose|level)\b|\b(good|bad) for (me|you|my)\b|\brecommend(ed)?\b"
    r"|\bdiet plan\b|\blose weight\b|\bfor my (health|heart|diabetes)\b|\bmy (kid|kids|child|children|son|daughter|teen\w*)\b"
)
SEXUAL = r"\b(porn\w*|nude\w*|nsfw|xxx|sex (video|chat|tape)s?|onlyfans)\b"
SLURS = r"\b(nigg|fagg?ot|retard|kike|spic|chink|tranny|wetback)\w*"
PERSON_NAME = r"^\s*[A-Z][a-z'’-]+(\s+[A-Z][a-z'’-]+){1,2}\s*$"


def _says(query: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(query, F.lit(f"(?i){pattern}")), F.lit(False))


def distress(query: Column) -> Column:
    """Self-harm intent, or words of distress in the first person; a null query has no intent."""
    return _says(query, DISTRESS_INTENT) | (_says(query, FIRST_PERSON) & _says(query, DISTRESS_WORDS))


def advice(query: Column) -> Column:
    return _says(query, ADVICE)


def self_harm(query: Column) -> Column:
    return _says(query, SELF_HARM)


def blocked(query: Column) -> Column:
    """Subjects that are never offered, and what looks like a person's name and nothing else."""
    return self_harm(query) | _says(query, SEXUAL) | _says(query, SLURS) | F.coalesce(F.rlike(query, F.lit(PERSON_NAME)), F.lit(False))
