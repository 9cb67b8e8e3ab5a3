"""String expressions: F1-F8, P8, P10."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from murmur import config


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stringify(c, parity: bool = False) -> Column:
    """P8. Parity: a missing value becomes the literal text 'nan' (pandas ``astype(str)``).
    Default: keep NULL (callers treat it as empty text)."""
    c = _col(c).cast("string")
    return F.coalesce(c, F.lit("nan")) if parity else c


def relevance(c, keywords=None) -> Column:
    """F7. Number of keywords occurring as substrings of lower(text); NULL text scores 0."""
    keywords = keywords if keywords is not None else config.RELEVANCE_KEYWORDS
    low = F.lower(F.coalesce(_col(c).cast("string"), F.lit("")))
    hits = [F.when(F.instr(low, F.lit(k)) > 0, 1).otherwise(0) for k in keywords]
    return reduce(lambda a, b: a + b, hits, F.lit(0)).cast("int")


def topic(c, rules=None, default: str | None = None, parity: bool = False) -> Column:
    """F8. First rule with a substring hit wins. Parity: NULL text is the word 'nan'."""
    rules = rules if rules is not None else config.TOPIC_RULES
    default = default if default is not None else config.TOPIC_DEFAULT
    low = F.lower(stringify(c, parity=True) if parity else F.coalesce(_col(c).cast("string"), F.lit("")))
    expr = None
    for name, needles in rules:
        cond = reduce(lambda a, b: a | b, [F.instr(low, F.lit(n)) > 0 for n in needles])
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def link_id_from_permalink(c) -> Column:
    """F3. Group 1 of ``/comments/([^/]+)/``; a miss is NULL (Spark itself returns '')."""
    return F.nullif(F.regexp_extract(_col(c), r"/comments/([^/]+)/", 1), F.lit(""))


def normalise_link_id(c, parity: bool = False) -> Column:
    """F4 (+P8). Strip one leading ``t3_``."""
    link = stringify(c, parity)
    return F.when(F.startswith(link, F.lit("t3_")), F.substr(link, F.lit(4))).otherwise(link)


def chunk_array(c, chunk_chars: int = config.CHUNK_CHARS) -> Column:
    """F5. Slice the whole text into ``chunk_chars`` pieces; at least one (possibly empty) piece.
    One pass of a pattern, so the work grows with the text's length only."""
    text = F.coalesce(_col(c), F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(pieces)
