"""Words of a text, and the search grammar."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# English words that carry no topic.
STOP_WORDS = ["a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "more", "most", "my", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own", "same", "she", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "you", "your"]


def words(text: str | Column) -> Column:
    """Lower-case words in order, stop words kept; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def parse_search(query: str) -> list[list[tuple[tuple[str | None, ...], bool]]]:
    """Alternatives, each a list of (phrase, excluded): quotes make a phrase, ``or`` parts alternatives, a
    leading minus excludes. A stop word inside a phrase is None: it keeps its place. Never an error; a query of
    stop words alone, or of exclusions alone, has no alternative."""
    out: list[list[tuple[tuple[str | None, ...], bool]]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        if word == "or" and not minus:
            out.append([])
            continue
        phrase = [None if w in STOP_WORDS else w for w in re.findall(r"\w+", quoted or word)]
        while phrase and phrase[-1] is None:
            phrase.pop()
        while phrase and phrase[0] is None:
            phrase.pop(0)
        if phrase:
            out[-1].append((tuple(phrase), minus == "-"))
    return [a for a in out if any(not excluded for _, excluded in a)]
