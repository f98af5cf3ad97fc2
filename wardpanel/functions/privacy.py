"""Word labels for notes whose private parts were replaced by [**tag**] marks."""

from __future__ import annotations

import re
from collections import Counter
from itertools import accumulate, pairwise

from wardpanel.functions.codes import PRIVACY_RULES

MARK = re.compile(r"\[\*\*(.+?)\*\*\]", re.DOTALL)


def category(raw: str) -> str:
    """Python twin of the column rule, from the same table."""
    clean = re.sub("[^a-z0-9 ]+", " ", raw.strip().lower()).strip()
    for label, rule in PRIVACY_RULES:
        if rule == "digits":
            hit = re.fullmatch(r"\d+", raw.strip()) is not None
        elif rule == " id ":
            hit = rule in f" {clean} "
        elif isinstance(rule, str):
            hit = re.search(rule, clean) is not None
        else:
            hit = any(w in clean for w in rule)
        if hit:
            return label
    return "NAME"


def spans(original: str, tagged: str) -> list[tuple[int, int, str]]:
    """Where each mark lies in the original: the gap between the plain texts around it.

    The plain texts are placed from left to right.  One that is not found counts as starting where the last one ended, so the
    mark before it gets no span; an empty one after a mark stands for the end of the original.
    """

    def place(last: tuple[int, int], text: str) -> tuple[int, int]:
        start = original.find(text, last[1]) if text else len(original)
        start = last[1] if start < 0 else start
        return start, start + len(text)

    first, *rest = MARK.split(tagged)
    texts, tags = rest[1::2], rest[::2]
    placed = accumulate(texts, place, initial=place((0, 0), first) if first else (0, 0))
    return [(left[1], right[0], category(tag)) for (left, right), tag in zip(pairwise(placed), tags) if right[0] > left[1]]


def tag_words(original: str, tagged: str) -> list[dict[str, str]]:
    """A word takes the category that covers most of its characters; a word that continues the category before it gets I-."""
    marks = spans(original, tagged)
    out, previous, first = [], "O", 0
    for word in re.finditer(r"\S+", original):
        cover: Counter[str] = Counter()
        while first < len(marks) and marks[first][1] <= word.start():
            first += 1
        for start, end, label in marks[first:]:
            if start >= word.end():
                break
            cover[label] += min(end, word.end()) - max(start, word.start())
        label = "O"
        if cover:
            name = cover.most_common(1)[0][0]
            label = ("I-" if previous != "O" and previous.endswith(name) else "B-") + name
        out.append({"word": word.group(), "label": label})
        previous = label
    return out
