"""Words as variable-length grams over a frequency-pruned dictionary, and how many of them one edit can change.

The dictionary holds every gram of two characters and every longer one whose prefix is frequent, so a gram is as long
as its lists need it to be. A word, between two marks, is decomposed from left to right: at each position the longest
gram of the dictionary, left out where an earlier one covers it. One edit changes the grams that contain its place
and, right of it, those that a new gram could cover; the most over all places is the word's bound. So two words one
edit apart share all but as many grams as either one's bound, at places that differ by the edit's shift only.
"""
from __future__ import annotations

SHORTEST = 2
#: Marks a word's begin and end; no word holds it.
MARK = "|"


def longest_gram(length: int, most: int = 5) -> int:
    """Longest gram for words of ``length`` and one more.

    With ``q <= (length + 4) / 3`` an edit always leaves a gram: starts of neighbouring grams are at most ``q - 1``
    apart, those changed start within ``2 q - 2`` places, and the word with its marks is longer than ``3 q - 3``.
    """
    return min(most, max(3, (length + 1) // 3))


class GramDictionary:
    """``frequent`` maps frequent grams to counts; with each gram it must hold its prefixes (two characters at least)."""

    def __init__(self, frequent: dict[str, int], longest: int):
        self.frequent, self.longest = frequent, longest
        self.tails = {""} | {gram[k:] for gram in frequent if len(gram) < longest for k in range(1, len(gram))}

    def decompose(self, word: str) -> list[tuple[int, int]]:
        """Spans of the grams of a marked word, by start and end alike."""
        frequent, longest, n, spans, covered = self.frequent, self.longest, len(word), [], 0
        for begin in range(n - 1):
            end = begin + SHORTEST
            while end < n and end - begin < longest and word[begin:end] in frequent:
                end += 1
            if end > covered:
                spans.append((begin, end))
                covered = end
        return spans

    def bound(self, word: str, spans: list[tuple[int, int]]) -> int:
        """The most grams that one inserted, deleted or replaced character can change."""
        changes = [0] * (len(word) + 1)
        for begin, end in spans:
            first = begin
            # a gram across the place that ends like this one would cover it
            while first > 0 and end - first < self.longest and word[first:end - 1] in self.tails:
                first -= 1
            changes[first] += 1
            changes[end] -= 1
        most = now = 0
        for change in changes:
            now += change
            most = max(most, now)
        return most

    def rarest(self, word: str) -> list[tuple[int, str]]:
        """Place and text of as many of a marked word's rarest grams as a word one edit away must share one of."""
        spans = self.decompose(word)
        grams = sorted((self.frequent.get(word[a:b], 0), word[a:b], a) for a, b in spans)
        return [(place, gram) for _, gram, place in grams[:self.bound(word, spans) + 1]]
