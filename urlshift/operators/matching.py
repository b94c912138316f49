"""Finding many literal patterns in one text: the row-level helper of large plans."""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle

# Shipped inside the function itself, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD = 2


class Finder:
    """Places of the patterns that occur in a text.

    The patterns of a plan share their first characters (``//`` or an escaped form). The text is searched
    for these heads only, and at each one a slice per pattern length is looked up.
    """

    def __init__(self, patterns):
        self.heads = {}
        for place, pattern in enumerate(patterns):
            by_size = self.heads.setdefault(pattern[:HEAD], {})
            by_size.setdefault(len(pattern), {}).setdefault(pattern, []).append(place)

    def __call__(self, text):
        for head, by_size in self.heads.items():
            at = text.find(head)
            while at >= 0:
                for size, known in by_size.items():
                    places = known.get(text[at : at + size])
                    if places:
                        yield from places
                at = text.find(head, at + 1)


class Folder:
    """Ordered replacements on one text: after each change the text is searched again for later patterns."""

    def __init__(self, pairs, boundary=False):
        self.pairs = pairs
        self.boundary = boundary
        self.find = Finder([search for search, _ in pairs])

    def _next(self, text, after):
        return min((place for place in self.find(text) if place > after), default=None)

    def __call__(self, text):
        place = self._next(text, -1)
        while place is not None:
            search, new = self.pairs[place]
            text = self._bounded(text, search, new) if self.boundary else text.replace(search, new)
            place = self._next(text, place)
        return text

    @staticmethod
    def _bounded(text, search, new):
        return re.sub(re.escape(search) + r"(?![A-Za-z0-9.-])", lambda _: new, text)


class Counter:
    """Non-overlapping occurrences of every pattern in one text."""

    def __init__(self, pairs):
        self.pairs = pairs
        self.find = Finder([search for _, search in pairs])

    def __call__(self, text):
        return [
            {"seq": self.pairs[place][0], "replacements": text.count(self.pairs[place][1])}
            for place in sorted(set(self.find(text)))
        ]
