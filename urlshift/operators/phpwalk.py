"""Reader of one serialized value: the row-level helper of the serialized replace.

A value is walked in its bytes with an explicit stack, so that its depth is bounded by its length alone. String values
are rewritten, with new byte counts; array keys, property names and class names stay. An object that serialized itself
(``C:``) is skipped by its length. A string that is itself a serialized value is walked in place, on the same stack; one that
starts like a serialized value but cannot be read to its end stays as it is.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle

# Shipped inside the function itself, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# One value without members: null, numbers, flags and references.
_SCALAR = re.compile(rb"N;|[irR]:[-+]?\d++;|b:[01];|d:[-+.0-9EINFAe]++;")
_SIZED = re.compile(rb"([sEOC]):(\d{1,18}):\"")
_ARRAY = re.compile(rb"a:(\d{1,18}):\{")
_COUNT = re.compile(rb"(\d{1,18}):\{")
_OPENING = re.compile(rb"[aOCsE]:\d+:")


class Unreadable(Exception):
    pass


class _Frame:
    """Something open: an array or object, or (``after`` is set) a string that holds a serialized value.

    ``left`` values are still to come, the last byte is before ``limit``, and ``out`` collects what is written. Behind
    a string the walk goes on at ``after``; its bytes begin at ``begin``.
    """

    __slots__ = ("left", "limit", "out", "begin", "after")

    def __init__(self, left, limit, out, begin=0, after=None):
        self.left, self.limit, self.out, self.begin, self.after = left, limit, out, begin, after


def _members(raw, at, pattern, limit):
    match = pattern.match(raw, at, limit)
    if not match or int(match[1]) > limit - at:  # a member takes more than a byte
        raise Unreadable
    return 2 * int(match[1]), match.end()


def _sized(raw, at, limit):
    """Kind, content start and content end of a value with a byte count."""
    match = _SIZED.match(raw, at, limit)
    end = match.end() + int(match[2]) if match else limit
    if end >= limit or raw[end] != 34:
        raise Unreadable
    return match[1], match.end(), end


class Rewriter:
    """Rewrites the string values of a serialized text; None where the text is not one whole value.

    ``unread`` counts the strings of the last text that start like a serialized value and cannot be read; they stay.
    """

    def __init__(self, fold):
        self.fold = fold
        self.unread = 0

    def __call__(self, text):
        self.unread = 0
        try:
            return self._walk(text.encode("utf-8")).decode("utf-8")
        except (Unreadable, ValueError):
            return None

    def _walk(self, raw):
        root = _Frame(1, len(raw), [], after=0)
        stack, at = [root], 0
        while True:
            try:
                at = self._step(raw, at, stack)
            except Unreadable:
                # The string around it stays as it is, and with it all that was opened inside.
                while stack[-1].after is None:
                    stack.pop()
                string = stack.pop()
                if string is root:
                    raise
                self.unread += 1
                self._write(stack[-1], raw[string.begin : string.limit])
                at = string.after
            if not stack:
                return b"".join(root.out)

    @staticmethod
    def _write(frame, content):
        frame.out.append(b's:%d:"%s";' % (len(content), content))

    def _step(self, raw, at, stack):
        """Read one value, or close what has come to its end; the place behind it."""
        top = stack[-1]
        if not top.left:
            if top.after is None:
                if at >= top.limit or raw[at] != 125:
                    raise Unreadable
                stack.pop()
                stack[-1].out.append(b"}")
                return at + 1
            if at != top.limit:
                raise Unreadable
            stack.pop()
            if stack:
                self._write(stack[-1], b"".join(top.out))
            return top.after
        is_key = top.after is None and top.left % 2 == 0
        limit = top.limit
        match = _SCALAR.match(raw, at, limit)
        if match:
            top.left -= 1
            top.out.append(match[0])
            return match.end()
        if raw[at : at + 2] == b"a:":
            begin, kind = at, b"a"
            count, after = _members(raw, at, _ARRAY, limit)
        else:
            kind, begin, end = _sized(raw, at, limit)
            if kind in b"sE":
                after = end + 2
                if after > limit or raw[end + 1] != 59:
                    raise Unreadable
            elif kind == b"O":
                count, after = _members(raw, end + 2, _COUNT, limit)
            else:  # only its class can read what it wrote
                match = _COUNT.match(raw, end + 2, limit)
                after = match.end() + int(match[1]) + 1 if match else limit + 1
                if after > limit or raw[after - 1] != 125:
                    raise Unreadable
            if kind in b"OC" and raw[end + 1] != 58:
                raise Unreadable
        if is_key and kind != b"s":
            raise Unreadable
        top.left -= 1
        if kind == b"s" and not is_key:
            content = raw[begin:end]
            if _OPENING.match(content):
                stack.append(_Frame(1, end, [], begin, after))
                return begin
            self._write(top, self.fold(content.decode("utf-8")).encode("utf-8"))
        else:
            top.out.append(raw[at:after])
            if kind in b"aO":
                stack.append(_Frame(count, limit, top.out))
        return after


class TextRewriter:
    """Any text: a serialized value is walked, one that cannot be read to its end stays, the rest is folded."""

    def __init__(self, fold, token, opening):
        self.fold = fold
        self.walk = Rewriter(fold)
        self.token = re.compile(token, re.ASCII)
        self.opening = re.compile(opening, re.ASCII)

    def __call__(self, text):
        if self.opening.match(text) or self.token.search(text):
            done = self.walk(text)
            if done is not None or self.opening.match(text):
                return text if done is None else done
        return self.fold(text)
