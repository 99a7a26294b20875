"""Forms in which a game shows a text after its own mark-up, so that what is shown is known to the rules as well.

A form is data: what to look for, and a template of what is put in its place. Templates name their parts in angle brackets: <body> is what
stands inside a mark, any other name is a value that only the running game knows. Such a value becomes a placeholder of the rule, one
for each place of the text where the form is used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import replaced

_PART = re.compile(r"<(\w+)>")


def _java(literal: str) -> str:
    return rf"\Q{literal}\E"


@dataclass(frozen=True)
class Mark:
    """A pair of marks round a text on one line, and the template that shows it."""

    opens: str
    closes: str
    shown: str

    @property
    def pattern(self) -> str:
        return f"{_java(self.opens)}.+?{_java(self.closes)}"

    def put(self, found: Column, place: Column) -> Column:
        """The template, filled for a match that is number `place` among all of its text."""
        inner = F.substr(found, F.lit(len(self.opens) + 1), F.length(found) - len(self.opens) - len(self.closes))
        words = _PART.split(self.shown)  # text and names by turns
        known = lambda name: inner if name == "body" else F.concat(F.lit("{__style_"), place.cast("string"), F.lit(f"_{name}}}"))
        return F.concat(*[known(w) if i % 2 else F.lit(w) for i, w in enumerate(words) if w])


@dataclass(frozen=True)
class Emphasis:
    """Every mark in a text is shown by its template, in the source and in the target."""

    marks: tuple[Mark, ...]

    def shown(self, text: Column) -> Column:
        def put(found: Column, place: Column) -> Column:
            return reduce(lambda rest, m: F.when(found.startswith(m.opens), m.put(found, place)).otherwise(rest), reversed(self.marks), found)

        return replaced(text, "|".join(m.pattern for m in self.marks), put)

    def pair(self, source: Column, target: Column) -> tuple[Column, Column]:
        return self.shown(source), self.shown(target)


@dataclass(frozen=True)
class Narration:
    """In a text with speech, all that stands beside the quotes of a line is shown by a template; a target that has none of it is shown whole."""

    quotes: tuple[tuple[str, str], ...]
    template: str

    @property
    def _sides(self) -> tuple[str, str]:
        before, _, after = self.template.partition("<body>")
        return before, after

    def wrapped(self, text: Column) -> Column:
        before, after = self._sides
        return F.concat(F.lit(before), text, F.lit(after))

    def shown(self, text: Column) -> Column:
        speech = "|".join(rf"{a}[^{b}\n]*{b}" for a, b in self.quotes)
        opening = "".join(a for a, _ in self.quotes)
        # speech is looked for as well, so that nothing inside it is; a stretch may begin with a quote that is never closed, and stays too
        said = lambda found: found.rlike(f"^[{opening}]")
        toned = replaced(text, rf"{speech}|(?:(?!{speech})[^\n])+", lambda found, _: F.when(said(found), found).otherwise(self.wrapped(found)))
        return F.when(text.rlike(f"[{opening}]"), toned).otherwise(text)

    def pair(self, source: Column, target: Column) -> tuple[Column, Column]:
        mark = F.lit(self._sides[0])
        one, other = self.shown(source), self.shown(target)
        return one, F.when(F.contains(one, mark) & ~F.contains(other, mark), self.wrapped(other)).otherwise(other)


# The marks and quotes of the engine, what it shows for them, and the names by which a project asks for them.
_BOX = "[bgcolor=<bg>][color=<ink>][font_size=<size>] <body> [/font_size][/color][/bgcolor]"
FORMS = {
    "double_markup": Emphasis((Mark("**", "**", "[color=<ink>]<body>[/color]"), Mark("[[", "]]", _BOX), Mark("((", "))", _BOX))),
    "quote_narration": Narration((("「", "」"), ("“", "”")), "[color={__narration}]<body>[/color]"),
}
