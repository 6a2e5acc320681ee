"""Which band of a query a phrase speaks of, and which tables and columns: by words and shapes, without a model."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field

_BANDS = {
    "window": r"\b(top|rank(ed|ing)?|best|worst|highest|lowest|first|last|running|cumulative|moving|previous|next)\b",
    "aggregate": r"\b(total|sum|average|avg|mean|count|how many|number of|per|by each|grouped?|median|maximum|minimum)\b",
    "filter": r"\b(where|only|with|without|whose|from|in|between|more than|less than|at least|at most|except|not)\b",
}
_TIME = {
    "as_of": r"\b(as of|as at|back then|at that time|on \d{4}-\d\d-\d\d)\b",
    "to_date": r"\b(year|quarter|month) to date\b|\b(ytd|qtd|mtd)\b",
    "rolling": r"\b(last|past|trailing|rolling) \d+ (day|week|month|quarter|year)s?\b",
    "period": r"\b(between .+ and .+|in (19|20)\d\d|q[1-4] (19|20)\d\d)\b",
    "trend": r"\b(over time|trend|by (day|week|month|quarter|year)|monthly|weekly|daily|yearly)\b",
}
_COMPOSE = {"union": r"\b(or also|as well as|together with|combined with|plus)\b", "intersect": r"\b(both|and also|that also|overlap)\b", "except": r"\b(but not|except|excluding|minus)\b", "join": r"\b(along with their|matched with|related to|joined to)\b"}


def _first(kinds: dict[str, str], text: str) -> str | None:
    return next((k for k, p in kinds.items() if re.search(p, text, re.I)), None)


def band(text: str) -> str:
    """window, aggregate or filter; context if it is none of these."""
    return _first(_BANDS, text) or "context"


def temporal(text: str) -> str | None:
    return _first(_TIME, text)


def composition(text: str) -> str | None:
    return _first(_COMPOSE, text)


@dataclass
class Entities:
    """Names that phrases may mean: tables, columns, and other words for them."""

    names: dict[str, str] = field(default_factory=dict)

    def add(self, target: str, *words: str) -> Entities:
        for w in (target.rpartition(".")[2].replace("_", " "), *words):
            self.names[w.lower()] = target
        return self

    def find(self, text: str, least: float = 0.84) -> list[str]:
        """Targets that the text names, exactly (in one or more words) or nearly, in the order they come up."""
        words = re.findall(r"[a-z0-9]+", text.lower())
        out: list[str] = []
        at = 0
        while at < len(words):
            for n in (3, 2, 1):
                said = " ".join(words[at : at + n])
                plain = said if said in self.names else said.removesuffix("s")
                if plain not in self.names and n == 1 and len(said) > 4:
                    plain = next(iter(difflib.get_close_matches(said, self.names, 1, least)), plain)
                if plain in self.names:
                    out.append(self.names[plain])
                    at += n - 1
                    break
            at += 1
        return list(dict.fromkeys(out))
