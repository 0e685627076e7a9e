"""Archive pages of results: years of a weekly show, years of big events, and every dated event.

A page becomes lines of runs (text, bold, italic); headers are told by a line's words and marks.
"""

from __future__ import annotations

import datetime as dt
import re
from html.parser import HTMLParser

from . import grammars
from .wikitext import MONTHS

_SHORT = re.compile(r"(\d{1,2})/(\d{1,2})/(\d{2})\b")
_EPISODE = re.compile(r"(?:.*?\s)??(Taped\s+)?(\d{1,2}/\d{1,2}/\d{2});\s*([^;]+?)(?:;\s*(.*))?", re.I)
_EVENT = re.compile(r"(.{2,120}?)\s+(?:–|@)\s+(.*?)\s*–\s*([A-Z][a-z]+) (\d{1,2}), (\d{4})\s*")


class _Lines(HTMLParser):
    """Lines of a page: (text, whether all of it is italic or ends so, whether it is bold)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str, bool]] = []
        self.runs: list[tuple[str, bool, bool]] = []
        self.italic = self.bold = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "p"):
            self.end()
        self.italic += tag in ("i", "em")
        self.bold += tag in ("b", "strong")

    def handle_endtag(self, tag):
        if tag == "p":
            self.end()
        self.italic -= tag in ("i", "em") and self.italic > 0
        self.bold -= tag in ("b", "strong") and self.bold > 0

    def handle_data(self, data):
        self.runs.append((data, bool(self.italic), bool(self.bold)))

    def end(self):
        squeeze = lambda parts: re.sub(r"\s+", " ", "".join(parts)).replace("’", "'").strip()
        whole = squeeze(t for t, _, _ in self.runs)
        if whole:
            self.lines.append((whole, squeeze(t for t, i, _ in self.runs if i), any(b for t, _, b in self.runs if t.strip())))
        self.runs = []


def lines(html: str | None) -> list[tuple[str, str, bool]]:
    """(text, its italic part, whether any of it is bold) of every line of a page."""
    p = _Lines()
    p.feed(html or "")
    p.end()
    return p.lines


def _short_date(text: str) -> dt.date | None:
    m = _SHORT.search(text)
    try:
        return dt.date(int(m[3]) + (2000 if int(m[3]) < 70 else 1900), int(m[1]), int(m[2])) if m else None
    except ValueError:
        return None


def _event_head(text: str, bold: bool) -> tuple[str, dt.date] | None:
    m = _EVENT.fullmatch(text) if bold else None
    try:
        return (m[1], dt.date(int(m[5]), MONTHS.index(m[3][:3].lower()) + 1, int(m[4]))) if m else None
    except ValueError:
        return None


def show_year(html: str | None) -> list[dict]:
    """Episodes of a weekly show's year: air_date, tape_date, date_conflict, city, venue, lines.

    A header tells the day and place of a taping; an italic date under it is the air date, and a further one
    begins a second episode of the same taping.  A live show without one airs on its header's day; a taped show
    without one has no air date and is left out.  A live show whose two dates differ is flagged.
    """
    out: list[dict] = []
    head, now = None, None

    def open_(air: dt.date | None, first: bool) -> dict | None:
        if air is None:
            return None
        out.append({"air_date": air, "tape_date": head["day"], "date_conflict": first and not head["taped"] and air != head["day"], "city": head["city"], "venue": head["venue"], "lines": []})
        return out[-1]

    for text, italic, bold in lines(html):
        m = _EPISODE.fullmatch(text)
        if m and (day := _short_date(m[2])):
            head, now = {"day": day, "taped": bool(m[1]), "city": m[3].strip(), "venue": (m[4] or "").strip()}, None
            head["fresh"] = True
        elif _event_head(text, bold):
            head = now = None
        elif head is not None:
            air = _short_date(italic[:80]) if italic and text.startswith(italic[:20]) else None
            if air:
                now = open_(air, head["fresh"])
                rest = text[len(italic) :].lstrip(" :")
                if now and rest:
                    now["lines"].append(rest)
            else:
                if head["fresh"] and not head["taped"]:
                    now = open_(head["day"], True)
                if now is not None and text != italic:
                    now["lines"].append(text)
            head["fresh"] = False
    return out


def all_events(html: str | None) -> list[dict]:
    """date, head, lines of every event under a bold dated header."""
    out: list[dict] = []
    for text, _, bold in lines(html):
        if found := _event_head(text, bold):
            out.append({"date": found[1], "head": found[0], "lines": []})
        elif out:
            out[-1]["lines"].append(text)
    return out


def event_year(html: str | None) -> list[dict]:
    """date, title, heat, ppv (lines) of the events that have a pay-per-view section; sections begin at italic labels, other italic lines are notes."""
    out: list[dict] = []
    now, section = None, None
    for text, italic, bold in lines(html):
        if found := _event_head(text, bold):
            now, section = {"date": found[1], "title": found[0], "heat": [], "ppv": []}, None
            out.append(now)
        elif now is not None and italic and text.startswith(italic[:12]):
            low = italic.lower()
            section = "ppv" if low.startswith("pay-per-view") else "heat" if low.startswith(("sunday night heat", "heat")) else section
            now["has"] = now.get("has", False) or low.startswith("pay-per-view")
            rest = text[len(italic) :].lstrip(" :")
            if rest and section:
                now[section].append(rest)
        elif section:
            now[section].append(text)
    return [{k: v for k, v in e.items() if k != "has"} for e in out if e.get("has")]


_LINES = "array<string>"
grammars.GRAMMARS |= {
    "show_year": (show_year, f"array<struct<air_date:date,tape_date:date,date_conflict:boolean,city:string,venue:string,lines:{_LINES}>>"),
    "event_year": (event_year, f"array<struct<date:date,title:string,heat:{_LINES},ppv:{_LINES}>>"),
    "all_events": (all_events, f"array<struct<date:date,head:string,lines:{_LINES}>>"),
}
