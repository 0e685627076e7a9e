"""Events and title histories in wikitext, read through the brace and field grammar."""

from __future__ import annotations

import datetime as dt
import re

from . import grammars

MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
_DTS = re.compile(r"\{\{\s*dts\s*\|(\d{4})\|(\d{1,2})\|(\d{1,2})", re.I)
_MONTH_FIRST = re.compile(rf"({MONTH})\s+(\d{{1,2}})(?:\s*(?:–|-|or|and|&)\s*(\d{{1,2}}))?\s*,?\s*(\d{{4}})")
_DAY_FIRST = re.compile(rf"(\d{{1,2}})(?:\s*(?:–|-|or|and|&)\s*(\d{{1,2}}))?\s+({MONTH})\s*,?\s*(\d{{4}})")
_NO_YEAR = re.compile(rf"({MONTH})\s+(\d{{1,2}})")
# Months by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _day(year, month: str, day) -> dt.date | None:
    try:
        return dt.date(int(year), MONTHS.index(month[:3].lower()) + 1, int(day))
    except ValueError:
        return None


def days(text: str | None) -> list[dt.date]:
    """The dates of a field in order: {{dts|y|m|d}}, "April 6, 2024", "15 January 2017", each day of a span; impossible ones are left out."""
    found: list[tuple[int, dt.date | None]] = []
    for m in _DTS.finditer(text or ""):
        try:
            found.append((m.start(), dt.date(*map(int, m.groups()))))
        except ValueError:
            pass
    for pattern, month, first, last in ((_MONTH_FIRST, 1, 2, 3), (_DAY_FIRST, 3, 1, 2)):
        for m in pattern.finditer(text or ""):
            for d in range(int(m[first]), int(m[last] or m[first]) + 1):
                found.append((m.start(), _day(m[4], m[month], d)))
    return [d for _, d in sorted(((p, d) for p, d in found if d), key=lambda x: x)]


def without_notes(text: str) -> str:
    """Wikitext without references and comments."""
    return re.sub(r"(?is)<ref[^>/]*/>|<ref[^>]*>.*?</ref>|<!--.*?-->", "", text)


def shown(text: str | None) -> str:
    """What a page shows of wikitext: notes and templates out, links by their label, marks and tags gone."""
    s = without_notes(text or "")
    spans = [x for x in grammars.brace_spans(s)]
    outer, end = [], 0
    for a, b in spans:
        if a >= end:
            outer.append(s[end:a])
            end = b
    s = "".join([*outer, s[end:]])
    s = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", r"\1", s)
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", s.replace("'''", "").replace("''", ""))).strip(" |")


def results(block: str) -> list[dict]:
    """order, stipulation, seconds, line and what the match grammar reads in it, of a results table (match1, stip1, time1, ...)."""
    fields, out, n = grammars.template_fields(block), [], 1
    while (line := fields.get(f"match{n}")) is not None:
        told = shown(line)
        out.append({"match_order": n, "stipulation": shown(fields.get(f"stip{n}")) or None, "seconds": grammars.duration(fields.get(f"time{n}") or ""), "line": told, "match": grammars.match_line(told)})
        n += 1
    return out


def event(wikitext: str) -> dict | None:
    """name, venue, city, attendance, dates and tables (caption, date, matches) of an event's page; null if it has no infobox.

    A table's date is that of its caption (with the infobox's year), else the date at its place among the
    infobox's dates, else the first of them.
    """
    boxes = grammars.templates(wikitext, "Infobox")
    if not boxes:
        return None
    box = grammars.template_fields(boxes[0])
    dates = days(box.get("date"))
    year = re.search(r"\d{4}", box.get("date") or "")
    tables = []
    for i, block in enumerate(grammars.templates(wikitext, "Pro wrestling results table")):
        caption = shown(grammars.template_fields(block).get("caption")) or None
        named, bare = days(caption), _NO_YEAR.search(caption or "")
        day = named[0] if named else _day(year[0], bare[1], bare[2]) if bare and year else None
        tables.append({"caption": caption, "date": day or (dates[i] if i < len(dates) else dates[0] if dates else None), "matches": results(block)})
    number = re.sub(r"\D", "", shown(box.get("attendance")))
    return {"name": shown(box.get("name")) or None, "venue": shown(box.get("venue")) or None, "city": shown(box.get("city")) or None, "attendance": int(number) if number else None, "dates": dates, "tables": tables}


# The templates that hold a reign.
REIGN_TEMPLATES = ["PWtitlereign", "Professional wrestling title history middle"]


def members(champion: str) -> list[str]:
    """People of a champion field: a small template or parentheses behind a team's name, or the field itself; a slash adds a third one."""
    raw = without_notes(champion)
    small = re.search(r"\{\{\s*small\s*\|\s*\((.*?)\)\s*\}\}", raw, re.S | re.I)
    told = shown(small[1]) if small else shown(re.split(r"(?i)<br\s*/?>", raw)[0])
    inside = re.search(r"\(([^()]*\sand\s[^()]*)\)\s*$", told)
    return [p.strip() for p in re.split(r",?\s+and\s+|,\s*|/|\s&\s", inside[1] if inside else told) if p.strip()]


def title_history(wikitext: str) -> list[dict]:
    """date, champion, members, event, location, notes of every dated reign of a title's page, in page order."""
    text, out = without_notes(wikitext), []
    spans = []
    for name in REIGN_TEMPLATES:
        spans += [(text.find(b), b) for b in dict.fromkeys(grammars.templates(text, name))]
    for _, block in sorted(spans):
        f = grammars.template_fields(block)
        day = days(f.get("date"))
        if day:
            out.append({"date": day[0], "champion": shown(f.get("champion")), "members": members(f.get("champion") or ""), "event": shown(f.get("event")), "location": shown(f.get("location")), "notes": shown(f.get("notes"))})
    return out


_TABLE_MATCH = f"struct<match_order:int,stipulation:string,seconds:int,line:string,match:{grammars.MATCH}>"
grammars.GRAMMARS |= {
    "wiki_event": (event, f"struct<name:string,venue:string,city:string,attendance:int,dates:array<date>,tables:array<struct<caption:string,date:date,matches:array<{_TABLE_MATCH}>>>>"),
    "title_history": (title_history, "array<struct<date:date,champion:string,members:array<string>,event:string,location:string,notes:string>>"),
}
