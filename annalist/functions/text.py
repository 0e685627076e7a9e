"""String functions as Column builders (JVM side), and the few that need Unicode tables in Python.

Patterns that touch names carry ``(?U)``, so that word classes are Unicode ones.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACES = r"(?U)\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, build) -> Column:
    """build(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def squeeze(c: Column | str) -> Column:
    """White space runs to one space, ends trimmed; zero-width characters go."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), "[​‌‍﻿]", ""), SPACES, " "))


def chain(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """Replacements one after the other."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, col(c))


def slugify(c: Column | str) -> Column:
    """Lower case; what is not a-z, 0-9, space or hyphen goes; runs of spaces and hyphens become one hyphen; ``unknown`` if nothing is left."""
    s = F.regexp_replace(F.lower(col(c)), r"[^a-z0-9\s-]", "")
    s = F.btrim(F.regexp_replace(s, r"[\s-]+", "-"), F.lit("-"))
    return F.when(s == "", "unknown").otherwise(s)


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def name_key(text: str | None) -> str | None:
    """A name's identity key: no accents, case, quoted nickname (unless that is all), leading "the" or punctuation."""
    if text is None:
        return None
    plain = strip_accents(text).lower().replace("“", '"').replace("”", '"').strip()
    pieces = plain.split('"')
    paired = len(pieces) // 2 * 2 - (len(pieces) % 2 == 0)  # an odd quote at the end closes nothing
    rest = " ".join([*pieces[0:paired:2], *pieces[paired:]]).strip() or plain
    key = re.sub("[^a-z0-9]", "", re.sub(r"^the\s+", "", rest))
    return key or "".join(plain.split())


@F.pandas_udf(T.StringType())
def normkey(names: pd.Series) -> pd.Series:
    """name_key over a column; NFKD has no built-in form."""
    return names.map(name_key, na_action="ignore")


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _words(name: str) -> list[str]:
    return [w for w in re.findall("[a-z0-9]+", name.lower()) if w != "the"]


def strength(a: str, b: str) -> int:
    """How sure two spellings are one person.

    3: equal keys, or one is the other's initials in capitals; 2: the words of one, of which one has 4 letters,
    are among the other's; 1: keys alike to 0.88, the first of 5 letters or more; 0: two people.
    """
    x, y = (re.sub("[^a-z0-9]", "", re.sub(r"^the\s+", "", n.strip().lower())) for n in (a, b))
    if not x or not y:
        return 0
    p, q = _words(a), _words(b)
    initials = any(len(s) > 1 and s.isupper() and s.lower() == "".join(w[0] for w in words) for s, words in ((a, q), (b, p)))
    if x == y or initials:
        return 3
    few, many = sorted((set(p), set(q)), key=len)
    if few and few <= many and max(map(len, few)) >= 4:
        return 2
    return int(len(x) >= 5 and ratio(x, y) >= 0.88)


@F.pandas_udf(T.IntegerType())
def match_strength(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None or y is None else strength(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


# Entities that texts of pages hold.
ENTITIES = {"&amp;": "&", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&lt;": "<", "&gt;": ">"}


def strip_tags(c: Column | str) -> Column:
    """Text of an HTML fragment: tags out, common entities decoded, white space squeezed."""
    s = F.regexp_replace(col(c), "<[^>]*>", "")
    for entity, char in [*((k, v) for k, v in ENTITIES.items() if k != "&amp;"), ("&amp;", "&")]:
        s = F.replace(s, F.lit(entity), F.lit(char))
    return squeeze(s)


def strip_refs(c: Column | str) -> Column:
    """Wikitext without <ref> elements and comments."""
    return chain(c, [(r"(?is)<ref[^>/]*/>", ""), (r"(?is)<ref[^>]*>.*?</ref>", ""), (r"(?s)<!--.*?-->", "")])


def strip_templates(c: Column | str) -> Column:
    """Wikitext without {{templates}}, from the innermost out until none is left (at most as often as braces open)."""
    opens = F.size(F.split(col(c), r"\{\{"))
    return F.aggregate(F.sequence(F.lit(1), opens), col(c), lambda text, _: F.regexp_replace(text, r"\{\{[^{}]*\}\}", ""))


def unlink(c: Column | str) -> Column:
    """[[target|label]] and [[target]] to what is shown; a disambiguating parenthesis goes where there is no label."""
    return chain(c, [(r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]|(]*?)\s*\([^)\]]*\)\]\]", "$1"), (r"\[\[([^\]|]*)\]\]", "$1")])


def links(c: Column | str) -> Column:
    """What the wikilinks of a text show, in order."""
    found = F.regexp_extract_all(col(c), F.lit(r"(\[\[[^\]]*\]\])"), F.lit(1))
    return F.transform(found, lambda x: F.trim(unlink(x)))


# What may stand before or after a person's name in result prose.
LEADING = r"(?i)^(?:and|with|plus|then|newcomer|former champion|champion|wwe|wwf|the team of|special referee|manager)\s+"
TRAILING = r"(?i)\s+(?:wins?|won|defeats?|defeated|def\.?|by (?:pinfall|submission|dq|disqualification|count ?out)|via .*|when .*|after .*|in \d+:\d+.*|at \d+:\d+.*|to retain.*|to win.*)$"
# What stands in a participant's place without naming a person.
PLACEHOLDER = (
    r"(?i)^(?:"
    r"\?\?\?"
    r"|(?:a|an|\d+)\s+jobbers?"
    r"|(?:a|an|\d+)\s+local\s+(?:competitors?|athletes?)"
    r"|\d+\s+ninjas?"
    r"|the\s+masked\s+ninja"
    r"|el\s+local\s+#?\d+"
    r"|facebook|google|twitter|disqus|login\s+this\s+site|newest(?:\s+best)?|oldest|popular"
    r"|\d+\s+up\s+\d+\s+down"
    r"|\d+\s+comments?"
    r"|and|countout|double\s+countout|no\s+contest|no\s+decision"
    r"|.*\bchampion"
    r")$"
)
# Results in a participant's place, and tails of results after a name.
NOT_PEOPLE = ["countout", "double countout", "no contest", "and"]
RESULT_TAIL = r"(?i)\s+(?:by\s+(?:tko|forfeit|reverse\s+decision)|to\s+unify\s+the\s+titles|non)\s*$"
# One person's two spellings, where one is a slip.
CARD_SPELLING = {
    "The Good Father": "The Goodfather",
    "Grand Master Sexay": "Grandmaster Sexay",
    "Lance Anoai": "Lance Anoa'i",
    "Je’Von Evans": "Je'Von Evans",
    "Walter": "WALTER",
    "Iyo Sky": "IYO SKY",
    "Mace": "MACE",
    "T-Bar": "T-BAR",
    "SLAPJACK": "Slapjack",
    "Cruz del Toro": "Cruz Del Toro",
    "månsôör": "mån.sôör",
}


def canonical_name(c: Column | str) -> Column:
    """A person's name out of result prose: brackets, lead words and tails go; "" if it is no name."""
    s = squeeze(chain(c, [(r"\[[^\]]*\]", " "), (r"\((?:c|C|champions?|with [^)]*|w/ ?[^)]*)\)", " "), (r"\([^)]*\)", " ")]))
    s = squeeze(F.regexp_replace(F.regexp_replace(s, LEADING, ""), LEADING, ""))
    s = squeeze(F.regexp_replace(F.regexp_replace(s, TRAILING, ""), TRAILING, ""))
    s = squeeze(F.regexp_replace(s, '"([^"]+)"', "$1"))
    junk = r"^\P{L}*$|(?i)\svs\.?\s|\b(?:defeated|pinned|segment|promo)\b|^(?:he|she|they|his|her|their|it)\s|^.?$|^.{61,}$"
    return let(F.btrim(s, F.lit(" .,;:-–—'")), lambda x: F.when(x.rlike(junk), "").otherwise(x))


def is_placeholder(c: Column | str) -> Column:
    return F.trim(col(c)).rlike(PLACEHOLDER)


def looks_like_prose(c: Column | str) -> Column:
    """Three words or more, one of them lower case and no particle of a name."""
    words = F.split(F.trim(col(c)), SPACES)
    return (F.size(words) >= 3) & F.exists(words, lambda w: w.rlike("^[a-z]{2,}$") & ~w.isin("de", "la", "del", "van", "von", "der", "da", "di", "of", "the", "and", "el"))


def clean_participant(c: Column | str) -> Column:
    """A name as a card shows it, or null where it names nobody; unnamed opponents are told alike, with their number."""
    unnamed = r"(?i)^(an?|\d+)\s+(?:jobbers?|local\s+(?:athletes?|competitors?))$"
    spelled = F.create_map(*(F.lit(x) for kv in CARD_SPELLING.items() for x in kv))

    def told(s: Column) -> Column:
        number = F.lower(F.regexp_extract(s, unnamed, 1))
        crowd = let(number, lambda n: F.when(n.isin("a", "an", "1"), F.lit("a local competitor")).when(n != "", F.concat(n, F.lit(" local competitors"))))
        nobody = (s == "") | F.lower(s).isin(*NOT_PEOPLE) | s.rlike(r"(?i)^(?:the\s+)?[A-Za-z]$")
        return F.when(~nobody, F.coalesce(F.try_element_at(spelled, s), crowd, s))

    closed = let(F.regexp_replace(squeeze(c), r"^[:;,\s]+", ""), lambda s: F.when(s.endswith(")") & ~s.contains("("), F.rtrim(F.substr(s, F.lit(1), F.length(s) - 1))).otherwise(s))
    return let(F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(closed, RESULT_TAIL, "")), "©+$", "")), told)


def clean_participants(names: Column | str) -> Column:
    return F.filter(F.transform(col(names), clean_participant), lambda x: x.isNotNull())


def members(side: Column | str) -> Column:
    """The people of "A, B & C" or "A and B"."""
    return F.filter(F.transform(F.split(col(side), r"(?i)\s*(?:,|&|/|\band\b)\s*"), lambda x: F.trim(x)), lambda x: x != "")


def corner(side: Column | str) -> Column:
    """The people of "... (w/ X & Y)" or "(with X)"."""
    inside = F.regexp_extract(col(side), r"(?i)\((?:w/|with)\s*([^)]*)\)", 1)
    return members(inside)


def sides(line: Column | str) -> Column:
    """"A & B vs. C" to its sides, each an array of people."""
    return F.transform(F.split(col(line), r"(?i)\s+vs?\.?\s+"), members)


def is_multi(match_type: Column | str) -> Column:
    return col(match_type).rlike(r"(?i)\b(?:battle royal|rumble|triple threat|three[- ]way|four[- ]way|\d+[- ]way|gauntlet|scramble|chamber)\b")


def declared_sides(match_type: Column | str) -> Column:
    """How many sides the type of a match declares; null if it does not."""
    t = F.lower(col(match_type))
    digits = F.regexp_extract(t, r"(\d+)[- ](?:way|corners?|team)", 1)
    return F.when(digits != "", digits.cast("int")).when(t.rlike("triple threat|three[- ]way"), 3).when(t.rlike("fatal four|four[- ]way"), 4).when(t.rlike("five[- ]way"), 5).when(t.rlike("six[- ]pack"), 6)


# Stakes that are no belt, stages of tournaments that move none, nights of a series, and what marks a change.
STAKE_FILTER = r"(?i)contender|tournament|battle royal|\bqualif"
TOURNAMENT_FINAL = r"(?i)^(?!.*contend)(.*?\b(?:Championships?|Titles?))\s+Tournament\s*-?\s*Final$"
NON_FINAL_STAGE = r"(?i)\b(?:first\s+round|round\s*(?:of\s+)?\d+|quarter\s*-?\s*finals?|semi\s*-?\s*finals?|qualifying|qualifiers?)\b"
SERIES_NIGHT = r"(?i)\bbest\s+of\s+\w+\s+series\b"
CHANGE_MARK = r"(?i)title change|\bto win the (?:vacant |new )?(?:[\w'’]+ ){0,4}?(?:title|titles|championship|championships)\b"
CONTENDERSHIP = r"(?i)\bcontender(?:ship|s)?\b"
# Spellings of belts.
TITLE_ALIASES = {
    "WWF Championship Title": "WWF World Heavyweight Title",
    "ECW Heavyweight Title": "ECW World Heavyweight Title",
    "WWE Women's Tag Tean Title": "WWE Women's Tag Team Title",
}
# Names of the main singles belts that are told apart by their words alone.
WORLD_SINGLES = ["wwe", "wwf", "undisputed wwe", "wwe world", "wwf world"]


def belt_name(part: Column | str) -> Column:
    """A belt's name in one spelling: the words up to Championship or Title; null if there is no such word."""
    known = F.create_map(*(F.lit(x) for kv in TITLE_ALIASES.items() for x in kv))
    s = F.regexp_extract(squeeze(part), r"(?i)^(.*?\b(?:Championships?|Titles?))(?:\s.*)?$", 1)
    s = F.trim(chain(s, [(r"\bRAW\b", "Raw"), (r"\bChampionships$", "Titles"), (r"\bChampionship$", "Title"), (r"\bWomens\b", "Women's")]))
    return let(s, lambda x: F.when(x != "", F.coalesce(F.try_element_at(known, x), x)))


def belt_parts(stake: Column | str, match_type: Column | None = None, rode: Column | None = None) -> Column:
    """The belts of a stake, in one spelling: quoted stipulations out, "A / B" and "A vs. B" split, shots at a belt and stages of tournaments left out.

    match_type: of a contendership match only belts that it names without the mark behind them count, and those
    only if a belt ``rode`` on the match.
    """

    def belts(whole: Column) -> Column:
        parts = F.filter(F.transform(F.split(whole, r"(?i)\s+/\s+|\s+vs\.?\s+"), squeeze), lambda p: p != "")
        if match_type is not None:
            kind = F.coalesce(match_type, F.lit(""))
            at = lambda p: F.position(F.lower(p), F.lower(kind))
            behind = lambda p: F.substr(F.lower(kind), at(p) + F.length(p))
            mark = r"^\s*(?:#\s*\d+\s*|no\.?\s*\d+\s*|number\s+one\s+)?contender(?:ship|s)?\b"
            held = F.coalesce(rode, F.lit(False)) if rode is not None else F.lit(True)
            parts = F.filter(parts, lambda p: ~kind.rlike(CONTENDERSHIP) | held & ~p.rlike(CONTENDERSHIP) & (at(p) > 0) & ~behind(p).rlike(mark))
        named = F.filter(F.transform(parts, belt_name), lambda p: p.isNotNull())
        return F.when(whole.rlike(STAKE_FILTER), F.array().cast("array<string>")).otherwise(named)

    return let(F.regexp_replace(squeeze(F.regexp_replace(col(stake), "\"[^\"]*\"", " ")), TOURNAMENT_FINAL, "$1"), belts)


def belt_key(title: Column | str) -> Column:
    """A belt's lineage by its words: names of one belt under several promotions share it; the world singles belts do not."""

    def keyed(n: Column) -> Column:
        apart = n.rlike("tag|women|divas|light heavyweight|junior|cruiserweight")
        world = ~apart & (n.rlike("heavyweight") & n.rlike("world|wwe|wwf") | n.isin(*WORLD_SINGLES))
        return F.when(world, F.concat(F.lit("world::"), n)).otherwise(F.concat(F.lit("belt::"), squeeze(F.regexp_replace(n, r"\b(?:wwf|wwe|undisputed)\b", " "))))

    return let(squeeze(F.regexp_replace(F.regexp_replace(F.lower(col(title)), "[^a-z0-9 ]", " "), r"\b(?:championship|title|the|of)\b", " ")), keyed)


def stake_label(stake: Column | str) -> Column:
    """struct(label, note): the belts of a stake, and what else it says."""
    return F.struct(F.array_join(F.array_distinct(belt_parts(stake)), " / ").alias("label"), F.regexp_extract(col(stake), "\"([^\"]*)\"", 1).alias("note"))


def first_keyword(c: Column | str, keywords: list[tuple[str, str]]) -> Column:
    """The value of the first pattern that the text has."""
    out = None
    for pattern, value in keywords:
        hit = col(c).rlike(pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


# Stipulations in order of precedence.
STIPULATIONS = [("(?i)hell in a cell", "Hell in a Cell"), ("(?i)steel cage|cage match", "Steel Cage"), ("(?i)ladder|\\btlc\\b", "Ladder"), ("(?i)tables?\\b", "Tables"), ("(?i)no (?:dq|disqualification|holds barred)", "No Disqualification"), ("(?i)falls count anywhere", "Falls Count Anywhere"), ("(?i)hardcore", "Hardcore"), ("(?i)street fight", "Street Fight"), ("(?i)iron ?man", "Iron Man"), ("(?i)i quit", "I Quit"), ("(?i)last man standing", "Last Man Standing"), ("(?i)submission", "Submission")]


def stipulation(c: Column | str) -> Column:
    return first_keyword(c, STIPULATIONS)


def outcome(was_winner: Column | str, finish: Column | str) -> Column:
    """Outcome of a side from the winner flag (null: nobody won) and the finish."""
    won, how = col(was_winner), F.lower(F.coalesce(col(finish), F.lit("")))
    none, draw = how.rlike("no contest|no decision"), how.rlike(r"\bdraw\b|time limit|double")
    dq, out = how.rlike("dq|disqualif"), how.rlike("count ?out")
    return F.when(none, "no_contest").when(draw | won.isNull(), F.when(draw, "draw").otherwise("no_contest")).when(dq, F.when(won, "win_dq").otherwise("loss_dq")).when(out, F.when(won, "win_countout").otherwise("loss_countout")).when(won, "win").otherwise("loss")


def strip_result_tail(c: Column | str) -> Column:
    return F.trim(F.element_at(F.split(col(c), r"(?i)\s+(?:by|via|in|at|when|after)\s+(?=[\d\w])"), 1))


def stand_ins(c: Column | str) -> Column:
    """map: stand-in -> the person replaced, of "X [Replacement for Y]"."""
    found = r"([A-Z][^\[\]()&,]*?)\s*\[Replacement for ([^\]]+)\]"
    who, whom = (F.transform(F.regexp_extract_all(col(c), F.lit(found), F.lit(i)), lambda x: F.trim(x)) for i in (1, 2))
    return F.map_from_entries(F.array_distinct(F.arrays_zip(F.array_distinct(who), F.slice(whom, F.lit(1), F.size(F.array_distinct(who))))))


def location(c: Column | str) -> Column:
    """struct(venue, city, region, country) of "Venue in City, State, Country"."""
    raw = col(c)
    has = F.instr(raw, " in ") > 0
    venue, place = F.when(has, F.trim(F.substring_index(raw, " in ", 1))), F.when(has, F.substring_index(raw, " in ", -1)).otherwise(raw)
    parts = F.transform(F.split(place, ","), lambda x: F.trim(x))
    n = F.size(parts)
    return F.struct(venue.alias("venue"), F.element_at(parts, 1).alias("city"), F.when(n >= 3, F.try_element_at(parts, F.lit(2))).alias("region"), F.when(n >= 2, F.element_at(parts, -1)).alias("country"))


def base_name(url: Column | str) -> Column:
    return F.regexp_replace(F.substring_index(F.substring_index(col(url), "?", 1), "/", -1), r"\.[A-Za-z0-9]+$", "")


def clean_cell(c: Column | str) -> Column:
    """A value fit for a TSV cell."""
    return F.regexp_replace(col(c), "[\\t\\n\\r]", " ")


def is_match_row(c: Column | str, bold: Column | None = None) -> Column:
    """Whether a list item is a match: a bold type in front, a verb of winning, or a versus."""
    told = col(c).rlike(r"(?i)\b(?:defeat(?:s|ed)?|beats?|def\.?)\s|\svs\.?\s")
    return told if bold is None else told | F.coalesce(bold, F.lit(False))


def show_name(c: Column | str) -> Column:
    """Raw or SmackDown of a title, common misspellings too; else null."""
    low = F.lower(col(c))
    return F.when(low.contains("raw"), "Raw").when(low.contains("mack") | low.rlike("^s(?:ma|am)"), "SmackDown")


def line_texts(html: Column | str) -> Column:
    """The lines of a fragment, cut at <br> and <p>, without tags; empty ones go."""
    return F.filter(F.transform(F.split(col(html), r"(?i)<br\s*/?>|</?p>"), strip_tags), lambda x: x != "")


def linked_stake(html: Column | str, page: str) -> Column:
    """The texts of a fragment's links to title pages (whose address has ``page``), joined by " / "; null if there is none."""
    found = F.regexp_extract_all(col(html), F.lit(rf'<a [^>]*href="[^"]*{page}[^"]*"[^>]*>([^<]*)</a>'), F.lit(1))
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, squeeze), " / "))


def numbered_rows(text: Column | str) -> Column:
    """array<struct(n, text)>: the numbered rows of a text, markup removed."""
    lines_ = F.split(col(text), "\n")
    rows = F.filter(lines_, lambda x: x.rlike(r"^\s*\d+[.)]\s"))
    return F.transform(rows, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d+)", 1).cast("int").alias("n"), strip_tags(F.regexp_replace(x, r"^\s*\d+[.)]\s+", "")).alias("text")))


def as_json_text(c: Column | str) -> Column:
    """A map, array or struct as JSON text; null stays null."""
    return F.when(col(c).isNotNull(), F.to_json(col(c)))
