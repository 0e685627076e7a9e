import datetime as dt
import sqlite3
import zipfile

import pytest
from annalist.sources import archive, files, grammars, wikitext

D = dt.date

EVENT = """{{Infobox Wrestling event
|name = Big Night<ref>x</ref> |venue = [[Some Hall]] |city = [[Town]], State |attendance = 12,345{{cn}} |date = April 2-3, 2022 }}
text {{Pro wrestling results table
|caption = Night 1 (April 2)
|match1 = [[Ann Lee|Ann]] (c) defeated [[Bob]] by pinfall
|stip1 = [[Ladder match]] for the World Championship
|time1 = 10:05
|match2 = nothing to read
}} {{pro wrestling results table|match1=Cat and Dan defeated Eve and Fay}} {{Pro wrestling results table|caption=x|match1=G vs. H - No Contest"""


def test_wiki_events():
    e = wikitext.event(EVENT)
    assert (e["name"], e["venue"], e["city"], e["attendance"], e["dates"]) == ("Big Night", "Some Hall", "Town, State", 12345, [D(2022, 4, 2), D(2022, 4, 3)])
    assert [t["date"] for t in e["tables"]] == [D(2022, 4, 2), D(2022, 4, 3)]
    one, two = e["tables"][0]["matches"]
    assert one["seconds"] == 605 and one["stipulation"] == "Ladder match for the World Championship"
    assert [s["participants"] for s in one["match"]["sides"]] == [["Ann"], ["Bob"]] and one["match"]["sides"][0]["champion"]
    assert two["match"] is None and two["line"] == "nothing to read"
    assert [s["participants"] for s in e["tables"][1]["matches"][0]["match"]["sides"]] == [["Cat", "Dan"], ["Eve", "Fay"]]
    assert wikitext.event("no box") is None


@pytest.mark.parametrize("text, want", [("{{dts|2001|2|3}}", [D(2001, 2, 3)]), ("{{dts|April 6, 2024}}", [D(2024, 4, 6)]), ("April 6 ,2024", [D(2024, 4, 6)]), ("October 30 2022", [D(2022, 10, 30)]), ("March 25 or 26, 2020", [D(2020, 3, 25), D(2020, 3, 26)]), ("{{dts|15 January 2017}}", [D(2017, 1, 15)]), ("February 30, 2001", []), (None, [])])
def test_wiki_dates(text, want):
    assert wikitext.days(text) == want


def test_title_histories():
    page = """{{PWtitlereign|champion=[[Too Cool]] {{small|([[A]] and [[B]])}}|date={{dts|2001|1|2}}|event=[[Raw]]<ref>{{cite|date=May 5, 1999}}</ref>|location=Town}}
{{Professional wrestling title history middle
|champion = {{sortname||Edge|dab=wrestler}}[[Edge]]<br/>x
|date = 15 March 2002
|notes = {{small|n}}won}}
{{PWtitlereign|champion=C|date=soon}} {{PWtitlereign|champion=D/E|date=May 1, 2003"""
    assert [(r["date"], r["champion"], r["members"]) for r in wikitext.title_history(page)] == [(D(2001, 1, 2), "Too Cool", ["A", "B"]), (D(2002, 3, 15), "Edge x", ["Edge"])]
    assert wikitext.title_history(page)[1]["notes"] == "won"
    assert wikitext.members("[[Logan]]/[[Bron]]") == ["Logan", "Bron"] and wikitext.members("[[T|A and B]]") == ["A", "B"]


SHOWS = """<p>Taped 1/2/01; Town, ST; Some Arena<br/><i>1/4/01 - first</i>:<br/>Ann pinned Bob<br/>Cat defeated Dan<br/><i>1/11/01</i>: Eve pinned Fay</p>
<p>Show 1/8/01; City, ST<br/>Gus pinned Hal</p><p>1/15/01; Place; Hall<br/><i>1/22/01</i>:<br/>Ivy pinned Joe</p>
<p>Taped 2/2/01; Lost, ST<br/>Kim pinned Lou</p><p><b>Group @ Trenton, NJ &#8211; Hall &#8211; February 9, 2001</b><br/>Moe pinned Ned</p>"""


def test_show_years():
    e = archive.show_year(SHOWS)
    assert [(x["air_date"], x["tape_date"], x["city"], x["lines"]) for x in e] == [
        (D(2001, 1, 4), D(2001, 1, 2), "Town, ST", ["Ann pinned Bob", "Cat defeated Dan"]),
        (D(2001, 1, 11), D(2001, 1, 2), "Town, ST", ["Eve pinned Fay"]),
        (D(2001, 1, 8), D(2001, 1, 8), "City, ST", ["Gus pinned Hal"]),
        (D(2001, 1, 22), D(2001, 1, 15), "Place", ["Ivy pinned Joe"]),
    ]
    assert [x["date_conflict"] for x in e] == [False, False, False, True]
    assert archive.show_year(None) == []


def test_event_years():
    page = """<p><b>Big Night &#8211; Town &#8211; Hall &#8211; April 1, 2001</b><br/><i>Sunday Night Heat</i>:<br/>A pinned B<br/><i>Pay-per-view bouts</i> - 5 hours:<br/>C pinned D<br/><i>featured a video</i>:<br/>E pinned F</p>
<p><b>Group @ Ft. Worth, TX &#8211; Hall &#8211; April 2, 2001</b><br/>G pinned H</p>"""
    assert archive.event_year(page) == [{"date": D(2001, 4, 1), "title": "Big Night", "heat": ["A pinned B"], "ppv": ["- 5 hours:", "C pinned D", "E pinned F"]}]
    assert [(e["date"], e["head"], len(e["lines"])) for e in archive.all_events(page)] == [(D(2001, 4, 1), "Big Night", 6), (D(2001, 4, 2), "Group", 1)]


def test_pages_on_spark(spark):
    df = spark.createDataFrame([(1, EVENT, SHOWS), (2, "no box", None)], "id int, wiki string, page string")
    good, bad = grammars.with_quarantine(grammars.parsed(df, "wiki", "wiki_event", "e"), "wiki", "e")
    assert good.first().e.tables[0].matches[0].match.sides[1].participants == ["Bob"] and [r.id for r in bad.collect()] == [2]
    assert grammars.parsed(df, "page", "show_year", "s").where("id = 1").first().s[0].air_date == D(2001, 1, 4)


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "w.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "ev" (id INTEGER PRIMARY KEY, "air date" TEXT, n REAL)')
        db.executemany("INSERT INTO ev VALUES (?, ?, ?)", [(i, f"2001-01-{i:02d}" if i % 5 else None, i / 2) for i in range(1, 26)])
    got = files.sqlite_table(spark, path, "ev", "id long, `air date` string, n double", rows_per_part=7)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect()))[3:5] == [(4, "2001-01-04", 2.0), (5, None, 2.5)] and got.count() == 25


def test_sheets(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Title</t></si><si><r><t>A</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2" s="1"><v>36893</v></c><c r="D2"><v>4.5</v></c></row><row/></sheetData></worksheet>')
    assert [r.cells for r in files.sheets(spark, str(tmp_path / "*.xlsx")).orderBy("row").collect()] == [["Title"], ["Ab", None, "2001-01-02", "4.5"], []]
