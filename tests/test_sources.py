import base64
import datetime as dt
import json

import pytest
from annalist.sources import grammars, sinks, tables

D = dt.date


def pages(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_markdown_tables(spark):
    head = "| Date | Match | WON | Rating | Votes |\n|---|---|---|---|---|\n"
    r = tables.rated_matches(pages(spark, head + "| 01.02.2003 | [A & B vs. C](x) | ***1/2 | 7.5 | 12 |\n")).collect()
    assert [(x.air_date, x.sides, x.stars, x.rating, x.votes) for x in r] == [(D(2003, 2, 1), [["A", "B"], ["C"]], 3.5, 7.5, 12)]


def test_promos_first_wins(spark):
    head = "| Date | Promo | Workers | Rating | Votes |\n|--|--|--|--|--|\n"
    r = tables.promos(pages(spark, head + "| 01.02.2003 | [P](?nr=5) | A, B | 8 | 3 |\n| 02.02.2003 | [Q](?nr=5) | C | 8 | 3 |")).collect()
    assert [(x.nr, x.title, x.workers) for x in r] == [(5, "P", ["A", "B"])]


def test_other_tables(spark):
    assert [tuple(r)[:3] for r in tables.feuds(pages(spark, "| Time | Feud | Rating | Votes |\n|-|-|-|-|\n| 01/2001 - 02/2001 | A vs. B | | |")).collect()] == [("A vs. B", "2001-01", "2001-02")]
    assert [tuple(r) for r in tables.tournaments(pages(spark, "| Date | Tournament | Winner |\n|-|-|-|\n| 01.01.2001 | Cup | [A](x) & [B](y) |\n| ? | Cup | [A](x) |")).collect()] == [(D(2001, 1, 1), "Cup", ["A", "B"])]
    assert [tuple(r) for r in tables.title_reigns(pages(spark, "| No | Champion | Dates | Days |\n|-|-|-|-|\n| 1 | A | 01.01.2001 - today | 1,234 |")).collect()] == [(1, ["A"], D(2001, 1, 1), None, 1234)]
    r = tables.listing(pages(spark, "x 01.01.2001 [Show](?id=1&nr=9) @ Town [A](?id=2&nr=3) [B](?id=2&nr=4)")).first()
    assert (r.nr, r.title, r.workers) == (9, "Show", ["A", "B"])


def test_pair_lines(spark):
    df = spark.createDataFrame([(1, "1. Ann\n1/2/2001\n2. Bob\nJanuary 3, 2002")], "id int, value string")
    assert [(r.name, r.day) for r in tables.pair_lines(df, ["line_no"]).orderBy("line_no").collect()] == [("Ann", D(2001, 1, 2)), ("Bob", D(2002, 1, 3))]


def test_embedded_json_and_injection(spark, tmp_path):
    page = sinks.inject('<script id="data">/*DATA*/</script>', json.dumps({"a": "</b>"}))
    assert "<\\/b>" in page
    sinks.atomic_write(str(tmp_path / "p.html"), page)
    assert tables.embedded_json(spark, str(tmp_path / "p.html"), "a string").first().a == "</b>"
    with pytest.raises(ValueError):
        sinks.inject("none", "{}")


def test_shards_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, D(2001, 1, 1), ["m"]), (2, D(2010, 1, 1), ["n"])], "event_id int, air_date date, matches array<string>")
    sinks.write_sharded(df, str(tmp_path / "b"))
    core, shards = spark.read.parquet(str(tmp_path / "b/core")), spark.read.parquet(str(tmp_path / "b/shards"))
    assert sorted(r.era for r in shards.select("era").collect()) == [2001, 2010]
    assert tables.with_shards(core, shards.drop("era")).count() == 2
    with pytest.raises(Exception, match="no shard"):
        tables.with_shards(core, shards.drop("era").where("event_id = 1")).collect()


def test_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("class,event,match,prefix,ruling\nwinner,1,2,A def,keep\n")
    assert tables.rulings(spark, str(tmp_path / "r.csv")).first().prefix == "A def"
    (tmp_path / "h.json").write_text('[{"title": "W"}]')
    assert tables.histories(spark, [str(tmp_path / "h.json"), str(tmp_path / "none.json")], "title string").count() == 1
    assert tables.histories(spark, [str(tmp_path / "none.json")], "title string").count() == 0
    har = {"log": {"entries": [{"request": {"url": "u/x.png"}, "response": {"content": {"mimeType": "image/png", "text": base64.b64encode(b"abc").decode(), "encoding": "base64"}}}]}}
    (tmp_path / "x.har").write_text(json.dumps(har))
    assert bytes(tables.har_images(spark, str(tmp_path / "x.har")).first().body) == b"abc"
    sinks.write_tsv(spark.createDataFrame([("a\tb",)], "x string"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).first().x == "a b"
    assert "| a | 1 |" in sinks.report(spark.createDataFrame([("a",)], "k string"), ["k"], "R")


@pytest.mark.parametrize("text, people", [("A, B & C", ["A", "B", "C"]), ("The Club (A and B) & C", ["A", "B", "C"]), ("Matt & Jeff Hardy", ["Matt Hardy", "Jeff Hardy"]), ("Bob & Jeff Hardy", ["Bob", "Jeff Hardy"]), ("Matt & Jeff Smith", ["Matt", "Jeff Smith"]), ("Bubba Ray & D-Von Dudley", ["Bubba Ray Dudley", "D-Von Dudley"]), ("", [])])
def test_members(text, people):
    assert grammars.flat_members(text) == people


def test_side():
    assert grammars.side("Team X (A & B) (w/ M) (c)") == {"team": "Team X", "participants": ["A", "B"], "accompaniment": ["M"], "champion": True}


@pytest.mark.parametrize(
    "line, winner, result, sides",
    [
        ("A & B def. C & D (10:05)", 0, "pinfall", [["A", "B"], ["C", "D"]]),
        ("World Title Match: A (c) defeated B by DQ", 0, "dq", [["A"], ["B"]]),
        ("A vs. B - No Contest (3:00)", None, "no_contest", [["A"], ["B"]]),
        ("A vs. B ended in a draw", None, "draw", [["A"], ["B"]]),
    ],
)
def test_match_lines(line, winner, result, sides):
    m = grammars.match_line(line)
    assert (m["winner"], m["result"], [s["participants"] for s in m["sides"]]) == (winner, result, sides)


def test_no_match():
    assert grammars.match_line("The show opened with fireworks") is None
    assert grammars.duration("x 1:02:03") == 3723


def test_pages():
    html = "<h3>Jan 1</h3><ul><li>A def. B</li><li>C &amp; D</li></ul><table><tr><td>Date:</td><td>x</td></tr><tr><th>a<th>b<th>c</table>"
    assert grammars.sections(html) == [("Jan 1", ["A def. B", "C & D"])]
    assert grammars.info_box(html) == {"Date": "x"}
    assert [c for t, c in grammars.blocks(html) if t == "tr"][-1] == ["a", "b", "c"]
    assert grammars.blocks("") == []


def test_wikitext():
    blocks = grammars.templates("x {{Infobox event|name=[[A|B]]|date={{d|1|2}}}} {{infobox y}} {{Infobox open", "infobox")
    assert len(blocks) == 2
    assert grammars.templates("}} {{a {{INFOBOX x|{{infobox y}}}}", "infobox") == ["{{INFOBOX x|{{infobox y}}}}"]
    assert grammars.templates("", "x") == [] and grammars.brace_spans("{{{{}}") == [(2, 6)]
    assert grammars.template_fields(blocks[0]) == {"name": "[[A|B]]", "date": "{{d|1|2}}"}


def test_parsed(spark):
    df = spark.createDataFrame([(1, "A def. B"), (2, None), (3, "nothing")], "id int, line string")
    good, bad = grammars.with_quarantine(grammars.parsed(df, "line", "match_line", "m"), "line", "m")
    assert [r.id for r in good.collect()] == [1] and [r.id for r in bad.collect()] == [3]
    assert good.first().m.sides[0].participants == ["A"]
