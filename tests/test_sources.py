"""Sources and sinks (S1–S11) on temp-dir files."""

import json
import os

import pytest

from pyspark.sql import functions as F

from litspark.sources import files, sinks
from litspark.sources import topics as topic_io


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


CSV = ('title,affiliation,year,abstract\n'
       '"A title","Uni, X",2021,"line one\nline ""two"""\n'
       'short,only\n'
       'long,x,2021,y,extra\n'
       'ok,Inst,2019,plain\n')


def test_csv_multiline_escape_and_bad_lines(spark, tmpdir_path):
    write(f"{tmpdir_path}/p.csv", CSV)
    rows = {r["title"]: r for r in files.read_papers_csv(spark, tmpdir_path, bad_lines="skip").collect()}
    assert rows["A title"]["abstract"] == 'line one\nline "two"'
    assert rows["A title"]["affiliation"] == "Uni, X"
    assert "long" not in rows                     # too many fields: skipped
    assert rows["short"]["year"] is None          # too few fields: kept, null padded
    assert rows["ok"]["year"] == 2019


def test_default_csv_read_keeps_short_lines_and_fails_on_long_ones(spark, tmpdir_path):
    write(f"{tmpdir_path}/s/p.csv", "title,affiliation,year,abstract\nshort,only\nok,Inst,2019,plain\n")
    rows = {r["title"]: r for r in files.read_papers_csv(spark, f"{tmpdir_path}/s").collect()}
    assert rows["short"]["abstract"] is None and rows["ok"]["abstract"] == "plain"
    write(f"{tmpdir_path}/l/p.csv", CSV)
    with pytest.raises(Exception, match="too many fields"):
        files.read_papers_csv(spark, f"{tmpdir_path}/l").collect()


@pytest.mark.parametrize("scheme", ["", "file://", "file:"])
def test_filenames_are_decoded_and_relative(spark, tmpdir_path, scheme):
    for name in ("sub dir/a b.json", "plus+sign/c%20d.json"):
        write(f"{tmpdir_path}/{name}", json.dumps(record({})))
    good, bad = files.read_json_tree(spark, scheme + tmpdir_path)
    assert {r["filename"] for r in good.collect()} == {"sub dir/a b.json", "plus+sign/c%20d.json"} and not bad.collect()


def record(org_group):
    return {"abstracts-retrieval-response": {"item": {
        "ait:process-info": {"ait:date-delivered": {"@year": "2021"}},
        "bibrecord": {"head": {"author-group": org_group, "abstracts": "About Climate Change today",
                               "citation-title": "T"}}}}}


def test_json_tree_recursive_with_rejects(spark, tmpdir_path):
    from litspark.operators import flatten
    write(f"{tmpdir_path}/a/one.json", json.dumps(record(
        {"affiliation": {"organization": [{"$": "Dept"}, {"$": "Uni A"}]}})))
    write(f"{tmpdir_path}/a/b/two.json", json.dumps(record(
        [{"affiliation": {}}, {"affiliation": {"organization": {"$": "Uni B"}}}])))
    write(f"{tmpdir_path}/a/b/three.json", json.dumps(record([{"affiliation": {"organization": []}}])))
    write(f"{tmpdir_path}/bad.json", "{not json")
    write(f"{tmpdir_path}/notes.txt", json.dumps(record({})))
    good, bad = files.read_json_tree(spark, tmpdir_path)
    flat = {r["filename"]: r for r in flatten.flatten_records(good).collect()}
    assert set(flat) == {"a/one.json", "a/b/two.json", "a/b/three.json"}
    assert flat["a/one.json"]["organization"] == "Uni A"       # last of the list
    assert flat["a/b/two.json"]["organization"] == "Uni B"     # first non-empty group
    assert flat["a/b/three.json"]["organization"] is None      # empty list: null, no crash
    assert flat["a/one.json"]["year"] == 2021
    assert [r["filename"] for r in bad.collect()] == ["bad.json"]
    rel = flatten.relevant(flatten.flatten_records(good), "abstracts")
    assert rel.count() == 3


def test_work_pages_from_files(spark, tmpdir_path):
    from litspark.operators import flatten
    item = {"title": [" T1 "], "author": [{"affiliation": [{"name": " Uni "}]}],
            "published": {"date-parts": [[2022, 1]]}, "abstract": " A "}
    no_aff = dict(item, author=[{"affiliation": []}])
    write(f"{tmpdir_path}/p1.json", json.dumps({"message": {"items": [item, no_aff], "next-cursor": "x"}}))
    write(f"{tmpdir_path}/p2.json", json.dumps({"message": {"items": [], "next-cursor": None}}))
    rows = flatten.flatten_works(files.read_work_pages(spark, tmpdir_path)).collect()
    assert [tuple(r) for r in rows] == [("T1", "Uni", 2022, "A")]


def test_topic_csv_round_trip(spark, tmpdir_path):
    long = spark.createDataFrame([(0, 0, "energy"), (0, 1, "carbon"), (1, 0, "climate"), (1, 1, "change")],
                                 "topic_id int, rank int, term string")
    topic_io.write_topic_words(long, f"{tmpdir_path}/tw", 2)
    back = topic_io.read_topic_words(spark, f"{tmpdir_path}/tw")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))
    # header-only-ranks layout: topic id = row position
    write(f"{tmpdir_path}/plain/t.csv", "0,1\nenergy,carbon\nclimate,change\n")
    back2 = topic_io.read_topic_words(spark, f"{tmpdir_path}/plain")
    assert sorted(map(tuple, back2.collect())) == sorted(map(tuple, long.collect()))
    write(f"{tmpdir_path}/labels/l.csv", '0\n"Energy, carbon"\nClimate\n')
    labels = topic_io.read_topic_labels(spark, f"{tmpdir_path}/labels")
    assert sorted(map(tuple, labels.collect())) == [(0, "Energy, carbon"), (1, "Climate")]


def test_geojson_features(spark, tmpdir_path):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "Thailand"}, "geometry": None},
        {"type": "Feature", "properties": {"name": "Ukraine"}, "geometry": None}]}
    write(f"{tmpdir_path}/world.json", json.dumps(fc))
    names = [r["country"] for r in files.read_geojson_features(spark, tmpdir_path).collect()]
    assert names == ["Thailand", "Ukraine"]


def test_sinks_skip_empty_and_write_header(spark, tmpdir_path):
    empty = spark.createDataFrame([], "a int")
    assert sinks.write_csv(empty, f"{tmpdir_path}/empty") is False
    assert not os.path.exists(f"{tmpdir_path}/empty")
    df = spark.createDataFrame([(1, ["x", "y"], 'q"uote')], "id int, tokens array<string>, s string")
    assert sinks.write_csv(df, f"{tmpdir_path}/out")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmpdir_path}/out").first()
    assert back["tokens"] == "x y" and back["s"] == 'q"uote'
    assert sinks.write_csv(df, f"{tmpdir_path}/out")       # overwritten
    assert sinks.write_csv(empty, f"{tmpdir_path}/out") is False and os.path.exists(f"{tmpdir_path}/out")
    assert not [n for n in os.listdir(tmpdir_path) if "draft" in n]
    assert sinks.write_json(df, f"{tmpdir_path}/js")
    assert spark.read.json(f"{tmpdir_path}/js").first()["tokens"] == ["x", "y"]


def test_html_cards_defaults_and_cap(spark):
    from litspark.sources import html
    page = ("<article><h1>T &amp; U</h1><p><b>x<br><p>First para.</p></article>"
            "<article><h1></h1><a href=\"/doc/1\">l</a></article>")
    pages = spark.createDataFrame([(1, page), (2, page)], "page_id long, html string")
    rows = html.extract_cards(pages, base_url="https://example.org", limit=3).collect()
    assert len(rows) == 3
    assert (rows[0]["Title"], rows[0]["Abstract"], rows[0]["Source"], rows[0]["Year"]) == \
        ("T & U", "x", "https://example.orgNo URL", "No year")
    assert (rows[1]["Title"], rows[1]["Abstract"], rows[1]["Source"]) == \
        ("No title", "No abstract", "https://example.org/doc/1")
    assert [r["page_id"] for r in rows] == [1, 1, 2]
    assert html.extract_cards(pages).count() == 4   # no cap unless asked for


def test_html_abstract_is_the_first_paragraph_with_text(spark):
    from litspark.sources import html
    bodies = ["<p></p><p> <b>in</b>line &amp; <i>more</i></p><p>next</p>", "<pre>no</pre><p class='a'>up to a block<div>not this</div>",
              "<p>to the end", "<p> </p>"]
    pages = spark.createDataFrame([(i, f"<article><h1>h</h1>{b}</article>") for i, b in enumerate(bodies)], "page_id long, html string")
    got = [r["Abstract"] for r in html.extract_cards(pages).orderBy("page_id").collect()]
    assert got == ["inline & more", "up to a block", "to the end", "No abstract"]


def tricky_csv(n):
    """Records with quoted line ends, doubled quotes, stray quotes, empty lines and empty fields."""
    import random
    rng = random.Random(n)
    pieces = ["plain", 'say ""so""', "line\nbreak", "a,b", "", '""', "é\n\n", 'end""', "\n"]
    rows = ["title,affiliation,year,abstract"]
    for i in range(n):
        quoted = ['"' + "".join(rng.choices(pieces, k=rng.randint(0, 6))) + '"' for _ in range(2)]
        rows.append(rng.choice([f'{quoted[0]},u{i},{2000 + i % 20},{quoted[1]}', f'pl"ain{i},it"s,2020,x"y"', f"{quoted[0]},short{i}",
                                f'"t{i}",,2001,"' + "long text\n" * rng.randint(0, 40) + '"', ""]))
    return "\n".join(rows) + "\n"


@pytest.mark.parametrize("split", [64, 301, 5000, 1 << 20])
def test_csv_in_many_splits_is_the_multi_line_reader(spark, tmpdir_path, split):
    """One file in many tasks has the rows of Spark's one-task reader, wherever the splits fall."""
    from collections import Counter
    write(f"{tmpdir_path}/one/p.csv", tricky_csv(400))
    write(f"{tmpdir_path}/one/q.csv", tricky_csv(3))
    wide = "title string, affiliation string, year int, abstract string"
    want = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(wide).csv(f"{tmpdir_path}/one"))
    keys = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        from litspark.sources.csv_records import _lines
        assert (_lines(spark, f"{tmpdir_path}/one").rdd.getNumPartitions() > 20) == (split < 1000)
        got = files.read_papers_csv(spark, f"{tmpdir_path}/one").collect()
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert Counter(map(tuple, got)) == Counter(map(tuple, want.collect()))


def test_csv_line_ends_with_carriage_returns(spark, tmpdir_path):
    write(f"{tmpdir_path}/p.csv", 'title,affiliation,year,abstract\r\n"a",b,2020,"x"\r\n\r\nc,d,2021,e\r\n')
    assert sorted(map(tuple, files.read_papers_csv(spark, tmpdir_path).collect())) == [("a", "b", 2020, "x"), ("c", "d", 2021, "e")]


# ---- element tree ---------------------------------------------------------

TREE_PAGE = ('<!DOCTYPE html><body><!-- <article><h1>no</h1> --><script>var a = "<article>";</script>'
             '<article class="card  wide" data-x="a > b"><h1>Outer &amp; <i>first</i></h1><a href="/o?a=1&amp;b=2">x</a>'
             '<p> <p>One<br>line <div><article class="card"><h1></h1><h1>Inner</h1><p>Deep</article></div><time>2020</time></article>'
             '<ul><li>a<li>b<ul><li>c</ul></ul></div>stray<img alt="x"/><p>open')


def test_element_tree():
    from litspark.sources.html_tree import parse
    text, found = parse(TREE_PAGE)
    shown = [(e["tag"], e["depth"], e["parent"], e["last"], text[e["start"]:e["end"]]) for e in found]
    assert [s[0] for s in shown] == ["body", "script", "article", "h1", "i", "a", "p", "p", "br", "div", "article", "h1", "h1", "p", "time",
                                     "ul", "li", "li", "ul", "li", "img", "p"]
    assert found[2]["attrs"] == {"class": "card  wide", "data-x": "a > b"} and found[5]["attrs"]["href"] == "/o?a=1&b=2"
    assert shown[3][4] == "Outer & first" and shown[7][3:] == (8, "Oneline ") and shown[10][1:4] == (3, 9, 13)
    assert shown[2][3] == 14 and shown[17][3] == 19 and shown[17][4] == "bc" and shown[21][4] == "open" and found[0]["last"] == 21
    for n, e in enumerate(found):  # nested ranges
        assert e["parent"] < n <= e["last"] and all(found[k]["last"] <= e["last"] for k in range(n, e["last"] + 1))
        assert e["depth"] == (found[e["parent"]]["depth"] + 1 if e["parent"] >= 0 else 0)


def test_cards_of_nested_articles_and_selectors(spark):
    from litspark.sources import html_tree
    pages = spark.createDataFrame([(1, TREE_PAGE), (2, None), (3, ""), (4, "<p>no card < here")], "page_id long, html string")
    rows = [tuple(r) for r in html_tree.extract_cards(pages, base_url="https://x").orderBy("page_id", "card_no").collect()]
    assert rows == [(1, 0, "Outer & first", "Oneline", "https://x/o?a=1&b=2", "2020"), (1, 1, "Inner", "Deep", "https://xNo URL", "No year")]
    wide = html_tree.extract_cards(pages, card="article.card.wide", fields={"title": ("i", None), "year": (".none", None)}).collect()
    assert [tuple(r)[2:] for r in wide] == [("first", "No abstract", "No URL", "No year")]
    listed = html_tree.elements(html_tree.parse_pages(pages)).where("tag = 'li'").orderBy("node").collect()
    assert [(r["text"], r["depth"]) for r in listed] == [("a", 2), ("bc", 2), ("c", 4)]


def test_tree_of_a_deep_and_a_long_page():
    from litspark.sources.html_tree import parse
    text, found = parse("<b>" * 3000 + "x" + "</b>" * 3000)
    assert len(found) == 3000 and found[-1]["depth"] == 2999 and all(e["last"] == 2999 for e in found)
    text, found = parse("<li>item" * 20_000)
    assert len(found) == 20_000 and {e["depth"] for e in found} == {0} and text == "item" * 20_000
    assert parse("<div " * 5000 + '"unclosed')[1] == []
