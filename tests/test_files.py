import random
import json

from pyspark.sql import functions as F

from almanac.functions import pages as P
from almanac.functions.pages import Field
from almanac.operators import gates as G
from almanac.operators.extract import standardise_pages
from almanac.schema import CITY_SCHEMA
from almanac.sources import records as R
from almanac.sources import tables as C
from almanac.streaming import ingest as S
from almanac.streaming.store import BucketStore


def write(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(content, encoding="utf-8")


def test_record_files(spark, tmp_path):
    good = {"city": "Köln", "times": ["00 - 01 Uhr"], "niederschlagsmenge_in_l_per_sqm": ["0.30", float("nan"), None], "report_short": None}
    write(tmp_path / "2001-1-1", "Köln-1_standardised.json", json.dumps(good, indent=4, ensure_ascii=False))
    write(tmp_path / "2001-1-1", "Köln-1.json", "{}")
    write(tmp_path / "2001-1-2", "Ulm-2_standardised.json", json.dumps({"city": "Ulm", "niederschlagsmenge_in_l_per_sqm": [float("nan")]}))
    write(tmp_path / "2001-1-2", "Bad-3_standardised.json", '{"city": "B')
    scanned = R.scan_records(spark, str(tmp_path))
    assert scanned.count() == 3
    rows = {r["city"]: r for r in R.readable(scanned.cache()).collect()}
    assert set(rows) == {"Köln", "Ulm"}
    assert rows["Köln"]["niederschlagsmenge_in_l_per_sqm"] == ["0.30", "NaN", None]
    assert rows["Ulm"]["niederschlagsmenge_in_l_per_sqm"] == ["NaN"] and rows["Ulm"]["times"] is None
    counts = {r["day"]: (r["found"], r["with_data"]) for r in R.day_counts(scanned).collect()}
    assert counts == {"2001-1-1": (1, 0), "2001-1-2": (2, 0)}


def test_manifest_scan(spark):
    df = spark.createDataFrame([("d/a",), ("d/b",), ("d/c",)], "path string")
    manifest = spark.createDataFrame([("eval", "d/a"), ("eval", "d/c"), ("test", "d/b")], "split string, path string")
    assert sorted(r["path"] for r in R.scan_split(df, manifest, "eval").collect()) == ["d/a", "d/c"]
    assert R.scan_split(df, manifest, ["eval", "test"]).count() == 3


def test_json_sink_keeps_umlauts(spark, tmp_path):
    df = spark.createDataFrame([("Köln", ["4/8"])], "city string, `bewölkungsgrad` array<string>")
    R.write_records(df, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(text) == {"city": "Köln", "bewölkungsgrad": ["4/8"]} and "Köln" in text


def test_city_csv(spark, tmp_path):
    write(tmp_path, "c.csv", "City,URL,Region,Country,Continent,Identifier,True Name,Latitude,Longitude,Timezone,Time Difference,Weather Report?\n"
          'a,/u,R,"C, D",K,7,Ulm,1.5,-2,Europe/Berlin,3,True\n')
    row = C.read_csv(spark, str(tmp_path), CITY_SCHEMA).first()
    assert (row["Country"], row["Latitude"], row["Time Difference"], row["Weather Report?"]) == ("C, D", 1.5, 3, True)


def test_city_files_keep_their_name(spark, tmp_path):
    write(tmp_path, "New_Land.csv", "City,Country\na,\na,\nb,\n")
    write(tmp_path, "South_America.csv", "City,Country\na,Peru\n")
    df = C.read_city_files(spark, str(tmp_path), "City string, Country string")
    got = sorted((r["City"], r["Country"]) for r in C.merge_city_files(df, "file", "South_America.csv").collect())
    assert got == [("a", "New Land"), ("a", "Peru"), ("b", "New Land")]


def test_embedded_csv(spark):
    df = spark.createDataFrame([(["x", 'q"', "a,b"], ["1", "", "3"])], "a array<string>, b array<string>")
    text = df.select("a", "b", C.to_csv_text({"A": F.col("a"), "B": F.col("b")}).alias("t"))
    assert text.first()["t"] == 'A,B\nx,1\n"q""",\n"a,b",3\n'
    back = [(r["A"], r["B"]) for r in text.select(F.inline(C.from_csv_text("t", ["A", "B"]))).collect()]
    assert back == [("x", "1"), ('q"', None), ("a,b", "3")]


def test_numbered_files_hold_exactly_n_lines(spark, tmp_path):
    C.write_numbered_splits(spark.range(23).select("id", F.col("id").cast("string").alias("v")), str(tmp_path / "o"), ["id"], "v", lines=10)
    counts = {r["split_k"]: r["count"] for r in spark.read.text(str(tmp_path / "o")).groupBy("split_k").count().collect()}
    assert counts == {0: 10, 1: 10, 2: 3}


HTML = """<html><head><script>var t = "<p>no</p>";</script></head><body><!-- <p>no</p> -->
<div id="cnt"><div><p> Heute &amp; morgen <b>nass</b> </p><p>zwei<li>x</div></div>
<span title='Sonnenaufgang'>a</span> 06:30 Uhr <span class="icon icon-sun_hours"></span><span>10 h</span>
<table><tr><th>h<td> 1\n 2<tr><td>b<br>c</td><td><table><tr><td>in</td></tr></table></td></tr></table></body>"""


def test_selectors(spark):
    fields = {
        "first": Field("p"), "mixed": Field("div", "mixed", "id", "cnt"), "sunrise": Field("span", "tail", "title", "Sonnenaufgang"),
        "sunhours": Field("span", "next", "class", "icon-sun_hours", contains=True), "sundown": Field("span", "tail", "title", "Sonnenuntergang")}
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "k int, html string")
    rows = {r["k"]: r for r in P.with_fields(df, "html", fields).collect()}
    assert [rows[1][f] for f in fields] == ["Heute & morgen", "Heute & morgen nass zwei x", "06:30 Uhr", "10 h", None]
    assert [rows[2][f] for f in fields] == [rows[3][f] for f in fields] == [None] * 5


def test_first_table(one):
    assert one(P.first_table("h"), "h string", (HTML,))[:2] == [["h", "1 2"], ["bc", "in"]]
    assert one(P.first_table("h"), "h string", ("<p>x</p>",)) is None


def test_options_and_sections(one):
    html = '<select><option value="/a"><option value="x"><option value=""><option value="/b"><option value="/c"><option value=""><option value="/d"></select>'
    assert one(P.options("h"), "h string", (html,)) == ["/a", "", "/b", "/c", "", "/d"]
    for k, expected in ((0, ["/a"]), (1, ["/b", "/c"]), (2, ["/d"]), (-1, ["/d"])):
        assert one(P.section(P.options("h"), k), "h string", (html,)) == expected
    assert one(P.section(F.array(F.lit("/a")), 0)) == ["/a"]


def test_hour_row(one):
    row = "\n 00 - 01 Uhr leicht bewölkt \n 7° 20 % 0,3 l/m² Südwest 11 km/h Böen 40"
    got = one(P.hour_columns("r"), "r string", (row,))
    assert list(got) == ["00 - 01 Uhr", "leicht bewölkt", "7°", "20 %", "3 l/m²", "Südwest", "11 km/h", "Böen 40"]
    assert list(one(P.hour_columns("r"), "r string", ("kaum",))) == [""] * 8


def city_page(first_hour):
    row = '<div class="x swg-row-wrapper border--grey-next"><b>{:02d} - {:02d} Uhr</b> leicht\n bewölkt <i>{}°</i> 20 % 3 l/m² <u>NO</u> 11 km/h</div>'
    rows = "".join(row.format(h, h + 1, h) for h in range(first_hour, 24))
    table = "".join("<tr>" + "".join(f"<td>{r}.{h}</td>" for h in range(24)) + "</tr>" for r in range(20))
    return (f'<html><body><div id="cnt-with-location-attributes"><p>falsch</p><div><p> Kühl in Ulm. </p></div></div>'
            f'<span title="Sonnenaufgang"></span><b></b> 06:30 Uhr <span class="a icon-sun_hours"></span><b>x</b><span>10 h</span>'
            f'<div id="uebersicht">{rows}</div><table><tr><td>nein</td></tr></table><div id="vhs-detail-diagram"><table>{table}</table></div>'
            f'<div id="furtherDetails"><div><div>Lang\n <b>und</b>\tbreit</div><div>zwei</div></div></div></body></html>')


def test_page_to_record(spark):
    df = spark.createDataFrame([("Ulm-1", city_page(0)), ("Bonn-2", city_page(1)), ("Kiel-3", "<p>leer</p>"), ("x", None)], "city string, html string")
    rows = standardise_pages(df, "html").collect()
    assert [r["city"] for r in rows] == ["Ulm-1"]
    r = rows[0]
    assert (r["report_short"], r["report_long"], r["sunrise"], r["sundown"], r["sunhours"]) == (
        "Kühl in Ulm.", "Lang und breit", "06:30 Uhr", None, "10 h")
    assert len(r["times"]) == 24 and r["times"][23] == "23 - 24 Uhr" and set(r["clearness"]) == {"leicht bewölkt"}
    assert r["overview"].split("\n")[:2] == [
        "Time,Clearness,Temperature,Rain Chance,Rain Amount,Wind Direction,Wind Speed,Extras",
        "00 - 01 Uhr,leicht bewölkt,0°,20 %,3 l/m²,NO,11 km/h,"]
    assert r["temperatur_in_deg_C"][:2] == ["6.0", "6.1"] and r["bewölkungsgrad"][23] == "19.23"
    assert "html" not in r.asDict()
    assert sorted(x["city"] for x in standardise_pages(df, "html", timezone=False).collect()) == ["Bonn-2", "Kiel-3", "Ulm-1", "x"]


def test_cascade(spark):
    raw = spark.createDataFrame([("a", "x"), ("b", None)], "base string, d string")
    standard = spark.createDataFrame([("a",), ("b",), ("c",)], "base string")
    kept, siblings = G.drop_undescribed(raw, standard, "base", F.col("d"))
    assert [r["base"] for r in kept.collect()] == ["a"] and sorted(r["base"] for r in siblings.collect()) == ["a", "c"]


def test_late_rows_are_dropped_and_days_wait_for_the_watermark(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"

    def batch(name, stamps):
        df = spark.createDataFrame([("x", s) for s in stamps], "e string, s string").select("e", F.col("s").cast("timestamp").alias("ts"))
        df.coalesce(1).write.parquet(str(source / name))

    def run():
        stream = spark.readStream.schema("e string, ts timestamp").option("recursiveFileLookup", True).parquet(str(source))
        S.ingest(S.complete_days(stream, "e", "ts", "10 minutes"), str(out / "rows"), str(out / "checkpoint"))

    batch("1", [f"2024-01-01 {h:02d}:15:00" for h in range(24)] + ["2024-01-02 05:00:00"])
    run()
    batch("2", ["2024-01-01 03:20:00", "2024-01-02 06:00:00", "2024-01-03 09:00:00"])
    run()
    got = {r["day"]: (r["slots"], r["complete"]) for r in spark.read.parquet(str(out / "rows")).collect()}
    assert got == {"2024-01-01": (24, True), "2024-01-02": (2, False)}


def test_ingest_resumes(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"

    def run():
        stream = spark.readStream.schema("id long, ts timestamp").option("recursiveFileLookup", True).parquet(str(source))
        S.ingest(S.unseen(stream, ["id"], "ts", "1 hour"), str(out / "rows"), str(out / "checkpoint"))

    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts")
    spark.range(5).select("id", stamp).write.parquet(str(source / "1"))
    run()
    spark.range(3, 8).select("id", stamp).write.parquet(str(source / "2"))
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(out / "rows")).collect()) == list(range(8))


def test_late_text_merge(spark, tmp_path):
    base = tmp_path / "t"
    spark.createDataFrame([(1, None, "l"), (2, "s", None), (3, "s", "l")], "k int, s string, l string").write.parquet(str(base / "v0"))
    spark.createDataFrame([(1, "new", None, 1), (1, "newer", None, 2), (2, None, "L", 1), (3, "x", "y", 1)], "k int, s string, l string, o int").write.parquet(str(base / "in"))
    stream = spark.readStream.schema("k int, s string, l string, o int").parquet(str(base / "in"))
    S.merge_late_texts(
        stream, lambda i: spark.read.parquet(str(base / f"v{i}")), lambda df, i: df.write.mode("overwrite").parquet(str(base / f"v{i + 1}")),
        "k", "o", ["s", "l"], str(base / "checkpoint"))
    got = {r["k"]: (r["s"], r["l"]) for r in spark.read.parquet(str(base / "v1")).collect()}
    assert got == {1: ("newer", "l"), 2: ("s", "L"), 3: ("s", "l")}


def test_a_batch_rewrites_only_the_buckets_it_changes(spark, tmp_path):
    rows = [(i, None if i % 2 else "s", "l") for i in range(200)]
    store = BucketStore.create(spark.createDataFrame(rows, "k int, s string, l string"), str(tmp_path / "store"), "k", buckets=20)
    assert len(store.live(0)) == 20 and store.read().count() == 200
    bucket = {r["k"]: r["b"] for r in spark.range(200).select(F.col("id").cast("int").alias("k")).select("k", F.pmod(F.xxhash64("k"), F.lit(20)).alias("b")).collect()}
    batches = [[(1, "new", None, 1), (3, "third", None, 1), (1, "newer", None, 2)],
               [(1, "newer", None, 3), (2, "x", "y", 1)],  # what is there already, and a row without a gap: nothing changes
               [(5, None, "only details", 1), (7, "seven", None, 1), (999, "no such row", None, 1)]]
    source = tmp_path / "in"

    def arrive(batch, name):
        spark.createDataFrame(batch, "k int, s string, l string, o int").coalesce(1).write.parquet(str(source / name))

    def run():
        stream = spark.readStream.schema("k int, s string, l string, o int").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(source))
        S.merge_into_store(stream, store, "o", ["s", "l"], str(tmp_path / "checkpoint"))

    for n, batch in enumerate(batches):
        arrive(batch, str(n))
        run()
    assert store.versions() == [0, 1, 2, 3]
    assert store.rewritten(1) == sorted({bucket[1], bucket[3]}) and store.rewritten(2) == [] and store.rewritten(3) == sorted({bucket[5], bucket[7]})
    want = {k: [s, l] for k, s, l in rows}
    want[1][0], want[3][0], want[5][1], want[7][0] = "newer", "third", "only details", "seven"
    assert {r["k"]: [r["s"], r["l"]] for r in store.read().collect()} == want
    assert {r["k"]: r["s"] for r in store.read(1).collect()}[7] is None  # an older version is as it was
    # A batch that is run again starts where it started and ends in the same rows.
    texts = S.latest_texts(spark.createDataFrame(batches[2], "k int, s string, l string, o int"), "k", "o", ["s", "l"])
    assert store.backfill(texts, ["s", "l"], 2) == len({bucket[5], bucket[7]})
    assert {r["k"]: [r["s"], r["l"]] for r in store.read().collect()} == want
    assert BucketStore.create(store.read().filter("k < 0"), str(tmp_path / "none"), "k").read().count() == 0


def test_streams_read_folders_of_several_files_as_they_read_one_file(spark, tmp_path):
    """Also when the late texts come in several batches: the last version is the one read."""
    from almanac.plans import streams

    for name in ("events", "documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in ("L1_incremental_ingest", "L2_late_texts", "L3_complete_days"):
        one, many = (sorted(map(str, streams.BOOK.queries[query](spark, sf).collect())) for sf in ("/root/testdata/sf0.001", str(tmp_path)))
        assert one == many and one


def test_table_cells_as_a_reader_of_tables_gives_them(one):
    rows = '<tr><th>a</th><th>b</th></tr><tr><td rowspan=2>x</td><td></td></tr><tr><td>y</td></tr><tr><td colspan="2"> z  w </td></tr></table>'
    body = [["x", "NaN"], ["x", "y"], ["z w", "z w"]]
    assert one(P.first_table("h"), "h string", ("<table>" + rows,)) == body
    assert one(P.first_table("h"), "h string", ("<table><thead><tr><th>top</th></tr></thead>" + rows,)) == [["a", "b"], *body]


def test_hours_are_read_below_the_overview_only(one):
    page = '<p class="k">out</p><div id="uebersicht"><p class="k j">in</p></div><p class="k">after</p>'
    assert one(P.element_texts("h", "class", "k", within=("id", "uebersicht")), "h string", (page,)) == ["in"]
    assert one(P.element_texts("h", "class", "k", within=("id", "none")), "h string", (page,)) == []
    assert one(P.element_texts("h", "class", "k"), "h string", (page,)) == ["out", "in", "after"]


def _library_tree(html):
    """The same tree by the standard library's parser."""
    from html.parser import HTMLParser

    single = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    closes = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open = [("", {}, [])]
            self.root = self.open[0]

        def handle_starttag(self, tag, attrs):
            while self.open[-1][0] in closes.get(tag, ()):
                self.open.pop()
            self.open[-1][2].append((tag, {k: v or "" for k, v in attrs}, []))
            if tag not in single:
                self.open.append(self.open[-1][2][-1])

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in single:
                self.handle_endtag(tag)

        def handle_endtag(self, tag):
            at = [i for i in range(1, len(self.open)) if self.open[i][0] == tag]
            if at:
                del self.open[at[-1]:]

        def handle_data(self, data):
            self.open[-1][2].append(data)

    reader = Reader()
    reader.feed(html)
    reader.close()
    return reader.root


def _joined(node):
    """Tree with neighbouring texts as one."""
    out = []
    for child in node[2]:
        if isinstance(child, str) and out and isinstance(out[-1], str):
            out[-1] += child
        else:
            out.append(child if isinstance(child, str) else _joined(child))
    return node[0], node[1], out


PIECES = ["<p>", "</p>", "<div id=a>", "<div class='x y' id=\"a\">", "</div>", "<table>", "<tr>", "<td colspan=2>", "<td>", "</td>", "</tr>", "</table>", "text ", " a < b ", "&amp;&uuml;",
          "<br>", "<br/>", "<img src='a>b'>", "<!-- <p> -->", "<script>if (a<b) '</p>'</script>", "<li>", "</ul>", "<a href=/x/y>", "</a>", "<b/>", "<option value=\"\">", "<!DOCTYPE html>", "<span hidden>", "</span>"]


def test_the_reader_gives_the_tree_of_the_library(spark):
    import random

    read, walk, _ = P._reader()
    rng = random.Random(6)
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    pages += ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    for page in pages:
        whole = _joined(_library_tree(page))
        assert _joined(read(page)) == whole
        for attribute, value in (("id", "a"), ("", "table")):
            wanted = next((n for n, _, _ in walk(whole) if (n[0] if attribute == "" else n[1].get(attribute)) == value), None)
            found = read(page, attribute, value)
            assert (found and _joined(found)) == wanted


def test_one_record_per_file_is_listed_in_tasks(spark, tmp_path):
    """No file name lies in the driver's plan: the listing of a Spark reader would hold all of them there."""
    for day in ("2001-1-1", "2001-1-2"):
        for i in range(5):
            write(tmp_path / day, f"Köln-{i}_standardised.json", json.dumps({"city": f"K{i}"}))
            write(tmp_path / day, f"Köln-{i}.json", "{}")
    write(tmp_path / "2001-1-1", ".draft_standardised.json", "{}")
    write(tmp_path / "2001-1-1", "Leer-9_standardised.json", " \n")
    scanned = R.scan_records(spark, str(tmp_path))
    assert scanned.inputFiles() == []
    assert sorted(r["path"] for r in scanned.collect()) == sorted(f"{d}/Köln-{i}_standardised.json" for d in ("2001-1-1", "2001-1-2") for i in range(5))
    assert R.scan_records(spark, f"file://{tmp_path}").count() == 10


def test_record_files_keep_numbers_as_they_are_written(spark, tmp_path):
    raw = '{"city": "a 0.30, \\"1.50\\", NaN", "times": [0.30, NaN, -Infinity, 1e5, -2.50 , true, "1.50", null],\n "sunrise": 7.10, "sundown": "' + "x\\n" * 20000 + '"}'
    write(tmp_path / "d", "A_standardised.json", raw)
    write(tmp_path / "d", "B_standardised.json", '{"city": 01, "x": 0.30}')
    good, bad = R.scan_records(spark, str(tmp_path)).orderBy("path").collect()
    plain = spark.read.schema(R.RECORD_SCHEMA).option("multiLine", True).json(str(tmp_path / "d" / "A_standardised.json")).first()
    assert good["times"] == ["0.30", "NaN", "-Infinity", "1e5", "-2.50", "true", "1.50", None] and good["sunrise"] == "7.10"
    assert good["city"] == 'a 0.30, "1.50", NaN' and {k: good[k] for k in plain.asDict()} == plain.asDict()
    assert bad["_corrupt_record"] == '{"city": 01, "x": 0.30}' and bad["city"] is None


def test_a_reference_without_its_semicolon_is_text(spark):
    page = "<html><title>a&amp;b &amp</title><a href='/x&amp;y&amp=1'>t &ampamp; &#65; &#66 &uuml; &nosuch;</a></html>"
    got = P.with_fields(spark.createDataFrame([(page,)], "html string"), "html", {
        "title": Field("title"), "link": Field("a", "@href"), "text": Field("a")}).first()
    assert (got["title"], got["link"], got["text"]) == ("a&b &amp", "/x&y&amp=1", "t &ampamp; A B ü &nosuch;")


def test_pages_become_objects_in_portions(spark, monkeypatch):
    """However large the batch, only a portion of it is held as Python objects, and portions keep the order and missing pages."""
    assert P.PORTION <= 64
    monkeypatch.setattr(P, "PORTION", 3)
    pages = [None if i % 5 == 4 else f"<table><tr><td>{i}</td></tr></table>" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").coalesce(1)
    got = {r["i"]: r for r in df.select("i", P.first_table("html").alias("t"), P.page_fields("html", {"x": Field("td")})["x"].alias("x")).collect()}
    assert all((got[i]["t"], got[i]["x"]) == ((None, None) if p is None else ([[str(i)]], str(i))) for i, p in enumerate(pages))


def test_a_task_writes_many_planned_files(spark, tmp_path):
    from almanac.sources.planned import write_planned

    df = spark.range(300).select(F.when(F.col("id") < 290, "a").otherwise("b").alias("day"), F.col("id"), F.lit("x").alias("records"))
    plan = {r["day"]: r["files"] for r in write_planned(df, str(tmp_path / "out"), "day", 10).collect()}
    names = [p for p in (tmp_path / "out").rglob("part-*.json")]
    assert plan == {"a": 29, "b": 1} and 20 < len(names) <= 30 and len({p.name[:10] for p in names}) == 1
    back = spark.read.option("recursiveFileLookup", True).schema("id long, records string").json(str(tmp_path / "out"))
    assert back.count() == 300 and back.select("id").distinct().count() == 300 and back.filter("records = 'x'").count() == 300


def test_small_rows_are_dealt_by_their_number(spark):
    from almanac.plans.pages import PAGES_PER_TASK, spread

    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(9 * PAGES_PER_TASK + 1).coalesce(1)).rdd.getNumPartitions() == 10


def test_simple_tables_are_cut_as_the_reader_builds_them():
    rng = random.Random(8)
    read, _, _ = P._reader()
    first = P._table_reader()
    cut = 0
    ends = ["</td>", "</td>\n", "</td> "]
    for _ in range(400):
        odd = rng.random() < 0.3
        texts = ["", " a  b\t", "x&amp;y", "&nbsp;", "&amp", "ü\n", "1 &lt; 2"] + ["<b>x</b>", "a < b", "<!-- c -->", "<td>y"] * odd
        tags = ["<td>", '<td class="a b">', "<td  id='q' nowrap>"] + ["<th>", "<td colspan='2'>", "<TD>", '<td title="a>b">', "<td rowspan=2>"] * odd
        rows = ["".join(f"{rng.choice(tags)}{rng.choice(texts)}{rng.choice(ends)}" for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 4))]
        page = "<p>z</p><table class='d'>" + "".join(f"<tr>{r}</tr>\n" for r in rows) + "</table><table><tr><td>no</td></tr></table>"
        quick = read(page, "", "table", rows=True)
        cut += quick[0] == "rows"
        assert first(quick) == first(read(page, "", "table")), page
    assert 250 < cut < 400


def test_reading_stops_where_no_field_can_find_more():
    read, walk, _ = P._reader()
    fields = {**P.CITY_PAGE, "link": P.Field("a", "@href", "class", "go", contains=True)}
    fields_of, last, holds = P._field_finder(P._specs(fields))
    rng = random.Random(9)
    parts = ["<div id='cnt-with-location-attributes'>", "<div>", "</div>", "<p>", "</p>", "text ", "<div id='furtherDetails'>", "<span title='Sonnenaufgang'>", "</span>",
             "<span title='Sonnenuntergang'/>", "<i class='icon icon-sun_hours'>", "<span class='icon icon-sun_hours'>", "<span>", "<br>", "<a class='go' href='/x'>", "</a>",
             "<span title='Sonnen&#97;ufgang'>", "<li>", "<td>", "<script>icon-sun_hours</script>", "<!-- furtherDetails -->"]
    short = 0
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) + rng.choice(["", "</div></p></div>" * 3]) + "<div><p>a</p></div>" * 5
        whole, some = read(page), read(page, last=last(page), holds=holds)
        assert fields_of(some) == fields_of(whole), page
        short += len(list(walk(some))) < len(list(walk(whole)))
    assert short > 500
    page = "<p><span title='Sonnenaufgang'></span>06:30 Uhr</p>" + "<tr><td>x</td></tr>" * 1000
    assert len(list(walk(read(page, last=last(page), holds=holds)))) <= 3


def test_pages_off_the_first_hour_are_left_after_their_first_row(spark, one):
    """Their texts, later rows and table are not looked for, and pages are made and read once although a filter follows."""
    def parts(page, start=None):
        return one(P.page_parts("h", P.CITY_PAGE, P.OVERVIEW_ROW, P.OVERVIEW, P.DIAGRAM, start), "h string", (page,))

    late, early = parts(city_page(1), "00 - 01 Uhr"), parts(city_page(0), "00 - 01 Uhr")
    assert late["rows"] == parts(city_page(1))["rows"][:1] and late["fields"] is None and late["cells"] is None
    assert early == parts(city_page(0)) and len(early["rows"]) == 24 and early["cells"][19][23] == "19.23"
    row = '<div class="swg-row-wrapper border--grey-next">{}</div>'
    nested = '<div id="uebersicht">' + row.format(" \n00\t \xa0- 01 <br>&#85;hr" + row.format("inner") + "<p>x") + row.format("2") + "</div>"
    assert parts(nested, "00 - 01 Uhr")["rows"] == parts(nested)["rows"] and len(parts(nested)["rows"]) == 3
    assert parts("<p>leer</p>", "00 - 01 Uhr")["rows"] == [] and parts('<div id="uebersicht">', "00 - 01 Uhr")["rows"] == []
    pages = spark.createDataFrame([("Ulm-1", city_page(0)), ("Bonn-2", city_page(1))], "city string, html string")
    plan = standardise_pages(pages, "html")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_first_table_below_an_element_is_cut_as_it_is_built(one):
    """Simple tables in an element, with a head and without, give what a table of the same cells gives that has to be built."""
    rows = "<tr><td>a</td><td> b &amp; c </td></tr>\n<tr></tr><tr><td></td></tr>"
    more = "</table><table><tr><td>second</td></tr></table></div><table><tr><td>outside</td></tr></table>"
    for head in ("", "<thead><tr><th>h</th></tr></thead>", "<thead></thead> "):
        for lead in ("", "<p>text", "<b/>"):
            page = '<div id="other"><table><tr><td>no</td></tr></table></div><div id="d">' + lead + "<table>" + head
            got = [one(P.first_table("h", "id", "d"), "h string", (page + r + more,)) for r in (rows, rows.replace("<tr></tr>", "<tr><!-- built --></tr>"))]
            assert got == [[["a", "b & c"], [], ["NaN"]]] * 2
