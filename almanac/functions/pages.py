"""Text out of raw pages. A small HTML reader runs inside Arrow batches; everything after it is native."""

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from almanac.functions import text
from almanac.functions.text import SPACE, col
from almanac.schema import FIRST_SLOT, NAN

# Patterns of an hourly overview row, and how many characters are cut at the start and end of a match.
HOUR_PATTERNS = {
    "Time": (r"^(\d{2} - \d{2} Uhr)", 0, 0),
    "Clearness": (r"(r [\w+ ]+ )", 2, 1),
    "Temperature": (r"(\d+°)", 0, 0),
    "Rain Chance": (r"(\d+ %)", 0, 0),
    "Rain Amount": (r"(\d+ l/m²)", 0, 0),
    "Wind Direction": (r"(m² \w+)", 3, 0),
    "Wind Speed": (r"(\d+ km/h)", 0, 0),
    "Extras": (r"(h[\w+ ]+$)", 2, 0),
}
HOUR_COLUMNS = list(HOUR_PATTERNS)
# Fixed value: label of a button inside the rainfall table.
RAINFALL_BUTTON = "Weitere Werte anzeigen"
# Rows of the diagram table that become series of the record.
DIAGRAM_ROWS = {
    "temperatur_in_deg_C": 6, "niederschlagsrisiko_in_perc": 8, "niederschlagsmenge_in_l_per_sqm": 10, "windrichtung": 12,
    "windgeschwindigkeit_in_km_per_s": 13, "luftdruck_in_hpa": 15, "relative_feuchte_in_perc": 17, "bewölkungsgrad": 19,
}


#: Pages whose texts and trees a worker holds as Python objects at once.
PORTION = 64


def _per_page(make, kind: T.DataType, html: str | Column, once: bool = False) -> Column:
    """``make()`` builds, once a batch, the function that turns a page into a value. Results go to Arrow after every portion, so a batch
    of thousands of large pages is never held as Python objects; a missing page gives NULL. With ``once``, Spark may not repeat the step below a
    filter on its result, which would make and read the pages that pass it twice."""
    portion = PORTION

    def batch(pages: pa.Array) -> pa.Array:
        of_page, type_ = make(), to_arrow_type(kind)
        parts = [pa.array([None if p is None else of_page(p) for p in pages.slice(at, portion).to_pylist()], type_) for at in range(0, len(pages), portion)]
        return pa.concat_arrays(parts or [pa.array([], type_)])

    udf = F.arrow_udf(batch, kind)
    return (udf.asNondeterministic() if once else udf)(col(html))


@dataclass(frozen=True)
class Field:
    """First element with ``tag`` (``*`` for any) whose ``attribute`` equals (or contains) ``value``, or the first one below
    it along ``path``, steps such as ``div`` or ``div[2]``; and what to take from it.

    ``take``: ``first`` text node, ``mixed`` (all text nodes joined by a space), ``text`` (joined without one),
    ``tail`` (first text among the following siblings), ``next`` (text of the following siblings of the same tag) or
    ``@name`` for an attribute.
    """

    tag: str
    take: str = "first"
    attribute: str | None = None
    value: str | None = None
    contains: bool = False
    path: tuple[str, ...] = ()


# Where the texts and tables of a city page are.
CITY_PAGE = {
    "report_short": Field("*", "first", "id", "cnt-with-location-attributes", path=("div", "p")),
    "report_long": Field("*", "mixed", "id", "furtherDetails", path=("div", "div[1]")),
    "sunrise": Field("span", "tail", "title", "Sonnenaufgang"),
    "sundown": Field("span", "tail", "title", "Sonnenuntergang"),
    "sunhours": Field("span", "next", "class", "icon-sun_hours", contains=True),
}
OVERVIEW = ("id", "uebersicht")
OVERVIEW_ROW = ("class", "swg-row-wrapper border--grey-next")
DIAGRAM = ("id", "vhs-detail-diagram")


def _reader():
    """Page -> tree of (tag, attributes, children), from events: text, start and end of an element. Built per worker, so executors need
    nothing but the standard library."""
    import re
    from html import unescape as decoded
    from html.entities import html5

    missing = NAN
    single = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    closes = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
    # Comments and declarations; end tags; start tags, whose quoted values may hold any sign.
    markup = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
    given = re.compile(r"""([^\s"'=/][^\s=/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']\S*)|))?""")
    plain = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style")}

    reference = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[a-zA-Z][a-zA-Z0-9]*;)")

    def unescape(text):
        """Character references decoded. A name counts only with its semicolon: ``&amp`` alone is text, as in the SQL."""
        return reference.sub(lambda m: decoded(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), text) if "&" in text else text

    def attributes(text):
        """Names and values, and whether the tag closes itself."""
        out, end = {}, 0
        for m in given.finditer(text):
            out[m[1].lower()] = unescape(next((v for v in m.groups()[1:] if v is not None), ""))
            end = m.end()
        return out, "/" in text[end:]

    def events(html):
        """(kind, tag or text, attributes, end): 0 text, 1 start, 2 end; an element that closes itself is a start and an end."""
        at = 0
        while m := markup.search(html, at):
            if m.start() > at:
                yield 0, unescape(html[at:m.start()]), None, m.start()
            at = m.end()
            if m[1]:
                yield 2, m[1].lower(), None, at
            elif m[2]:
                tag = m[2].lower()
                have, closed = attributes(m[3]) if m[3] else ({}, False)
                yield 1, tag, have, at
                if closed and tag not in single:
                    yield 2, tag, None, at
                elif tag in plain:
                    end = plain[tag].search(html, at)
                    stop = end.start() if end else len(html)
                    if stop > at:
                        yield 0, html[at:stop], None, stop
                    at = stop
        if at < len(html):
            yield 0, unescape(html[at:]), None, len(html)

    # The inside of a table that holds nothing but rows of closed cells with plain text, and none that spans others.
    given_plain = r"""(?:\s+(?!colspan|rowspan)[a-z-]++(?:="[^"<>]*+"|='[^'<>]*+')?)*+"""
    head = rf"""\s*+(?:<thead{given_plain}>\s*+(?:<tr{given_plain}>\s*+(?:<th{given_plain}>[^<]*+</th>\s*+)*+</tr>\s*+)*+</thead>)?+"""
    simple = re.compile(rf"""{head}(\s*+(?:<tr{given_plain}>\s*+(?:<td{given_plain}>[^<]*+</td>\s*+)*+</tr>\s*+)*+)</table>""")
    inside = re.compile(r"<td[^>]*+>([^<]*+)<")

    def simple_rows(html, at):
        """Cells of a simple table whose inside begins at a place, found by whole rows; None if it is not simple. Its head holds no data."""
        m = simple.match(html, at)
        if m is None:
            return None
        rows = [inside.findall(row) for row in m[1].split("</tr>")[:-1]]
        if "&" in m[1]:
            rows = [[unescape(c) for c in row] for row in rows]
        return [[" ".join(c.split()) or missing for c in row] for row in rows]

    def read(html, attribute=None, value=None, rows=False, last=None, holds=None, enough=None):
        """The root, or the first element with the value of an attribute (or, for an empty one, that tag); None if there is none. Only
        the element that is wanted is built, and reading stops at its end. With ``rows``, the first table that is wanted itself or lies in what is wanted
        is not built if it is simple: its cells stand for its children, and its tag is ``rows``.

        With ``enough``, a test of attributes, reading stops at the end of the first element below the wanted one that passes it.

        With ``last``, the place after which no element of interest starts (such elements have attributes), reading stops as soon as it is passed and all of interest
        is complete. ``holds`` says of a tag and its attributes how many levels up must be closed for that: 1 the element itself, 2 the one
        that holds it, 0 none."""
        root = ("", {}, [])
        opened, wanted, depth = [root], root if attribute is None else None, 0
        held = []  # places in ``opened`` of what must be closed yet, rising
        until = -1  # place in ``opened`` of the element that is enough
        for kind, name, have, end in events(html):
            if last is not None and kind:
                while held and len(opened) <= held[-1]:
                    held.pop()
                if end > last and not held and (kind == 2 or not have or not holds(name, have)):
                    return wanted
            if kind == 0:
                if wanted is not None:
                    opened[-1][2].append(name)
                continue
            if kind == 1:
                while opened[-1][0] in closes.get(name, ()):
                    opened.pop()
                while held and len(opened) <= held[-1]:
                    held.pop()
                if wanted is not None:
                    if len(opened) <= depth or len(opened) <= until:
                        return wanted
                    if rows and name == "table":
                        if (cells := simple_rows(html, end)) is not None:
                            return "rows", have, cells
                        rows = False  # the first table counts
                    if enough is not None and enough(have):
                        until, enough = len(opened), None
                node = (name, have, [])
                if last is not None and have and (up := holds(name, have)):
                    place = len(opened) + 1 - up
                    if up == 2 or name not in single:
                        held.append(place)
                if wanted is not None:
                    opened[-1][2].append(node)
                elif (name if attribute == "" else have.get(attribute)) == value:
                    if rows and name == "table":
                        if (cells := simple_rows(html, end)) is not None:
                            return "rows", have, cells
                        rows = False
                    wanted, depth = node, len(opened)
                    if name in single:
                        return node
                if name not in single:
                    opened.append(node)
                elif len(opened) == until:
                    return wanted
                continue
            for i in range(len(opened) - 1, 0, -1):
                if opened[i][0] == name:
                    del opened[i:]
                    break
            if wanted is not None and (len(opened) <= depth or len(opened) <= until):
                return wanted
        return wanted

    def walk(node):
        """(element, its parent, its place there) in document order."""
        stack = [(node, None, 0)]
        while stack:
            item = stack.pop()
            if item[1] is not None:
                yield item
            children = item[0][2]
            for i in range(len(children) - 1, -1, -1):
                if not isinstance(children[i], str):
                    stack.append((children[i], item[0], i))

    def texts(node):
        """Text nodes in document order; neighbouring pieces of one text node are one."""
        out, joined = [], False
        stack = [iter(node[2])]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    if joined:
                        out[-1] += child
                    else:
                        out.append(child)
                    joined = True
                else:
                    joined = False
                    stack.append(iter(child[2]))
                    break
            else:
                stack.pop()
                joined = False
        return out

    return read, walk, texts


def _field_finder(specs):
    """Tree -> one text per field. ``specs``: name -> (tag, take, attribute, value, contains, path)."""
    _, walk, texts = _reader()

    def leading(children):
        out = []
        for c in children:
            if not isinstance(c, str):
                break
            out.append(c)
        return "".join(out) if out else None

    def next_text(children):
        for i, c in enumerate(children):
            if isinstance(c, str):
                return leading(children[i:])
        return None

    def below(node, parent, place, path):
        if not path:
            return node, parent, place
        tag, _, nth = path[0].partition("[")
        found = [(c, i) for i, c in enumerate(node[2]) if not isinstance(c, str) and c[0] == tag]
        for child, i in found[int(nth[:-1]) - 1:int(nth[:-1])] if nth else found:
            hit = below(child, node, i, path[1:])
            if hit:
                return hit
        return None

    def matches(node, tag, attribute, value, contains):
        if tag not in ("*", node[0]):
            return False
        if attribute is None:
            return True
        have = node[1].get(attribute)
        return have is not None and (value in have if contains else have == value)

    def taken(node, parent, place, take):
        if take.startswith("@"):
            return node[1].get(take[1:])
        if take == "first":
            return leading(node[2])
        if take == "tail":
            return next_text(parent[2][place + 1:])
        if take == "next":
            after = (next_text(c[2]) for c in parent[2][place + 1:] if not isinstance(c, str) and c[0] == node[0])
            return next((t for t in after if t is not None), None)
        return (" " if take == "mixed" else "").join(texts(node))

    def holds(tag, have):
        """How many levels from an element up must be closed before what is taken of it is whole; 0 if no field may want it."""
        node, up = (tag, have, []), 0
        for wanted, take, attribute, value, contains, path in specs.values():
            if attribute in have and matches(node, wanted, attribute, value, contains):
                up = max(up, 2 if take in ("tail", "next") and not path else 1)
        return up

    def last(page):
        """The place after which no element starts that a field may want: the last of the values looked for, or of the signs
        that begin a character reference. None if a field has no value."""
        values = [s[3] if s[2] is not None and s[3] else None for s in specs.values()]
        return None if None in values else max([page.rfind("&"), *map(page.rfind, values)])

    def fields_of(tree):
        out, missing = dict.fromkeys(specs), dict(specs)
        for node, parent, place in walk(tree):
            for name in [n for n, s in missing.items() if matches(node, s[0], s[2], s[3], s[4])]:
                hit = below(node, parent, place, missing[name][5])
                if hit:
                    out[name] = taken(*hit, missing.pop(name)[1])
            if not missing:
                break
        return out

    return fields_of, last, holds


def _specs(fields: dict[str, Field]) -> dict[str, tuple]:
    return {n: (f.tag, f.take, f.attribute, f.value, f.contains, f.path) for n, f in fields.items()}


def page_fields(html: str | Column, fields: dict[str, Field]) -> Column:
    """Struct with one text per field; a selector that finds nothing gives NULL. Reading stops where no field can find anything more."""
    specs, reader, finder = _specs(fields), _reader, _field_finder

    def make():
        read, (fields_of, last, holds) = reader()[0], finder(specs)
        return lambda page: fields_of(read(page, last=last(page), holds=holds))

    found = _per_page(make, T.StructType([T.StructField(n, T.StringType()) for n in fields]), html)
    return F.coalesce(found, F.struct(*[F.lit(None).cast("string").alias(n) for n in fields]))


def tidied(value: Column, take: str) -> Column:
    """Clean-up of a taken text: line breaks and tabs deleted for joined text, then single spaces, then stripped."""
    if take in ("mixed", "text"):
        value = F.regexp_replace(F.translate(value, "\n\t", ""), SPACE + "+", " ")
    return text.strip(value)


def with_fields(df, html: str, fields: dict[str, Field]):
    """Add one cleaned column per field; the page is read once."""
    read = df.withColumn("_fields", page_fields(html, fields))
    return read.withColumns({n: tidied(F.col(f"_fields.{n}"), f.take) for n, f in fields.items()}).drop("_fields")


def element_texts(html: str | Column, attribute: str, part: str, within: tuple[str, str] | None = None) -> Column:
    """Text of every element whose attribute contains ``part``, in document order; with ``within`` (attribute, value) only of those
    below the first element that has it."""
    reader = _reader

    def make():
        read, walk, texts = reader()

        def found(page):
            top = read(page, *within) if within is not None else read(page)
            return ["".join(texts(n)) for n, _, _ in walk(top) if part in (n[1].get(attribute) or "")] if top else []

        return found

    return _per_page(make, T.ArrayType(T.StringType()), html)


def _table_reader():
    """Table element -> its data rows."""
    _, walk, texts = _reader()

    def span(cell, name):
        given = cell[1].get(name) or ""
        return max(1, int(given)) if given.isdigit() else 1

    def data(table):
        out, below, head = [], {}, True
        for row, parent, _ in walk(table):
            if row[0] != "tr":
                continue
            cells = [c for c in row[2] if not isinstance(c, str) and c[0] in ("td", "th")]
            head = head and parent[0] != "thead" and all(c[0] == "th" for c in cells)
            if parent[0] == "thead" or (head and cells):
                continue
            line = []

            def from_above():
                while below.get(len(line), (0,))[0]:
                    n, shown = below[len(line)]
                    below[len(line)] = (n - 1, shown)
                    line.append(shown)

            for cell in cells:
                from_above()
                shown = " ".join("".join(texts(cell)).split()) or NAN
                for _ in range(span(cell, "colspan")):
                    below[len(line)] = (span(cell, "rowspan") - 1, shown)
                    line.append(shown)
            from_above()
            out.append(line)
        return out

    def first(tree):
        """Rows of the first table of a tree, the tree itself included."""
        if tree is None or tree[0] == "rows":
            return tree and tree[2]
        return data(tree) if tree[0] == "table" else next((data(node) for node, _, _ in walk(tree) if node[0] == "table"), None)

    return first


def first_table(html: str | Column, attribute: str | None = None, value: str | None = None) -> Column:
    """Cells of the first table as rows of texts, white space collapsed; with an attribute, the first table that is or
    lies in an element with that value. Rows of the head (in ``thead``, or without one the leading rows of heading cells only) are no data, an
    empty cell is the missing marker, and a cell that spans rows or columns is repeated in each of them.

    Only the wanted element is built: reading begins to keep things at its start and ends with it. A table of nothing but closed rows and cells
    of plain text is cut into them without building it."""
    reader, table_reader = _reader, _table_reader
    wanted = ("", "table") if attribute is None else (attribute, value)

    def make():
        read, first = reader()[0], table_reader()
        return lambda page: first(read(page, *wanted, rows=True))

    return _per_page(make, T.ArrayType(T.ArrayType(T.StringType())), html)


def page_parts(html: str | Column, fields: dict[str, Field], rows: tuple[str, str], within: tuple[str, str], table: tuple[str, str],
               start: str | None = None) -> Column:
    """Everything a record needs from its page: struct of ``fields`` (one text each), ``rows`` (texts of the elements whose
    attribute contains a part, within an element) and ``cells`` (of the first table in an element). Each is read as far as it can be found.

    With ``start``, a page whose first row does not begin with that text, white space cleaned, is read no further: ``rows`` is that row or
    none, the rest is missing."""
    specs, reader, finder, table_reader, (attribute, part) = _specs(fields), _reader, _field_finder, _table_reader, rows

    def make():
        (read, walk, texts), (fields_of, last, holds), first = reader(), finder(specs), table_reader()

        def is_row(have):
            return part in (have.get(attribute) or "")

        def rows_of_page(page, enough=None):
            top = read(page, *within, enough=enough)
            return ["".join(texts(n)) for n, _, _ in walk(top) if is_row(n[1])] if top else []

        def parts(page):
            if start is not None:
                # The first row is whole; further ones may lie in it.
                one = rows_of_page(page, is_row)[:1]
                if not one or not " ".join(one[0].replace("\n", "").replace("\t", "").split()).startswith(start):
                    return {"fields": None, "rows": one, "cells": None}
            return {"fields": fields_of(read(page, last=last(page), holds=holds)), "rows": rows_of_page(page),
                    "cells": first(read(page, *table, rows=True))}

        return parts

    texts_type = T.ArrayType(T.StringType())
    schema = T.StructType([
        T.StructField("fields", T.StructType([T.StructField(n, T.StringType()) for n in fields])), T.StructField("rows", texts_type),
        T.StructField("cells", T.ArrayType(texts_type))])
    return _per_page(make, schema, html, once=True)


def harvest(html: str | Column, tag: str, attribute: str) -> Column:
    """Attribute values of all elements with a tag, in document order."""
    reader = _reader

    def make():
        read, walk, _ = reader()
        return lambda page: [n[1][attribute] for n, _, _ in walk(read(page)) if n[0] == tag and attribute in n[1]]

    return _per_page(make, T.ArrayType(T.StringType()), html)


def options(html: str | Column) -> Column:
    """Option values that are links or empty; an empty one ends a section."""
    return F.filter(harvest(html, "option", "value"), lambda v: (v == "") | v.startswith("/"))


def section(values: Column, k: int) -> Column:
    """Items after boundary ``k`` (0 = from the start) up to the next boundary or the end; -1 is the last section."""
    marks = F.filter(F.transform(values, lambda v, i: F.when(v == "", i)), lambda i: i.isNotNull())
    if k == -1:
        start = F.coalesce(F.try_element_at(marks, F.lit(-1)) + 1, F.lit(0))
        end = F.size(values)
    else:
        start = F.get(marks, F.lit(k - 1)) + 1 if k else F.lit(0)
        end = F.coalesce(F.get(marks, F.lit(k)), F.size(values))
    return F.slice(values, start + 1, F.greatest(end - start, F.lit(0)))


def hour_text(row_text: str | Column) -> Column:
    """Text of an hourly row as its columns are found in it."""
    return text.strip(F.regexp_replace(F.translate(col(row_text), "\n\t", ""), SPACE + "+", " "))


def hour_part(name: str, clean: Column) -> Column:
    """One of the eight columns of a cleaned hourly row: first match of its pattern, empty text if there is none."""
    pattern, head, tail = HOUR_PATTERNS[name]
    found = F.regexp_extract(clean, "(?U)" + pattern, 1)
    return F.substr(found, F.lit(head + 1), F.greatest(F.length(found) - head - tail, F.lit(0))) if head or tail else found


def hour_columns(row_text: str | Column) -> Column:
    """Struct of the eight columns of an hourly row."""
    clean = hour_text(row_text)
    return F.struct(*[hour_part(name, clean).alias(name) for name in HOUR_COLUMNS])


def time_descriptions(flat: str | Column) -> Column:
    """Array of (time, description) from flattened rainfall text."""
    bare = text.strip(text.swap(F.translate(col(flat), "\n\t", ""), RAINFALL_BUTTON, ""))
    pattern = F.lit(r"(?U)([0-9]{2}:[0-9]{2})\s+([^0-9]*)")
    both = F.arrays_zip(F.regexp_extract_all(bare, pattern, F.lit(1)).alias("time"), F.regexp_extract_all(bare, pattern, F.lit(2)).alias("description"))
    return F.transform(both, lambda s: F.struct(s["time"].alias("time"), text.strip(s["description"]).alias("description")))


def rows_of(flat: str | Column, n: int) -> Column:
    """Items between runs of two or more spaces, the first dropped, in rows of ``n``."""
    items = F.split(text.strip(F.translate(col(flat), "\n\t", "")), " {2,}", -1)
    # Shifted copies zipped: the split runs once per column of a row and not once per row.
    shifted = [F.slice(items, j + 2, F.greatest(F.size(items) - 1 - j, F.lit(0))).alias(f"c{j}") for j in range(n)]
    starts = F.filter(F.arrays_zip(*shifted), lambda s, i: i % n == 0)
    return F.transform(starts, lambda s: F.array_compact(F.array(*[s[f"c{j}"] for j in range(n)])))


def on_time(times: Column, timezone: bool = True) -> Column:
    """Gate before the costly table parse: the first hour must be the first slot, unless zones are not checked."""
    return F.lit(not timezone) | F.coalesce(F.get(times, F.lit(0)) == FIRST_SLOT, F.lit(False))


def diagram_series(cells: Column) -> list[Column]:
    """Series of the record picked from the diagram table by row number; NULL where the table is shorter."""
    return [F.get(cells, F.lit(i)).alias(name) for name, i in DIAGRAM_ROWS.items()]


def segment(url: str | Column, k: int) -> Column:
    return F.get(F.split(col(url), "/", -1), F.lit(k))


def url_identifier(url: str | Column) -> Column:
    """Last path segment without ``.html``."""
    return F.regexp_replace(F.element_at(F.split(col(url), "/", -1), -1), r"\.html$", "")


def absolute(url: str | Column, host: str) -> Column:
    return F.concat(F.lit(host), col(url))


def true_name(sentence: str | Column, lead: str) -> Column:
    """Name inside a question: the fixed lead is removed, and the last character."""
    rest = text.swap(col(sentence), lead, "")
    return F.substr(rest, F.lit(1), F.greatest(F.length(rest) - 1, F.lit(0)))


def flatten_hierarchy(df, tree: str, host: str):
    """(Region, Country, Continent, Link) rows of a map continent -> country -> region -> link, names in title case."""
    continents = df.select(F.explode(F.map_entries(tree)).alias("c"))
    countries = continents.select("c.key", F.explode(F.map_entries("c.value")).alias("n"))
    regions = countries.select("key", F.col("n.key").alias("country"), F.explode(F.map_entries("n.value")).alias("r"))
    return regions.select(
        text.title_case("r.key").alias("Region"), text.title_case("country").alias("Country"),
        text.title_case("key").alias("Continent"), absolute("r.value", host).alias("Link"))


def with_coordinates(df, latitude: Column, longitude: Column):
    """Add Latitude, Longitude and Error: a text that is no number is reported instead of ending the job."""
    lat, lon = latitude.try_cast("double"), longitude.try_cast("double")
    bad = F.when(lat.isNull(), latitude).when(lon.isNull(), longitude)
    broken = lat.isNull() | lon.isNull()
    message = F.concat(F.lit("could not convert string to float: '"), F.coalesce(bad, F.lit("")), F.lit("'"))
    return df.withColumns({
        "Latitude": F.when(~broken, lat), "Longitude": F.when(~broken, lon), "Error": F.when(broken, message)})


def located(df, zone: str):
    """Rows with a time zone, sorted by it."""
    return df.dropna(subset=[zone]).orderBy(zone)


def wanted_links(df, html: str, part: str, stop: Sequence[str]):
    """(link): distinct links that contain ``part`` and are not on the stop list."""
    links = df.select(F.explode(F.array_distinct(harvest(html, "a", "href"))).alias("link"))
    return links.filter(F.col("link").contains(part) & ~F.col("link").isin(list(stop))).distinct()
