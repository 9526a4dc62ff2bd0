"""City pages to standardised records: the whole extraction as one plan."""

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions import pages as P
from almanac.schema import FIRST_SLOT
from almanac.sources.tables import to_csv_text


def standardise_pages(df: DataFrame, html: str, timezone: bool = True) -> DataFrame:
    """Records of the pages in ``html``; the other columns, such as city and crawl time, are kept.

    Texts, hourly rows and the cells of the diagram come from one visit of the page. Pages that do not start with the first hour
    are left after their first row and dropped before anything else is worked out.
    """
    parts = P.page_parts(html, P.CITY_PAGE, P.OVERVIEW_ROW, P.OVERVIEW, P.DIAGRAM, FIRST_SLOT if timezone else None)
    read = df.withColumn("_parts", parts).drop(html)
    first = F.transform(F.slice("_parts.rows", 1, 1), lambda r: P.hour_part("Time", P.hour_text(r)))
    # A row is cleaned once, and only the columns that are asked for are found in it.
    kept = read.filter(P.on_time(first, timezone)).withColumn("_rows", F.transform("_parts.rows", P.hour_text))
    columns = {name: F.transform("_rows", partial(P.hour_part, name)) for name in P.HOUR_COLUMNS}
    shaped = kept.withColumns({
        **{n: P.tidied(F.col(f"_parts.fields.{n}"), f.take) for n, f in P.CITY_PAGE.items()},
        "times": columns["Time"], "clearness": columns["Clearness"], "overview": to_csv_text(columns)})
    others = [c for c in shaped.columns if c not in ("_parts", "_rows")]
    return shaped.select(*others, *P.diagram_series(F.col("_parts.cells")))
