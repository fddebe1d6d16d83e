"""Numbers that texts state, as data points."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

# Patterns of numbers with what they count.
NUMBER = r"(\d+(?:,\d{3})*(?:\.\d+)?)"
PERIOD = r"(?:Q[1-4]|Quarter\s*[1-4]|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s*\d{4}"
#: Kind: pattern, groups of value, category and unit (0: none), least length of a category.
PATTERNS = {
    "leave": (r"(?i)(\d+)\s+(days?|weeks?|months?)\s+(?:of\s+)?([a-zA-Z\s]+(?:leave|vacation|holiday))", 1, 3, 2, 0),
    "percent": (r"(\d+(?:\.\d+)?)\s*(%)\s+([a-zA-Z\s]+)", 1, 3, 2, 4),
    "currency": (r"([$€£])\s*" + NUMBER + r"\s+([a-zA-Z\s]+)", 2, 3, 1, 4),
    "general": (NUMBER + r"\s+([a-zA-Z]+)\s+([a-zA-Z\s]{5,30})", 1, 3, 2, 6),
    "label": (r"([A-Za-z][A-Za-z\s]{5,40})\s*:\s*" + NUMBER + r"\s*([a-zA-Z%$€£]*)", 2, 1, 3, 6),
    "period": (f"({PERIOD})" + r"\s*:\s*" + NUMBER, 2, 1, 0, 0),
}
# Parts that a category of the kind "general" must not hold; beginnings of lines about a chunk, not of its text.
SKIPPED = ["if ", "she ", "he ", "must ", "will ", "the ", "an ", "and "]
ABOUT = r"^\s*(\[ID:|source_name:|page_|section:|text:)"
CLOCK = r"(\d{1,2}:\d{2})\s*(AM|PM|am|pm)\s*(?:to|–|-)\s*(\d{1,2}:\d{2})\s*(AM|PM|am|pm)"
POINT = "array<struct<category:string,time_period:string,value:double,unit:string>>"
#: Marks of texts from sheets, the first number and the first unit of a cell, the name of a sheet that has none.
SHEETS, CELL_NUMBER, CELL_UNIT, SHEET = r"Sheet:|CSV Data|Columns:", r"[\d,]+\.?\d*", r"[%$€£]|[a-zA-Z]+(?:\s|$)", "Sheet1"


def _matches(line: Column, kind: str) -> Column:
    pattern, value, category, unit, least = PATTERNS[kind]
    group = lambda n: F.regexp_extract_all(line, F.lit(pattern), F.lit(n))
    units = group(unit) if unit else F.transform(group(value), lambda v: F.lit(""))
    zipped = F.arrays_zip(group(value).alias("v"), group(category).alias("c"), units.alias("u"))

    def point(m: Column) -> Column:
        name = F.regexp_replace(m["c"], rf"^{T.BLANK}|{T.BLANK}$", "")
        named = T.title_case(F.regexp_replace(name, r"\s", " "))
        unit_of = F.lower(m["u"]) if kind in ("leave", "general") else m["u"]
        return F.struct(
            (F.lit(None) if kind == "period" else named).cast("string").alias("category"),
            (name if kind == "period" else F.lit(None)).cast("string").alias("time_period"),
            F.translate(m["v"], ",", "").cast("double").alias("value"),
            unit_of.alias("unit"),
        )

    def fine(p: Column) -> Column:
        if kind == "period":
            return p["value"] > 0
        long = F.length(T.normalize_text(p["category"]) if kind == "general" else p["category"]) >= least
        if kind == "general":
            for part in SKIPPED:
                long = long & ~F.contains(F.lower(T.normalize_text(p["category"])), F.lit(part))
        return long & (p["value"] > 0)

    return F.filter(F.transform(zipped, point), fine).cast(POINT)


def _hours(line: Column, fix_meridiem: bool) -> Column:
    """Durations between two clock times of a line about work. As observed, PM anywhere in the line moves both ends."""
    lower = F.lower(line)
    week = F.contains(lower, F.lit("monday")) & F.contains(lower, F.lit("friday"))
    day = F.coalesce(F.when(week, F.lit("Monday to Friday")), *[F.when(F.contains(lower, F.lit(d.lower())), F.lit(d)) for d in ("Saturday", "Sunday")], F.lit("Weekday"))
    found = [F.regexp_extract_all(line, F.lit(CLOCK), F.lit(n)) for n in (1, 2, 3, 4)]
    minutes = lambda c: F.split(c, ":")[0].cast("int") * 60 + F.split(c, ":")[1].cast("int")

    def at(clock: Column, half: Column) -> Column:
        noon = 12 * 60
        if fix_meridiem:
            moved = minutes(clock) % noon + F.when(F.lower(half) == "pm", noon).otherwise(0)
        else:
            moved = minutes(clock) + F.when(F.contains(line, F.lit("PM")) & (minutes(clock) < noon), noon).otherwise(0)
        return moved

    spans = F.arrays_zip(*[x.alias(n) for x, n in zip(found, ("s", "sh", "e", "eh"), strict=True)])
    points = F.transform(spans, lambda x: F.struct(F.concat(day, F.lit(" Working Hours")).alias("category"), F.lit(None).cast("string").alias("time_period"), ((at(x["e"], x["eh"]) - at(x["s"], x["sh"])) / 60).alias("value"), F.lit("hours").alias("unit")))
    return F.when(lower.rlike("working|hours|office"), F.filter(points, lambda p: p["value"] > 0)).otherwise(F.array()).cast(POINT)


def numbers(docs: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple[str, ...] = ("hours", *PATTERNS), fix_meridiem: bool = False) -> DataFrame:
    """key, category, time_period, value, unit, line_no: the positive points of the kinds that are distinct in their row, with
    the first line of each. Lines about a chunk (its id, source, pages, section) are left out.

    Points are distinct before the blanks inside their categories are made single.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike("[0-9]") & ~F.col("line").rlike(ABOUT))
    line = F.col("line")
    arrays = [_hours(line, fix_meridiem) if k == "hours" else _matches(line, k) for k in kinds]
    points = lines.select(key, "line_no", F.inline(F.flatten(F.array(*arrays)))).groupBy(key, "category", "time_period", "value", "unit").agg(F.min("line_no").alias("line_no"))
    return points.withColumn("category", T.normalize_text(F.col("category")))


def first_distinct(points: DataFrame, order: list[str]) -> DataFrame:
    """Points that are distinct over all rows: of equal ones the first by the order columns, which are kept."""
    rest = [c for c in points.columns if c not in order]
    return points.groupBy(*rest).agg(F.min(F.struct(*order)).alias("o")).select(*rest, "o.*")


def largest(points: DataFrame, n: int = 15) -> DataFrame:
    """The n largest; ties in the order of lines where there is one, then by name."""
    at = [c for c in ("line_no",) if c in points.columns]
    return points.orderBy(F.desc("value"), *at, "category", "time_period", "unit").limit(n)


def markdown_table(points: DataFrame) -> DataFrame:
    """One row, table: the 15 largest points; where any has a time, only those that have one."""
    best = largest(points).withColumn("timed", F.col("time_period").isNotNull())
    name = F.when(F.col("timed"), F.col("time_period")).otherwise(T.truncated(F.col("category"), 40, 37))
    row = F.format_string("| %s | %s | %s |", name, T.shown_number(F.col("value")), F.coalesce("unit", F.lit("")))
    listed = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("minus"), name.alias("name"), "timed", row.alias("row")))).alias("all"), F.bool_or("timed").alias("timed"))
    lines = F.transform(F.filter("all", lambda x: x["timed"] == F.col("timed")), lambda x: x["row"])
    head = F.when(F.col("timed"), F.array(F.lit("| Time Period | Value | Unit |"), F.lit("|-------------|-------|------|"))).otherwise(F.array(F.lit("| Category | Value | Unit |"), F.lit("|----------|-------|------|")))
    return listed.select(F.when(F.size("all") == 0, "No tabular data found in the provided context.").otherwise(F.array_join(F.concat(head, lines), "\n")).alias("table"))


def csv(points: DataFrame, order: list[str]) -> DataFrame:
    """One row, csv: time_period or category, value and unit, unquoted, in the given order; only points with a time where any has one."""
    # without an exponent, and with a decimal point as a float has it
    whole = (F.col("value") == F.floor("value")) & (F.abs("value") < 1e16)
    decimal = F.when(whole, F.concat(F.col("value").cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(F.col("value").cast("string"))
    row = F.concat_ws(",", F.coalesce("time_period", "category"), decimal, F.coalesce("unit", F.lit("")))
    listed = points.agg(F.sort_array(F.collect_list(F.struct(*order, F.col("time_period").isNotNull().alias("timed"), row.alias("row")))).alias("all"), F.bool_or(F.col("time_period").isNotNull()).alias("timed"))
    lines = F.transform(F.filter("all", lambda x: x["timed"] == F.col("timed")), lambda x: x["row"])
    head = F.when(F.col("timed"), "time_period,value,unit").otherwise("category,value,unit")
    return listed.select(F.when(F.size("all") == 0, "").otherwise(F.array_join(F.concat(F.array(head), lines), "\n")).alias("csv"))


def preview(points: DataFrame, n: int = 10) -> DataFrame:
    """name, value, unit of the first n."""
    return largest(points, n).select(F.coalesce("time_period", "category").alias("name"), "value", "unit")


HINTS = ("Auto-detect", "Bar Chart", "Line Chart", "Pie Chart", "Scatter Plot", "Area Chart", "Horizontal Bar", "Donut Chart", "Table")
SCHEMA = "https://vega.github.io/schema/vega-lite/v5.json"


def _field(name: str, kind: str, **more) -> dict:
    return {"field": name, "type": kind, **more}


def chart(points: list[dict], hint: str = "Bar Chart") -> dict:
    """Vega-Lite specification of points that the driver has (a search gives few): those with a time in their order, all of
    them, where any has one, else the eight largest."""
    counts = Counter(p["unit"] for p in points if p.get("unit"))
    unit = min(counts, key=lambda u: (-counts[u], u)) if counts else ""
    in_unit = f" ({unit})" if unit else ""
    timed = [p for p in points if p.get("time_period")]
    shown = timed or sorted(points, key=lambda p: -p["value"])[:8]
    name = "time" if timed else "category"
    short = lambda c: c if timed or len(c) <= 30 else c[:27] + "..."
    values = [{name: short(p["time_period"] if timed else p["category"]), "value": p["value"]} for p in shown]
    kind = "ordinal" if timed else "nominal"
    number = _field("value", "quantitative", title=f"Value{in_unit}")
    tip = [_field(name, kind, title="Period" if timed else "Category"), _field("value", "quantitative", format=".1f", title="Value")]
    title = f"{'Time Series Data' if timed else 'Category Analysis'}{in_unit}"
    round_, across = hint in ("Pie Chart", "Donut Chart") and not timed, hint == "Horizontal Bar" and not timed
    if timed:
        mark = {"type": "area", "line": True, "point": True} if hint == "Area Chart" else {"type": "line", "point": True, "strokeWidth": 3}
        encoding, about = {"x": _field(name, kind, title="Time Period"), "y": number}, "Time series chart showing values over time"
    elif round_:
        mark = {"type": "arc", "innerRadius": 50 if hint == "Donut Chart" else 0}
        encoding = {"theta": _field("value", "quantitative"), "color": _field(name, kind, legend={"title": "Category"})}
        about = f"{hint.split()[0]} chart showing distribution by category"
    elif across:
        mark = {"type": "bar", "color": "#1f77b4"}
        encoding, about = {"y": _field(name, kind, title="Category", sort="-x"), "x": number}, "Horizontal bar chart showing values by category"
    else:
        mark = {"type": "line" if hint == "Line Chart" else "bar", "color": "#1f77b4"}
        encoding, about = {"x": _field(name, kind, title="Category", axis={"labelAngle": -45, "labelLimit": 100}), "y": number}, "Bar chart showing values by category"
    return {"$schema": SCHEMA, "title": title, "description": about, "data": {"values": values}, "mark": mark, "encoding": encoding | {"tooltip": tip}, "width": 400 if round_ else 600, "height": 400}


def captioned(points: list[dict], hint: str = "Bar Chart") -> str:
    """The caption of a chart and its specification in a fenced block."""
    spec = chart(points, hint)
    timed, n = "time" in spec["encoding"].get("x", {}).get("field", ""), len(spec["data"]["values"])
    unit = spec["title"].partition(" (")[2].rstrip(")")
    if spec["mark"]["type"] == "arc":
        caption = f"This {hint.split()[0].lower()} chart shows the distribution of {unit} by category from the provided documents."
    else:
        form = "line chart" if timed else "pie chart" if hint == "Pie Chart" else "horizontal bar chart" if hint == "Horizontal Bar" else "bar chart"
        caption = f"This {form} shows {n} data points extracted from the provided documents." + (f" Values are in {unit}." if unit else "")
    return f"{caption}\n\n```json\n{json.dumps(spec, indent=2)}\n```"


def key_values(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int | None = 20) -> DataFrame:
    """key, category, value, unit, line_no of texts that come from sheets: lines with exactly one colon and a number
    after it, under the name of their sheet. Distinct in their row; with n, only the largest n of each. Lines about a chunk
    are left out."""
    sheets = F.transform(F.split(text, r"(?m)^(?=[ \t]*Sheet:)"), lambda p: F.struct(F.coalesce(F.nullif(T.strip(F.regexp_extract(p, r"^[ \t]*Sheet:([^\n]*)", 1)), F.lit("")), F.lit(SHEET)).alias("sheet"), F.split(p, "\n", -1).alias("lines")))
    cells = F.flatten(F.transform(sheets, lambda s: F.transform(s["lines"], lambda x: F.struct(s["sheet"].alias("sheet"), T.strip(x).alias("line")))))
    rows = docs.where(F.col(text).rlike(SHEETS)).select(key, F.posexplode(cells).alias("line_no", "c")).select(key, "line_no", "c.*")
    one = F.length("line") - F.length(F.replace("line", F.lit(":"), F.lit(""))) == 1
    rows = rows.where(one & ~F.col("line").rlike(r"^(Sheet:|Columns:|CSV Data)") & ~F.col("line").rlike(ABOUT))
    name, cell = T.strip(F.split("line", ":")[0]), T.strip(F.split("line", ":")[1])
    value = F.replace(F.regexp_extract(cell, CELL_NUMBER, 0), F.lit(","), F.lit("")).try_cast("double")
    category = F.when(F.col("sheet") == SHEET, name).otherwise(F.concat("sheet", F.lit(" - "), name))
    found = rows.select(key, category.alias("category"), value.alias("value"), T.strip(F.regexp_extract(cell, CELL_UNIT, 0)).alias("unit"), "line_no").where("value is not null")
    distinct = found.groupBy(key, "category", "value", "unit").agg(F.min("line_no").alias("line_no"))
    if n is None:
        return distinct
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("value"), "line_no"))
    return distinct.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def modal_unit(points: DataFrame, unit: str = "unit") -> DataFrame:
    """The most frequent unit; ties by name."""
    return points.where(F.col(unit) != "").groupBy(unit).agg(F.count("*").alias("n")).orderBy(F.desc("n"), unit).limit(1)


def context(chunks: DataFrame, rank: str) -> DataFrame:
    """rank, context: the block of each chunk that says its id, source, pages, section and text."""
    shown = lambda *c: F.coalesce(*[F.col(x).cast("string") for x in c[:-1]], F.lit(c[-1]))
    block = F.format_string("[ID: %s]\nsource_name: %s\npage_start: %s   page_end: %s\nsection: %s\ntext: |\n%s\n\n", shown("id", ""), shown("source_name", "Unknown"), shown("page_start", "1"), shown("page_end", "1"), shown("section_path", "-"), shown("text", ""))
    return chunks.select(rank, block.alias("context"))


# Words that ask for a chart or a table, and the answer without numbers.
CHART_WORDS, TABLE_WORDS = ("chart", "graph", "plot", "visualization"), ("table", "list", "show")
NOTHING = """Not enough information in the provided context.

No sufficient numeric data found to create the requested visualization.

**What we look for:**
- Working hours: '9:45 AM to 6:15 PM'
- Leave policies: '21 days annual leave'
- Financial data: '$1,250,000 revenue'
- Percentages: '45% completion rate'
- Time series: 'Q1 2023: 1500'

**Tips:** Try uploading documents with tables, financial reports, or structured data."""


def form(request: str, hint: str, n: int) -> str:
    """table or chart, by the request's words, the hint, and the number of points; a table comes first."""
    asks = lambda words: any(w in request.lower() for w in words)
    if asks(TABLE_WORDS) or hint == "Table":
        return "table"
    if asks(CHART_WORDS) or hint != HINTS[0]:
        return "chart"
    return "table" if n <= 3 else "chart"


def respond(chunks: DataFrame, request: str, hint: str = HINTS[0], include_csv: bool = True, rank: str = "rank", fix_meridiem: bool = False) -> str:
    """The grounded answer to a request from ranked chunks (id, source_name, page_start, page_end, section_path, text, rank):
    a table or a chart of the numbers that they state, these as CSV, and references.

    A search ranks few chunks, and of their numbers 15 (20 from sheets) at most reach the driver.
    """
    from quarry.operators.answer import distinct_sources

    stated = numbers(chunks, rank, "text", fix_meridiem=fix_meridiem)
    points = [r.asDict() for r in largest(first_distinct(stated, [rank, "line_no"])).collect()]
    cells = first_distinct(key_values(chunks, rank, "text", None), [rank, "line_no"]).orderBy(F.desc("value"), rank, "line_no").limit(20).collect()
    if len(cells) > len(points):
        points = [r.asDict() | {"time_period": None} for r in cells]
    out = ["## Answer"]
    if not points:
        out.append(NOTHING)
    else:
        as_rows = chunks.sparkSession.createDataFrame([(i, p["category"], p["time_period"], p["value"], p["unit"]) for i, p in enumerate(points)], "place int, category string, time_period string, value double, unit string")
        if form(request, hint, len(points)) == "table":
            out.append(markdown_table(as_rows).first()[0])
        else:
            out.append(captioned(points, "Bar Chart" if hint == HINTS[0] else hint))
        if include_csv:
            out.append(f"\n```csv\n{csv(as_rows, ['place']).first()[0]}\n```")
    out.append("\n## References")
    for r in distinct_sources(chunks, rank).orderBy("rank").collect():
        out.append(f"- [ID:{r.id}] {r.source_name} — pages {r.page_start}–{r.page_end} | section: {r.section}")
    return "\n".join(out)
