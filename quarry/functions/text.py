"""Text primitives as Column functions. White space is ASCII white space."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\x0B\f\r]+"
GAP = r"[ \t\x0B\f\r]"
FENCE = r"(?m)^[ \t\x0B\f\r]*`{3,}"


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c worked out once even where use() has it in a lambda, which a plain column would not be."""
    return F.element_at(F.transform(F.array(c), use), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}|{BLANK}\z", "")


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANK, " "))


def normalize_whitespace(c: Column) -> Column:
    """Runs of blanks and tabs as one blank; line feeds stay."""
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def approx_tokens(c: Column) -> Column:
    """A token is about four characters; a text has at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def content_hash(c: Column) -> Column:
    return F.sha2(normalize_text(c), 256)


def chunk_id(text: Column, source: Column, page_start: Column, page_end: Column, start: Column, end: Column) -> Column:
    """sha256 of the parts joined by dashes; a missing part leaves an empty slot."""
    return F.sha2(F.concat_ws("-", *[F.coalesce(x.cast("string"), F.lit("")) for x in (text, source, page_start, page_end, start, end)]), 256)


def words(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(normalize_text(c)), " "), "")


def shingles(c: Column, n: int) -> Column:
    """Distinct runs of n words; fewer words have none."""
    run = lambda w, i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: run(w, i)))
    return bound(words(c), lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(runs(w)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def sentences(c: Column) -> Column:
    """Pieces between runs of full stops, exclamation and question marks, without them."""
    return F.filter(F.transform(F.split(c, r"[.!?]+"), strip), lambda s: s != "")


def split_sentences(c: Column) -> Column:
    """Sentences with their marks: they end before white space and a capital letter or digit."""
    pieces = F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"(?<=[.!?])\s+(?=[A-Z0-9])")
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


# What makes a line a heading. Other than in Java, \s of their SQL has no \x0B and $ does not match before a line end.
HEADINGS = [r"^[ \t\n\f\r]{0,3}#{1,6}[ \t\n\f\r]+[^ \t\n\f\r]", r"^[ \t\n\f\r]*[0-9IVXivx]+[.)][ \t\n\f\r]+[^ \t\n\f\r]"]
LABEL = r"^[A-Z][A-Za-z0-9 ,/&()\-:]{3,}\z"


def is_heading(line: Column) -> Column:
    """A markdown header, a numbered line, or a short capitalised line that ends with a colon."""
    label = (F.length(line) < 120) & line.rlike(LABEL) & F.endswith(strip(line), F.lit(":"))
    return line.rlike(HEADINGS[0]) | line.rlike(HEADINGS[1]) | label


def is_code_fence(line: Column) -> Column:
    return line.rlike(r"^\s*`{3,}")


def is_table_block(block: Column) -> Column:
    """Two lines or more of which over 2 % of the characters are bars, or that hold a rule line."""
    lines = lambda b: F.split(b, "\n")
    size = lambda b: F.length(F.replace(b, F.lit("\n"), F.lit("")))
    bars = lambda b: F.length(b) - F.length(F.replace(b, F.lit("|"), F.lit("")))
    return bound(strip(block), lambda b: (F.size(lines(b)) >= 2) & ((bars(b) > 0.02 * F.greatest(F.lit(1), size(b))) | b.rlike(r"(?m)^\s*[-|+:]+\s*$")))


def boundary_cleanup(block: Column) -> Column:
    """Closes an open code fence, and leaves one blank line of several."""
    open_fence = F.pmod(F.regexp_count(block, F.lit(FENCE)), F.lit(2)) == 1
    closed = F.when(open_fence, F.concat(block, F.lit("\n```"))).otherwise(block)
    return strip(F.regexp_replace(closed, r"\n{3,}", "\n\n"))


def md_types(c: Column) -> Column:
    """Markdown features of a text, sorted."""
    # The pattern of each feature.
    kinds = {"blockquote": r"(?m)^\s*>\s+", "code_fence": r"```", "list": r"(?m)^\s*[-*+]\s+", "table": r"\|.*\|"}
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in kinds.items()]))


# Strings that YAML 1.1 would read as something else, or that can't stand plain in a block mapping.
YAML_OTHER = r"(?x) ^( | ~ | null|Null|NULL | yes|Yes|YES|no|No|NO|true|True|TRUE|false|False|FALSE|on|On|ON|off|Off|OFF | = | << | [-+]?0b[01_]+ | [-+]?0[0-7_]+ | [-+]?(0|[1-9][0-9_]*) | [-+]?0x[0-9a-fA-F_]+ | [-+]?[1-9][0-9_]*(:[0-5]?[0-9])+ | [-+]?[0-9][0-9_]*\.[0-9_]*([eE][-+][0-9]+)? | \.[0-9][0-9_]*([eE][-+][0-9]+)? | [-+]?[0-9][0-9_]*(:[0-5]?[0-9])+\.[0-9_]* | [-+]?\.(inf|Inf|INF) | \.(nan|NaN|NAN) | [0-9]{4}-[0-9]{2}-[0-9]{2} | [0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([Tt]|[\ \t]+)[0-9]{1,2}:[0-9]{2}:[0-9]{2}(\.[0-9]*)?([\ \t]*(Z|[-+][0-9]{1,2}(:?[0-9]{2})?))? )$"
YAML_MARKED = r"^[#,\[\]{}&*!|>'\"%@`]|^[-?:]($|[ ])|^---|^\.\.\.|:($|[ ])|[ ]#|^[ ]|[ ]$"
YAML_ESCAPED = r"[^\x20-\x7e]"
YAML_WIDTH = 80


def yaml_scalar(c: Column, column: int = 0) -> Column:
    """A string as the value of a block mapping that begins at the column: plain, in single quotes where plain text would
    be read as something else, or in double quotes with escapes where it has other than printable ASCII characters. Plain
    and single-quoted text goes on in a new line at the first single blank beyond 80 columns; escaped text is one line."""
    quoted = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    flow = F.when(c.rlike(YAML_OTHER) | c.rlike(YAML_MARKED), quoted).otherwise(c)

    def step(a: Column, w: Column) -> Column:
        over = (a["at"] > YAML_WIDTH) & (a["out"] != "")
        sep = F.when(a["first"], "").when(over, "\n  ").otherwise(" ")
        at = F.when(a["first"], a["at"] + F.length(w)).when(over, 2 + F.length(w)).otherwise(a["at"] + 1 + F.length(w))
        return F.struct(at.alias("at"), F.lit(False).alias("first"), F.concat(a["out"], sep, w).alias("out"))

    start = F.struct(F.lit(column).alias("at"), F.lit(True).alias("first"), F.lit("").alias("out"))
    folded = F.aggregate(F.split(flow, r"(?<=[^ ]) (?=[^ ])", -1), start, step, lambda a: a["out"])
    hexed = lambda x, n: F.lpad(F.hex(F.ascii(x)), n, "0")
    named = {"\\": "\\\\", '"': '\\"', "\0": "\\0", "\x07": "\\a", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\v": "\\v", "\f": "\\f", "\r": "\\r", "\x1b": "\\e", "\x85": "\\N", "\xa0": "\\_", "\u2028": "\\L", "\u2029": "\\P"}

    def escaped(x: Column) -> Column:
        code = F.ascii(x)
        long = F.when(code < 256, F.concat(F.lit("\\x"), hexed(x, 2))).when(code < 65536, F.concat(F.lit("\\u"), hexed(x, 4))).otherwise(F.concat(F.lit("\\U"), hexed(x, 8)))
        known = F.element_at(F.create_map(*[F.lit(v) for kv in named.items() for v in kv]), x)
        return F.coalesce(known, F.when(x.rlike(YAML_ESCAPED), long).otherwise(x))

    double = F.concat(F.lit('"'), F.array_join(F.transform(F.split(c, ""), escaped), ""), F.lit('"'))
    return F.when(c.rlike(YAML_ESCAPED), double).otherwise(folded)


def front_matter(values: dict[str, Column], numbers: Collection[str] = ()) -> Column:
    """`key: value` lines between `---` lines, in order of the keys; missing values are left out, and nothing is rendered of none.

    Values are strings, but for the keys in `numbers`.
    """
    shown = {k: v.cast("string") if k in numbers else yaml_scalar(v.cast("string"), len(k) + 2) for k, v in values.items()}
    lines = F.array_compact(F.array(*[F.concat(F.lit(f"{k}: "), v) for k, v in sorted(shown.items())]))
    return F.when(F.size(lines) == 0, "").otherwise(F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---")))


# Phrases that a policy answer goes without, and what stands for them.
POLICY_PHRASES = {
    r"(?i)\b(?:The\s+)?(?:dress\s+code\s+)?policy\s+explicitly\s+": "",
    r"(?i)\bprohibits\s+the\s+following\s+types?\s+of\s+clothing\s+at\s+the\s+workplace:\s*": "prohibits ",
}


def clean_policy(c: Column) -> Column:
    for pattern, short in POLICY_PHRASES.items():
        c = F.regexp_replace(c, pattern, short)
    return bound(normalize_text(c), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2))))


def truncated(c: Column, most: int, keep: int | None = None) -> Column:
    """Texts over `most` characters as their first `keep` and an ellipsis (no ellipsis without keep)."""
    short = F.substring(c, 1, most) if keep is None else F.concat(F.substring(c, 1, keep), F.lit("..."))
    return F.when(F.length(c) > most, short).otherwise(c)


def shown_number(c: Column) -> Column:
    """Thousands separators and one decimal from 1 on, else three decimals."""
    return F.when(c >= 1, F.format_number(c, 1)).otherwise(F.format_string("%.3f", c))


def title_case(c: Column) -> Column:
    """A capital after anything that is no letter, small letters else."""
    return F.array_join(F.transform(F.split(F.lower(c), r"(?<=\P{L})(?=\p{L})"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """With 1e-9 added to the product of the norms, so that zero vectors give 0."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def run_lengths(c: Column) -> Column:
    """array<struct<value, n>> of an array: its distinct values with how often they occur, in order; one sort and one pass."""

    def counted(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return bound(starts, lambda at: F.transform(at, lambda p, k: F.struct(F.get(s, p).alias("value"), (F.coalesce(F.get(at, k + 1), F.size(s)) - p).alias("n"))))

    return bound(F.sort_array(c), counted)  # array_sort compares by a lambda


def hashed_vector(c: Column, size: int = 64) -> Column:
    """Counts of the words by hash in `size` places, at unit length: a stand-in for an encoder, not semantic."""
    place = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long"), F.lit(size)).cast("int")
    counts = lambda m: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0)).cast("double"))
    places = F.coalesce(F.map_from_entries(run_lengths(F.transform(words(c), place))), F.create_map().cast("map<int,int>"))
    return bound(bound(places, counts), lambda v: bound(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def term_weights(c: Column) -> Column:
    """map<int,double>: log1p of how often each word occurs, by the word's CRC: a stand-in for a sparse encoder. Words of one CRC count as one."""
    ids = F.transform(words(c), lambda w: F.crc32(F.encode(w, "UTF-8")).bitwiseAND(0x7FFFFFFF).cast("int"))
    return F.map_from_entries(F.transform(run_lengths(ids), lambda r: F.struct(r["value"], F.log1p(r["n"]))))


def strongest(weights: Column, n: int) -> Column:
    """map<int,double> of the n largest positive weights, of equal ones those of the smaller ids."""
    ordered = F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("key"))))
    return F.map_from_entries(F.transform(F.slice(F.filter(ordered, lambda e: e["minus"] < 0), 1, n), lambda e: F.struct(e["key"], -e["minus"])))
