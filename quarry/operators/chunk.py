"""Chunkers: a row per chunk, with all other columns of the document that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import hooks
from quarry.functions import text as T
from quarry.operators import pack, punkt, segment
from quarry.sources.store import Options


def _step(size: int, overlap: int) -> int:
    if size <= overlap:
        raise ValueError("the overlap must be smaller than the window")
    return size - overlap


def _starts(length: Column, step: int) -> Column:
    return F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(step)))


def token_windows(docs: DataFrame, keys: list[str], target: int = 700, overlap: int = 80, least: int = 120, text: str = "text", raw: bool = False, tokenizer: hooks.Tokenizer | None = None) -> DataFrame:
    """Windows over tokens, by default pieces of four characters; short ones stay only where they reach the end.

    char_start and char_end count tokens. A window goes from the start of its first token to the start of the one after its last, so that what a tokenizer
    leaves out between tokens stays in the text.
    """
    step = _step(target, overlap)
    if tokenizer is None:
        n = F.ceil(F.length(text) / 4).cast("int")
        windows = docs.select(*keys, text, n.alias("n"), F.explode(_starts(n, step)).alias("char_start"))
        first, behind = F.col("char_start") * 4, F.col("char_end") * 4
    else:
        # a window takes along where it begins and ends, not the offsets of the whole text
        cut = lambda t: F.transform(_starts(F.size(t), step), lambda i: F.struct(i.alias("char_start"), F.least(i + target, F.size(t)).alias("char_end"), F.size(t).alias("n"), F.when(i > 0, F.get(t, i)["start"]).otherwise(0).alias("first"), F.get(t, i + target)["start"].alias("behind")))
        spans = docs.select(*keys, text, tokenizer(F.col(text)).alias("spans"))
        windows = spans.select(*keys, text, F.explode(cut(F.col("spans"))).alias("w")).select(*keys, text, "w.char_start", "w.n", "w.first", "w.behind")
        first, behind = F.col("first"), F.coalesce("behind", F.length(text))
    windows = windows.withColumn("char_end", F.least(F.col("char_start") + target, F.col("n")))
    windows = windows.where((F.col("char_end") - F.col("char_start") >= least) | (F.col("char_end") == F.col("n")))
    piece = F.substr(text, first + 1, behind - first)
    return windows.select(*keys, "char_start", "char_end", (piece if raw else T.normalize_text(piece)).alias("chunk"))


def char_windows(docs: DataFrame, keys: list[str], size: int = 4000, overlap: int = 400, least: int = 120, text: str = "text", raw: bool = False) -> DataFrame:
    """Windows of characters; those with fewer than 4 * least characters when stripped are left out."""
    step = _step(size, overlap)
    windows = docs.select(*keys, text, F.explode(_starts(F.length(text), step)).alias("char_start"))
    windows = windows.withColumn("piece", F.substr(text, F.col("char_start") + 1, F.lit(size)))
    chunk = F.col("piece") if raw else T.normalize_text(F.col("piece"))
    return windows.where(F.length(T.strip(F.col("piece"))) >= 4 * least).select(*keys, "char_start", (F.col("char_start") + F.length("piece")).alias("char_end"), chunk.alias("chunk"))


def chart_sections(docs: DataFrame, keys: list[str], text: str = "text", least: int = 50) -> DataFrame:
    """Sections between blank lines, numbered over all, those of over `least` characters kept."""
    sections = docs.select(*keys, F.posexplode(F.split(text, "\n\n", -1)).alias("section", "piece"))
    return sections.withColumn("chunk", T.strip(F.col("piece"))).where(F.length("chunk") > least).select(*keys, "section", "chunk")


def pages(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return docs.select(*keys, T.normalize_text(F.col(text)).alias("chunk"), T.approx_tokens(F.col(text)).alias("tokens"))


def sentence_rows(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return docs.select(*keys, F.posexplode(T.sentences(F.col(text))).alias("sentence_no", "sentence"))


STRATEGIES = ("token", "character", "sentence", "paragraph", "page", "markdown_structure", "semantic_boundary", "recursive_character", "hybrid")


def chunked(pages: DataFrame, options: Options | None = None, embed: segment.Embedder | None = T.hashed_vector, overrides: bool = False, tokenizer: hooks.Tokenizer | None = None, punkt_model: punkt.Model | None = None) -> DataFrame:
    """Page records (source_name, text, page_start, page_end and metadata, if they have it) as chunks of the schema store.CHUNK.

    A tokenizer gives the windows of the strategy `token` and the token counts of all chunks; a Punkt model the sentences of the strategy `sentence`.

    An unknown strategy is `token`, and `hybrid_chunking` is `hybrid`. The id is worked out from the text, its source, pages and place, before metadata is
    looked at; with overrides, metadata that has the name of a text column takes its place. Front matter is put before the text at the end, so that id, hash
    and token count are those of the text alone; a key that is no column is looked up in the metadata.
    """
    o = options or Options()
    docs = pages.withColumns({"page_start": F.coalesce("page_start", F.lit(1)), "page_end": F.coalesce("page_end", F.lit(1))})
    if "metadata" not in docs.columns:
        docs = docs.withColumn("metadata", F.create_map().cast("map<string,string>"))
    keys = ["source_name", "page_start", "page_end", "metadata"]
    text, limits = F.col("text"), {"target": o.target_tokens, "least": o.min_tokens}
    strategy = {"hybrid_chunking": "hybrid"}.get(o.strategy, o.strategy)
    strategy = strategy if strategy in STRATEGIES else "token"
    zero = F.lit(0)
    if strategy == "token":
        found = token_windows(docs, keys, o.target_tokens, o.overlap_tokens, o.min_tokens, raw=True, tokenizer=tokenizer)
    elif strategy == "character":
        found = char_windows(docs, keys, o.char_size, o.char_overlap, o.min_tokens, raw=True)
    elif strategy == "sentence" and punkt_model is not None:
        split = punkt.sentence_arrays(docs.select(*keys, "text"), punkt_model)
        found = split.select(*keys, F.explode(pack.packed(F.col("sentences"), overlap=2, **limits)).alias("chunk")).select(*keys, "chunk", zero.alias("char_start"), F.length("chunk").alias("char_end"))
    elif strategy == "recursive_character":
        numbered = docs.withColumn("row", F.monotonically_increasing_id())
        texts = numbered.select(F.struct("row", *keys).alias("page"), "text").withColumn("page", F.to_json("page"))
        found = segment.by_recursion(texts, "page", size=o.char_size, overlap=o.char_overlap)
        found = found.select(F.from_json("page", docs.select(*keys).schema).alias("p"), "char_start", "chunk").select("p.*", "char_start", (F.length("chunk")).alias("char_end"), "chunk")
    else:
        arrays = {
            "sentence": lambda: pack.packed(T.sentences(text), overlap=2, **limits),
            "paragraph": lambda: pack.packed(F.filter(F.transform(F.split(text, "\n\n", -1), T.strip), lambda p: p != ""), sep="\n\n", **limits),
            "page": lambda: F.array(text),
            "markdown_structure": lambda: pack.sections(text),
            "semantic_boundary": lambda: segment.semantic(text, threshold=o.semantic_threshold, embed=embed, **limits) if embed else pack.packed(T.sentences(text), overlap=2, **limits),
            "hybrid": lambda: segment.hybrid(text, embed=embed, **limits),
        }
        found = docs.select(*keys, F.explode(arrays[strategy]()).alias("c"))
        fields = found.schema["c"].dataType
        names = fields.names if hasattr(fields, "names") else []
        raw = F.col("c.raw") if "raw" in names else F.col("c.chunk") if names else F.col("c")
        own = {made: F.col(f"c.{name}") for made, name in {"section_path": "section_path", "md_types_present": "md_types", "header_level": "header_level", "sentence_count": "sentence_count"}.items() if name in names}
        found = found.select(*keys, raw.alias("chunk"), zero.alias("char_start"), F.length(raw).alias("char_end"), *[c.alias(made) for made, c in own.items()])
    extras = {"section_path": "string", "md_types_present": "array<string>", "header_level": "int", "sentence_count": "int"}
    found = found.withColumns({c: F.lit(None).cast(kind) for c, kind in extras.items() if c not in found.columns})
    rows = found.where("chunk is not null").select(
        T.normalize_text(F.col("chunk")).alias("text"), "source_name", "page_start", "page_end", hooks.count_tokens(F.col("chunk"), tokenizer).alias("tokens"), F.lit(strategy).alias("parser"), F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"), *extras, "metadata"
    )
    own = T.chunk_id(*[F.col(c) for c in ("text", "source_name", "page_start", "page_end", "char_start", "char_end")])
    rows = rows.select(own.alias("id"), F.sha2("text", 256).alias("sha256"), *rows.columns)
    if overrides:
        rows = rows.withColumns({c: F.coalesce(F.col("metadata")[c], F.col(c)) for c in ("id", "sha256", "text", "source_name", "parser", "section_path")})
    if o.include_front_matter:
        values = {k: F.col(k) if k in rows.columns else F.col("metadata")[k] for k in o.front_matter_keys}
        front = T.front_matter(values, numbers=("page_start", "page_end", "tokens", "char_start", "char_end", "header_level", "sentence_count"))
        rows = rows.withColumn("text", F.concat(front, F.lit("\n\n"), "text"))
    return rows
