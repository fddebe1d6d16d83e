"""One object for ingest, search, answers and charts over a store of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import answer, cells, chunk, ground, search, store as chunks_of
from quarry.operators.segment import Embedder
from quarry.sources import store
from quarry.sources.log import Conflict, Log, Run, State
from quarry.sources.store import Options

TABLES = {"chunks": store.CHUNK, "sparse": search.SPARSE.format("string")} | search.schemas("string") | {t: s for t, s in cells.schemas("id", "string").items() if t in cells.LAID}


@dataclass
class Engine:
    """A store below `path`: chunks, the index of their vectors and that of their terms, in one log of commits, and settings.

    embed turns texts into vectors, encoder (none by default) into sparse weights of which `top_k_vocab` a chunk are kept, reranker scores texts for a query, model(context, query) writes answers: all are
    hooks with a built-in stand-in or none. Chunks whose id is stored already are left out at ingest, and of those that repeat
    one in a batch one stays. An ingest that fails, wherever it does, leaves the store as it was.
    """

    spark: SparkSession
    path: str
    options: Options = field(default_factory=Options)
    embed: Embedder = T.hashed_vector
    encoder: search.Encoder | None = None
    reranker: search.Reranker | None = None
    model: Callable[[str, str], str] | None = None

    def _at(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    @property
    def log(self) -> Log:
        return Log(self.spark, self.path)

    def chunks(self, state: State | None = None) -> DataFrame:
        return self.log.read((state or self.log.state()).of("chunks"), store.CHUNK)

    def vectors(self, state: State | None = None) -> DataFrame:
        return cells.Cells(self.log, state or self.log.state(), "id").vectors()

    def index(self) -> search.Index:
        return search.Index.read(self.spark, self.path)

    def ingest(self, pages: DataFrame, stream: str | None = None, batch: int = 0) -> dict[str, int]:
        """Stores the new chunks of page records; files, new and skipped are counted.

        Chunks, vectors and index runs are written first and enter the store by one commit. Where another writer has committed in
        between, what is new is worked out again. A batch of a stream that is committed already is not looked at again, and its counts are
        given as they were.
        """
        store.claim(self.spark, self.path)
        log, found_at = self.log, store.fresh(self.spark, "batch")
        if stream is not None and self._seen(log.state(), stream, batch):
            return log.state().info["streams"][stream]["stats"]
        chunk.chunked(pages, self.options, self.embed).write.parquet(found_at)
        found = self.spark.read.schema(store.CHUNK).parquet(found_at)
        while True:
            state = log.state()
            if stream is not None and self._seen(state, stream, batch):
                return state.info["streams"][stream]["stats"]
            new = log.write("chunks", chunks_of.ingest(found, self.chunks(state), "id").dropDuplicates(["id"]))
            rows = log.read([new], store.CHUNK)
            stats, runs, info = chunks_of.ingest_stats(found, rows), [], {}
            if stats["new"]:
                embedded = store.fresh(self.spark, "embedded")  # a model sees each chunk once
                rows.select("id", self.embed(F.col("text")).cast("array<double>").alias("vector")).write.parquet(embedded)
                vectors, counts = cells.stored(log, state, self.spark.read.schema("id string, vector array<double>").parquet(embedded), "id")
                store.removed(self.spark, embedded)
                runs, info = search.indexed(log, rows, state, "id", "text")
                runs, info = [new, *vectors, *runs, *self._sparse(rows)], info | counts
            if stream is not None:
                info["streams"] = state.info.get("streams", {}) | {stream: {"batch": batch, "stats": stats}}
            if not info:
                break
            try:
                log.commit(state, runs, info=info)
                break
            except Conflict:
                continue
        store.put_json(self.spark, self._at("sparse.json"), {"backend": self.options.sparse_backend, "top_k_vocab": self.options.top_k_vocab})
        log.merge(TABLES, search.LAID | cells.LAID, cells.SPLIT)
        cells.laid_anew(log, "id")
        return stats

    @staticmethod
    def _seen(state: State, stream: str, batch: int) -> bool:
        return state.info.get("streams", {}).get(stream, {"batch": -1})["batch"] >= batch

    def _sparse(self, chunks: DataFrame) -> list[Run]:
        if self.encoder is None:
            return []
        return [self.log.write("sparse", search.sparse_rows(chunks, self.encoder, self.options.top_k_vocab, "id"))]

    def rebuild(self, backend: str | None = None) -> None:
        """The sparse index of a backend anew from the stored chunks, by default that of the options: BM25 is the index of terms,
        anything else the encoder's weights. It takes the place of the one before by one commit."""
        log, none, words = self.log, State(0, (), {}), (backend or self.options.sparse_backend) == "BM25"
        if not words and self.encoder is None:
            raise ValueError("there is no encoder")
        while True:
            state = log.state()
            runs, info = search.indexed(log, self.chunks(state), none, "id", "text") if words else (self._sparse(self.chunks(state)), {})
            tables = search.schemas("string") if words else ("sparse",)
            try:
                log.commit(state, runs, [r for t in tables for r in state.of(t)], info)
                return
            except Conflict:
                continue

    def reset(self) -> None:
        store.reset(self.spark, self.path)

    def stats(self) -> DataFrame:
        return chunks_of.chunk_stats(self.chunks())

    def search(self, query: str, **changes) -> DataFrame:
        """The ranked chunks with score and rank; changes are options for this query alone."""
        o = Options(**{**self.options.__dict__, **changes})
        vector = self.spark.range(1).select(self.embed(F.lit(query)).alias("v")).first()[0]
        index = self.index()
        best = search.search(index, cells.Cells(index.log, index.state, "id"), query, o.mode, "id", list(vector), o.top_k, o.rerank_top_n, o.rrf_k, o.alpha, self._weights(query))
        found = self.chunks(index.state).join(F.broadcast(best), "id")  # as many rows as asked for
        reranker = self.reranker or search.RERANKERS.get(o.reranker)
        if reranker is not None:
            found = search.rerank(found, query, o.top_k, reranker, "id")
        return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))

    def _weights(self, query: str) -> dict[int, float] | None:
        """Of the query; None without an encoder."""
        if self.encoder is None:
            return None
        return self.spark.range(1).select(search.strongest_of(self.encoder, F.lit(query), self.options.top_k_vocab).alias("w")).first().w or {}

    def answer(self, query: str, **changes) -> tuple[str, list[str]]:
        """An answer and its references."""
        ranked = self.search(query, **changes)
        row = answer.answered(ranked, query, self.options.answer_mode, self.model, key="id").first()
        used = ranked.where(F.col("id").isin(row.used))
        return row.answer, [r.reference for r in answer.references(used, "rank").orderBy("rank").collect()]

    def chart(self, request: str, hint: str = ground.HINTS[0], include_csv: bool = True, **changes) -> str:
        return ground.respond(self.search(request, **changes), request, hint, include_csv)
