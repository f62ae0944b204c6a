"""The engine as a class: insert, query and delete over versioned tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import hooks, schemas
from tessella.functions.limits import Limits
from tessella.functions.text import csv_row, hash_id
from tessella.functions.tokenizers import WHITE, Tokenizer
from tessella.functions.vectors import quantised
from tessella.operators import cache, chunking, context, custom, extraction, graph, kv, ranking, search, sections
from tessella.sources.sinks import Keyed, TableStore

FAIL = "Sorry, I cannot answer that from what I know."


@dataclass(frozen=True)
class QueryParam:
    """Parameters of one query; ``cached`` looks for an equal question first, ``similar`` for one of at least that cosine."""

    mode: str = "hybrid"
    only_need_context: bool = False
    only_need_prompt: bool = False
    top_k: int = 60
    threshold: float = 0.2
    budget: int = 4000
    high_keywords: tuple[str, ...] = ()
    low_keywords: tuple[str, ...] = ()
    history: tuple[dict, ...] = field(default_factory=tuple)
    history_turns: int = 3
    gradient: float | None = None
    least: int = 30
    cached: bool = True
    similar: float | None = None
    recheck: bool = False


_VECTOR = "hash string, vector array<float>"


def _tables() -> dict[str, Keyed]:
    """The engine's tables; those that are looked up by a part of their key are dealt out by it."""
    return {
        "full_docs": Keyed(schemas.FULL_DOCS), "doc_status": Keyed("id string, status string, error string, attempts int, due double"), "doc_chunks": Keyed("doc_id string, id string", ("doc_id", "id"), ("doc_id",)),
        "text_chunks": Keyed(schemas.TEXT_CHUNKS), "answers": Keyed("args_hash string, answer string", ("args_hash",)), "nodes": Keyed(schemas.NODES), "edges": Keyed(schemas.EDGES, ("lo", "hi")),
        "node_mentions": Keyed("name string, entity_type string, description string, chunk_id string, pos long", ("name", "chunk_id"), ("name",)),
        "edge_mentions": Keyed("lo string, hi string, src string, tgt string, weight double, description string, keywords string, chunk_id string, pos long", ("lo", "hi", "chunk_id"), ("lo", "hi")),
        "adjacency": Keyed("id string, lo string, hi string", ("id", "lo", "hi"), ("id",)), "degrees": Keyed("id string, degree long"), "chunk_vectors": Keyed(f"id string, created double, {_VECTOR}"), "node_vectors": Keyed(f"id string, {_VECTOR}"),
        "edge_vectors": Keyed(f"id string, lo string, hi string, {_VECTOR}", ("lo", "hi")), "cache": Keyed("mode string, args_hash string, question string, answer string, q array<int>, low double, high double", ("mode", "args_hash"), ("mode",)),
    }


class GraphRetrieval:
    """Documents in, answers out; tables live in a folder that driver and executors share.

    ``score`` is a reranker, ``chunk`` cuts ``docs(doc_id, text)`` into the columns that
    :func:`tessella.operators.chunking.by_tokens` gives, ``tokenizer`` counts for chunks and budgets,
    and descriptions of over ``summary_tokens`` are summarised by the model. ``limits`` bound the
    calls of models. A failed document waits ``pause`` seconds, each time twice as long, until
    :meth:`retry` takes it in turn, and after ``attempts`` failures until it is asked for by name.
    """

    def __init__(
        self, spark: SparkSession, folder: str, embed: hooks.Embed, complete: hooks.Complete, size: int = 1200, overlap: int = 100, score: hooks.Score | None = None,
        chunk: Callable[[DataFrame], DataFrame] | None = None, tokenizer: Tokenizer = WHITE, summary_tokens: int = 500, limits: Limits = Limits(), pause: float = 60.0, attempts: int = 8, buckets: int = 64,
    ):
        self.spark, self.embed, self.complete, self.score, self.tokenizer, self.summary_tokens = spark, embed, complete, score, tokenizer, summary_tokens
        self.limits, self.pause, self.attempts = limits, pause, attempts
        self.chunk = chunk or (lambda docs: chunking.by_tokens(docs, size, overlap, tokenizer=tokenizer))
        self.store = TableStore(spark, folder, _tables(), buckets)
        self.counts: dict[str, int] = {}

    # indexing

    def insert(self, docs: DataFrame) -> None:
        """Index ``docs(text)`` that are new or failed before; all tables change together at the end.

        A document with a chunk for which the model fails is marked ``failed`` with the message, and
        nothing of it but its text is kept; the next insert of it, or :meth:`retry`, tries again.
        Answers of the model are kept by their prompts, also those of failed documents, so equal
        chunks are asked for once. ``counts`` says what the last insert did.
        """
        ingested = graph.checkpoint(chunking.ingest(docs).select("id", "content"))
        new = self._wanted(ingested)
        cut = self.chunk(new.select(F.col("id").alias("doc_id"), F.col("content").alias("text")))
        self._index(new, cut.select("doc_id", "chunk_order_index", "tokens", "content", "id"))

    def insert_chunks(self, docs: DataFrame) -> None:
        """Index ``docs(text, chunks)`` whose chunks are given."""
        ingested = graph.checkpoint(docs.where("text is not null").select(F.trim("text").alias("content"), "chunks").withColumn("id", hash_id("doc-", F.col("content"))).dropDuplicates(["id"]))
        new = self._wanted(ingested)
        each = new.select(F.col("id").alias("doc_id"), F.posexplode("chunks").alias("chunk_order_index", "content")).withColumn("content", F.trim("content"))
        self._index(new.select("id", "content"), each.select("doc_id", "chunk_order_index", self.tokenizer.count(F.col("content")).alias("tokens"), "content", hash_id("chunk-", F.col("content")).alias("id")))

    def _wanted(self, ingested: DataFrame) -> DataFrame:
        """Those that are new or failed before."""
        wanted = kv.missing_or(ingested, self.store.lookup("doc_status", ingested.select("id")), F.col("status") == "failed")
        return graph.checkpoint(ingested.join(wanted, "id", "left_semi"))

    def retry(self, due_only: bool = False) -> None:
        """Index the failed documents again; with ``due_only`` those whose pause is over and that have attempts left."""
        failed = self.store.read("doc_status").where("status = 'failed'")
        if due_only:
            failed = failed.where((F.col("due") <= time.time()) & (F.col("attempts") < self.attempts))
        failed = graph.checkpoint(failed.select("id"))
        if not failed.isEmpty():
            self.insert(self.store.lookup("full_docs", failed).select(F.col("content").alias("text")))

    def _index(self, new: DataFrame, cut: DataFrame) -> None:
        since, lookup = self.store.snapshot(), self.store.lookup
        cut = graph.checkpoint(cut)
        pairs = cut.select("doc_id", "id").distinct()
        # equal chunks are one, the last place wins
        single = cut.groupBy("id").agg(F.max_by(F.struct("tokens", "content", F.col("doc_id").alias("full_doc_id"), "chunk_order_index"), F.struct("doc_id", "chunk_order_index")).alias("c")).select("id", "c.*")
        single = graph.checkpoint(single.select(*schemas.names(schemas.TEXT_CHUNKS)))
        chunks = graph.checkpoint(single.join(lookup("text_chunks", single.select("id")).select("id"), "id", "left_anti"))
        answers, fresh = self._answers(chunks)
        errors = answers.where("error is not null").select(F.col("chunk_id").alias("id"), "error")
        failed = graph.checkpoint(pairs.join(errors, "id").groupBy("doc_id").agg(F.min("error").alias("error")))
        good = graph.checkpoint(pairs.join(failed, "doc_id", "left_anti"))
        kept = good.select(F.col("id").alias("chunk_id")).distinct()
        told = answers.where("error is null").join(kept, "chunk_id", "left_semi")
        nodes = extraction.entities(told).select(F.col("entity_name").alias("name"), "entity_type", "description", "chunk_id", F.col("pos").cast("long").alias("pos"))
        edges = extraction.relationships(told).select(F.col("src_id").alias("src"), F.col("tgt_id").alias("tgt"), "weight", "description", "keywords", "chunk_id", F.col("pos").cast("long").alias("pos"))
        before = lookup("doc_status", new.select("id")).select("id", F.coalesce("attempts", F.lit(0)).alias("was"))
        status = new.select("id").join(failed.withColumnRenamed("doc_id", "id"), "id", "left").join(before, "id", "left").withColumn("attempts", F.when(F.col("error").isNull(), 0).otherwise(F.coalesce("was", F.lit(0)) + 1))
        due = F.when(F.col("error").isNotNull(), F.lit(time.time()) + F.lit(self.pause) * F.pow(F.lit(2.0), F.col("attempts") - 1))
        status, seen = context.observed(
            status.select("id", F.when(F.col("error").isNull(), "processed").otherwise("failed").alias("status"), "error", "attempts", due.alias("due")),
            documents=F.count(F.lit(1)), failed=F.count("error"),
        )
        self._grow(
            nodes, edges, chunks.join(kept.withColumnRenamed("chunk_id", "id"), "id", "left_semi"), since,
            {"doc_status": status, "full_docs": new.select("id", "content"), "doc_chunks": good, "answers": fresh},
        )
        self.counts |= {k: int(v or 0) for k, v in seen.get.items()}

    def _answers(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``chunk_id, text, error`` for every chunk, and the new answers to keep: prompts are hashed and looked up before any call."""
        asked = graph.checkpoint(chunks.select("id", "content", F.md5(F.encode(F.concat(F.lit(hooks.EXTRACT), "content"), "UTF-8")).alias("args_hash")))
        known = self.store.lookup("answers", asked.select("args_hash"))
        known = graph.checkpoint(asked.select(F.col("id").alias("chunk_id"), "args_hash").join(known, "args_hash"))
        missing = asked.join(known.select(F.col("chunk_id").alias("id")), "id", "left_anti")
        told, seen = context.observed(hooks.extracted(missing, self.complete, limits=self.limits), asked=F.count(F.lit(1)), errors=F.count("error"))
        told = graph.checkpoint(told)
        fresh = told.where("error is null").join(asked.select(F.col("id").alias("chunk_id"), "args_hash"), "chunk_id").select("args_hash", F.col("text").alias("answer"))
        self.counts = {"cached": known.count(), **{k: int(v or 0) for k, v in seen.get.items()}}
        return told.unionByName(known.select("chunk_id", F.col("answer").alias("text"), F.lit(None).cast("string").alias("error"))), fresh.dropDuplicates(["args_hash"])

    def insert_custom_graph(self, entities: DataFrame, relationships: DataFrame, chunks: DataFrame) -> None:
        """Index a prebuilt graph whose parts name their chunks by label; rows have ``pos``, their order. What is there already adds nothing."""
        since, labels = self.store.snapshot(), custom.chunk_map(chunks)
        ids = chunks.select(hash_id("chunk-", F.trim("content")).alias("id"), self.tokenizer.count(F.col("content")).alias("tokens"), F.trim("content").alias("content"))
        fresh = ids.dropDuplicates(["id"]).select("id", "tokens", "content", F.lit(None).cast("string").alias("full_doc_id"), F.lit(0).alias("chunk_order_index"))
        nodes = custom.nodes(entities, relationships, labels).select(F.col("id").alias("name"), "entity_type", "description", F.col("source_id").alias("chunk_id"), F.lit(0).cast("long").alias("pos"))
        edges = custom.edges(relationships, labels).select("src", "tgt", "weight", "description", "keywords", F.col("source_id").alias("chunk_id"), F.lit(0).cast("long").alias("pos"))
        fresh = graph.checkpoint(fresh)
        new = fresh.join(self.store.lookup("text_chunks", fresh.select("id")).select("id"), "id", "left_anti")
        self._grow(self._beside("node_mentions", nodes), self._beside("edge_mentions", _with_ends(edges)), new, since, {})

    def _beside(self, table: str, rows: DataFrame) -> DataFrame:
        """New rows of mentions, each once, with the stored ones of the same keys, which they join."""
        spec, rows = self.store.keyed[table], graph.checkpoint(rows.distinct())
        known = graph.checkpoint(self.store.lookup(table, rows.select(*spec.key)))
        fresh = graph.checkpoint(_new_rows(rows.select(*spec.columns), known))
        return fresh.unionByName(known.join(fresh.select(*spec.key).distinct(), list(spec.key), "left_semi").select(*spec.columns))

    def _grow(self, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, since: dict, put: dict[str, DataFrame]) -> None:
        """Add mentions and chunks; only names and pairs that they touch are read and merged, and only changed texts embedded."""
        nodes, edges, chunks = graph.checkpoints(nodes, _with_ends(edges), chunks)
        vectors = hooks.embedded(chunks, self.embed, limits=self.limits).join(chunks.select("id", _digest().alias("hash")), "id").select("id", F.lit(time.time()).alias("created"), "hash", "vector")
        changed, gone = self._changed(nodes, edges, None, None)
        self.store.commit(put={**put, **changed, "text_chunks": chunks, "node_mentions": nodes, "edge_mentions": edges, "chunk_vectors": vectors}, remove=gone, since=since)

    def _shrink(self, nodes: DataFrame, edges: DataFrame, since: dict, remove: dict[str, DataFrame]) -> None:
        """Take the mentions of the given keys away."""
        nodes, edges = graph.checkpoint(nodes.select("name", "chunk_id").distinct()), graph.checkpoint(edges.select("lo", "hi", "chunk_id").distinct())
        changed, gone = self._changed(None, None, nodes, edges)
        self.store.commit(put=changed, remove={**gone, **remove, "node_mentions": nodes, "edge_mentions": edges}, since=since)

    def _after(self, table: str, at: DataFrame, new: DataFrame | None, gone: DataFrame | None) -> DataFrame:
        """Stored mentions of some names or pairs as they are once ``new`` rows are put or those of keys ``gone`` removed."""
        key = list(self.store.keyed[table].key)
        left = self.store.lookup(table, at).join((new if gone is None else gone).select(*key).distinct(), key, "left_anti").select(*self.store.keyed[table].columns)
        return left if new is None else left.unionByName(new.select(*left.columns))

    def _changed(self, nodes: DataFrame | None, edges: DataFrame | None, gone_nodes: DataFrame | None, gone_edges: DataFrame | None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """What to put and what to remove in the graph's tables after mentions changed.

        All reads are lookups by the touched names and pairs: their mentions, edges, degrees and
        vectors. Degrees are kept by what they gain and lose, so a hub's edges are not counted again.
        """
        lookup, names_of = self.store.lookup, schemas.names
        pairs = (edges if gone_edges is None else gone_edges).select("lo", "hi").distinct()
        named = (nodes if gone_nodes is None else gone_nodes).select(F.col("name").alias("id"))
        pairs, names = graph.checkpoints(pairs, named.unionByName(pairs.select(F.explode(F.array("lo", "hi")).alias("id"))).distinct())
        short = lambda rows: hooks.summarised(rows, self.complete, self.summary_tokens, counter=self.tokenizer.count, limits=self.limits)

        def edges_now() -> DataFrame:
            merged = graph.relation_ids(graph.merge_edges(self._after("edge_mentions", pairs, edges, gone_edges))).select("id", *names_of(schemas.EDGES))
            return graph.checkpoint(short(merged).drop("id"))

        def nodes_now() -> DataFrame:
            merged = graph.merge_nodes(self._after("node_mentions", names.withColumnRenamed("id", "name"), nodes, gone_nodes))
            return graph.checkpoint(short(merged.select(*names_of(schemas.NODES))))

        new_edges, merged, were = graph.together(edges_now, nodes_now, lambda: graph.checkpoint(lookup("edges", pairs).select("lo", "hi")))
        lost, added, bare = graph.checkpoints(
            were.join(new_edges, ["lo", "hi"], "left_anti"), new_edges.select("lo", "hi").join(were, ["lo", "hi"], "left_anti"), names.join(merged.select("id"), "id", "left_anti")
        )
        ends = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("id")
        each = lambda df, by: df.select(F.explode(F.array("lo", "hi")).alias("id"), F.lit(by).alias("by"))
        moved = each(added, 1).unionByName(each(lost, -1)).groupBy("id").agg(F.sum("by").alias("by"))

        def degrees_now() -> DataFrame:
            return graph.checkpoint(moved.join(lookup("degrees", moved.select("id")), "id", "left").select("id", (F.coalesce("degree", F.lit(0)) + F.col("by")).alias("degree")))

        def all_nodes() -> DataFrame:
            if bare.isEmpty():
                return merged
            old = self.stored_edges(bare).join(pairs, ["lo", "hi"], "left_anti").select(*names_of(schemas.EDGES))
            lacking = graph.placeholders(old.unionByName(graph.touching(new_edges, bare)), merged).join(bare, "id", "left_semi")
            return graph.checkpoint(merged.unionByName(lacking.select(*names_of(schemas.NODES))))

        edge_text = graph.relation_ids(new_edges).select("id", "lo", "hi", F.concat("keywords", "lo", "hi", "description").alias("content"))
        degrees, new_nodes, edge_vectors = graph.together(degrees_now, all_nodes, lambda: self._embedded(edge_text, "edge_vectors", ["lo", "hi"]))
        node_text = new_nodes.select("id", F.concat("id", "description").alias("content"))
        dead, node_vectors = graph.together(lambda: graph.checkpoint(names.join(new_nodes.select("id"), "id", "left_anti")), lambda: self._embedded(node_text, "node_vectors", ["id"]))
        put = {
            "nodes": new_nodes, "edges": new_edges, "adjacency": added.select(ends, "lo", "hi"), "degrees": degrees.where("degree > 0"),
            "node_vectors": node_vectors, "edge_vectors": edge_vectors,
        }
        gone = {"nodes": dead, "node_vectors": dead, "edges": lost, "edge_vectors": lost, "adjacency": lost.select(ends, "lo", "hi"), "degrees": degrees.where("degree <= 0")}
        return put, gone

    def stored_edges(self, ids: DataFrame) -> DataFrame:
        """Stored edges with an end among ``ids(id)``, by the adjacency of these ends."""
        near = graph.checkpoint(self.store.lookup("adjacency", ids.select("id")).select("lo", "hi").distinct())
        return self.store.lookup("edges", near)

    def _embedded(self, texts: DataFrame, table: str, key: list[str]) -> DataFrame:
        """New vectors of ``texts(id, content)`` whose text is not as it was when its vector was made."""
        texts = texts.withColumn("hash", _digest())
        known = self.store.lookup(table, texts.select(*key)).select(*key, "hash")
        fresh = graph.checkpoint(texts.join(known, [*key, "hash"], "left_anti"))
        return graph.checkpoint(hooks.embedded(fresh, self.embed, limits=self.limits).join(fresh.drop("content"), "id").select(*self.store.keyed[table].columns))

    def delete_document(self, doc_id: str) -> None:
        """Remove a document with the chunks that no other has, and what only these support."""
        since, read = self.store.snapshot(), self.store.read
        this = self.spark.createDataFrame([(doc_id,)], "doc_id string")
        theirs = graph.checkpoint(self.store.lookup("doc_chunks", this))
        shared = read("doc_chunks").where(F.col("doc_id") != doc_id).join(theirs.select("id"), "id", "left_semi")
        gone = graph.checkpoint(theirs.select("id").distinct().join(shared.select("id"), "id", "left_anti"))
        of_chunk = gone.withColumnRenamed("id", "chunk_id")
        mine = lambda name: read(name).join(of_chunk, "chunk_id", "left_semi")
        doc = this.withColumnRenamed("doc_id", "id")
        self._shrink(mine("node_mentions"), mine("edge_mentions"), since, {"text_chunks": gone, "chunk_vectors": gone, "doc_chunks": theirs, "full_docs": doc, "doc_status": doc})

    def delete_entity(self, name: str) -> None:
        """Remove an entity and its relations."""
        since, this = self.store.snapshot(), self.spark.createDataFrame([(name,)], "id string")
        pairs = graph.checkpoint(self.store.lookup("adjacency", this).select("lo", "hi").distinct())
        self._shrink(self.store.lookup("node_mentions", this.withColumnRenamed("id", "name")), self.store.lookup("edge_mentions", pairs), since, {})

    def clear(self) -> None:
        self.store.drop()

    def status_counts(self) -> DataFrame:
        return kv.status_counts(self.store.read("doc_status"))

    def labels(self) -> DataFrame:
        return self.store.read("nodes").select("entity_type").distinct().orderBy("entity_type")

    def subgraph(self, name: str, depth: int = 5) -> tuple[DataFrame, DataFrame]:
        """Nodes within ``depth`` steps of a name, with their depth, and the edges between them."""
        edges = self.store.read("edges")
        near = graph.reachable(edges, self.spark.createDataFrame([(name,)], "id string"), depth)
        return near.join(self.store.read("nodes"), "id", "left"), graph.induced(edges, near)

    def entity_info(self, name: str, with_vector: bool = False) -> DataFrame:
        """Node of a name, with its vector if asked."""
        this = self.spark.createDataFrame([(name,)], "id string")
        found = self.store.lookup("nodes", this)
        return graph.with_vectors(found, self.store.lookup("node_vectors", this), ["id"]) if with_vector else found

    def relation_info(self, one: str, other: str, with_vector: bool = False) -> DataFrame:
        """Edge between two names, with its vector if asked."""
        this = self.spark.createDataFrame([(min(one, other), max(one, other))], "lo string, hi string")
        found = self.store.lookup("edges", this)
        return graph.with_vectors(found, self.store.lookup("edge_vectors", this), ["lo", "hi"]) if with_vector else found

    # queries

    def keywords(self, text: str) -> tuple[list[str], list[str]]:
        """High and low keywords of a query by the model; none if its answer has no JSON."""
        answer = self.complete("Give JSON with high_level_keywords and low_level_keywords.\nQuery: " + text)
        row = self.spark.createDataFrame([(answer,)], "a string").select(extraction.keywords(F.col("a")).alias("k")).first()
        return list(row.k.high), list(row.k.low)

    def _ranked(self, rows: DataFrame, query: str, param: QueryParam) -> str:
        """Paragraphs ``rows(place, text)`` of all sections in the reranker's order, cut where scores fall, numbered from 1 (Q6).

        Quotes and commas at the edges of a paragraph go; one that the reranker gave no score comes last.
        """
        asked = graph.checkpoint(rows).withColumns({"query": F.lit(query), "query_id": F.lit(0)})
        scored = hooks.scored(asked, self.score, "text", limits=self.limits)
        kept = ranking.gradient_select(scored, param.least, param.gradient, key="place")
        block = F.concat(F.col("rn").cast("string"), F.lit(":\n"), F.btrim(F.col("text"), F.lit('",')), F.lit("\n\n"))
        return context.joined_chunks(kept.select("rn", block.alias("content")), "rn", "").first().context or ""

    def context(self, text: str, param: QueryParam = QueryParam()) -> str | None:
        """Context of a query, or None where nothing is found."""
        if param.mode == "naive":
            found = _Stored(self, param, text, text, text)
            return context.joined_chunks(sections.naive_rows(found), "pos").first().context or None
        high, low = list(param.high_keywords), list(param.low_keywords)
        if not high and not low:
            high, low = self.keywords(text)
        mode = "hybrid" if param.mode == "mix" else param.mode
        if not high and not low:
            return None
        mode = "global" if not low and mode in ("local", "hybrid") else "local" if not high and mode in ("global", "hybrid") else mode
        g = _Stored(self, param, ", ".join(low), ", ".join(high), text)
        local = (sections.local_entity_rows, sections.local_relation_rows, sections.local_source_rows)
        overall = (sections.global_entity_rows, sections.global_relation_rows, sections.global_source_rows)
        columns = (["entity", "type", "description", "rank"], ["source", "target", "description", "keywords", "weight", "rank"], ["content"])
        titles = ("Entities", "Relationships", "Sources")
        found = []
        for mine, theirs, names in zip(local, overall, columns, strict=True):
            found.append(mine(g) if mode == "local" else theirs(g) if mode == "global" else context.combine(theirs(g), mine(g), names))
        joint = param.mode == "mix" and self.score and param.gradient
        if joint:
            line = lambda names: csv_row(*[F.col(c) for c in names])
            rows = [r.select((F.lit(k << 32) + F.col("id")).alias("place"), line(["id", *names]).alias("text")) for k, (r, names) in enumerate(zip(found, columns, strict=True))]
            return self._ranked(reduce(DataFrame.unionByName, [*rows, self._dated(g).select((F.lit(3 << 32) + F.col("pos")).alias("place"), F.col("content").alias("text"))]), text, param) or None
        parts = [f"-----{title}-----\n" + context.csv_section(r, ["id", *names]).first().csv for title, r, names in zip(titles, found, columns, strict=True)]
        if param.mode == "mix":
            parts.append("-----Chunks-----\n" + (context.joined_chunks(self._dated(g), "pos").first().context or ""))
        return "\n".join(parts)

    def _dated(self, g: _Stored) -> DataFrame:
        """``pos, content`` of the chunks that a mixed query hits, ten at most and within the budget, with the times they were stored (Q5)."""
        hits = g.chunk_hits().where(F.col("pos") < min(10, g.param.top_k))
        kept = ranking.token_budget(hits.join(g.chunks_at(hits), "id"), "content", g.budget, [F.col("pos")], counter=g.counter)
        stamp = F.concat(F.lit("[Created at: "), context.created_at(F.floor("created").cast("long")), F.lit("]\n"))
        return kept.select("pos", F.concat(F.coalesce(stamp, F.lit("")), "content").alias("content"))

    def past(self, param: QueryParam) -> str:
        """The last turns of the history as text."""
        if not param.history:
            return ""
        rows = [(0, i, m.get("role"), m.get("content")) for i, m in enumerate(param.history)]
        found = extraction.conversation_turns(self.spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), param.history_turns).first()
        return found.history + "\n" if found else ""

    def query(self, text: str, param: QueryParam = QueryParam()) -> str:
        """Answer of the model over the query's context; a prefix such as ``/local `` names the mode.

        An answer is kept under mode, query, keywords and history, and an equal query later takes it from there.
        """
        row = self.spark.createDataFrame([(text,)], "q string").select(extraction.query_mode(F.col("q")).alias("m")).first().m
        if row.query != text:
            param, text = replace(param, mode=row.mode), row.query
        whole = not (param.only_need_context or param.only_need_prompt)
        known = self._cached(text, param) if whole and param.cached else None
        if known is not None:
            return known
        found = self.context(text, param)
        if found is None:
            return FAIL
        if param.only_need_context:
            return found
        prompt = f"Answer from the data below only.\n{self.past(param)}\n{found}\n\nQuestion: {text}"
        if param.only_need_prompt:
            return prompt
        answer = self.complete(prompt)
        if param.cached:
            vector = self.spark.createDataFrame([(self._key(text, param), param.mode, text, answer, [float(x) for x in self.embed([text])[0]])], "args_hash string, mode string, question string, answer string, v array<double>")
            saved = vector.select("mode", "args_hash", "question", "answer", quantised(F.col("v")).alias("q"), F.array_min("v").alias("low"), F.array_max("v").alias("high"))
            self.store.commit(put={"cache": saved})
        return answer

    def _key(self, text: str, param: QueryParam) -> str:
        parts = repr((text, param.high_keywords, param.low_keywords, param.history, param.top_k, param.threshold, param.budget, param.gradient, param.least))
        return self.spark.range(1).select(cache.key(F.lit(param.mode), F.lit(parts), "query").alias("k")).first().k

    def _cached(self, text: str, param: QueryParam) -> str | None:
        """Answer to an equal query, or to the most similar one of the mode that the model, if asked, takes for the same."""
        stored = self.store.lookup("cache", self.spark.createDataFrame([(param.mode,)], "mode string"))
        asked = self.spark.createDataFrame([(param.mode, self._key(text, param))], "mode string, args_hash string")
        answer = cache.exact(asked, stored).select("answer").first()
        if answer and answer.answer is not None:
            return answer.answer
        if param.similar is None:
            return None
        query = self.spark.createDataFrame([(0, [float(x) for x in self.embed([text])[0]])], "query_id long, vector array<double>")
        best = cache.similar(query, stored.withColumn("id", F.col("args_hash")), param.similar).first()
        if best is None:
            return None
        other = stored.where(F.col("args_hash") == best.id).first()
        if param.recheck and self.complete(f"{hooks.SAME}1. {text}\n2. {other.question}").strip().strip("\"'").lower() not in ("yes", "是"):
            return None
        return other.answer


def _digest():
    return F.md5(F.encode("content", "UTF-8"))


def _with_ends(mentions: DataFrame) -> DataFrame:
    """Edge mentions with both ends in order, in the table's columns."""
    return mentions.withColumns({"lo": F.least("src", "tgt"), "hi": F.greatest("src", "tgt")}).select(*_tables()["edge_mentions"].columns)


def _new_rows(rows: DataFrame, known: DataFrame, distinct: bool = True) -> DataFrame:
    """Rows that ``known`` does not have, nulls equal to nulls; equal rows once unless told otherwise."""
    match = None
    other = known.select(*[F.col(c).alias(f"__{c}") for c in rows.columns])
    for c in rows.columns:
        same = F.col(c).eqNullSafe(F.col(f"__{c}"))
        match = same if match is None else match & same
    return (rows.distinct() if distinct else rows).join(other, match, "left_anti")


class _Stored:
    """The stored tables as a graph for :mod:`tessella.operators.sections`; what hits touch is looked up."""

    def __init__(self, engine: GraphRetrieval, param: QueryParam, low: str, high: str, text: str):
        self.engine, self.param, self.low, self.high, self.text, self.budget = engine, param, low, high, text, param.budget
        self.counter = engine.tokenizer.count
        self.found: dict[str, DataFrame] = {}

    def nodes_at(self, ids: DataFrame) -> DataFrame:
        return self.engine.store.lookup("nodes", ids.select("id"))

    def edges_at(self, pairs: DataFrame) -> DataFrame:
        return self.engine.store.lookup("edges", pairs.select("lo", "hi"))

    def edges_touching(self, ids: DataFrame) -> DataFrame:
        return self.engine.stored_edges(ids)

    def degrees_at(self, ids: DataFrame) -> DataFrame:
        return self.engine.store.lookup("degrees", ids.select("id"))

    def chunks_at(self, ids: DataFrame) -> DataFrame:
        return self.engine.store.lookup("text_chunks", ids.select("id")).select("id", "content")

    def _hits(self, table: str, text: str, columns: list[str]) -> DataFrame:
        """Hits of a table's vectors, made once; a top-k bounds them."""
        if table not in self.found:
            found = search.top_k(self.engine.store.read(table), self.engine.embed([text])[0], self.param.top_k, self.param.threshold)
            self.found[table] = graph.checkpoint(ranking.numbered(found, [F.desc("similarity"), F.col("id")], name="pos").select("pos", *columns))
        return self.found[table]

    def entity_hits(self) -> DataFrame:
        return self._hits("node_vectors", self.low, ["id"])

    def edge_hits(self) -> DataFrame:
        return self._hits("edge_vectors", self.high, ["lo", "hi"])

    def chunk_hits(self) -> DataFrame:
        return self._hits("chunk_vectors", self.text, ["id", "created"])
