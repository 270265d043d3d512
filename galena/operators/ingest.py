"""From submitted documents to what is searched: validation, blocks, chunks, enrichment, vectors,
the reference graph, and the rows that publish a generation. Each step is a plan of its own."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext, inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galena.functions import hashing, identifiers, text
from galena.operators import chunking, concepts, references
from galena.operators.lifecycle import count_differences
from galena.sources.embedders import Embedder, embedded
from galena.sources.shared import stored
from galena.sources.tables import spread

#: A submitted document, version 1.
CANONICAL = "version int, documentId string, title string, language string, domain string, accessLevel bigint, metadata map<string,string>, blocks array<struct<type:string,level:int,text:string,page:int>>"
BLOCK_TYPES = ("HEADING", "PARAGRAPH", "LIST_ITEM", "TABLE", "CODE")
LEVELS = 6


def canonical(rows: DataFrame, json: str) -> DataFrame:
    """The rows with `doc` (the record, or null) and `problem`: why it is not accepted, or null."""
    doc = F.from_json(json, CANONICAL, {"mode": "PERMISSIVE"})
    read = rows.withColumn("doc", doc)
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    problem = (
        F.when(F.col("doc").isNull() | F.col("doc.documentId").isNull(), "UNREADABLE")
        .when(~some(F.col("doc.documentId")), "NO_ID")
        .when(~F.coalesce(F.col("doc.version") == 1, F.lit(False)), "VERSION")
        .when(~F.coalesce(F.col("doc.accessLevel") > 0, F.lit(False)), "ACCESS")
        .when(~F.coalesce(F.exists("doc.blocks", lambda b: some(b["text"])), F.lit(False)), "NO_TEXT")
        .when(F.exists("doc.blocks", lambda b: ~F.coalesce(b["type"].isin(*BLOCK_TYPES), F.lit(False))), "BLOCK_TYPE")
    )
    return read.withColumn("problem", problem)


def canonical_hash(doc: Column) -> Column:
    """A digest of a record that does not depend on the order of its metadata: every part stands
    behind its length."""
    entries = F.array_sort(F.map_entries(F.coalesce(doc["metadata"], F.create_map().cast("map<string,string>"))))
    part = lambda c: F.concat(F.octet_length(F.coalesce(c.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c.cast("string"), F.lit("")))
    listed = F.array_join(F.transform(entries, lambda e: F.concat(part(e["key"]), part(e["value"]))), "")
    blocks = F.array_join(F.transform(doc["blocks"], lambda b: F.concat(part(b["type"]), part(b["level"]), part(b["text"]), part(b["page"]))), "")
    heads = [part(doc[c]) for c in ("documentId", "title", "language", "domain", "accessLevel")]
    return F.sha2(F.concat(*heads, listed, F.lit("|"), blocks), 256)


def canonical_units(docs: DataFrame) -> DataFrame:
    """(document, position, kind, section_path, text, page): blocks with text, under the headings before them.

    A level's heading holds until a heading of the same or a higher level follows."""
    each = docs.select(F.col("doc.documentId").alias("document"), F.posexplode("doc.blocks").alias("position", "b")).select("document", "position", F.col("b.type").alias("kind"), F.col("b.level").alias("level"), F.trim("b.text").alias("text"), F.col("b.page").alias("page")).filter("text <> ''")
    so_far = Window.partitionBy("document").orderBy("position")
    heading = F.col("kind") == "HEADING"
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(LEVELS))
    marks = {f"h{n}": F.last(F.when(heading & (level == n), F.struct("position", "text")), ignorenulls=True).over(so_far) for n in range(1, LEVELS + 1)}
    rows = each.withColumns(marks)
    path, newest = [], F.lit(-1)
    for n in range(1, LEVELS + 1):
        holds = F.col(f"h{n}.position") > newest
        path.append(F.when(holds, F.col(f"h{n}.text")))
        newest = F.greatest(newest, F.coalesce(f"h{n}.position", F.lit(-1)))
    return rows.select("document", "position", "kind", F.concat_ws(" > ", *path).alias("section_path"), "text", "page")


@lru_cache(maxsize=4)  # a stream asks for them in each batch, and to make them takes seconds
def _enrichment(context: SparkContext, marked: bool) -> dict[str, Column]:
    body, marks = F.col("text"), F.col("marks") if marked else None
    found = F.concat(identifiers.references(body, marks), identifiers.chinese_references(body, marks), identifiers.named_objects(body, marks))
    return {"identifiers": identifiers.extracted(body, marks=marks), "references": F.array_distinct(found), "unit": chunking.unit_class(body, F.col("domain"), marks)}


def enriched(chunks: DataFrame, surfaces: DataFrame | None = None) -> DataFrame:
    """Chunks (document, chunk, language, domain, text, perhaps marks, ...) with identifiers, references, the class
    of the unit, and at most twelve concepts."""
    out = chunks.withColumns(_enrichment(chunks.sparkSession.sparkContext, "marks" in chunks.columns))
    none = F.array().cast("array<string>")
    if surfaces is None:
        return out.withColumn("concepts", none)
    keyed = out.withColumn("_key", F.struct("document", *["generation"] * ("generation" in out.columns), "chunk"))
    found = concepts.annotated(concepts.matched(keyed.select("_key", "language", "text"), surfaces, "_key", "text"), "_key")
    return keyed.join(found, "_key", "left").withColumn("concepts", F.coalesce("concepts", none)).drop("_key")


def searchable(chunks: DataFrame) -> DataFrame:
    """Chunks that are searched: parents are only shown."""
    return chunks.filter("role <> 'PARENT'")


def assembled(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """(vector_id, document, generation, chunk, access_level, language, content, metadata, vector): a
    vector of every searchable chunk, under an id of its routing fields; metadata names are prefixed."""
    header = text.embedding_text(F.coalesce("title", F.lit("")), F.coalesce("domain", F.lit("")), F.coalesce("language", F.lit("")), F.col("section_path"), F.col("text"))
    vector_id = hashing.content_id("v1_", F.col("access_level").cast("string"), F.col("document"), F.col("generation").cast("string"), F.col("chunk"))
    names = {"unit": F.col("unit"), "section": F.col("section_path"), "role": F.col("role")}
    metadata = F.map_filter(F.create_map(*[x for k, v in names.items() for x in (F.lit(f"galena.{k}"), v)]), lambda k, v: v.isNotNull() & (v != ""))
    rows = searchable(chunks).select(vector_id.alias("vector_id"), "document", "generation", "chunk", "access_level", "language", header.alias("content"), metadata.alias("metadata"))
    return embedded(rows, embedder, "content")


#: What writes a table under its name and gives back what was written.
Keep = Callable[[str, DataFrame], DataFrame]


def _kept(tables: dict[str, DataFrame], keep: Keep | None) -> dict[str, DataFrame]:
    """Tables that do not need each other, written at the same time."""
    if keep is None:
        return tables
    with ThreadPoolExecutor(len(tables)) as pool:
        writes = {name: pool.submit(inheritable_thread_target(rows.sparkSession)(keep), name, rows) for name, rows in tables.items()}
        return {name: write.result() for name, write in writes.items()}


def claimed(docs: DataFrame, known: DataFrame | None = None, keep: Keep | None = None) -> tuple[DataFrame, DataFrame]:
    """Of documents (document, title, language, domain, access_level, text, perhaps seq) each distinct content once,
    with its fingerprint and generation, and the claims on contents.

    claims: document, fingerprint, generation, requests, status. Contents of a document are numbered behind its
    greatest generation in `known` (document_id, generation, perhaps fingerprint) in order of their first seq, then
    fingerprint; the last is CURRENT, those before it are SUPERSEDED. A content whose fingerprint is known is a
    REPLAY under its old generation and is not returned again. Only contents that occur more than once move. With `keep`
    the claims are written here, and the contents made from what was written."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "language", "domain", "access_level", "text")]
    keyed = docs.withColumn("fingerprint", hashing.content_id("f1_", *parts))
    seq = F.min("seq") if "seq" in docs.columns else F.lit(0)
    contents = keyed.groupBy("document", "fingerprint").agg(F.count("*").alias("requests"), seq.alias("_at"))
    old = None
    if known is not None:
        old = known.select(F.col("document_id").alias("document"), "generation", (F.col("fingerprint") if "fingerprint" in known.columns else F.lit(None).cast("string")).alias("fingerprint"))
        replayed = old.filter("fingerprint is not null").groupBy("document", "fingerprint").agg(F.max("generation").alias("_old"))
        contents = contents.join(replayed, ["document", "fingerprint"], "left").join(old.groupBy("document").agg(F.max("generation").alias("_last")), "document", "left")
    else:
        contents = contents.withColumns({"_old": F.lit(None).cast("long"), "_last": F.lit(None).cast("long")})
    new, by = F.col("_old").isNull(), Window.partitionBy("document")
    number = F.sum(new.cast("long")).over(by.orderBy("_at", "fingerprint").rowsBetween(Window.unboundedPreceding, 0))
    newest = F.max("_n").over(by)
    claims = contents.withColumn("_n", number)
    status = F.when(~new, "REPLAY").when(F.col("_n") == newest, "CURRENT").otherwise("SUPERSEDED")
    claims = claims.select("document", "fingerprint", F.coalesce("_old", F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("long").alias("generation"), "requests", status.alias("status"))
    claims = claims if keep is None else keep("claims", claims)
    fresh = keyed.join(claims.filter("status <> 'REPLAY'"), ["document", "fingerprint"])
    once = fresh.filter("requests = 1").unionByName(fresh.filter("requests > 1").dropDuplicates(["document", "fingerprint"]))
    return once.drop("requests"), claims


@dataclass
class Ingested:
    """Tables that an ingestion adds: what is searched, the rows of its generations, and the claims on contents."""

    chunks: DataFrame
    identifiers: DataFrame
    anchors: DataFrame
    edges: DataFrame
    vectors: DataFrame
    generations: DataFrame
    claims: DataFrame


def ingested(docs: DataFrame, embedder: Embedder, known: DataFrame | None = None, surfaces: DataFrame | None = None, keep: Keep | None = None) -> Ingested:
    """The whole way for documents (document, title, language, domain, access_level, text, perhaps seq).

    Each distinct content of a document is one generation, see claimed(): a document that comes twice with one content
    is chunked once. The newest is PUBLISHED if it has chunks and every searchable chunk has its vector, else FAILED;
    older ones of the batch are SUPERSEDED. The contents and their chunks are stored in the shared
    folder; the rest is run by the caller, who writes the tables, the generations last. With `keep` the tables are written
    here: claims, chunks, then what is made of these, the generations last, each from those written before it, so that
    nothing is found or embedded twice."""
    contents, claims = claimed(docs, known, keep)
    contents = stored(contents, "contents")
    key = ["document", "generation"]
    own = [*key, "title", "language", "domain", "access_level"]
    heads = contents.select(*own, "status", "fingerprint")
    # What chunks have of their document goes with it, so that none is joined.
    cut = chunking.chunked(spread(contents.select(F.struct(*own).alias("id"), "text", "domain")), "id", domain_col="domain", marked=True).withColumnRenamed("chunk_id", "chunk").select("id.*", "*").drop("id")
    # The place is part of a chunk's name, as a document can hold a text twice.
    cut = cut.withColumn("chunk", F.concat_ws("-", "chunk", "chunk_index"))
    if keep is None or surfaces is not None:
        cut = stored(cut, "chunks")
    # A table reads of a chunk's text only what it needs; concepts are joined for the chunks alone.
    rich = enriched(cut, surfaces)
    plain = rich if surfaces is None else enriched(cut)
    if keep is not None:
        rich = plain = cut = keep("chunks", rich)
    found = plain.select("access_level", *key, "chunk", F.explode("identifiers").alias("x")).select("access_level", *key, "chunk", "x.*")
    body = cut.filter("role <> 'CHILD'").select("document", "chunk", "text", "marks")
    made = _kept({"identifiers": found, "anchors": references.anchors(body), "edges": references.edges(body), "vectors": assembled(plain, embedder)}, keep)
    vectors = made["vectors"]
    both = F.struct(*key).alias("_both")
    wanted = searchable(cut).groupBy(both).agg(F.count("*").alias("expected"))
    wrong = count_differences(wanted, vectors.groupBy(both).agg(F.count("*").alias("stored")), "_both").select("_both.*", F.lit(True).alias("_wrong"))
    counts = cut.groupBy(*key).agg(F.count("*").alias("chunk_count"))
    status = F.when(F.col("chunk_count").isNull() | F.col("_wrong"), "FAILED").when(F.col("status") == "SUPERSEDED", "SUPERSEDED").otherwise("PUBLISHED")
    generations = heads.join(counts, key, "left").join(wrong, key, "left").select(F.col("document").alias("document_id"), "generation", "access_level", status.alias("generation_status"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(embedder.profile).alias("profile"), "fingerprint")
    return Ingested(rich, **made, generations=generations if keep is None else keep("generations", generations), claims=claims)


def admitted(requests: DataFrame, most: int) -> DataFrame:
    """The queue's answer to each request (key, fingerprint, seq, document): the first of a key is
    ACCEPTED while the queue has room, the same again is a REPLAY, another text under its key a CONFLICT,
    and what finds no room is BUSY. Room is counted over first requests, in order of arrival."""
    by = Window.partitionBy("key").orderBy("seq")
    first = requests.withColumns({"_n": F.row_number().over(by), "_owner": F.first("fingerprint").over(by)})
    # Places in the queue: the earliest `most` first requests.
    room = first.filter("_n = 1").orderBy("seq").limit(most).select("key").withColumn("_room", F.lit(True))
    status = F.when((F.col("_n") > 1) & (F.col("fingerprint") != F.col("_owner")), "CONFLICT").when(F.col("_room").isNull(), "BUSY").when(F.col("_n") > 1, "REPLAY").otherwise("ACCEPTED")
    return first.join(room, "key", "left").select("key", "seq", status.alias("status"))
