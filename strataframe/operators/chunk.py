"""Chunking, chunk identity, and the incremental index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import uuid5
from .paging import numbered

MAX_CHARS, OVERLAP = 3000, 300


def clean_lines(text: Column) -> Column:
    """Lines without surrounding white space, blank lines dropped."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\n")), "\n")
    strip = r"^\s+|\s+$"
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, strip, "")), lambda x: x != ""), "\n")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks_of(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Pieces of at most ``max_chars`` characters that overlap by ``overlap``.

    A piece that is not the last ends at the last line break, full stop with a space, or space of its window, if that lies
    beyond the window's middle; a full stop stays with the piece. Steps are longer than ``max_chars / 2 - overlap``, which
    bounds their number.
    """
    if not 0 <= overlap < max_chars // 2:
        raise ValueError("the overlap is smaller than half a piece")
    stride = max_chars // 2 - overlap

    def last(window: Column, mark: str) -> Column:
        """Place of the last ``mark`` in the window from 0, or -1."""
        at = F.locate(mark[::-1], F.reverse(window))
        return F.when(at == 0, F.lit(-1)).otherwise(F.length(window) - at - (len(mark) - 1))

    def cut(clean: Column) -> Column:
        n = F.length(clean)
        state = F.struct(F.lit(0).alias("start"), (n == 0).alias("done"), F.array().cast("array<string>").alias("parts"))

        def step(acc: Column, _: Column) -> Column:
            start = acc["start"]
            window = F.substring(clean, start + 1, F.lit(max_chars))

            def ended(w: Column) -> Column:
                full = F.least(start + max_chars, n)
                bound = F.greatest(last(w, "\n"), last(w, ". "), last(w, " "))
                dot = F.when(F.substring(w, bound + 1, F.lit(1)) == ".", 1).otherwise(0)
                end = F.when((full < n) & (bound > max_chars // 2), start + bound + dot).otherwise(full)

                def out(e: Column) -> Column:
                    part = F.regexp_replace(F.substring(w, F.lit(1), e - start), r"^\s+|\s+$", "")
                    return F.struct(F.greatest(start + 1, e - overlap).alias("start"), (e >= n).alias("done"), F.when(part != "", F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts"))

                return _let(end, out)

            return F.when(acc["done"], acc).otherwise(_let(window, ended))

        return F.aggregate(F.sequence(F.lit(1), F.floor(n / stride).cast("int") + 2), state, step)["parts"]

    return _let(clean_lines(text), cut)


def chunk_text(df: DataFrame, text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """One row for each piece of each row's text, with ``ordinal`` from 0 and ``chunk``."""
    return df.select("*", F.posexplode(chunks_of(F.col(text), max_chars, overlap)).alias("ordinal", "chunk"))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """``chunk_id`` from version, unit, ordinal and text; ``token_count`` and ``character_count``."""
    name = F.concat_ws(":", "source_unit_type", "source_unit_id", "ordinal", F.sha2("chunk", 256))
    return chunks.withColumns({"chunk_id": uuid5(F.col("document_version_id"), name), "token_count": F.greatest(F.lit(1), F.floor(F.length("chunk") / 4).cast("int")), "character_count": F.length("chunk")})


def chunk_index(chunks: DataFrame) -> DataFrame:
    """Running number of a chunk in its version: pages first, in order, then trusted rows."""
    order = [F.col("document_version_id"), F.col("evidence_type") == "TRUSTED_CANONICAL_DATA", F.col("page_number"), F.col("source_unit_id"), F.col("ordinal")]
    rows = numbered(chunks, order, "_number")  # a version is as many ranges as its size asks for
    first = rows.groupBy(F.col("document_version_id").alias("_v")).agg(F.min("_number").alias("_first"))
    return rows.join(first, F.col("document_version_id").eqNullSafe(F.col("_v"))).withColumn("chunk_index", (F.col("_number") - F.col("_first")).cast("int")).drop("_number", "_v", "_first")


def span_blocks(spans: DataFrame) -> DataFrame:
    """Text of each block of a page: spans joined to lines, lines to blocks."""
    lines = spans.groupBy("page_id", "block_index", "line_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_index", "id", "text"))), lambda x: x["text"]), "").alias("line"), F.min("id").alias("first"), F.collect_list("id").alias("ids"))
    return lines.groupBy("page_id", "block_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_index", "line"))), lambda x: x["line"]), "\n").alias("text"), F.min("first").alias("source_unit_id"), F.sort_array(F.flatten(F.collect_list("ids"))).alias("source_unit_ids"))


def table_row_text(cells: DataFrame) -> DataFrame:
    """A sentence for each row of each table, its cells named by the first row's."""
    value = F.trim(F.coalesce(F.nullif("normalized_value", F.lit("")), "raw_value", F.lit("")))
    table = Window.partitionBy("table_id")
    # cells are dealt out and sorted once: windows, rows and headers follow that order, with no join that could broadcast all headers
    dealt = cells.select("table_id", "table_order", "row_index", "column_index", value.alias("value")).repartition("table_id").sortWithinPartitions("table_id", "column_index")
    rows = dealt.withColumns({"head": F.min("row_index").over(table), "deep": F.max("row_index").over(table)})
    top = F.when((F.col("row_index") == F.col("head")) & (F.col("value") != ""), F.col("value"))
    header = F.coalesce(F.max(top).over(Window.partitionBy("table_id", "column_index")), F.concat(F.lit("Column "), F.col("column_index") + 1))
    found = rows.withColumn("header", header).groupBy("table_id", "table_order", "row_index").agg(F.first("head").alias("head"), F.first("deep").alias("deep"), F.sort_array(F.collect_list(F.struct("column_index", "header", "value"))).alias("_cells"))
    own = F.transform("_cells", lambda x: F.struct(x["column_index"], x["header"]))
    every = F.sort_array(F.flatten(F.collect_list(F.when(F.col("row_index") == F.col("head"), own)).over(table)))
    body = found.withColumn("_head", every).where("row_index > head OR deep = head")
    headers = F.array_join(F.transform("_head", lambda x: x["header"]), " | ")
    row_text = F.array_join(F.transform("_cells", lambda x: F.concat(x["header"], F.lit(": "), x["value"])), " | ")
    return body.select("table_id", "row_index", F.concat(F.lit("Table "), F.col("table_order"), F.lit(", row "), F.col("row_index") + 1, F.lit(". Headers: "), headers, F.lit(". "), row_text).alias("text"))


def page_chunks(pages: DataFrame, contents: DataFrame, rows: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of each page: of its contents, of its text where it has none, and of its tables' rows.

    ``pages (page_id, document_version_id, page_number, text)``, ``contents (page_id, id, text)``, ``rows (page_id, table_id, text)``.
    """
    version = pages.select("page_id", "document_version_id", "page_number")
    own = contents.select("page_id", F.col("id").alias("source_unit_id"), F.lit("CONTENT").alias("source_unit_type"), "text")
    bare = pages.join(contents.select("page_id").distinct(), "page_id", "left_anti").where(F.col("text").isNotNull()).select("page_id", F.col("page_id").alias("source_unit_id"), F.lit("PAGE").alias("source_unit_type"), "text")
    table = rows.select("page_id", F.col("table_id").alias("source_unit_id"), F.lit("TABLE_ROW").alias("source_unit_type"), "text")
    units = own.unionByName(bare).unionByName(table).join(version, "page_id")
    return chunk_ids(chunk_text(units, "text", max_chars, overlap)).withColumn("evidence_type", F.lit("SOURCE_DOCUMENT")).drop("text")


def trusted_text(kind: str, df: DataFrame, fields: list[str]) -> DataFrame:
    """Trusted rows as evidence: ``kind. field: value; ...`` of the fields that are not empty."""
    parts = [F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.concat(F.lit(f"{f}: "), F.col(f).cast("string"))) for f in fields]
    return df.select("id", F.lit(kind).alias("entity_type"), F.concat(F.lit(f"{kind}. "), F.concat_ws("; ", *parts)).alias("text"), F.lit("TRUSTED_CANONICAL_DATA").alias("evidence_type"))


def merge_chunks(old: DataFrame, new: DataFrame, model: str, dimension: int, rest: bool = False) -> DataFrame:
    """The index after new chunks ``(chunk_id, chunk)``: an unchanged chunk keeps its vector, a changed one loses it, a missing one goes.

    A chunk is indexed if its text is unchanged and its vector is of ``model`` and ``dimension`` and finite, whatever its flag
    was. ``change`` is ADDED, CHANGED, KEPT, or FLAGGED where only the flag differs. With ``rest`` the missing ones stay as they are.
    """
    text_hash = F.sha2("chunk", 256)  # where texts themselves are not asked for, their hashes meet
    o = old.select(*[F.col(c).alias(f"_{c}") for c in ("chunk_id", "chunk", "embedding", "embedding_model", "embedding_dimension", "is_indexed")], text_hash.alias("_hash"))
    joined = new.withColumns({"_arrived": F.lit(True), "_new_hash": text_hash}).join(o, F.col("chunk_id") == F.col("_chunk_id"), "full" if rest else "left")
    arrived = F.col("_arrived").isNotNull()
    same = F.col("_chunk_id").isNotNull() & F.col("_new_hash").eqNullSafe(F.col("_hash"))
    fits = same & valid_vector(F.col("_embedding"), dimension) & F.col("_embedding_model").eqNullSafe(F.lit(model)) & F.col("_embedding_dimension").eqNullSafe(F.lit(dimension))
    state = F.when(~arrived, "KEPT").when(F.col("_chunk_id").isNull(), "ADDED").when(~same, "CHANGED").when(~fits.eqNullSafe(F.col("_is_indexed")), "FLAGGED").otherwise("KEPT")
    vector = {c: F.when(same | ~arrived, F.col(f"_{c}")) for c in ("embedding", "embedding_model", "embedding_dimension")}
    own = {c: F.when(arrived, F.col(c)).otherwise(F.col(f"_{c}")) for c in ("chunk_id", "chunk")}
    return joined.withColumns({**vector, "is_indexed": F.when(arrived, fits).otherwise(F.col("_is_indexed")), "change": state}).withColumns(own).drop("_arrived", "_new_hash", *o.columns)


def removed_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of the index that the new ones do not have."""
    return old.join(new.select(F.col("chunk_id").alias("_id")), F.col("chunk_id") == F.col("_id"), "left_anti")


def valid_vector(vector: Column, dimension: int) -> Column:
    """Of the length wanted and finite throughout."""
    return F.coalesce((F.size(vector) == dimension) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def needs_embedding(chunks: DataFrame, model: str, dimension: int) -> DataFrame:
    """Chunks whose vector is missing or of another model or length, nulls included."""
    return chunks.where(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model)) | ~F.col("embedding_dimension").eqNullSafe(F.lit(dimension)))


def attach_vectors(chunks: DataFrame, vectors: DataFrame, model: str, dimension: int) -> DataFrame:
    """``vectors (id, text_hash, vector)`` put on the chunks whose text still has that hash."""
    v = vectors.where(valid_vector(F.col("vector"), dimension))
    joined = chunks.withColumn("_hash", F.sha2("chunk", 256)).join(v, (F.col("chunk_id") == F.col("id")) & (F.col("_hash") == F.col("text_hash")), "left").drop("_hash")
    got = F.col("vector").isNotNull()
    return joined.withColumns({"embedding": F.coalesce("vector", "embedding"), "is_indexed": got | F.coalesce("is_indexed", F.lit(False)), "embedding_model": F.when(got, model).otherwise(F.col("embedding_model")), "embedding_dimension": F.when(got, dimension).otherwise(F.col("embedding_dimension"))}).drop("id", "text_hash", "vector")


def lexical_index(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("is_indexed", F.length(F.trim("chunk")) > 0)


def clear_vectors(chunks: DataFrame, version, model: str, dimension: int, expected: int) -> DataFrame:
    """The vectors of one version taken off, if that version has just ``expected`` of that model and length; else nothing changes."""
    mine = F.col("document_version_id") == version
    fits = mine & F.col("embedding").isNotNull() & (F.col("embedding_model") == model) & (F.col("embedding_dimension") == dimension)
    n = chunks.agg(F.count(F.when(fits, 1)).alias("_n"))
    clear = mine & (F.col("_n") == expected)
    return chunks.crossJoin(F.broadcast(n)).withColumns({"embedding": F.when(~clear, F.col("embedding")), "is_indexed": F.col("is_indexed") & ~clear}).drop("_n")  # one row


def index_progress(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_version_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("embedding").alias("n_vectors"))
