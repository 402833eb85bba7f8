"""Text functions: tokens, inverted index, line metrics, chunks, usages and digests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SIZE, CHUNK_OVERLAP, NEWLINE_REACH = 2000, 300, 200


def tokens(text: str | Column, least: int = 2) -> Column:
    """Lower-cased runs of letters, digits and underscores of at least ``least`` characters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) >= least)


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """token, key and how often: one row per distinct token of a document."""
    return docs.select(F.col(key), F.explode(tokens(text)).alias("token")).groupBy("token", key).agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame, text: str) -> DataFrame:
    """token and in how many documents; distinct per document before the shuffle."""
    return docs.select(F.explode(F.array_distinct(tokens(text))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def index_search(index: DataFrame, query: str, key: str) -> DataFrame:
    """Keys for which every token of ``query`` is contained in some indexed token."""
    asked = [t for t in dict.fromkeys(_plain_tokens(query))]
    if not asked:
        return index.select(key).limit(0)
    hit = F.array_compact(F.array(*[F.when(F.col("token").contains(t), F.lit(i)) for i, t in enumerate(asked)]))
    hits = index.where(F.size(hit) > 0).select(key, F.explode(hit).alias("i"))
    return hits.groupBy(key).agg(F.countDistinct("i").alias("n")).where(F.col("n") == len(asked)).select(key)


def _plain_tokens(text: str, least: int = 2) -> list[str]:
    import re

    return [t for t in re.findall(r"\w+", text.lower()) if len(t) >= least]


def lines(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row per line: key, line (from 1) and its text."""
    return docs.select(*key, F.posexplode(F.split(text, "\n")).alias("at", "content")).select(*key, (F.col("at") + 1).alias("line"), "content")


def line_metrics(text: str | Column, comment: str = "//") -> list[Column]:
    """n_lines, n_blank, n_comment and n_code of a text, without exploding it."""
    parts = F.split(text, "\n")
    blank = F.size(F.filter(parts, lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", "")) == ""))
    comments = F.size(F.filter(parts, lambda x: F.ltrim(F.regexp_replace(x, r"\t", " ")).startswith(comment)))
    return [
        F.size(parts).cast("long").alias("n_lines"),
        blank.cast("long").alias("n_blank"),
        comments.cast("long").alias("n_comment"),
        (F.size(parts) - blank - comments).cast("long").alias("n_code"),
    ]


def line_range(text: str | Column, start: int, end: int) -> Column:
    """Lines ``start`` to ``end``, both counted from 1 and included, clamped to the text."""
    first = max(start, 1)
    return F.array_join(F.slice(F.split(text, "\n"), first, max(end - first + 1, 0)), "\n")


def usages(docs: DataFrame, key: list[str], text: str, identifier: str, limit: int | None = 100) -> DataFrame:
    """Lines with the identifier as a whole word (any case), without those that define it; ordered, at most ``limit``."""
    word = identifier.lower()
    escaped = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in word)
    here = rf"(^|[^\p{{L}}\p{{N}}_]){escaped}($|[^\p{{L}}\p{{N}}_])"
    defines = rf"^\s*(процедура|функция|procedure|function)\s+{escaped}\s*\("
    low = F.lower("content")
    # The cheap test first: most lines do not have the letters at all.
    found = lines(docs.where(F.lower(text).contains(word)), key, text).where(low.contains(word) & low.rlike(here) & ~low.rlike(defines))
    found = found.orderBy(*key, "line")
    return found if limit is None else found.limit(limit)


# --- chunks ------------------------------------------------------------------


def chunk_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, reach: int = NEWLINE_REACH) -> Iterator[tuple[int, int]]:
    """Start and end of windows of at most ``size`` characters that cover the text.

    A window ends after the last line feed of its final ``reach`` characters, if that
    still leaves progress; the next starts ``overlap`` before its end, and always
    later than this one.
    """
    at, n = 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n:
            cut = text.rfind("\n", max(at, end - reach), end)
            if cut > at:
                end = cut + 1
        yield at, end
        if end >= n:
            return
        at = max(end - overlap, at + 1) if overlap < end - at else end


def chunks(docs: DataFrame, key: list[str], text: str, size: int | Column = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, empty: bool = False) -> DataFrame:
    """key, chunk_index, chunk_total, start and chunk of every window of every text; the size may differ by row, and an empty text has one chunk if ``empty``.  A text is never split over tasks, its windows are never gathered."""
    sized = size if isinstance(size, Column) else F.lit(size)
    source = docs.select(*key, sized.cast("int").alias("__size"), F.col(text).alias("__text"))
    out = T.StructType([*source.drop("__size", "__text").schema.fields, T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_total", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, texts = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            rows, index, total, starts, parts = [], [], [], [], []
            for r, (most, t) in enumerate(zip(sizes, texts, strict=True)):
                t = t or ""
                spans = list(chunk_spans(t, most, overlap)) or [(0, 0)] * empty
                for i, (a, b) in enumerate(spans):
                    rows.append(r)
                    index.append(i)
                    total.append(len(spans))
                    starts.append(a)
                    parts.append(t[a:b])
            take = pa.array(rows, pa.int64())
            kept = [batch.column(i).take(take) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(index, pa.int32()), pa.array(total, pa.int32()), pa.array(starts, pa.int32()), pa.array(parts, pa.string())], [f.name for f in out.fields])

    return source.mapInArrow(cut, out)


def chunk_id(base: str | Column, index: str | Column, total: str | Column) -> Column:
    """The base id alone if there is one chunk, else with its number."""
    base, index, total = (F.col(c) if isinstance(c, str) else c for c in (base, index, total))
    return F.when(total <= 1, base).otherwise(F.concat(base, F.lit(".chunk_"), index.cast("string")))


def base_id(chunk: str | Column) -> Column:
    return F.regexp_replace(chunk, r"\.chunk_[^.]*$", "")


def procedure_header(owner: Column, name: Column, is_function: Column, is_export: Column, directive: Column, comment: Column) -> Column:
    """The lines that precede every chunk of a procedure's body."""
    kind = F.when(is_function, "Function").otherwise("Procedure")
    title = F.concat(owner, F.lit("."), name, F.lit(" ("), kind, F.when(is_export, ", export").otherwise(""), F.lit(")"))
    return F.concat_ws("\n", title, F.when(directive != "", directive), F.when(comment != "", comment))


def procedure_chunks(procedures: DataFrame, key: list[str], most: int = 4000, overlap: int = CHUNK_OVERLAP, least: int = 100, marker: str = "…") -> DataFrame:
    """key, chunk_index, chunk_total, start and content: the whole header and a window of the body (the signature, if that is empty).

    Both are within ``most`` characters together, unless the header leaves the window less than ``least``.
    """
    header = procedure_header(*[F.col(c) for c in ("owner", "name", "is_function", "is_export", "directive", "comment")])
    signature = F.col("signature") if "signature" in procedures.columns else F.lit("")
    held = procedures.select(*key, header.alias("__header"), F.coalesce(F.nullif("body", F.lit("")), signature, F.lit("")).alias("__body"))
    lead_size = F.length("__header") + 1
    budget = F.greatest(F.lit(most) - lead_size - len(marker) - 1, F.lit(least))
    # What fits with its header is one chunk and needs no marker.
    size = F.when(lead_size + F.length("__body") <= most, F.greatest(F.length("__body"), F.lit(1))).otherwise(budget)
    parts = chunks(held, [*key, "__header"], "__body", size, overlap, empty=True)
    lead = F.when(F.col("chunk_index") > 0, F.lit(marker + "\n")).otherwise(F.lit(""))
    return parts.select(*key, "chunk_index", "chunk_total", "start", F.concat("__header", F.lit("\n"), lead, F.col("chunk")).alias("content"))


def module_chunks(modules: DataFrame, key: list[str], most: int = 2000, overlap: int = CHUNK_OVERLAP, least: int = 100) -> DataFrame:
    """key, chunk_index, chunk_total, start and content of modules (owner, module, content): a title line, then a window of the source; a module without text has none."""
    title = F.concat(F.col("owner"), F.lit(" ("), F.col("module"), F.lit(")"))
    held = modules.where("content <> ''").select(*key, title.alias("__title"), F.col("content").alias("__source"))
    size = F.greatest(F.lit(most) - F.length("__title") - 1, F.lit(least))
    parts = chunks(held, [*key, "__title"], "__source", size, overlap)
    return parts.select(*key, "chunk_index", "chunk_total", "start", F.concat("__title", F.lit("\n"), "chunk").alias("content"))


def metadata_text(name: Column, synonym: Column, comment: Column, attributes: Column, sections: Column) -> Column:
    """Labelled lines that describe an object; empty parts are left out."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Object: "), name),
        F.when(synonym != "", F.concat(F.lit("Synonym: "), synonym)),
        F.when(comment != "", F.concat(F.lit("Comment: "), comment)),
        F.when(F.size(attributes) > 0, F.concat(F.lit("Attributes: "), F.array_join(attributes, ", "))),
        F.when(F.size(sections) > 0, F.concat(F.lit("Tabular sections: "), F.array_join(sections, ", "))),
    )


# --- names and digests -------------------------------------------------------


def normal_name(name: str | Column) -> Column:
    return F.lower(F.trim(name))


def camel_words(name: str | Column) -> Column:
    """CamelCase split at capitals, in words."""
    return F.split(F.regexp_replace(name, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " "), " ")


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of the row as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def short_id(value: str | Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def file_path(uri: str | Column) -> Column:
    """A file:// URI as a path; null for other schemes."""
    return F.when(F.lower(uri).startswith("file://"), F.url_decode(F.regexp_replace(uri, "(?i)^file://(localhost)?", "")))
