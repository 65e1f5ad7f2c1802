"""Token windows, partial selections, masking and the registry of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.vocabulary import cut, has_tokens

POLICY = "v1"
#: What registry() takes of chunks.
REGISTERED = ["document_id", "chunk_index", "total_chunks", "chunk_id", "chunk_text"]
#: (condition, region, masked)
CONDITIONS = [(f"{r}_{m}", r.removesuffix("_only"), m == "masked") for m in ("unmasked", "masked") for r in ("complete", "beginning_only", "middle_only", "end_only", "beginning_middle_end")]
# Phrases that name an agency.
AGENCY_PHRASES = {
    "USCIS": ["United States Citizenship and Immigration Services", "U.S. Citizenship and Immigration Services", "Citizenship and Immigration Services", "Department of Homeland Security", "USCIS", "DHS"],
    "DMV": ["Department of Motor Vehicles", "Division of Motor Vehicles", "DMV"],
    "SSA": ["Social Security Administration", "SSA"],
    "IRS": ["Internal Revenue Service", "Department of the Treasury", "IRS"],
}
# Patterns of what identifies an agency.
#: (rule, pattern, replacement), applied in this order: a rule would spoil what an earlier one needs whole.
MASKS = [
    ("agency_url", r"(?i)\b(?:https?://)?(?:www\.)?[\w-]+(?:\.[\w-]+)*\.gov(?:/[\w\-./?%&=]*)?", "[AGENCY_URL]"),
    ("form_number", r"(?i)\b(Form)\s+[a-z]{1,5}-?\d{1,5}[a-z]{0,3}\b", "$1 [FORM_NUMBER]"),
    *((f"agency_identifier:{a}", r"(?i)\b(?:" + "|".join(p.replace(".", r"\.") for p in phrases) + r")\b", "[AGENCY_NAME]") for a, phrases in AGENCY_PHRASES.items()),
    ("omb_number", r"(?i)\bOMB\s*(?:No\.?|Number|#)?\s*\d{4}-\d{4}\b", "[OMB_NUMBER]"),
]


def window_ranges(total: Column, window: int, step: int) -> Column:
    """array<struct<chunk_index, token_start, token_end>>: windows step apart, the last snapped back to end with the text."""
    if step <= 0:
        raise ValueError("step must be positive")
    n = F.when(total <= 0, 0).when(total <= window, 1).otherwise(1 + F.ceil((total - window) / step)).cast("int")
    start = lambda i: F.when((i == n - 1) & (total > window), total - window).otherwise(i * step).cast("int")
    ranges = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(i.alias("chunk_index"), start(i).alias("token_start"), F.least(start(i) + window, total).cast("int").alias("token_end")))
    return F.slice(ranges, F.lit(1), n)


def chunk(docs: DataFrame, window: int = 510, overlap: int = 128, vocabulary: str | None = None, ends_only: bool = False, columns: list[str] | None = None) -> DataFrame:
    """A row per window of a vocabulary's tokens with its provenance; its text is cut from the document's. Documents without tokens have none. ends_only: the first, the middle and the last window, which are all that selections take. columns: only these, and what they do not need is not made."""
    wanted = lambda *names: columns is None or any(n in columns for n in names)
    made = tuple(n for n, used in (("chunk_text", wanted("chunk_text", "chunk_text_hash")), ("chunk_ids", wanted("chunk_ids"))) if used)
    if columns is not None:
        docs = docs.select(*(c for c in docs.columns if c in columns or c in ("document_id", "text")))
    if wanted("parent_text_hash"):
        # once a document, before its chunks
        docs = docs.withColumn("parent_text_hash", T.sha256(F.coalesce("text", F.lit(""))))
    out = cut(docs, window, overlap, vocabulary, ends_only=ends_only, columns=made)
    added = {
        "content_token_count": F.col("token_end") - F.col("token_start"),
        "chunk_text_hash": T.sha256(F.col("chunk_text")),
        "chunk_id": T.joined_hash(F.lit(POLICY), F.col("document_id"), F.col("chunk_index"), F.col("token_start"), F.col("token_end")),
    }
    out = out.withColumns({n: c for n, c in added.items() if wanted(n)})
    return out if columns is None else out.select(*columns)


def model_inputs(ids: Column, width: int = 512, first: int = 101, last: int = 102, pad: int = 0) -> tuple[Column, Column]:
    """Token ids between the marks of a sequence, cut and padded to width; and the mask of what is no padding."""
    whole = F.slice(F.concat(F.array(F.lit(first)), ids, F.array(F.lit(last))), 1, width)
    rest = lambda x: F.array_repeat(F.lit(x), F.lit(width) - F.size(whole))
    return F.concat(whole, rest(pad)), F.concat(F.transform(whole, lambda _: F.lit(1)), rest(0))


def chunk_split(docs: DataFrame, window: int = 510, overlap: int = 128, vocabulary: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """chunk, with its query failing on a document without tokens: in a saved split each document has text."""
    some = F.when(has_tokens(), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no chunks: "), F.col("document_id"))).cast("string"))
    return chunk(docs.withColumn("text", some), window, overlap, vocabulary, columns=columns)


def sampled_windows(total: Column, window: int, overlap: int, most: int) -> Column:
    """Up to most of the windows at the beginning, the middle (starting overlap before half) and the end, without repeats."""
    at = lambda s: F.struct(F.greatest(s, F.lit(0)).cast("int").alias("token_start"), F.least(F.greatest(s, F.lit(0)) + window, total).cast("int").alias("token_end"))
    three = F.array_distinct(F.array(at(F.lit(0)), at(F.floor(total / 2).cast("int") - overlap), at(total - window)))
    return F.when(total <= 0, F.slice(three, 1, 0)).otherwise(F.slice(three, 1, most))


def mask(x: Column) -> tuple[Column, dict[str, Column]]:
    """The masked text, and how often each rule matched what the rules before it had left."""
    counts: dict[str, Column] = {}
    for name, pattern, replacement in MASKS:
        counts[name] = F.regexp_count(x, F.lit(pattern)).cast("long")
        x = F.regexp_replace(x, pattern, replacement)
    return x, counts


def masked(df: DataFrame, column: str) -> DataFrame:
    """masked_text, its hash, rule_match_counts and total_replacements, a projection for each rule, so that no rule's text is computed twice."""
    out = df.withColumn("masked_text", F.coalesce(F.col(column), F.lit("")))
    names = []
    for i, (name, pattern, replacement) in enumerate(MASKS):
        out = out.withColumn(f"n{i}", F.regexp_count("masked_text", F.lit(pattern)).cast("long")).withColumn("masked_text", F.regexp_replace("masked_text", pattern, replacement))
        names += [F.lit(name), F.col(f"n{i}")]
    total = sum((F.col(f"n{i}") for i in range(1, len(MASKS))), F.col("n0"))
    out = out.withColumns({"rule_match_counts": F.create_map(*names), "total_replacements": total, "original_text_hash": T.sha256(F.coalesce(F.col(column), F.lit(""))), "masked_text_hash": T.sha256(F.col("masked_text"))})
    return out.drop(*(f"n{i}" for i in range(len(MASKS))))


def selections(docs: DataFrame) -> DataFrame:
    """For each document (document_id, total_chunks) and partial condition the chunks it takes. A region that falls together with another is named in fallback."""
    n = F.col("total_chunks")
    middle = F.floor(n / 2).cast("int")
    pick = lambda name, *at: F.struct(F.lit(name).alias("condition"), F.array_distinct(F.array(*at)).alias("selected"), F.lit(len(at)).alias("requested"))
    zero, last = F.lit(0), (n - 1).cast("int")
    rows = docs.where(n > 0).select("document_id", "total_chunks", F.inline(F.array(pick("beginning_only", zero), pick("middle_only", middle), pick("end_only", last), pick("beginning_middle_end", zero, middle, last))))
    spelt = F.array_join(F.transform("selected", lambda i: i.cast("string")), ",")
    return rows.withColumn("fallback", F.size("selected") < F.col("requested")).withColumn("selection_hash", T.joined_hash(F.lit(POLICY), F.col("document_id"), F.col("condition"), spelt)).drop("requested")


def resolve(selected: DataFrame, chunks: DataFrame, text: str) -> DataFrame:
    """The selected chunks' texts joined by blank lines, in the order of selection."""
    rows = selected.select("document_id", "condition", F.posexplode("selected").alias("place", "chunk_index")).join(chunks.select("document_id", "chunk_index", "chunk_id", F.col(text).alias("piece")), ["document_id", "chunk_index"])
    listed = F.array_sort(F.collect_list(F.struct("place", "piece", "chunk_id")))
    return rows.groupBy("document_id", "condition").agg(listed.alias("pieces")).select("document_id", "condition", F.array_join(F.transform("pieces", lambda p: p["piece"]), "\n\n").alias("text"), F.array_join(F.transform("pieces", lambda p: p["chunk_id"]), ",").alias("source_chunk_ids"))


def registry(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """The ten conditions of each document: its whole text or selected chunks, plain or masked.

    Whether a selection takes a chunk follows from the chunk's index and its document's total, so selections need no join; only chosen chunks are masked."""
    whole = masked(docs.select("document_id", "text"), "text")
    kinds = lambda name, plain, hidden, ids: F.inline(F.array(*(F.struct(F.lit(f"{name}_{k}").alias("condition"), t.alias("text"), ids.alias("source_chunk_ids")) for k, t in (("unmasked", plain), ("masked", hidden)))))
    complete = whole.select("document_id", kinds("complete", F.coalesce("text", F.lit("")), F.col("masked_text"), F.lit("")))
    i, n = F.col("chunk_index"), F.col("total_chunks")
    regions = {"beginning_only": i == 0, "middle_only": i == F.floor(n / 2), "end_only": i == n - 1}
    regions["beginning_middle_end"] = regions["beginning_only"] | regions["middle_only"] | regions["end_only"]
    chosen = chunks.select("document_id", "chunk_index", "total_chunks", "chunk_id", "chunk_text").where(regions["beginning_middle_end"])
    hidden = masked(chosen, "chunk_text").select("document_id", "chunk_index", "chunk_id", "chunk_text", "masked_text", F.explode(F.array_compact(F.array(*(F.when(x, F.lit(r)) for r, x in regions.items())))).alias("region"))
    pieces = hidden.groupBy("document_id", "region").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "chunk_text", "masked_text"))).alias("p"))
    joined = lambda c, mark: F.array_join(F.transform("p", lambda x: x[c]), mark)
    texts = pieces.select("document_id", "region", joined("chunk_text", "\n\n").alias("plain"), joined("masked_text", "\n\n").alias("hidden"), joined("chunk_id", ",").alias("ids"))
    two = F.inline(F.array(*(F.struct(F.concat("region", F.lit(f"_{k}")).alias("condition"), F.col(t).alias("text"), F.col("ids").alias("source_chunk_ids")) for k, t in (("unmasked", "plain"), ("masked", "hidden")))))
    out = complete.unionByName(texts.select("document_id", two))
    return out.withColumns({"masked": ~F.col("condition").endswith("_unmasked"), "text_fingerprint": T.sha256(F.col("text")), "policy_version": F.lit(POLICY)})
