"""Text, code, hash and cost expressions. All run inside the engine; none is a Python UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which documents count as one family.
LANGUAGE_TOKENS = ["sp", "es", "fr", "vi", "ru", "so", "tur", "hc", "ch", "pt", "psh", "ar", "dar", "km", "th", "sw", "ht", "ja", "hi", "ko", "tl", "uk", "pl", "el", "hy", "fa", "zh", "kr", "spanish", "chinese", "vietnamese", "russian", "somali", "turkish", "thai", "portuguese", "arabic", "dari", "khmer", "swahili", "haitian", "korean", "tagalog", "creole", "farsi", "armenian", "greek", "polish", "ukrainian"]
# Document kinds and revisions, no part of a form's code.
KIND_TOKENS = ["instr", "instruction", "instructions", "ws", "worksheet", "sup", "supa", "supb", "supc", "sup1", "sup2", "sup3", "supplement", "checklist", "form", "rev", "revised", "translated", "watermark", "pdf"]
NOISE_TOKENS = [*KIND_TOKENS, *LANGUAGE_TOKENS]
#: Rates in dollars a million tokens: input, output, embedding.
RATES = {"input": 0.10, "output": 0.40, "embedding": 0.15}
RETRYABLE = ["timeout", "rate limit", "429", "500", "503", "deadline exceeded", "connection", "unavailable"]
NO_PREDICTION = "__NO_PREDICTION__"


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalized_code(x: Column) -> Column:
    return F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")


def stem_tokens(filename: Column) -> Column:
    """Parts of a file name without its last extension, URL-decoded."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))), stem)
    return F.filter(F.split(F.regexp_replace(F.lower(decoded), r"[\s_]+", "-"), "-"), lambda t: t != "")


def without_trailing(tokens: Column, noise: list[str]) -> Column:
    """tokens up to the last that is no noise."""
    last = F.array_max(F.transform(tokens, lambda t, i: F.when(t.isin(noise), F.lit(0)).otherwise(i + 1)))
    return F.slice(tokens, F.lit(1), F.coalesce(last, F.lit(0)))


def without_language_ending(x: Column) -> Column:
    """x without short language codes at its end, longest first, one after the other; two characters stay at least."""
    codes = sorted((t for t in LANGUAGE_TOKENS if len(t) <= 3), key=len, reverse=True)
    # backwards, endings are beginnings, which one pattern takes off without going back on its choices
    backwards = "|".join(f"{t[::-1]}(?=..)" for t in codes)
    return F.reverse(F.regexp_replace(F.reverse(x), f"^(?:{backwards})*+", ""))


def filename_code(filename: Column) -> Column:
    """The form code that a file name ends with; null without good evidence."""
    tokens = without_trailing(stem_tokens(filename), NOISE_TOKENS)
    # neighbours (letters, digits...) from the right
    pairs = F.filter(F.transform(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t, i: F.when(F.get(tokens, i).rlike("^[a-z]{1,6}$") & t.rlike("^[0-9]"), F.concat(F.get(tokens, i), t))), lambda p: p.isNotNull())
    joined = without_language_ending(F.array_join(tokens, ""))
    bare = F.when((F.length(joined) > 2) & joined.rlike(r"^[fi]\p{L}"), F.substring(joined, 2, 1_000_000)).otherwise(joined)
    return F.when(F.size(tokens) == 0, F.lit(None)).when(F.size(pairs) > 0, normalized_code(F.element_at(pairs, F.when(F.size(pairs) > 0, F.size(pairs)).otherwise(1)))).when(joined.rlike("[0-9]"), normalized_code(bare))


def form_number(agency: Column, filename: Column) -> Column:
    """The form number that each agency writes into its file names."""
    name = F.lower(filename)
    some = lambda pattern: F.nullif(F.upper(F.regexp_extract(name, pattern, 0)), F.lit(""))
    bare = F.upper(F.substring(F.replace(name, F.lit(".pdf"), F.lit("")), 2, 1_000_000))
    irs = F.when(name.rlike("^[fi]"), F.when(bare.startswith("W"), F.replace(bare, F.lit("W"), F.lit("W-"))).otherwise(bare))
    return F.when(agency == "USCIS", some(r"^[a-z]+-\d+")).when(agency == "DMV", some(r"(reg|dl|ol|adm|inf|mc)-?\d+")).when(agency == "SSA", some(r"ssa-\d+[a-z\-]*|ss-\d+[a-z\-]*")).when(agency == "IRS", irs)


#: Per agency: (pattern in the lower-case name, kind), the first that matches; otherwise a form.
KINDS = {
    "USCIS": [("instr", "instructions"), ("sup", "supplement"), ("checklist", "checklist"), ("es", "translated_form")],
    "IRS": [("^i", "instructions")],
    "SSA": [("inst", "instructions"), ("guide", "guide"), ("worksheet", "worksheet")],
}


def document_type(agency: Column, filename: Column) -> Column:
    out = F.lit("form")
    for name, rules in KINDS.items():
        for pattern, kind in reversed(rules):
            out = F.when((agency == name) & F.lower(filename).rlike(pattern), kind).otherwise(out)
    return out


def contains_any(x: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lit(w)) for w in words])


def is_retryable(message: Column) -> Column:
    return contains_any(message, RETRYABLE)


def is_form_detail_path(path: Column) -> Column:
    return path.rlike(r"^/[a-zA-Z]{1,2}-\d+[a-zA-Z0-9]*$")


def is_form_pdf(url: Column, host: str, folder: str) -> Column:
    return F.try_parse_url(url, F.lit("HOST")).endswith(host) & F.contains(F.try_parse_url(url, F.lit("PATH")), F.lit(folder)) & F.lower(F.try_parse_url(url, F.lit("PATH"))).endswith(".pdf")


def alphabetic_ratio(x: Column) -> Column:
    """Letters among the characters that are no white space; 0 without any."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(x, r"[^\p{L}]", "")), F.length(F.regexp_replace(x, r"\s", ""))), F.lit(0.0))


def windows(x: Column, n: int) -> Column:
    """n windows of equal width; the last takes the rest."""
    width = F.floor(F.length(x) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(x, i * width + 1, F.when(i == n - 1, F.length(x)).otherwise(width)))


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def normalized_text_hash(x: Column) -> Column:
    """White space is squeezed before punctuation goes, so 'a - b' and 'a b' differ."""
    squeezed = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")), r"\s+", " ")
    return sha256(F.regexp_replace(squeezed, r"[^\p{L}\p{N}_\s]", ""))


def truncated(x: Column, limit: int = 6000) -> tuple[Column, Column]:
    return F.substring(x, 1, limit), F.length(x) > limit


def estimated_tokens(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4)).cast("long")


def cost(prompt: Column, completion: Column) -> Column:
    return prompt / 1e6 * RATES["input"] + completion / 1e6 * RATES["output"]


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by bars; a null part is the word nan, never dropped."""
    return sha256(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("nan")) for p in parts)))


def render(template: str, values: dict[str, Column]) -> Column:
    """Placeholders replaced one after the other; later ones see the values of earlier ones."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def words_for_counts(x: Column, stop: list[str]) -> Column:
    """Lower-case words of more than two letters a-z that are no stop words; repeats stay."""
    return F.filter(F.split(F.regexp_replace(F.lower(x), r"[^a-z\s]", " "), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(stop))


def size_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise("21+")


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax(a: Column) -> Column:
    """From 0; the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def duplication_ratio(a: Column) -> Column:
    return F.lit(1.0) - F.size(F.array_distinct(a)) / F.size(a)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
