"""Sources, scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.queries.bind import CORPUS_SQL, Registry, corpus, table
from docloom.sources import tables

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
WITH = f"WITH {CORPUS_SQL} "
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query("a20_page_links", """SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages""")
def a20(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", F.explode(tables.links(F.col("html"))).alias("link"))


@query("a22_url_predicates", r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, regexp_matches(path, '^/[a-zA-Z]{1,2}-\d+[a-zA-Z0-9]*$') AS is_detail, (host LIKE '%example.com' AND contains(path, '/en/') AND lower(path) LIKE '%.pdf') AS is_pdf FROM u""")
def a22(s, d):
    url = F.col("url")
    path = F.try_parse_url(url, F.lit("PATH"))
    return table(s, d, "pages").select("page_id", F.try_parse_url(url, F.lit("HOST")).alias("host"), path.alias("path"), T.is_form_detail_path(path).alias("is_detail"), T.is_form_pdf(url, "example.com", "/en/").alias("is_pdf"))


@query("a24_page_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def a24(s, d):
    return table(s, d, "pages").select("page_id", tables.page_text(F.col("html")).alias("text"))


@query("a16_snippet_index", WITH + "SELECT document_id, agency, substring(text, 1, 500) AS snippet FROM corpus")
def a16(s, d):
    return tables.snippet_index(corpus(s, d).select("document_id", "agency", "text"))


@query("a12_cache_misses", WITH + "SELECT document_id, sha256('v1|' || document_id) AS cache_key FROM corpus WHERE doc_id % 3 <> 0")
def a12(s, d):
    wanted = corpus(s, d).select("document_id", "doc_id", T.joined_hash(F.lit("v1"), F.col("document_id")).alias("cache_key"))
    return tables.missing_from(wanted.drop("doc_id"), wanted.where("doc_id % 3 = 0"))


@query("a03_split_filter", WITH + "SELECT document_id FROM corpus WHERE lang = 'de'")
def a03(s, d):
    return corpus(s, d).where(F.col("lang") == "de").select("document_id")


@query("b01_normalized_metadata", WITH + "SELECT filename, CAST(NULL AS STRING) AS url, lang, 'SSA' AS agency, 'raw/ssa/' || filename AS filepath FROM corpus")
def b01(s, d):
    return tables.normalize_metadata(corpus(s, d).select("filename", "lang"), "SSA", "raw/ssa", ["filename", "url", "lang"])


@query("b02_null_fill", WITH + "SELECT document_id, coalesce(form_number, '') AS form_number FROM corpus")
def b02(s, d):
    return corpus(s, d).select("document_id", "form_number").na.fill("", ["form_number"])


@query("b03_numbered", WITH + "SELECT doc_id, source, CAST(row_number() OVER (ORDER BY source, doc_id) AS STRING) AS document_id FROM corpus")
def b03(s, d):
    return tables.numbered(corpus(s, d).select("doc_id", "source"), ["source", "doc_id"])


_FORM = r"""CASE agency WHEN 'USCIS' THEN nullif(upper(regexp_extract(n, '^[a-z]+-\d+', 0)), '') WHEN 'DMV' THEN nullif(upper(regexp_extract(n, '(reg|dl|ol|adm|inf|mc)-?\d+', 0)), '') WHEN 'SSA' THEN nullif(upper(regexp_extract(n, 'ssa-\d+[a-z\-]*|ss-\d+[a-z\-]*', 0)), '')
ELSE CASE WHEN regexp_matches(n, '^[fi]') THEN CASE WHEN starts_with(upper(replace(n, '.pdf', ''))[2:], 'W') THEN replace(upper(replace(n, '.pdf', ''))[2:], 'W', 'W-') ELSE upper(replace(n, '.pdf', ''))[2:] END END END"""


@query("b04_form_numbers", WITH + f"SELECT document_id, agency, {_FORM} AS form FROM (SELECT *, lower(filename) AS n FROM corpus)")
def b04(s, d):
    return corpus(s, d).select("document_id", "agency", T.form_number(F.col("agency"), F.col("filename")).alias("form"))


@query("b08_document_types", WITH + """SELECT document_id, CASE agency WHEN 'USCIS' THEN CASE WHEN n LIKE '%instr%' THEN 'instructions' WHEN n LIKE '%sup%' THEN 'supplement' WHEN n LIKE '%checklist%' THEN 'checklist' WHEN n LIKE '%es%' THEN 'translated_form' ELSE 'form' END
WHEN 'IRS' THEN CASE WHEN n LIKE 'i%' THEN 'instructions' ELSE 'form' END WHEN 'SSA' THEN CASE WHEN n LIKE '%inst%' THEN 'instructions' WHEN n LIKE '%guide%' THEN 'guide' WHEN n LIKE '%worksheet%' THEN 'worksheet' ELSE 'form' END ELSE 'form' END AS document_type FROM (SELECT *, lower(filename) AS n FROM corpus)""")
def b08(s, d):
    return corpus(s, d).select("document_id", T.document_type(F.col("agency"), F.col("filename")).alias("document_type"))


@query("b09_keyword_exclusion", "SELECT page_id FROM pages WHERE NOT (contains(lower(url), '/fr') OR contains(lower(url), 'ref='))")
def b09(s, d):
    return table(s, d, "pages").where(~T.contains_any(F.col("url"), ["/fr", "ref="])).select("page_id")


@query("b10_prefix_frequency", WITH + "SELECT string_split(filename, '-')[1] AS prefix, count(*) AS n FROM corpus GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10")
def b10(s, d):
    return corpus(s, d).groupBy(F.split("filename", "-")[0].alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(10)


_codes3 = "|".join(t for t in T.LANGUAGE_TOKENS if len(t) == 3)
_codes2 = "|".join(t for t in T.LANGUAGE_TOKENS if len(t) == 2)


def _ending(x: str, n: int = 5) -> str:
    for _ in range(n):
        x = rf"regexp_replace({x}, '^(..+)(?:{_codes3})$|^(..+)(?:{_codes2})$', '\1\2')"
    return x


FAMILY_SQL = rf"""t0 AS (SELECT *, list_filter(string_split(regexp_replace(lower(url_decode(regexp_replace(filename, '\.[^.]*$', ''))), '[\s_]+', '-', 'g'), '-'), lambda t: t <> '') AS raw FROM corpus),
t1 AS (SELECT *, raw[1:coalesce(list_max(list_transform(raw, lambda t, i: CASE WHEN list_contains({_LIST(T.NOISE_TOKENS)}, t) THEN 0 ELSE i END)), 0)] AS toks FROM t0),
t2 AS (SELECT *, list_filter(list_transform(range(2, len(toks) + 1), lambda i: CASE WHEN regexp_matches(toks[i - 1], '^[a-z]{{1,6}}$') AND regexp_matches(toks[i], '^[0-9]') THEN toks[i - 1] || toks[i] END), lambda x: x IS NOT NULL) AS pairs, {_ending("array_to_string(toks, '')")} AS joined FROM t1),
t3 AS (SELECT *, CASE WHEN len(toks) = 0 THEN NULL WHEN len(pairs) > 0 THEN pairs[-1] WHEN regexp_matches(joined, '[0-9]') THEN CASE WHEN length(joined) > 2 AND regexp_matches(joined, '^[fi]\p{{L}}') THEN joined[2:] ELSE joined END END AS code0 FROM t2),
t4 AS (SELECT *, regexp_replace(upper(code0), '[^A-Z0-9]', '', 'g') AS named, nullif(regexp_replace(upper(CASE WHEN lower(form_number) NOT IN ('nan', '') THEN form_number END), '[^A-Z0-9]', '', 'g'), '') AS given FROM t3),
families AS (SELECT *, CASE WHEN given IS NOT NULL THEN agency || ':' || given WHEN named IS NOT NULL THEN agency || ':' || named ELSE 'SINGLETON:' || agency || ':' || document_id END AS family_id, CASE WHEN given IS NOT NULL THEN 'form_number_exact' WHEN named IS NOT NULL THEN 'filename_code_match' ELSE 'singleton_no_evidence' END AS evidence_type FROM t4)"""


@query("b15_filename_codes", f"WITH {CORPUS_SQL}, {FAMILY_SQL} SELECT document_id, filename, named AS code FROM families")
def b15(s, d):
    return corpus(s, d).select("document_id", "filename", T.filename_code(F.col("filename")).alias("code"))


@query("b17_alphabetic_ratio", WITH + r"SELECT document_id, round(coalesce(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / nullif(length(regexp_replace(text, '\s', '', 'g')), 0), 0), 6) AS ratio FROM corpus")
def b17(s, d):
    return corpus(s, d).select("document_id", F.round(T.alphabetic_ratio(F.col("text")), 6).alias("ratio"))


@query("b18_text_windows", WITH + "SELECT document_id, CAST(i AS INT) AS part, sha256(substring(text, CAST(i * (length(text) // 3) + 1 AS BIGINT), CASE WHEN i = 2 THEN length(text) ELSE length(text) // 3 END)) AS digest FROM corpus, range(3) AS t(i)")
def b18(s, d):
    return corpus(s, d).select("document_id", F.posexplode(T.windows(F.col("text"), 3)).alias("part", "w")).select("document_id", "part", T.sha256(F.col("w")).alias("digest"))


_SQUEEZED = r"regexp_replace(regexp_replace(lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g')"
HASHED_SQL = f"hashed AS (SELECT *, sha256({_SQUEEZED}) AS text_hash FROM corpus)"


@query("b24_normalized_hash", f"WITH {CORPUS_SQL}, {HASHED_SQL} SELECT document_id, sha256(text) AS plain, text_hash FROM hashed")
def b24(s, d):
    return corpus(s, d).select("document_id", T.sha256(F.col("text")).alias("plain"), T.normalized_text_hash(F.col("text")).alias("text_hash"))


@query("b25_llm_inputs", WITH + """SELECT document_id, length(text) > 6000 AS truncated, sha256(substring(text, 1, 6000)) AS digest, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS tokens,
round(greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) / 1e6 * 0.10 + 10 / 1e6 * 0.40, 9) AS cost FROM corpus""")
def b25(s, d):
    text, cut = T.truncated(F.col("text"))
    n = T.estimated_tokens(F.col("text"))
    return corpus(s, d).select("document_id", cut.alias("truncated"), T.sha256(text).alias("digest"), n.alias("tokens"), F.round(T.cost(n, F.lit(10)), 9).alias("cost"))


@query("b28_keys", WITH + "SELECT document_id, sha256(concat_ws('|', 'llm', 'model', document_id, 'complete_unmasked', coalesce(form_number, 'nan'))) AS cache_key, sha256('v1|' || document_id || '|0|0|510') AS chunk_id FROM corpus")
def b28(s, d):
    doc = F.col("document_id")
    return corpus(s, d).select("document_id", T.joined_hash(F.lit("llm"), F.lit("model"), doc, F.lit("complete_unmasked"), F.col("form_number")).alias("cache_key"), T.joined_hash(F.lit("v1"), doc, F.lit(0), F.lit(0), F.lit(510)).alias("chunk_id"))


@query("b31_rendered_prompts", WITH + "SELECT document_id, sha256(replace(replace('Agency {agency}: {document} / {agency}', '{agency}', agency), '{document}', text)) AS digest FROM corpus")
def b31(s, d):
    return corpus(s, d).select("document_id", T.sha256(T.render("Agency {agency}: {document} / {agency}", {"agency": F.col("agency"), "document": F.col("text")})).alias("digest"))


@query("b32_context", "SELECT conv_id AS query_id, string_agg('[' || (turn + 1) || '] ' || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1")
def b32(s, d):
    from docloom.plans.cases import context_text

    return context_text(table(s, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("new_place"), "text"))


@query("b35_size_buckets", WITH + "SELECT CASE WHEN k <= 1 THEN '1' WHEN k <= 5 THEN '2-5' WHEN k <= 20 THEN '6-20' ELSE '21+' END AS bucket, count(*) AS n FROM (SELECT CAST(ceil(n_chars / 1000) AS BIGINT) AS k FROM corpus) GROUP BY 1")
def b35(s, d):
    return corpus(s, d).groupBy(T.size_bucket(F.ceil(F.col("n_chars") / 1000)).alias("bucket")).agg(F.count("*").alias("n"))


@query("b36_json_counts", WITH + "SELECT k, CAST(sum(v) AS BIGINT) AS total FROM (SELECT unnest(['a', 'b']) AS k, unnest([doc_id % 3, doc_id % 5]) AS v FROM corpus) GROUP BY k")
def b36(s, d):
    spelt = corpus(s, d).select(F.to_json(F.create_map(F.lit("a"), F.col("doc_id") % 3, F.lit("b"), F.col("doc_id") % 5)).alias("counts"))
    return spelt.select(F.explode(F.from_json("counts", "map<string,int>")).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("total"))


@query("b37_retryable", WITH + "SELECT document_id, (m LIKE '%timeout%' OR m LIKE '%429%' OR m LIKE '%500%' OR m LIKE '%503%') AS retryable FROM (SELECT document_id, CASE doc_id % 4 WHEN 0 THEN 'read timeout' WHEN 1 THEN 'http ' || (400 + doc_id % 110) ELSE 'bad key' END AS m FROM corpus)")
def b37(s, d):
    message = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Read TIMEOUT' WHEN 1 THEN 'HTTP ' || (400 + doc_id % 110) ELSE 'bad key' END")
    return corpus(s, d).select("document_id", T.is_retryable(message).alias("retryable"))


@query("b39_cue_presence", WITH + "SELECT document_id, (contains(lower(text), 'tion') OR contains(lower(text), 'wh')) AS cue FROM corpus")
def b39(s, d):
    return corpus(s, d).select("document_id", T.contains_any(F.col("text"), ["tion", "wh"]).alias("cue"))


@query("b40_softmax_argmax", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), e AS (SELECT vec_id, a, list_transform(a, lambda x: exp(x - list_max(a))) AS s FROM v)
SELECT vec_id, CAST(list_position(a, list_max(a)) - 1 AS INT) AS best, round(1.0 / list_sum(s), 6) AS top_probability FROM e""")
def b40(s, d):
    a = F.col("embedding").cast("array<double>")
    return table(s, d, "embeddings").select("vec_id", T.argmax(a).alias("best"), F.round(F.array_max(T.softmax(a)), 6).alias("top_probability"))


@query("b42_duplication", r"SELECT doc_id, round(1.0 - len(list_distinct(w)) / len(w), 6) AS ratio FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def b42(s, d):
    return table(s, d, "documents").select("doc_id", F.round(T.duplication_ratio(F.split("text", " ")), 6).alias("ratio"))


@query("b43_top_share", WITH + "SELECT source, round(max(n) / sum(n), 6) AS share FROM (SELECT source, lang, count(*) AS n FROM corpus GROUP BY ALL) GROUP BY source")
def b43(s, d):
    return corpus(s, d).groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("e30_embedding_norms", "SELECT count(*) AS vectors, round(avg(n), 6) AS mean_norm, round(min(n), 6) AS least, round(max(n), 6) AS most FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)")
def e30(s, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return table(s, d, "embeddings").agg(F.count("*").alias("vectors"), F.round(F.avg(norm), 6).alias("mean_norm"), F.round(F.min(norm), 6).alias("least"), F.round(F.max(norm), 6).alias("most"))


@query("e31_truncation_effect", WITH + "SELECT length(text) > 6000 AS truncated, count(*) AS n, round(avg(length(text)), 6) AS mean_length FROM corpus GROUP BY 1")
def e31(s, d):
    return corpus(s, d).groupBy((F.length("text") > 6000).alias("truncated")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))


@query("i01_union_distinct", WITH + "SELECT filename FROM corpus WHERE doc_id % 2 = 0 UNION SELECT filename FROM corpus WHERE doc_id % 3 = 0")
def i01(s, d):
    c = corpus(s, d).select("filename", "doc_id")
    return c.where("doc_id % 2 = 0").unionByName(c.where("doc_id % 3 = 0")).select("filename").dropDuplicates()


@query("i03_intersect_except", WITH + "SELECT 'both' AS kind, count(*) AS n FROM (SELECT filename FROM corpus WHERE lang = 'en' INTERSECT SELECT filename FROM corpus WHERE lang = 'fr') UNION ALL SELECT 'first', count(*) FROM (SELECT filename FROM corpus WHERE lang = 'en' EXCEPT SELECT filename FROM corpus WHERE lang = 'fr')")
def i03(s, d):
    c = corpus(s, d)
    a, b = c.where("lang = 'en'").select("filename"), c.where("lang = 'fr'").select("filename")
    count = lambda name, x: x.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return count("both", a.intersect(b)).unionByName(count("first", a.subtract(b)))
