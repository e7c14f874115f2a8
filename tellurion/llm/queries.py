"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language, lattice, mixing, multiset, packing, pages, simhash, toxicity, urls
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.link_vectors(table(spark, sf_dir, "embeddings"))


def op2_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex64("fp").alias("fingerprint"), "component_id")


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


#: A conversation that says control strings.
PROBE = "(-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')"


def op6_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT * FROM VALUES {PROBE} AS p(conv_id, turn, role, text)")
    return chat.report(rows.unionByName(probe.select(*(F.col(f.name).cast(f.dataType) for f in rows.schema))))


def _extra(column: str) -> str:
    """SQL for the number of characters that escaping adds."""
    marks = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) / {len(c)}" for c in ("\\", *chat.CONTROL))
    return f"({marks})"


OP6_SQL = f"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES {PROBE})
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum({len(chat.OPEN) + len(chat.CLOSE) + 1} + length(role) + {_extra("role")} + length(role) - length(replace(role, chr(10), ''))
        + length(text) + {_extra("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

def op7_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


#: For pages whose article is marked as one and holds headings and paragraphs alone, as the tables' do.
OP7_SQL = r"""
WITH b AS (
    SELECT page_id, url, list_transform(
        regexp_split_to_array(coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), ''), '</?(?:p|h1)>'),
        lambda x: trim(regexp_replace(
            regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
                '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks
    FROM pages
)
SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text,
    length(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10))) AS n_chars
FROM b
"""


def op8_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op9_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("passages", F.size("passages").cast("long"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def _url_sql() -> str:
    """The judgement in SQL: rules by a chain, then the three levels of shrinkage."""
    rules = [(v, r) for v, r, *_ in urls.ranked(URL_RULES)]

    def fits(rule: str, start: bool = True) -> str:
        h, _, p = rule.partition("/")
        return f"((host = '{h}' OR host LIKE '%.{h}')" + (f" AND starts_with(path, '/{p}'))" if start else ")")

    chain = lambda n: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[n]}'" for r in rules) + " END"
    second = ", ".join(f"'{s}'" for s in urls.SECOND)

    def strength(level: str, mean: str) -> str:
        v = f"{mean} * (1 - {mean})"
        rho = f"(sum((k - n * {mean}) * (k - n * {mean})) - sum(n * {v})) / nullif(sum(n * (n - 1) * {v}), 0)"
        return f"(SELECT 1 / least({urls.MOST}, greatest({urls.LEAST}, coalesce({rho}, 0))) - 1 AS w FROM {level})"

    return f"""
WITH p AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '{urls.URL}', 1), '{urls.UPPER}', '{urls.LOWER}'), '') AS host,
        coalesce(regexp_extract(url, '{urls.URL}', 2), '') AS path FROM pages
), r AS (
    SELECT *, {chain(1)} AS rule, {chain(0)} AS says, {" OR ".join(fits(r[1], False) for r in rules)} AS reviewed FROM p
), h0 AS (
    SELECT host, sum(reviewed::INT)::DOUBLE AS n, sum((reviewed AND coalesce(says = 'block', false))::INT)::DOUBLE AS k,
        regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', '') AS bare, string_split(bare, '.') AS l FROM r GROUP BY host
), h1 AS (
    SELECT *, CASE WHEN regexp_matches(bare, '{urls.ADDRESS}') THEN len(l) WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ({second}) THEN 2 ELSE 1 END AS s FROM h0
), h2 AS (
    SELECT host, n, k, array_to_string(l[greatest(1, len(l) - s):], '.') AS domain, array_to_string(l[greatest(1, len(l) - s + 1):], '.') AS suffix FROM h1
), base AS (
    SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS m FROM h2
), s1 AS (
    SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT m FROM base) AS mean FROM h2 GROUP BY suffix
), s2 AS (
    SELECT suffix, (w * mean + k) / (w + n) AS mean FROM s1, {strength("s1", "mean")}
), d1 AS (
    SELECT domain, h2.suffix, sum(n) AS n, sum(k) AS k, any_value(mean) AS mean FROM h2 JOIN s2 USING (suffix) GROUP BY domain, h2.suffix
), d2 AS (
    SELECT domain, suffix, (w * mean + k) / (w + n) AS mean FROM d1, {strength("d1", "mean")}
), h3 AS (
    SELECT host, n, k, mean FROM h2 JOIN d2 USING (domain, suffix)
), h4 AS (
    SELECT host, w * mean + k AS a, w * (1 - mean) + n - k AS b FROM h3, {strength("h3", "mean")}
), h5 AS (
    SELECT host, a / (a + b) - {urls.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM h4
)
SELECT page_id, r.host, path, rule, coalesce(says, CASE WHEN bound > {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN h5 USING (host)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_links": op1_lattice_links,
    "op2_multiset_fingerprints": op2_multiset_fingerprints,
    "op3_simhash_anchors": op3_simhash_anchors,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_entropy_mixing": op5_entropy_mixing,
    "op6_chat_events": op6_chat_events,
    "op7_consensus_paths": op7_consensus_paths,
    "op8_byte_network": op8_byte_network,
    "op9_toxic_passages": op9_toxic_passages,
    "op10_url_reputation": op10_url_reputation,
}

ORACLE_SQL: dict[str, str] = {
    "op6_chat_events": OP6_SQL,
    "op7_consensus_paths": OP7_SQL,
    "op10_url_reputation": _url_sql(),
}
