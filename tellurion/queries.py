"""Queries over whole tables, one or more for each operator, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.entropy import shannon_entropy
from .functions.tokens import is_kept_jwt
from .operators import curate, evaluate, hits, intervals, redact
from .operators.scan import count_hits, scan, scan_native, scan_udf
from .operators.views import CUSTOM, EVERY, LOUD, SHAPED, planted, planted_sql, table
from .plans import rules as rule_sets
from .plans.dialect import to_re2
from .plans.rules import Rule, rules_frame
from .sources import dispatch
from .streaming.hits import hourly_hits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
EMAIL, IPV4, PHONE, CARD = (next(r for r in CUSTOM if r.rule_id == n) for n in ("email", "ipv4", "phone", "card"))
GITHUB = next(r for r in rule_sets.curated() if r.rule_id == "github_pat_classic")
PROPS = [Rule("props_k", r'"k": (\d+)', 1)]


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query under its function's name, with its SQL if it has any."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- SQL that several queries share --------------------------------------------------------------------------------

ENTROPY = """(CASE WHEN length({m}) = 0 THEN 0.0 ELSE abs(list_sum(list_transform(list_distinct(string_split({m}, '')),
    lambda c: ((length({m}) - length(replace({m}, c, ''))) / length({m})) * log2((length({m}) - length(replace({m}, c, ''))) / length({m}))))) END)"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits_sql(source: str, keys: str, text: str, rules: list[Rule]) -> str:
    """(keys, ord, rule_id, offset, len, match) of the rules' hits in a text column, byte for byte.

    The matches are put between marks, the text is split at them, and what comes before is measured. A pattern with a
    group has nothing before the group but what the mark is put after.
    """
    parts = []
    for k, r in enumerate(rules):
        pattern = to_re2(r.pattern)
        if r.capture_index:  # what stands around the group is kept outside of the marks
            before, inner = pattern.split("(", 1) if not pattern.startswith("(?") else _around(pattern)
            inner, after = inner.rsplit(")", 1)
            pattern, mark = f"({before})({inner})({after})", r"'\1' || chr(1) || '\2' || chr(2) || '\3'"
        else:
            pattern, mark = f"({pattern})", r"chr(1) || '\1' || chr(2)"
        floor = f"WHERE {ENTROPY.format(m='match')} >= {r.min_entropy}" if r.min_entropy else ""
        parts.append(f"""
SELECT {keys}, {k} AS ord, {_quote(r.rule_id)} AS rule_id, "offset", strlen(match) AS len, match FROM (
    SELECT {keys}, (strlen(array_to_string(p[:i - 1], '')) - (i - 2))::BIGINT AS "offset", string_split(p[i], chr(2))[1] AS match FROM (
        SELECT {keys}, p, unnest(range(2, len(p) + 1)) AS i FROM (
            SELECT {keys}, string_split(regexp_replace({text}, {_quote(pattern)}, {mark}, 'g'), chr(1)) AS p FROM {source} WHERE {text} IS NOT NULL))) {floor}""")
    return "(" + " UNION ALL ".join(parts) + ")"


def _around(pattern: str) -> tuple[str, str]:
    """The pattern before its only capture group, and from there on."""
    at = pattern.index("([")
    return pattern[:at], pattern[at + 1 :]


CURATED = [r for r in rule_sets.default_rules() if not r.filter]
DOC_HITS = hits_sql("documents", "doc_id", "text", CUSTOM)
PLANTED = planted_sql("documents", "doc_id")
PLANTED_HITS = hits_sql(PLANTED, "doc_id", "text", [GITHUB])


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(_documents(spark, sf_dir), "doc_id")


def _doc_hits(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return scan(_documents(spark, sf_dir), "text", CUSTOM, ["doc_id", *more])


# ---- scans ---------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, rule_id, \"offset\", len, md5(match) AS digest FROM {DOC_HITS}")
def scan_custom_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of a custom rule set, with byte offsets; one rule has a capture group and an entropy floor."""
    return _doc_hits(spark, sf_dir).select("doc_id", "rule_id", "offset", "len", F.md5("match").alias("digest"))


@query(f"SELECT doc_id, \"offset\", len, match FROM {hits_sql('documents', 'doc_id', 'text', [EMAIL])}")
def scan_whole_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one rule, from built-in functions alone."""
    return scan_native(_documents(spark, sf_dir), "text", [EMAIL], ["doc_id"]).select("doc_id", "offset", "len", "match")


@query(f"SELECT doc_id, rule_id, \"offset\", len, match FROM {hits_sql(PLANTED, 'doc_id', 'text', CURATED)}")
def scan_planted_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated rules and the JWT detector over documents with planted tokens."""
    return scan(_planted(spark, sf_dir), "text", rule_sets.default_rules(), ["doc_id"]).select("doc_id", "rule_id", "offset", "len", "match")


@query(f"SELECT page_id, rule_id, \"offset\", len, match FROM {hits_sql('pages', 'page_id', 'html', CUSTOM)}")
def scan_pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "pages"), "html", CUSTOM, ["page_id"]).select("page_id", "rule_id", "offset", "len", "match")


CONVERSATIONS = planted_sql("conversations", "conv_id")


@query(f"SELECT conv_id, turn, \"offset\", len, match FROM {hits_sql(CONVERSATIONS, 'conv_id, turn', 'text', [GITHUB])}")
def scan_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(table(spark, sf_dir, "conversations"), "conv_id")
    return scan(rows, "text", [GITHUB], ["conv_id", "turn"]).select("conv_id", "turn", "offset", "len", "match")


@query(f"SELECT event_id, \"offset\", len, match FROM {hits_sql('events', 'event_id', 'props', PROPS)}")
def scan_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "events"), "props", PROPS, ["event_id"]).select("event_id", "offset", "len", "match")


@query(f"SELECT source, rule_id, count(*) AS n, sum(len)::BIGINT AS bytes FROM {hits_sql('documents', 'source', 'text', [EMAIL, IPV4, PHONE, CARD])} GROUP BY ALL")
def pii_email_ipv4_phone_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_hits(_documents(spark, sf_dir), "text", [EMAIL, IPV4, PHONE, CARD], ["source"])


@query(f"""SELECT d.doc_id, coalesce(h.n, 0)::INT AS n, coalesce(h.s, 0)::BIGINT AS bytes FROM documents d LEFT JOIN
    (SELECT doc_id, count(*) AS n, sum(len) AS s FROM {DOC_HITS} GROUP BY doc_id) h USING (doc_id)""")
def hits_beside_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits as an array beside each row: no join."""
    rows = _documents(spark, sf_dir).select("doc_id", scan_udf(CUSTOM)("text").alias("h"))
    return rows.select("doc_id", F.coalesce(F.size("h"), F.lit(0)).alias("n"), F.coalesce(F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + x["len"]), F.lit(0)).alias("bytes"))


# ---- aggregates, joins and windows over hits -----------------------------------------------------------------------


@query(f"SELECT rule_id, count(*) AS n, sum(len)::BIGINT AS bytes FROM {DOC_HITS} GROUP BY rule_id")
def hits_per_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_hits(_documents(spark, sf_dir), "text", CUSTOM)


@query(f"SELECT d.source, d.lang, rule_id, count(*) AS n FROM {DOC_HITS} h JOIN documents d USING (doc_id) GROUP BY ALL")
def hits_per_source_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source and lang travel with the scan, so nothing is joined."""
    return _doc_hits(spark, sf_dir, "source", "lang").groupBy("source", "lang", "rule_id").agg(F.count("*").alias("n"))


@query(f"SELECT source, count(*) AS clean FROM documents d WHERE NOT EXISTS (SELECT 1 FROM {DOC_HITS} h WHERE h.doc_id = d.doc_id) GROUP BY source")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source")
    return docs.join(_doc_hits(spark, sf_dir).select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("clean"))


@query(f"SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM {DOC_HITS} h WHERE h.doc_id = d.doc_id)")
def dirty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source")
    return docs.join(_doc_hits(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")


@query(f"""WITH h AS {DOC_HITS}, c AS (SELECT rule_id, count(*) AS n FROM h GROUP BY rule_id)
SELECT rule_id, sample, doc_id, "offset", len, shown, greatest(n - 3, 0) AS more FROM (
    SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY doc_id, "offset", len)::INT AS sample, match AS shown FROM h) JOIN c USING (rule_id) WHERE sample <= 3""")
def rule_samples_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.samples(_doc_hits(spark, sf_dir), 3, "doc_id")


@query(f"""SELECT rule_id, n, bytes, row_number() OVER (ORDER BY n DESC, rule_id)::INT AS rank FROM
    (SELECT rule_id, count(*) AS n, sum(len)::BIGINT AS bytes FROM {DOC_HITS} GROUP BY rule_id)""")
def rules_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.ranked(hits.per_rule(_doc_hits(spark, sf_dir)))


@query(f"""SELECT rule_id, n, bytes, row_number() OVER (ORDER BY bytes DESC, n DESC, rule_id)::INT AS rank FROM
    (SELECT rule_id, count(*) AS n, sum(len)::BIGINT AS bytes FROM {DOC_HITS} GROUP BY rule_id)""")
def rules_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.ranked(hits.per_rule(_doc_hits(spark, sf_dir)), by_bytes=True)


@query(f"SELECT doc_id, \"offset\", round({ENTROPY.format(m='match')}, 6) AS entropy FROM {PLANTED_HITS}")
def entropy_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_planted(spark, sf_dir), "text", [GITHUB], ["doc_id"])
    return found.select("doc_id", "offset", F.round(shannon_entropy("match"), 6).alias("entropy"))


@query(f"SELECT rule_id, count(*) AS n, sum(len)::BIGINT AS bytes FROM {DOC_HITS} WHERE round({ENTROPY.format(m='match')}, 6) >= 3.25 GROUP BY rule_id")
def entropy_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.per_rule(_doc_hits(spark, sf_dir).where(F.round(shannon_entropy("match"), 6) >= 3.25))


@query(f"""SELECT doc_id, rule_id, "offset", CASE WHEN length(match) > 12 THEN substr(match, 1, 12) ELSE match END AS head FROM {DOC_HITS}""")
def hits_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printable renderings; ASCII hits are shown as they are."""
    return _doc_hits(spark, sf_dir).select("doc_id", "rule_id", "offset", F.substring(hits.rendered("match"), 1, 12).alias("head"))


@query(f"""SELECT count(*) AS n, coalesce(sum(len), 0)::BIGINT AS overwritten, (SELECT sum(strlen(text)) // 1000 FROM documents)::BIGINT AS cap,
    coalesce(sum(len), 0) <= (SELECT sum(strlen(text)) // 1000 FROM documents) AS within FROM {DOC_HITS}""")
def scrub_byte_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = _documents(spark, sf_dir).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return hits.audit(count_hits(_documents(spark, sf_dir), "text", CUSTOM), size)


NOISY = [r for r in SHAPED if r.rule_id in LOUD]
NOISY_COUNTS = " UNION ALL ".join(
    f"SELECT {_quote(r.rule_id)} AS rule_id, sum(len(m)) AS n, sum(list_sum(list_transform(m, lambda x: strlen(x)))) AS bytes FROM (SELECT regexp_extract_all(text, {_quote(r.pattern)}, 1) AS m FROM documents)" for r in NOISY
)


@query(f"SELECT rule_id, n::BIGINT AS n, bytes::BIGINT AS bytes FROM ({NOISY_COUNTS}) WHERE n > 10 OR bytes > 1024")
def noise_rules_before_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that a corpus shows to be noise: the quarantine, measured."""
    return curate.noisy(_documents(spark, sf_dir), "text", NOISY)


@query(f"""SELECT doc_id, a AS start, max(e) AS "end", count(*) AS n FROM (
    SELECT *, max(CASE WHEN fresh THEN s END) OVER (PARTITION BY doc_id ORDER BY s, e - s, k) AS a FROM (
        SELECT doc_id, "offset" AS s, "offset" + len AS e, row_number() OVER () AS k,
            coalesce("offset" > max("offset" + len) OVER (PARTITION BY doc_id ORDER BY "offset", len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM {DOC_HITS}))
    GROUP BY doc_id, a""")
def overlapping_hits_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged(_doc_hits(spark, sf_dir), "doc_id")


# ---- redaction -----------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5(regexp_replace(text, {_quote(GITHUB.pattern)}, repeat(chr(0), 40), 'g')) AS digest FROM {PLANTED}")
def redact_zero_fill_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits found by the scan, overwritten in the same pass."""
    rows = _planted(spark, sf_dir).select("doc_id", "text", scan_udf([GITHUB])("text").alias("h"))
    return redact.redact_column(rows, "text", "h", "clean").select("doc_id", F.md5("clean").alias("digest"))


@query(f"SELECT doc_id, md5(regexp_replace(text, {_quote(GITHUB.pattern)}, repeat('*', 40), 'g')) AS digest FROM {PLANTED}")
def redact_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.scrub_text(_planted(spark, sf_dir).select("doc_id", "text"), "text", [GITHUB], redact.PATTERN, b"*").select("doc_id", F.md5("text").alias("digest"))


@query(f"SELECT doc_id, md5(regexp_replace(text, {_quote(GITHUB.pattern)}, repeat('XY', 20), 'g')) AS digest FROM {PLANTED}")
def redact_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits from a table of their own, joined to their rows."""
    rows = _planted(spark, sf_dir).select("doc_id", "text")
    found = scan(rows, "text", [GITHUB], ["doc_id"])
    return redact.redact_joined(rows, "doc_id", "text", found, redact.PATTERN, b"XY").select("doc_id", F.md5("text").alias("digest"))


@query(f"SELECT true AS kept, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM {PLANTED}")
def redaction_length_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planted(spark, sf_dir).select("text", F.col("text").alias("clean"))
    done = redact.scrub_text(rows, "clean", rule_sets.default_rules() + CUSTOM)
    return done.groupBy(redact.invariants(F.col("text"), F.col("clean")).alias("kept")).agg(F.count("*").alias("n"), F.sum(F.octet_length("clean")).alias("bytes"))


@query("SELECT 0::BIGINT AS left_over")
def nothing_left_after_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scan of scrubbed text finds nothing."""
    done = redact.scrub_text(_planted(spark, sf_dir).select("doc_id", "text"), "text", [*rule_sets.default_rules(), *CUSTOM[:4]])
    return scan(done, "text", [*rule_sets.default_rules(), *CUSTOM[:4]], ["doc_id"]).agg(F.count("*").alias("left_over"))


# ---- rules ---------------------------------------------------------------------------------------------------------

ALL_RULES = [*rule_sets.curated(), *SHAPED, rule_sets.jwt_rule()]
RULES_SQL = "(VALUES " + ", ".join(f"({k}, {_quote(r.rule_id)}, {_quote(r.pattern)})" for k, r in enumerate(ALL_RULES)) + ") AS r(ord, rule_id, pattern)"
LOUD_SQL = "(" + ", ".join(map(_quote, LOUD)) + ")"
STRUCTURAL_SQL = f"""SELECT rule_id FROM {RULES_SQL} WHERE rule_id NOT IN ({", ".join(map(_quote, rule_sets.SPARED))})
    AND split_part(rule_id, '__', 1) IN (SELECT split_part(x, '__', 1) FROM (SELECT unnest([{", ".join(map(_quote, LOUD))}]) AS x))
    AND NOT regexp_matches(regexp_replace(regexp_replace(regexp_replace(
        CASE WHEN contains(pattern, '(?:.|[\\n\\r]){{0,') THEN regexp_replace(pattern, '^.*?\\(\\?:\\.\\|\\[\\\\n\\\\r\\]\\)\\{{0,.*?\\}}\\?', '', 's') ELSE regexp_replace(pattern, '^\\(\\?i\\)', '') END,
        '\\\\.', ' ', 'gs'), '\\[[^\\]]*\\]', ' ', 'g'), '\\{{[^}}]*\\}}', ' ', 'g'), '[A-Za-z0-9]{{3}}')"""


def _quarantine(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in LOUD], "rule_id string")


@query(f"SELECT ord, rule_id FROM {RULES_SQL} WHERE rule_id NOT IN {LOUD_SQL} AND rule_id NOT IN ({STRUCTURAL_SQL})")
def rules_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.active(rules_frame(spark, ALL_RULES), _quarantine(spark)).select("ord", "rule_id")


@query(STRUCTURAL_SQL)
def rules_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.structural(rules_frame(spark, ALL_RULES), _quarantine(spark)).select("rule_id")


@query(f"SELECT split_part(rule_id, '__', 1) AS provider, count(*) AS n FROM {RULES_SQL} GROUP BY 1")
def rules_per_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_frame(spark, ALL_RULES).groupBy(curate.provider().alias("provider")).agg(F.count("*").alias("n"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (rule_id IN {LOUD_SQL}) AS explicit, count(*) FILTER (rule_id IN ({STRUCTURAL_SQL})) AS structural,
    count(*) FILTER (rule_id NOT IN {LOUD_SQL} AND rule_id NOT IN ({STRUCTURAL_SQL})) AS active FROM {RULES_SQL}""")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.counts(rules_frame(spark, ALL_RULES), _quarantine(spark))


@query(f"SELECT rule_id, source FROM (SELECT rule_id, 'curated' AS source FROM {RULES_SQL} WHERE ord < {len(rule_sets.CURATED)} UNION ALL SELECT rule_id, 'custom' FROM {RULES_SQL} WHERE ord BETWEEN {len(rule_sets.CURATED)} AND {len(ALL_RULES) - 2}) WHERE rule_id <> 'jwt_token' AND NOT starts_with(rule_id, 'jwt__') UNION ALL SELECT 'jwt_token', 'code'")
def union_rule_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = rules_frame(spark, rule_sets.curated()).unionByName(rules_frame(spark, SHAPED))
    return curate.with_jwt(both, rules_frame(spark, [rule_sets.jwt_rule()])).select("rule_id", "source")


@query(f"SELECT rule_id, count(*) AS n FROM {RULES_SQL} GROUP BY rule_id HAVING count(*) > 1")
def duplicate_rule_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.duplicate_ids(rules_frame(spark, ALL_RULES))


HEADERS = ('{"alg":"HS256","typ":"JWT"}', '{"typ":"JWT", "alg" : "RS256"}', '{"typ":"JWT"}', '{"alg" :"HS512"}')


@query("WITH t AS (SELECT doc_id, CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {_quote(h)}" for k, h in enumerate(HEADERS)) + """ END AS head FROM documents)
SELECT doc_id, NOT regexp_matches(head, '"alg"[:\\s]*"*HS') AS kept FROM t""")
def jwt_keep_non_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens made for every document, with headers signed in different ways."""
    head = F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("doc_id") % 4 + 1).cast("int"))
    coded = F.regexp_replace(F.translate(F.base64(F.encode(head, "UTF-8")), "+/", "-_"), "=", "")
    made = F.concat(coded, F.lit(".eyJzdWIiOiIxMjM0NTY3ODkwIn0."), F.md5(F.col("doc_id").cast("string")))
    return _documents(spark, sf_dir).select("doc_id", is_kept_jwt(made).alias("kept"))


# ---- members, cells and intervals ----------------------------------------------------------------------------------

MEMBERS = "(SELECT source, doc_id, strlen(text)::BIGINT AS span, coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM documents)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("source", "doc_id", F.octet_length("text").cast("long").alias("span"))
    return intervals.linearise(rows, "source", "doc_id")


def _linear_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in the space of their source's texts, one after the other."""
    return _doc_hits(spark, sf_dir).join(_members(spark, sf_dir), "doc_id").select("source", "rule_id", (F.col("base") + F.col("offset")).alias("offset"), "len")


@query(f"SELECT * FROM {MEMBERS}")
def linearise_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir)


@query(f"SELECT m.source, rule_id, base + \"offset\" AS \"offset\", len, doc_id AS member, \"offset\" AS inner_offset FROM {DOC_HITS} JOIN {MEMBERS} m USING (doc_id)")
def route_hits_to_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit's member and offset in it, by a join on blocks of the space."""
    return intervals.route(_linear_hits(spark, sf_dir), _members(spark, sf_dir), "source", "doc_id")


@query(f"SELECT count(*) AS n, 0::BIGINT AS outside FROM {DOC_HITS}")
def containment_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of which none lies outside of every member."""
    found, members = _linear_hits(spark, sf_dir), _members(spark, sf_dir)
    outside = intervals.unrouted(found, members, "source").withColumn("out", F.lit(1))
    return found.withColumn("out", F.lit(0)).unionByName(outside).agg(F.count(F.when(F.col("out") == 0, 1)).alias("n"), F.count(F.when(F.col("out") == 1, 1)).alias("outside"))


DIGITS = Rule("digits", "[0-9]{5,}")


@query(f"SELECT doc_id, start, \"end\" FROM (SELECT doc_id, \"offset\" AS start, \"offset\" + len AS \"end\", match FROM {PLANTED_HITS}) WHERE NOT regexp_matches(match, '[0-9]{{5,}}')")
def coverage_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted tokens that no hit of a weak rule overlaps: what would leak."""
    rows = _planted(spark, sf_dir)
    secrets = scan(rows, "text", [GITHUB], ["doc_id"]).select("doc_id", F.col("offset").alias("start"), (F.col("offset") + F.col("len")).alias("end"))
    return intervals.uncovered(secrets, scan(rows, "text", [DIGITS], ["doc_id"]), "doc_id")


# ---- formats -------------------------------------------------------------------------------------------------------

HEADS = (b"PERFILE2", b"FLR\0", b"JAVA PROFILE 1.0.2\0", b"SQLite format 3\0", b"PK\x03\x04", b"\x0a\x0d\x0d\x0a", b"")
NAMES = ("perf", "jfr", "hprof", "sqlite", "tar", "pcap", "passthrough")


@query("SELECT format, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES)) + " END AS format, strlen(text) + CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {len(h)}" for k, h in enumerate(HEADS)) + " END AS size FROM documents) GROUP BY format")
def dispatch_by_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by the heads of artifacts, made from every document."""
    heads = F.array(*(F.unhex(F.lit(h.hex())) for h in HEADS))
    content = F.concat(F.element_at(heads, (F.col("doc_id") % len(HEADS) + 1).cast("int")), F.encode("text", "UTF-8"))
    rows = _documents(spark, sf_dir).select(content.alias("content"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"))
    return rows.groupBy(dispatch.sniffed().alias("format")).agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))


FORMATS_SQL = f"SELECT format, count(*) AS artifacts, sum(n * k)::BIGINT AS hits, 0::BIGINT AS left_over, 0::BIGINT AS errors FROM (SELECT CASE doc_id % 8 WHEN 0 THEN 'passthrough' WHEN 1 THEN 'perf' WHEN 2 THEN 'elf-core' WHEN 3 THEN 'hprof' WHEN 4 THEN 'jfr' WHEN 5 THEN 'pcap' WHEN 6 THEN 'sqlite' ELSE 'tar' END AS format, CASE doc_id % 8 WHEN 3 THEN 2 ELSE 1 END AS k, len(regexp_extract_all(text, {_quote(GITHUB.pattern)})) AS n FROM {PLANTED}) GROUP BY format"


@query(FORMATS_SQL)
def formats_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in an artifact of one of eight formats, scrubbed and scanned again."""
    from .sources import artifacts
    from .sources.build import wrapped

    made = wrapped(_planted(spark, sf_dir), "doc_id", "text")
    done = artifacts.scrub(made, [GITHUB], verify=True)
    return done.groupBy("format").agg(
        F.count("*").alias("artifacts"), F.sum("n_hits").alias("hits"), F.sum("left_over").alias("left_over"), F.count("error").alias("errors")
    )


# ---- evaluation ----------------------------------------------------------------------------------------------------

CASE_RULES = [Rule(f"{r.rule_id}__pat", r.pattern, r.capture_index, r.min_entropy) for r in CUSTOM]


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each document: every other provider's texts want an at sign, the rest nothing."""
    provider = F.element_at(F.array(*(F.lit(r.rule_id) for r in CUSTOM), F.lit("nobody")), (F.col("doc_id") % 6 + 1).cast("int"))
    want = F.when(F.col("doc_id") % 2 == 1, F.array(F.lit("@")))
    return _documents(spark, sf_dir).select(provider.alias("provider"), F.col("doc_id").cast("string").alias("name"), F.col("text").alias("input"), want.alias("want"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.outcomes(_cases(spark, sf_dir), CASE_RULES, evaluate.provider_rules(rules_frame(spark, CASE_RULES)))


OUTCOMES = f"""(SELECT provider, name, CASE WHEN provider = 'nobody' THEN 'skip' WHEN wanted AND found THEN 'pass' WHEN NOT wanted AND n = 0 THEN 'pass' ELSE 'fail' END AS outcome FROM (
    SELECT c.provider, c.doc_id::VARCHAR AS name, c.doc_id % 2 = 1 AS wanted, count(match) AS n, coalesce(bool_or(contains(match, '@')), false) AS found FROM
    (SELECT doc_id, [{", ".join(_quote(r.rule_id) for r in CUSTOM)}, 'nobody'][doc_id % 6 + 1] AS provider FROM documents) c
    LEFT JOIN {DOC_HITS} h ON h.doc_id = c.doc_id AND h.rule_id = c.provider GROUP BY c.provider, c.doc_id))"""


@query(f"""SELECT provider, count(*) FILTER (outcome = 'pass') AS passed, count(*) FILTER (outcome = 'fail') AS failed, count(*) FILTER (outcome = 'skip') AS skipped,
    round(count(*) FILTER (outcome = 'pass') / nullif(count(*) FILTER (outcome <> 'skip'), 0), 6) AS share FROM {OUTCOMES} GROUP BY provider""")
def outcome_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.totals(_outcomes(spark, sf_dir))


@query(f"SELECT provider, count(*) FILTER (outcome = 'pass') AS pass, count(*) FILTER (outcome = 'fail') AS fail, count(*) FILTER (outcome = 'skip') AS skip FROM {OUTCOMES} GROUP BY provider")
def pass_fail_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _outcomes(spark, sf_dir).groupBy("provider").pivot("outcome", ["pass", "fail", "skip"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY name)::INT AS k, count(*) OVER (PARTITION BY provider) AS n FROM {OUTCOMES} WHERE outcome = 'fail')
SELECT provider, name, k, greatest(n - 3, 0) AS more FROM f WHERE k <= 3""")
def failures_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.failures(_outcomes(spark, sf_dir))


@query(f"SELECT provider FROM {OUTCOMES} GROUP BY provider HAVING count(*) FILTER (outcome = 'fail') = 0 AND count(*) FILTER (outcome = 'pass') > 0")
def clean_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.clean_providers(_outcomes(spark, sf_dir))


@query(f"SELECT count(DISTINCT provider) AS n FROM {OUTCOMES} WHERE outcome = 'fail'")
def distinct_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.distinct_failures(_outcomes(spark, sf_dir), "provider").agg(F.count("*").alias("n"))


@query("SELECT doc_id, strlen(substr(text, 1, 100))::INT AS at_100 FROM documents")
def code_point_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", evaluate.byte_offset("text", F.lit(100)).alias("at_100"))


# ---- streams -------------------------------------------------------------------------------------------------------


@query(f"SELECT hour, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS hour, event_id FROM events) JOIN {hits_sql('events', 'event_id', 'props', PROPS)} USING (event_id) GROUP BY hour")
def hits_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed count that the streaming job keeps, over the whole table at once."""
    return hourly_hits(table(spark, sf_dir, "events"), "ts", "props", PROPS).select(F.col("hour"), "n")


__all__ = ["EVERY", "ORACLE", "QUERIES"]
