import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tellurion.operators import evaluate, hits, intervals, redact
from tellurion.operators.scan import count_hits, scan, scan_native, scan_udf
from tellurion.operators.views import CUSTOM
from tellurion.plans.rules import Rule, curated, default_rules
from tellurion.streaming.hits import hourly_hits, scrub_stream


def fill(n: int, letters: str, seed: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


AN, HEX, UP = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits
#: Secrets of the kinds that must never be missed; made here, so that none stands in the repository.
SECRETS = {
    "github_pat_classic": "gh" + "p_" + fill(36, AN, 1), "github_oauth_token": "gh" + "o_" + fill(36, AN, 2), "github_user_token": "gh" + "u_" + fill(36, AN, 3),
    "github_server_token": "gh" + "s_" + fill(36, AN, 4), "github_refresh_token": "gh" + "r_" + fill(36, AN, 5), "github_fine_grained_pat": "github" + "_pat_" + fill(82, AN, 6),
    "huggingface_user_token": "h" + "f_" + fill(34, AN, 7), "openai_classic_key": "s" + "k-" + fill(20, AN, 8) + "T3Blbk" + "FJ" + fill(20, AN, 9),
    "openai_project_key": "s" + "k-proj-" + fill(40, AN, 10), "anthropic_api_key": "s" + "k-ant-" + "api03-" + fill(93, AN, 11) + "AA", "aws_access_key_id": "AK" + "IA" + fill(16, UP, 12),
    "aws_temp_access_key_id": "AS" + "IA" + fill(16, UP, 13), "google_oauth_access_token": "ya" + "29." + fill(30, AN, 14), "google_api_key": "AI" + "za" + fill(35, AN, 15),
    "slack_bot_token": "xo" + "xb-" + "1234567890-1234567890-" + fill(24, AN, 16), "slack_app_token": "xa" + "pp-" + fill(30, AN, 17), "nvidia_ngc_api_key": "nv" + "api-" + fill(64, AN, 18),
    "wandb_api_key_prefixed": "wan" + "db-" + fill(40, HEX, 19), "wandb_api_key_keyword": "WANDB key is " + fill(40, HEX, 20), "stripe_live_secret": "s" + "k_live_" + fill(24, AN, 21),
    "stripe_test_secret": "r" + "k_test_" + fill(24, AN, 22),
}


def test_every_marquee_secret_is_covered(spark):
    rows = [(label, f"line one é\nvalue = {s}\nend") for label, s in SECRETS.items()]
    frame = spark.createDataFrame(rows, "label string, text string")
    found = scan(frame, "text", default_rules(), ["label"])
    spans = [(label, (at := text.encode().index(SECRETS[label].encode())), at + len(SECRETS[label])) for label, text in rows]
    secrets = spark.createDataFrame(spans, "label string, start long, end long")
    assert intervals.uncovered(secrets, found, "label").collect() == []
    assert {r.label for r in found.where("label = rule_id").collect()} == set(SECRETS)


def test_scans_agree_and_offsets_are_bytes(spark):
    rows = [(1, "mail: ä.b@c.example, 𝄞 x@y.org"), (2, None), (3, ""), (4, 'tok token = "' + fill(40, HEX, 3) + '" (123) 456-7890'), (5, "10.0.0.1 " * 3)]
    frame = spark.createDataFrame(rows, "id long, text string")
    rules = [r for r in CUSTOM if not r.capture_index]
    a = sorted(map(tuple, scan(frame, "text", rules, ["id"]).collect()))
    assert a == sorted(map(tuple, scan_native(frame, "text", rules, ["id"]).collect()))
    texts = dict(rows)
    for i, _, _, at, n, match in a:
        assert texts[i].encode()[at : at + n].decode() == match
    beside = frame.select("id", F.explode(scan_udf(rules)("text")).alias("h")).select("id", "h.*")
    assert sorted(map(tuple, beside.collect())) == a
    binary = scan(frame.withColumn("text", F.encode("text", "UTF-8")), "text", rules, ["id"])
    assert sorted((r.id, r.rule_id, r.offset) for r in binary.where("rule_id <> 'email'").collect()) == [(i, r, at) for i, _, r, at, _, _ in a if r != "email"]
    counted = {(r.id, r.rule_id): (r.n, r.bytes) for r in count_hits(frame, "text", rules, ["id"]).collect()}
    grouped = {(r.id, r.rule_id): (r.n, r.bytes) for r in hits.per_rule(scan(frame, "text", rules, ["id"]), "id").collect()}
    assert counted == grouped
    got = scan(frame, "text", CUSTOM, ["id"]).where("rule_id = 'assigned_token'").first()
    assert got.len == 40 and got.offset == len('tok token = "')


def test_floor_and_capture(spark):
    frame = spark.createDataFrame([(1, "k=" + "A" * 40), (2, "k=" + fill(40, AN, 1)), (3, "j=x")], "id long, text string")
    rules = [Rule("k", "(?:k=([A-Za-z0-9]{40}))|j=x", 1, 4.0)]
    assert [(r.id, r.offset, r.len) for r in scan(frame, "text", rules, ["id"]).collect()] == [(2, 2, 40)]


def test_results_do_not_depend_on_partitions(spark):
    frame = spark.createDataFrame([(k, f"a{k}@b.org 1.2.3.{k % 250}") for k in range(100)], "id long, text string")
    want = sorted(map(tuple, scan(frame.coalesce(1), "text", CUSTOM, ["id"]).collect()))
    assert sorted(map(tuple, scan(frame.repartition(7), "text", CUSTOM, ["id"]).collect())) == want


def test_redaction_by_example():
    data = b"abcdEFGHijkl"
    assert redact.apply_hits(data, [(4, 4)]) == b"abcd\0\0\0\0ijkl"
    assert redact.apply_hits(data, [(4, 4)], redact.PATTERN, b"XY") == b"abcdXYXYijkl"
    assert redact.apply_hits(data, [(4, 4), (6, 4), (4, 4)]) == b"abcd" + bytes(6) + b"kl"
    for bad in ([(10, 3)], [(-1, 2)]):
        with pytest.raises(redact.RedactionError):
            redact.apply_hits(data, bad)
    with pytest.raises(redact.RedactionError):
        redact.apply_hits(data, [(0, 1)], redact.PATTERN)
    with pytest.raises(redact.RedactionError):
        redact.apply_hits(data, [(0, 1)], redact.DROP)


@settings(max_examples=25, deadline=None)
@given(st.binary(min_size=1, max_size=50), st.lists(st.tuples(st.integers(0, 49), st.integers(0, 12)), max_size=5))
def test_redaction_keeps_length_and_the_rest(data, spans):
    spans = [(a, n) for a, n in spans if a + n <= len(data)]
    out = redact.apply_hits(data, spans)
    assert len(out) == len(data)
    inside = {i for a, n in spans for i in range(a, a + n)}
    assert all((out[i] == 0) if i in inside else (out[i] == data[i]) for i in range(len(data)))


def test_native_redaction_equals_python(spark):
    rows = [(b"abcdEFGHijkl", [(4, 4), (6, 3)]), (b"x", []), (b"", []), (b"0123456789", [(0, 10)]), (b"0123456789", [(3, 0)])]
    frame = spark.createDataFrame(rows, "content binary, hits array<struct<offset:long,len:long>>")
    for kind, pattern in ((redact.ZERO, b""), (redact.PATTERN, b"*"), (redact.PATTERN, b"XYZ")):
        got = [bytes(r.o) for r in frame.select(redact.redact_native("content", "hits", kind, pattern).alias("o")).collect()]
        assert got == [redact.apply_hits(c, h, kind, pattern) for c, h in rows]
    outside = spark.createDataFrame([(b"abc", [(2, 2)])], frame.schema)
    with pytest.raises(Exception, match="outside"):
        outside.select(redact.redact_native("content", "hits")).collect()


def test_scrub_leaves_nothing_and_keeps_length(spark):
    text = "é " + " ".join(SECRETS.values())
    frame = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "id long, text string")
    done = redact.scrub_text(frame, "text", default_rules())
    assert scan(done, "text", default_rules(), ["id"]).collect() == []
    got = {r.id: r.text for r in done.collect()}
    assert len(got[1].encode()) == len(text.encode()) and got[2] == "clean" and got[3] is None
    found = scan(frame, "text", default_rules(), ["id"])
    assert {r.id: r.text for r in redact.redact_joined(frame, "id", "text", found).collect()} == got


def test_members_and_routes(spark):
    members = spark.createDataFrame([("a", 1, 10), ("a", 2, 0), ("a", 3, 200_000), ("a", 4, 5), ("b", 1, 7)], "path string, ord long, span long")
    placed = intervals.linearise(members, "path", "ord")
    assert {(r.path, r.ord): r.base for r in placed.collect()} == {("a", 1): 0, ("a", 2): 10, ("a", 3): 10, ("a", 4): 200_010, ("b", 1): 0}
    short = intervals.linearise(members, "path", "ord", width=2)
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, placed.collect()))
    found = spark.createDataFrame([("a", 0, 10), ("a", 9, 2), ("a", 150_000, 60), ("a", 200_010, 5), ("a", 200_014, 2), ("b", 3, 4), ("c", 0, 1)], "path string, offset long, len long")
    routed = {(r.path, r.offset): (r.member, r.inner_offset) for r in intervals.route(found, placed, "path", "ord").collect()}
    assert routed == {("a", 0): (1, 0), ("a", 150_000): (3, 149_990), ("a", 200_010): (4, 0), ("b", 3): (1, 3)}
    assert {(r.path, r.offset) for r in intervals.unrouted(found, placed, "path").collect()} == {("a", 9), ("a", 200_014), ("c", 0)}
    assert intervals.guard(found.where("path = 'b'"), placed, "path").count() == 1
    with pytest.raises(Exception, match="outside"):
        intervals.guard(found, placed, "path").collect()


def test_members_without_a_name(spark):
    """A null ``by`` is a group of its own, as in linearise."""
    members = spark.createDataFrame([(None, 1, 10), (None, 2, 10), ("a", 1, 7)], "path string, ord long, span long")
    placed = intervals.linearise(members, "path", "ord")
    found = spark.createDataFrame([(None, 12, 3), (None, 20, 1), ("a", 0, 2), ("a", 7, 1)], "path string, offset long, len long")
    assert sorted((r.path or "", r.offset, r.member, r.inner_offset) for r in intervals.route(found, placed, "path", "ord").collect()) == [("", 12, 2, 2), ("a", 0, 1, 0)]
    assert sorted((r.path or "", r.offset) for r in intervals.unrouted(found, placed, "path").collect()) == [("", 20), ("a", 7)]
    assert intervals.guard(found.where("offset < 13 and (path is null or offset < 7)"), placed, "path").count() == 2
    secrets = spark.createDataFrame([(None, 13, 14), (None, 16, 18), ("a", 3, 4)], "path string, start long, end long")
    assert sorted((r.path or "", r.start) for r in intervals.uncovered(secrets, found, "path").collect()) == [("", 16), ("a", 3)]
    twice = secrets.unionByName(secrets).unionByName(spark.createDataFrame([("a", None, None)], secrets.schema))
    assert sorted((r.path or "", r.start or -1) for r in intervals.uncovered(twice, found, "path").collect()) == [("", 16), ("", 16), ("a", -1), ("a", 3), ("a", 3)]
    assert intervals.uncovered(secrets, found.limit(0), "path").count() == 3 and intervals.uncovered(secrets.limit(0), found, "path").count() == 0


def test_merged_intervals(spark):
    found = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 7, 1), (1, 9, 1), (1, 0, 2), (2, 0, 1)], "id long, offset long, len long")
    assert {tuple(r) for r in intervals.merged(found, "id").collect()} == {(1, 0, 8, 4), (1, 9, 10, 1), (2, 0, 1, 1)}


def test_reports(spark):
    found = spark.createDataFrame([("r", k, 0, 200, "x" * 130 if k else "a\té") for k in range(12)] + [("s", 0, 1, 5, "hello")], "rule_id string, id long, offset long, len long, match string")
    stats = hits.per_rule(found)
    assert [(r.rule_id, r["rank"]) for r in hits.ranked(stats).orderBy("rank").collect()] == [("r", 1), ("s", 2)]
    assert [r.rule_id for r in hits.over_bounds(stats).collect()] == ["r"]
    shown = hits.samples(found, 2, "id").orderBy("rule_id", "sample").collect()
    assert [(r.rule_id, r.sample, r.more) for r in shown] == [("r", 1, 10), ("r", 2, 10), ("s", 1, 0)]
    assert shown[0].shown == "a\\x09\\xc3\\xa9" and shown[1].shown == "x" * 120 + " [+10 bytes]"
    total = hits.audit(stats, 1000).first()
    assert (total.n, total.overwritten, total["cap"], total.within) == (13, 2405, 1, False)


def test_evaluation_outcomes(spark):
    rules = [Rule("mail__pat", "[a-z]+@[a-z]+"), Rule("other__pat", "zzz")]
    cases = spark.createDataFrame(
        [
            ("mail", "equal", "x a@b y", ["a@b"]), ("mail", "inside", "x a@b y", ["@"]), ("mail", "around", "x a@b y", ["x a@b y"]), ("mail", "missing", "nothing", ["a@b"]),
            ("mail", "negative", "nothing", None), ("mail", "false alarm", "a@b", []), ("mail", "others' rules don't count", "zzz", None), ("unknown", "case", "a@b", ["a@b"]),
        ],
        "provider string, name string, input string, want array<string>",
    )
    from tellurion.plans.rules import rules_frame

    out = evaluate.outcomes(cases, rules, evaluate.provider_rules(rules_frame(spark, rules)))
    got = {r.name: r.outcome for r in out.collect()}
    assert got == {"equal": "pass", "inside": "pass", "around": "pass", "missing": "fail", "negative": "pass", "false alarm": "fail", "others' rules don't count": "pass", "case": "skip"}
    assert {r.provider: (r.passed, r.failed, r.skipped) for r in evaluate.totals(out).collect()} == {"mail": (5, 2, 0), "unknown": (0, 0, 1)}
    assert [(r.name, r.more) for r in evaluate.failures(out, 1).collect()] == [("false alarm", 1)]
    assert evaluate.clean_providers(out).collect() == []


def test_noise_bounds_hold_on_text_without_secrets(spark):
    rng = random.Random(9)
    lines = [f"2024-01-{k % 28 + 1:02d} INFO worker-{k % 16} handled request {rng.randrange(10**9)} in {rng.random():.6f}s id={fill(8, HEX, k)}-{fill(4, HEX, k)}" for k in range(20_000)]
    frame = spark.createDataFrame([(k, "\n".join(lines[k * 100 : k * 100 + 100])) for k in range(200)], "id long, text string")
    stats = count_hits(frame, "text", curated())
    assert hits.over_bounds(stats).collect() == []


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"a{k}@b.org") for k in range(50)], "id long, text string").withColumn("ts", F.timestamp_seconds(F.col("id") * 600))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    email = [r for r in CUSTOM if r.rule_id == "email"]
    scrub_stream(stream, "text", email, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("text like '%@%'").count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    q = hourly_hits(stream, "ts", "text", email, "10 days").writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.hour, r.n) for r in hourly_hits(rows, "ts", "text", email).collect()}
    assert {(r.hour, r.n) for r in spark.table("hourly").collect()} == want
