import json
import os
import re

import pytest

from tellurion.functions.entropy import shannon, shannon_entropy
from tellurion.functions.tokens import is_kept_jwt, keep_jwt
from tellurion.operators import curate
from tellurion.operators.views import LOUD, SHAPED
from tellurion.plans import dialect, prefilter, rules
from tellurion.plans.matcher import Matcher
from tellurion.plans.rules import Rule


def test_totals_of_the_curated_set():
    assert len(rules.curated()) == 25
    assert len(rules.default_rules()) == 25  # 24, and the JWT detector last
    assert rules.default_rules()[-1].filter == "jwt"
    rules.validate(rules.default_rules())


@pytest.mark.skipif("EXTRACTED_RULES" not in os.environ, reason="EXTRACTED_RULES and QUARANTINE name files of rules and ids")
def test_totals_of_an_extracted_set():
    """The figures of the public set of 1,149 extracted rules and 203 quarantined ids."""
    extracted = rules.load(os.environ["EXTRACTED_RULES"])
    quarantine = json.loads(open(os.environ["QUARANTINE"]).read())
    by_shape = rules.structural(extracted, quarantine)
    assert (len(extracted), len(quarantine), len(by_shape), len(by_shape - set(quarantine))) == (1149, 203, 240, 57)
    assert len(rules.active(extracted, quarantine)) == 889
    assert len(rules.default_rules(extracted, quarantine)) == 913


def test_rule_files(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"rules": [{"id": "a", "pattern": "x(y)", "capture_index": 1}, {"id": "a", "pattern": "z", "min_entropy": 2.5}]}))
    assert rules.load(str(path)) == [Rule("a", "x(y)", 1, source="file"), Rule("a", "z", None, 2.5, source="file")]
    path.write_text(json.dumps({"rules": [{"id": "bad", "pattern": "("}]}))
    with pytest.raises(rules.RuleError, match="bad"):
        rules.load(str(path))
    path.write_text(json.dumps({"rules": [{"id": "nogroup", "pattern": "x", "capture_index": 1}]}))
    with pytest.raises(rules.RuleError, match="nogroup"):
        rules.load(str(path))


def test_value_part_and_literals():
    assert rules.value_part(r"(?i:kw)(?:.|[\n\r]){0,40}?\b([a-z]{3})\b") == r"\b([a-z]{3})\b"
    assert rules.value_part("(?i)abc") == "abc"
    for pattern, found in ((r"\b([0-9a-z]{32})\b", False), (r"snd_[a-z]", True), (r"\d\d\d[abc]{123}", False), (r"ab\wc", False), (r"[abc]def", True)):
        assert rules.has_literal(pattern) is found


def test_curation_tables_agree_with_the_lists(spark):
    every = rules.curated() + SHAPED
    frame, quarantine = rules.rules_frame(spark, every), spark.createDataFrame([(x,) for x in LOUD], "rule_id string")
    assert {r.rule_id for r in curate.structural(frame, quarantine).collect()} == rules.structural(every, LOUD)
    assert [r.rule_id for r in curate.active(frame, quarantine).orderBy("ord").collect()] == [r.rule_id for r in rules.active(every, LOUD)]
    assert rules.from_frame(frame) == every
    sql = {r.rule_id: r.v for r in frame.select("rule_id", curate.has_literal(curate.value_part()).alias("v")).collect()}
    assert all(sql[r.rule_id] == rules.has_literal(rules.value_part(r.pattern)) for r in every if [x.rule_id for x in every].count(r.rule_id) == 1)


@pytest.mark.parametrize(
    ("pattern", "text", "found"),
    [
        (r"a$", "a\n", []), (r"a\z", "ba", ["a"]), (r"[[:alnum:]]+", "a:b", ["a", "b"]), (r"x(?i)ab|CD", "xAB cd", ["xAB", "cd"]), (r"(?P<n>ab)c", "abc", ["abc"]),
        (r"[^\s[]+", "a[b", ["a", "b"]), (r"[]a]+", "]a", ["]a"]), (r"(a(?i)b|c)d", "aBd Cd cd", ["aBd", "Cd", "cd"]),
    ],
)
def test_dialects(spark, pattern, text, found):
    assert [m[0] for m in re.finditer(dialect.to_python(pattern), text)] == found
    java = dialect.to_java(pattern).replace("'", "\\'")
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(f"({java})"), F.lit(0)).alias("m")).first().m
    assert got == found


def test_portable():
    assert dialect.portable(r"a(?:b)[c]\d") and not dialect.portable(r"(?=a)b") and not dialect.portable(r"(?<!a)b") and not dialect.portable(r"(a)\1")


def test_needed_literals():
    assert prefilter.literals(r"(?i:KeyWord|other)(?:.|[\n\r]){0,40}?\b([0-9]{4})\b") == {"keyword", "other"}
    assert prefilter.literals(r"[A-Za-z]+@[a-z]+") == {"@"}
    assert prefilter.literals(r"\b\d{4}\b") == {prefilter.DIGIT}
    assert prefilter.literals(r"(?:abc)?x") is None
    assert prefilter.literals(r"(?:abc)+x|defg") == {"abc", "defg"}


def test_prefilter_loses_nothing():
    every = rules.default_rules() + SHAPED
    a, b = Matcher(every), Matcher(every, prefilter=False)
    token = "gh" + "p_" + "TESTFAKE" * 5
    texts = ["", "plain words", f"x {token} y", "demo " + "0a" * 16, "WANDB ſomething " + "ab" * 20, "ſound key " + "a1" * 20, "K snd_" + "Z" * 30, "00" + "b" * 40]
    for t in texts:
        assert a.scan_text(t) == b.scan_text(t)
        assert a.scan_bytes(t.encode()) == b.scan_bytes(t.encode())


def test_entropy(spark):
    assert shannon(b"") == 0 and shannon(b"AAAA") == 0 and shannon(b"aabb") == 1 and shannon(bytes(range(256))) == 8
    texts = ["", "AAAA", "aabb", "ghp_x9Q!", None]
    got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(shannon_entropy("t").alias("e")).collect()]
    assert got[-1] is None and all(abs(g - shannon(t.encode())) < 1e-9 for g, t in zip(got, texts) if t is not None)


def token(header: bytes) -> str:
    import base64

    return base64.urlsafe_b64encode(header).rstrip(b"=").decode() + ".eyJzdWIiOiIxIn0.c2lnbmF0dXJl"


def test_jwt_filter(spark):
    cases = {
        token(b'{"alg":"HS256"}'): False, token(b'{"alg" : "HS512","x":1}'): False, token(b'{"alg":"RS256"}'): True, token(b'{"typ":"JWT"}'): True,
        token(b'{"typ":"HS","alg":"ES256"}'): True, "!!.x.y": True, "nodot": False, token(b"\xff\xfe"): True,
    }
    assert {t: keep_jwt(t) for t in cases} == cases
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", is_kept_jwt("t").alias("k")).collect()}
    assert got == cases


def test_jwt_rules_give_way(spark):
    both = curate.with_jwt(rules.rules_frame(spark, rules.curated() + SHAPED), rules.rules_frame(spark, [rules.jwt_rule()]))
    assert [r.source for r in both.where("rule_id like 'jwt%'").collect()] == ["code"]


def test_counts_and_offsets_agree_with_a_slow_count():
    """Beside groups that take no part, empty groups, floors and letters of several bytes."""
    rules_ = [Rule("word", r"([a-z]{3,5})", 1), Rule("whole", r"[0-9]{2}"), Rule("maybe", r"x(y)?", 1), Rule("empty", r"q(z*)", 1), Rule("two", r"(a)(b)", 2), Rule("floor", r"[a-z]+9", None, 1.5)]
    matcher = Matcher(rules_)
    for text in ("", "straße 12 xy x qz q abab é99 aaa9 abc9 ſx", "plain 1234 xyx qqz ab9", "é" * 50 + " abc 12"):
        slow: dict[int, list[int]] = {}
        spans = []
        for k, r in enumerate(rules_):
            for m in re.finditer(r.pattern, text):
                a, z = m.span(r.capture_index or 0)
                if a >= 0 and (r.min_entropy is None or shannon(text[a:z].encode()) >= r.min_entropy):
                    spans.append((k, len(text[:a].encode()), len(text[a:z].encode())))
                    entry = slow.setdefault(k, [0, 0])
                    entry[0] += 1
                    entry[1] += spans[-1][2]
        assert matcher.scan_text(text) == spans
        assert matcher.count_text(text) == [(k, *v) for k, v in sorted(slow.items())]


def test_offsets_of_long_texts_take_linear_time():
    import time

    text = "é abc " * 400_000
    start = time.perf_counter()
    found = Matcher([Rule("word", r"abc")]).scan_text(text)
    assert len(found) == 400_000 and found[-1] == (0, 7 * 399_999 + 3, 3)
    assert time.perf_counter() - start < 10
