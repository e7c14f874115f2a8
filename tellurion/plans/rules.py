"""Detection rules: what they are, the curated set, files of more, and which of them are active."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "ord int, rule_id string, pattern string, min_entropy double, capture_index int, filter string, source string"

# The curated rules as (id, pattern, capture group, entropy floor).
CURATED = (
    ("github_pat_classic", r"ghp_[A-Za-z0-9_]{36,255}", None, None),
    ("github_oauth_token", r"gho_[A-Za-z0-9_]{36,255}", None, None),
    ("github_user_token", r"ghu_[A-Za-z0-9_]{36,255}", None, None),
    ("github_server_token", r"ghs_[A-Za-z0-9_]{36,255}", None, None),
    ("github_refresh_token", r"ghr_[A-Za-z0-9_]{36,255}", None, None),
    ("github_fine_grained_pat", r"github_pat_[A-Za-z0-9_]{82,255}", None, None),
    ("huggingface_user_token", r"(?:hf_|api_org_)[A-Za-z0-9]{34}", None, None),
    ("openai_classic_key", r"sk-(?:[A-Za-z0-9_-]+)?T3BlbkFJ[A-Za-z0-9_-]{20,}", None, None),
    ("openai_project_key", r"sk-proj-[A-Za-z0-9_-]{20,}", None, None),
    ("anthropic_api_key", r"sk-ant-(?:admin01|api03)-[A-Za-z0-9_-]{93}AA", None, None),
    ("aws_access_key_id", r"(?:AKIA|ABIA|ACCA)[0-9A-Z]{16}", None, None),
    ("aws_temp_access_key_id", r"ASIA[0-9A-Z]{16}", None, None),
    ("google_oauth_access_token", r"ya29\.[A-Za-z0-9_-]{20,}", None, None),
    ("google_api_key", r"AIza[A-Za-z0-9_-]{35}", None, None),
    ("slack_bot_token", r"xoxb-[0-9]{10,13}-[0-9]{10,13}[A-Za-z0-9-]*", None, None),
    ("slack_user_token", r"xoxp-[0-9]{10,13}-[0-9]{10,13}[A-Za-z0-9-]*", None, None),
    ("slack_app_token", r"xapp-[A-Za-z0-9-]{20,}", None, None),
    ("slack_workspace_access_token", r"xoxa-[0-9]{10,13}-[0-9]{10,13}[A-Za-z0-9-]*", None, None),
    ("slack_workspace_refresh_token", r"xoxr-[0-9]{10,13}-[0-9]{10,13}[A-Za-z0-9-]*", None, None),
    ("nvidia_ngc_api_key", r"nvapi-[A-Za-z0-9_-]{64}", None, None),
    ("wandb_api_key_prefixed", r"wandb-[A-Fa-f0-9]{40}", None, None),
    ("wandb_api_key_keyword", r"(?i)wandb[\s\S]{0,300}?([0-9a-f]{40})", 1, None),
    ("stripe_live_secret", r"[rs]k_live_[A-Za-z0-9]{20,247}", None, None),
    ("stripe_test_secret", r"[rs]k_test_[A-Za-z0-9]{20,247}", None, None),
    ("jwt_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", None, 3.5),
)
# The JWT detector that takes the place of all plain JWT rules, and rules that the noise heuristic spares.
JWT = ("jwt_token", r"\b(?:eyJ|ewogIC|ewoid)[A-Za-z0-9_-]{8,}={0,2}\.(?:eyJ|ewo)[A-Za-z0-9_-]{8,}={0,2}\.[A-Za-z0-9_-]{8,}", None, 3.5)
SPARED = ("azure_cosmosdb__dbkeypattern", "okta__tokenpat")
PROXIMITY = re.compile(r"\(\?:\.\|\[\\n\\r\]\)\{0,.*?\}\?", re.S)
LITERAL_RUN = 3


class RuleError(ValueError):
    """A rule that can't be used; the message names it."""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    capture_index: int | None = None
    min_entropy: float | None = None
    filter: str | None = None  # a semantic predicate after the entropy floor: "jwt"
    source: str = "custom"

    @property
    def provider(self) -> str:
        """What comes before two underscores in the id; the whole id if there are none."""
        return self.rule_id.partition("__")[0]


def curated() -> list[Rule]:
    return [Rule(*r, source="curated") for r in CURATED]


def jwt_rule() -> Rule:
    return Rule(*JWT, filter="jwt", source="code")


def load(path: str) -> list[Rule]:
    """Rules of a YAML or JSON file: {"rules": [{"id", "pattern", "capture_index"?, "min_entropy"?}, ...]}. Ids may repeat."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuleError(f"{path}: reading YAML needs PyYAML; JSON doesn't") from e
        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    rules = [Rule(r["id"], r["pattern"], r.get("capture_index"), r.get("min_entropy"), source="file") for r in found["rules"]]
    validate(rules)
    return rules


def validate(rules: Iterable[Rule]) -> None:
    """Raises RuleError for the first rule that doesn't compile."""
    from .dialect import to_python

    for r in rules:
        try:
            compiled = re.compile(to_python(r.pattern))
        except re.error as e:
            raise RuleError(f"rule {r.rule_id}: {e}") from e
        if (r.capture_index or 0) > compiled.groups:
            raise RuleError(f"rule {r.rule_id}: no group {r.capture_index}")


def value_part(pattern: str) -> str:
    """The part that matches the secret: what follows a keyword window, or else follows a leading ``(?i)``."""
    m = PROXIMITY.search(pattern)
    return pattern[m.end() :] if m else pattern.removeprefix("(?i)")


def has_literal(pattern: str, run: int = LITERAL_RUN) -> bool:
    """True if ``run`` plain letters or digits stand together outside escapes, classes and counts."""
    bare = pattern
    for part in (r"\\.", r"\[[^\]]*\]", r"\{[^}]*\}"):
        bare = re.sub(part, " ", bare, flags=re.S)
    return re.search(f"[A-Za-z0-9]{{{run}}}", bare) is not None


def noisy_by_shape(rule: Rule) -> bool:
    return rule.rule_id not in SPARED and not has_literal(value_part(rule.pattern))


def structural(rules: Iterable[Rule], quarantined: Iterable[str]) -> set[str]:
    """Ids of the rules that have no literal in their value and share the provider of a quarantined rule."""
    loud = {q.partition("__")[0] for q in quarantined}
    return {r.rule_id for r in rules if r.provider in loud and noisy_by_shape(r)}


def active(rules: list[Rule], quarantined: Iterable[str] = ()) -> list[Rule]:
    """Rules that are neither quarantined by id nor by shape."""
    quarantined = set(quarantined)
    out = quarantined | structural(rules, quarantined)
    return [r for r in rules if r.rule_id not in out]


def default_rules(extracted: list[Rule] | None = None, quarantined: Iterable[str] = ()) -> list[Rule]:
    """The curated rules, then the active ones of ``extracted``; JWT rules among them give way to the JWT detector, which comes last."""
    found = curated() + active(extracted or [], quarantined)
    return [r for r in found if r.rule_id != "jwt_token" and not r.rule_id.startswith("jwt__")] + [jwt_rule()]


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table, in order."""
    return spark.createDataFrame([(k, r.rule_id, r.pattern, r.min_entropy, r.capture_index, r.filter, r.source) for k, r in enumerate(rules)], SCHEMA)


def from_frame(frame: DataFrame) -> list[Rule]:
    """The rules of a table; a rule set fits on the driver, which compiles it."""
    return [Rule(r["rule_id"], r["pattern"], r["capture_index"], r["min_entropy"], r["filter"], r["source"]) for r in frame.orderBy("ord").collect()]


def dump(rules: list[Rule]) -> str:
    return json.dumps([asdict(r) for r in rules])
