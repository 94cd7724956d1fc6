"""Column expressions for cleaning and encoding; nulls follow the rule each states."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
FILE_CHANGES = ["ADD", "MODIFY", "DELETE", "RENAME", "COPY", "UNKNOWN"]
FUNCTION_CHANGES = ["MODIFY", "ADD", "DELETE", "RENAME", "REFACTOR"]
BOTS = ["gardener@tensorflow.org"]
OWNER_SHARE = 0.05
KEYWORDS = r"fix|bug|patch|security|overflow|not|working"
LONG_KEYWORDS = (
    r"\b(?:fix|fixed|fixes|patch|patched|patches|address|addresses|addressed|resolve|resolves|resolved|remediate|remediates|remediated|correct|corrects|corrected|mitigate|mitigates|mitigated|harden|hardens|hardened|secure|secures|secured|protect|protects|protected|guard|guards|guarded|enforce|enforces|enforced|restrict|restricts|restricted|sanitize|sanitizes|sanitized|validate|validates|validated|escape|escapes|escaped|encode|encodes|encoded|filter|filters|filtered|check|checks|checked|bound|bounds|bounded|clamp|clamps|clamped|initialize|initializes|initialized|null-?check|nullchecks|verify|verifies|verified|authenticate|authoriz(?:e|es|ed)|prevent|prevents|prevented|block|blocks|blocked|deny|denies|denied|reject|rejects|rejected|remove|removes|removed|disable|disables|disabled|revert|reverts|reverted|backport|backports|backported|bump|bumps|bumped)\b"
    r"|\b(?:bypass|bypasses|bypassed|skip|skips|skipped|ignore|ignores|ignored|relax|relaxes|relaxed|expose|exposes|exposed|leak|leaks|leaked|overflow|overflows|overflowed|underflow|underflows|underflowed|dereference|dereferences|dereferenced|trust|trusted|parse|parses|parsed)\b"
    r"|\b(?:security|vuln(?:erabilit(?:y|ies))?|cve|xss|csrf|sqli|rce|ssrf|lfi|rfi|dos|overflow|underflow|bug|error|issue|risk|fuck|bullshit|shit|deadline|sprint)\b"
)
DEVELOPER_COUNTS = ["repo_total_commits_before", "repo_active_weeks_before", "repo_tenure_days", "repo_commits_as_committer_before", "recent_commits_90d", "time_since_last_commit_days", "cross_repo_commits_before", "num_repos_contributed_before"]
DEVELOPER_SHARE = "experience_percentile_in_repo"
DEVELOPER_AT_COMMIT = ["dev_experience_days", "dev_commits_before", "dev_is_new_contributor"]
ISSUE_FEATURES = ["issue_open_30d", "issue_open_90d", "issue_open_180d", "issue_age_median", "issues_closed_last_90d", "issues_closed_last_180d", "issue_open_velocity_30d", "issue_open_velocity_90d"]
PULL_FEATURES = ["pr_count_30d", "pr_count_90d", "pr_count_180d", "pr_age_median", "pr_closed_last_90d", "pr_closed_last_180d", "pr_open_velocity_30d", "pr_open_velocity_90d"]
TAG_FEATURES = ["days_since_prev_tag", "tags_last_180d", "tags_last_365d", "avg_release_cadence_days", "days_since_prev_tag_norm"]
ISSUE_FEATURES_V2 = ["issue_open_90d", "issue_age_median", "issues_closed_last_90d", "issue_open_velocity_90d"]
PULL_FEATURES_V2 = ["pr_count_90d", "pr_age_median", "pr_closed_last_90d", "pr_open_velocity_90d"]
TAG_FEATURES_V2 = ["days_since_prev_tag", "tags_last_365d", "avg_release_cadence_days", "days_since_prev_tag_norm"]
AUTHOR_EDGE_V2 = ["dev_experience_days", "dev_commits_before", "dev_is_new_contributor"]
ISSUE_EDGE_V2 = ["pr_to_issue_open_ratio_90d", "issue_to_pr_closed_ratio_90d", "has_issue_pr_gap"]
TAG_EDGE_V2 = ["activity_since_last_tag"]
EDGE_FEATURES = {"linked_issue": ["issue_open_90d"], "linked_pr": ["pr_count_90d"], "has_release_tag": ["days_since_prev_tag_norm"], "references_issue": ["pr_to_issue_open_ratio_90d", "has_issue_pr_gap"], "affects": ["activity_since_last_tag"]}
PRERELEASE = ["alpha", "beta", "rc", "pre", "dev"]
HOTFIX = ["hotfix", "fix", "patch"]
DELAY_LIMITS = [-24, -1, 0, 1 / 60, 1, 24, 168]
DELAY_NAMES = ["<-24h", "-24→-1h", "-1→0h", "0→1min", "1min→1h", "1→24h", "1→7d", ">7d"]
RAW_EXCLUDED = ["hash", "repo", "url", "id", "number", "node_id", "fc_hash", "vcc_hash", "matched_anchor", "window_since", "window_until", "commit_datetime", "created_at", "closed_at", "merged_at", "updated_at", "title", "body"]
LOGGED_COUNTS = [
    "issue_open_30d", "issue_open_90d", "issue_open_180d", "issue_age_median", "issues_closed_last_90d", "issues_closed_last_180d", "issue_open_velocity_30d", "issue_open_velocity_90d",
    "pr_count_30d", "pr_count_90d", "pr_count_180d", "pr_age_median", "pr_closed_last_90d", "pr_closed_last_180d", "pr_open_velocity_30d", "pr_open_velocity_90d",
    "days_since_prev_tag", "avg_release_cadence_days", "tags_last_180d", "tags_last_365d", "activity_since_last_tag", "dev_experience_days", "dev_commits_before",
    "repo_commits_last_30d", "repo_commits_last_90d", "repo_active_authors_90d",
]


def safe_double(df: DataFrame, column: str) -> Column:
    """Tolerant number: absent, null, NaN and unreadable values are 0."""
    if column not in df.columns:
        return F.lit(0.0)
    number = F.col(column).try_cast("double")
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def normal_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def normal_change(c: Column) -> Column:
    """Change type without its enum prefix; MODIFIED is MODIFY."""
    return F.replace(F.replace(c, F.lit("ModificationType."), F.lit("")), F.lit("MODIFIED"), F.lit("MODIFY"))


def label_of(commit_type: Column) -> Column:
    return F.when(commit_type == "VCC", 1).otherwise(0)


def log_count(c: Column) -> Column:
    return F.log1p(F.greatest(c.cast("double"), F.lit(0.0)))


def signed_log(c: Column) -> Column:
    return F.signum(c.cast("double")) * F.log1p(F.abs(c.cast("double")))


def one_hot(value: Column, categories: Sequence[str], default: str) -> Column:
    """An array of 0 and 1; an unknown or null value takes the default's slot."""
    known = F.when(value.isin(*categories), value).otherwise(F.lit(default))
    return F.array(*[(known == c).cast("double") for c in categories])


def capped_ratio(a: Column, b: Column, cap: float = 1.0) -> Column:
    """a over b, b at least 1, the result at most ``cap``."""
    return F.least(a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0)), F.lit(cap))


def cyclic(position: Column, period: float) -> list[Column]:
    angle = position * (2 * math.pi / period)
    return [F.coalesce(F.sin(angle), F.lit(0.0)), F.coalesce(F.cos(angle), F.lit(0.0))]


def churn(added: Column, deleted: Column) -> Column:
    """Lines added and deleted; a missing side makes it null."""
    return added + deleted


def log_churn(added: Column, deleted: Column) -> Column:
    return F.log1p(churn(added, deleted).cast("double"))


def hour_cycle(ts: Column) -> list[Column]:
    return cyclic(F.hour(ts) + F.minute(ts) / 60, 24)


def weekday_cycle(ts: Column) -> list[Column]:
    """Monday is 0."""
    return cyclic(F.weekday(ts), 7)


def local_time(utc: Column, offset_seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(utc) - offset_seconds)


def zone_share(offset_seconds: Column) -> Column:
    return offset_seconds.cast("double") / 43200


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between timestamps, rounded down; not the number of midnights."""
    return F.floor((F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))) / 86400)


def finite(c: Column) -> Column:
    """NaN and infinite values are 0; null stays."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def finite_array(c: Column) -> Column:
    return F.transform(c, finite)


def bot_flag(email: Column, bots: Sequence[str] = BOTS) -> Column:
    return F.coalesce(normal_key(email).isin(*bots), F.lit(False)).cast("int")


def keyword_flag(message: Column, pattern: str = KEYWORDS) -> Column:
    return F.coalesce(message.rlike(f"(?i){pattern}"), F.lit(False)).cast("int")


def message_length(message: Column, null_text: str = "nan") -> Column:
    return F.length(F.coalesce(message, F.lit(null_text)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def hash_list(text: Column) -> Column:
    """The commit hashes in a written list: runs of 7 to 64 hexadecimal digits, so words like ``nan`` or ``None`` are none."""
    return F.regexp_extract_all(text, F.lit("(?<![0-9A-Za-z])[0-9A-Fa-f]{7,64}(?![0-9A-Za-z])"), F.lit(0))


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def parsed_tag(name: Column, days_from_commit: Column) -> dict[str, Column]:
    """Version numbers, flags and the signed log distance of a release tag."""
    part = lambda i: F.coalesce(F.regexp_extract(name, r"(\d+)\.(\d+)(?:\.(\d+))?", i).try_cast("int"), F.lit(0))
    flag = lambda words: F.coalesce(F.lower(name).rlike("|".join(words)), F.lit(False)).cast("int")
    return {
        "major": part(1), "minor": part(2), "patch": part(3), "prerelease": flag(PRERELEASE), "hotfix": flag(HOTFIX),
        "major_bump": ((part(1) > 0) & (part(2) == 0) & (part(3) == 0)).cast("int"), "log_days": signed_log(days_from_commit),
    }


def delay_hours(author: Column, committer: Column) -> Column:
    return (F.unix_timestamp(committer.cast("timestamp")) - F.unix_timestamp(author.cast("timestamp"))) / 3600


def delay_bin(hours: Column) -> Column:
    """Labelled bins, closed on the left; null for a null delay."""
    out = F.when(hours < DELAY_LIMITS[0], DELAY_NAMES[0])
    for limit, name in zip(DELAY_LIMITS[1:], DELAY_NAMES[1:], strict=False):
        out = out.when(hours < limit, name)
    return out.when(hours.isNotNull(), DELAY_NAMES[-1])


def issue_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"#(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def raw_numeric_columns(df: DataFrame, excluded: Sequence[str] = RAW_EXCLUDED) -> list[Column]:
    """Numeric and boolean columns whose names hold none of the excluded substrings; else a placeholder 1."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    found = [n for n, t in df.dtypes if (t in numeric or t.startswith("decimal")) and not any(x in n.lower() for x in excluded)]
    return [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in found] or [F.lit(1.0).alias("placeholder")]


def feature_vector(df: DataFrame, columns: Sequence[str], logged: Sequence[str]) -> Column:
    """Engineered features in a fixed order: log counts for some, missing ones 0."""
    return F.array(*[log_count(safe_double(df, c)) if c in logged else safe_double(df, c) for c in columns])


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))
