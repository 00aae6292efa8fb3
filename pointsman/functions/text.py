"""Text, name, id and hash columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, as a regex class body.
WS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

# Short spellings that stand for one dataset name.
NAME_ALIASES = {
    "swebench": "swe_bench",
    "tau2bench": "tau2",
    "tau2": "tau2",
    "mmlupro": "mmlupro",
}

# Dataset name to capability domain.
DATASET_DOMAINS = {
    "aime": "math",
    "math500": "math",
    "mathbench": "math",
    "livemathbench": "math",
    "humaneval": "code",
    "mbpp": "code",
    "livecodebench": "code",
    "swe_bench": "code",
    "swe-bench": "code",
    "bbh": "logic",
    "korbench": "logic",
    "kandk": "logic",
    "knights_and_knaves": "logic",
    "knights-knaves": "logic",
    "mmlu_pro": "knowledge",
    "mmlu-pro": "knowledge",
    "mmlupro": "knowledge",
    "gpqa": "knowledge",
    "finqa": "knowledge",
    "medqa": "knowledge",
    "hle": "knowledge",
    "simpleqa": "knowledge",
    "emorynlp": "affective",
    "meld": "affective",
    "arenahard": "instruction_following",
    "arena_hard": "instruction_following",
    "tau2": "tool_use",
    "tau2_bench": "tool_use",
    "tau2-bench": "tool_use",
}


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in values.items() for v in kv])


def collapse_ws(c: Column) -> Column:
    """White space runs become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def is_blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(~c.rlike(f"[^{WS}]"), F.lit(True))


def query_hash(c: Column) -> Column:
    return F.sha2(collapse_ws(c), 256)


def leakage_group(dataset: Column, query: Column) -> Column:
    """Identical router input within a dataset gets the same group."""
    return F.sha2(F.concat(dataset, F.lit("\0"), collapse_ws(F.coalesce(query, F.lit("")))), 256)


def normalize_name(c: Column) -> Column:
    text = F.replace(F.lower(strip_ws(c)), F.lit("²"), F.lit("2"))
    text = F.btrim(F.regexp_replace(text, f"[-_{WS}]+", "_"), F.lit("_"))
    return F.coalesce(literal_map(NAME_ALIASES)[F.replace(text, F.lit("_"), F.lit(""))], text)


def domain_of(dataset: Column, domains: dict[str, str] = DATASET_DOMAINS) -> Column:
    return F.coalesce(literal_map(domains)[normalize_name(dataset)], F.lit("unknown"))


def identity_text(prompt: Column, origin: Column, prefer: str = "origin_query") -> Column:
    """The preferred field, the other one when it is blank, null when both are."""
    first, second = (prompt, origin) if prefer == "prompt" else (origin, prompt)
    return F.when(~is_blank(first), first).when(~is_blank(second), second)


def sample_id(
    rule: str, dataset: Column, split: Column, index: Column, digest: Column
) -> Column:
    """Sample ids by one of five rules.

    content, content_split: dataset [split] and 16 digits of the query digest;
    index, index_split: dataset [split], the word idx and the record index;
    frozen: dataset, split, record index and 12 digits of the digest.
    """
    parts = {
        "content": [dataset, F.substring(digest, 1, 16)],
        "content_split": [dataset, split, F.substring(digest, 1, 16)],
        "index": [dataset, F.lit("idx"), index],
        "index_split": [dataset, split, F.lit("idx"), index],
        "frozen": [dataset, split, index, F.substring(digest, 1, 12)],
    }[rule]
    return F.concat_ws(":", *parts)


def digest_is_valid(digest: Column) -> Column:
    return F.coalesce(F.lower(digest).rlike("^[0-9a-f]{64}$"), F.lit(False))


def filename_timestamp(path: Column) -> Column:
    """Sortable integer from a name ending in YYYYMMDD_HHMMSS.json; 0 without one."""
    pattern = r"(\d{8})_(\d{6})\.json$"
    digits = F.concat(F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2))
    return F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("long"))


def sanitize_label(c: Column) -> Column:
    return F.translate(c, " /", "__")


def probe_of(feature: Column) -> Column:
    """Probe name inside a `<backend>_<probe>__<stat>` feature name, for any backend."""
    return F.regexp_extract(feature, r"^[^_]+_(.*?)__", 1)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys; nulls are kept."""
    cols = [fields[k].alias(k) for k in sorted(fields)]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def canonical_json_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)
