"""Personal data: detection, masking, pseudonyms, access, retention, erasure, text screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecraft.functions.exprs import any_of, case_map, col, json_valid, match_count
from zonecraft.functions.hashing import digest, mask_keep_last

# Detection patterns by kind of personal data.
PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "zip_code": r"\b\d{5}(?:-\d{4})?\b",
}

# Parts of column names that indicate personal data, checked in this order.
NAME_HINTS = {
    "ssn": ["ssn", "social_security", "social_sec"],
    "email": ["email", "e_mail", "mail"],
    "phone": ["phone", "tel", "telephone", "mobile", "cell"],
    "credit_card": ["credit_card", "card_number"],
    "name": ["name", "first_name", "last_name", "full_name"],
    "address": ["address", "street", "city", "state"],
    "date_of_birth": ["dob", "date_of_birth", "birth_date", "birthdate"],
    "medical_record_number": ["mrn", "medical_record", "patient_id"],
    "bank_account": ["account_number", "account_no", "bank_account"],
}

# Recommended masking by kind; anything else is hashed.
RECOMMENDED = {
    "ssn": "hash", "credit_card": "partial", "email": "tokenize", "phone": "partial", "ip_address": "hash",
    "date_of_birth": "fake", "name": "tokenize", "address": "redact", "medical_record_number": "hash", "bank_account": "partial",
}


def name_kind(column: str, match: str = "substring") -> str | None:
    """Kind suggested by a column name; `match='token'` compares whole words only."""
    words = column.lower().replace("-", " ").replace("_", " ")
    for kind, hints in NAME_HINTS.items():
        for h in hints:
            h = h.replace("_", " ")
            if h in words if match == "substring" else f" {h} " in f" {words} ":
                return kind
    return None


def name_kind_column(c) -> Column:
    """name_kind for a column that holds column names."""
    words = F.translate(F.lower(col(c)), "-_", "  ")
    out = None
    for kind, hints in NAME_HINTS.items():
        hit = any_of([words.contains(h.replace("_", " ")) for h in hints])
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def recommended(kind) -> Column:
    """Masking strategy for a kind of personal data."""
    return F.coalesce(case_map(col(kind), RECOMMENDED), F.lit("hash"))


def pattern_counts(df: DataFrame, columns=None) -> DataFrame:
    """Per string column and pattern: rows with a value and rows that match, in one pass."""
    cols = [c for c in (columns or df.columns) if df.schema[c].dataType.typeName() in ("string", "varchar")]
    present = {c: F.coalesce(F.length(c) > 0, F.lit(False)) for c in cols}
    aggs = [F.count_if(present[c]).alias(f"n{i}") for i, c in enumerate(cols)]
    aggs += [F.count_if(F.col(c).rlike(p)).alias(f"m{i}_{k}") for i, c in enumerate(cols) for k, p in PATTERNS.items()]
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), F.col(f"n{i}").alias("total_count"), F.col(f"m{i}_{k}").alias("match_count"))
            for i, c in enumerate(cols) for k in PATTERNS]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def detect(df: DataFrame, threshold: float = 0.7, columns=None, match: str = "substring") -> DataFrame:
    """Kind and confidence per column: name .8, name and pattern .95, pattern by share of rows."""
    counts = pattern_counts(df, columns)
    named = {c: name_kind(c, match) for c in (columns or df.columns)}
    h = hint = case_map(F.col("column_name"), {c: k for c, k in named.items() if k} or {"": ""})
    order = F.lit(0)
    for i, k in enumerate(PATTERNS):
        order = F.when(F.col("kind") == k, F.lit(-i)).otherwise(order)
    hits = F.col("match_count") > 0
    g = counts.groupBy("column_name").agg(
        F.max("total_count").alias("total_count"),
        F.max(F.struct(F.col("match_count").alias("m"), order.alias("o"), F.col("kind").alias("k"))).alias("_best"),
        F.max(F.when(F.col("kind") == hint, F.col("match_count"))).alias("_own"))
    own = F.coalesce("_own", F.lit(0)) > 0
    share = F.col("_best.m") / F.col("total_count")
    kind = F.when(h.isNotNull(), h).when(F.col("_best.m") > 0, F.col("_best.k"))
    conf = (F.when(h.isNotNull(), F.when(own, 0.95).otherwise(0.8))
            .when(F.col("_best.m") > 0, F.least(F.lit(0.9), 0.5 + share * 0.4)))
    n = F.when(h.isNotNull(), F.when(own, F.col("_own")).otherwise(F.col("total_count"))).otherwise(F.col("_best.m"))
    return (g.filter(F.col("total_count") > 0).select("column_name", kind.alias("kind"), conf.alias("confidence"), n.alias("match_count"), "total_count")
            .filter(F.col("confidence") >= threshold)
            .withColumn("match_pct", 100.0 * F.col("match_count") / F.col("total_count"))
            .withColumn("masking", recommended("kind")))


def _seeded(x: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(size))


def mask(c, strategy: str, kind: str | None = None, key: str | None = None) -> Column:
    """Masked value of a column: redact, hash, partial, tokenize, null, fake or encrypt.

    Fake values are derived from the value's hash so that reruns agree."""
    x = col(c).cast("string")
    if strategy == "redact":
        out = F.lit("***REDACTED***")
    elif strategy == "hash":
        out = F.sha2(x, 256)
    elif strategy == "tokenize":
        out = F.concat(F.lit("TOK_"), F.md5(x))
    elif strategy == "partial":
        if kind == "credit_card":
            out = F.when(F.length(x) > 4, F.concat(F.lit("**** **** **** "), F.right(x, F.lit(4)))).otherwise(F.repeat(F.lit("*"), F.length(x)))
        else:
            out = mask_keep_last(x, 4)
    elif strategy == "null":
        return F.lit(None).cast("string")
    elif strategy == "fake":
        if kind == "date_of_birth":
            out = F.concat((F.lit(1950) + _seeded(x, 50)).cast("string"), F.lit("-01-01"))
        elif kind == "email":
            out = F.concat(F.lit("user"), _seeded(x, 10000).cast("string"), F.lit("@example.com"))
        else:
            out = F.lit("FAKE_DATA")
    elif strategy == "encrypt":
        if not key:
            raise ValueError("encryption needs a key")
        out = F.base64(F.aes_encrypt(x, F.lit(key)))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return F.when(x.isNotNull(), out)


def decrypt(c, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(col(c)), F.lit(key)).cast("string")


def enforce(df: DataFrame, classifications, key: str | None = None) -> DataFrame:
    """Apply classification rows `{column_name, masking_strategy, pii_type}` in one projection."""
    plan = {}
    known = {"redact", "hash", "partial", "tokenize", "null", "fake", "encrypt"}
    for c in classifications:
        s = c.get("masking_strategy", "hash").lower().replace("partial_mask", "partial")
        if c["column_name"] in df.columns:
            plan[c["column_name"]] = mask(c["column_name"], s if s in known else "hash", (c.get("pii_type") or "name").lower(), key)
    return df.withColumns(plan)


def detect_and_mask(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Detect on the whole table, then mask the found columns.  The findings are at most one row
    per column."""
    found = detect(df, threshold).collect()
    return enforce(df, [{"column_name": r.column_name, "masking_strategy": r.masking, "pii_type": r.kind} for r in found])


def pseudonym(c, method: str, salt: str = "", concat=None) -> Column:
    """Deterministic pseudonym of a column.

    fpe: as many hash characters as the value has; fpe_hk: hash of the value; fpe_col_concat_hk:
    hash of several columns; fpe_md5: salted md5; hash / sha256 / sha512 / md5."""
    x = col(c).cast("string")
    if method == "fpe":
        return F.substring(F.sha2(x, 256), F.lit(1), F.length(x))
    if method == "fpe_md5":
        return F.md5(F.concat(x, F.lit(salt)))
    if method == "fpe_hk":
        return F.sha2(x, 256)
    if method == "fpe_hk_md5":
        return F.md5(F.upper(F.trim(x)))
    if method == "fpe_col_concat_hk":
        return F.sha2(F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("")) for k in (concat or [c])]), 256)
    if method in ("hash", "sha256", "sha512", "md5"):
        return digest(x, "sha256" if method == "hash" else method)
    raise ValueError(f"unknown method {method}")


def pseudonymise(df: DataFrame, columns) -> DataFrame:
    """`columns` maps a column to a method, or to (method, source columns); hash keys get their
    own `_hk` column."""
    out = {}
    for c, m in columns.items():
        m, parts = (m, None) if isinstance(m, str) else m
        out[f"{c}_hk" if m.startswith("fpe_") and "hk" in m else c] = pseudonym(c, m, concat=parts)
    return df.withColumns(out)


def redact_text(c, kinds=("ssn", "credit_card", "email", "phone", "ip_address")) -> Column:
    """Replace every occurrence in free text by a marker of its kind."""
    x = col(c)
    for k in kinds:
        x = F.regexp_replace(x, PATTERNS[k], f"[REDACTED-{k.upper()}]")
    return x


# Access levels from weakest to strongest.
ACCESS_RANK = {"MASKED_READ": 0, "READ": 1, "WRITE": 2, "ADMIN": 3}


def access_decisions(requests: DataFrame, grants: DataFrame, now: str, keys=("principal_id", "resource_id")) -> DataFrame:
    """Granted when the strongest active, unexpired grant reaches the required level."""
    live = grants.filter(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))))
    best = live.groupBy(*[F.col(k).alias(f"g_{k}") for k in keys]).agg(F.max(case_map(F.col("access_level"), ACCESS_RANK, 0)).alias("_rank"))
    cond = None
    for k in keys:
        e = F.col(k) == F.col(f"g_{k}")
        cond = e if cond is None else cond & e
    need = case_map(F.col("required_level"), ACCESS_RANK, 1)
    return (requests.join(best, cond, "left").withColumn("granted", F.coalesce(F.col("_rank") >= need, F.lit(False)))
            .drop("_rank", *[f"g_{k}" for k in keys]))


def masked_columns(classified: DataFrame, grants: DataFrame, principals: DataFrame) -> DataFrame:
    """Sensitive columns a principal may only see masked: no READ or stronger column grant."""
    sensitive = classified.filter(F.col("classification_type").isin("PII", "PHI"))
    wanted = principals.join(sensitive, "asset_id").select("principal_id", "asset_id", "column_name")
    g = grants.filter(F.col("is_active") & F.col("access_level").isin("READ", "WRITE", "ADMIN"))
    return wanted.join(g.select("principal_id", F.col("resource_id").alias("column_name")).distinct(), ["principal_id", "column_name"], "left_anti")


def pii_columns(classified: DataFrame, assets: DataFrame) -> DataFrame:
    return classified.filter(F.col("classification_type").isin("PII", "PHI")).join(assets.filter("is_active"), "asset_id")


# Retention days, deletion method and archive-first flag by data category.
RETENTION = {
    "audit_logs": (2555, "secure_delete", True), "ai_decisions": (365, "secure_delete", True), "incident_data": (365, "anonymize_then_delete", True),
    "pii_data": (90, "secure_delete", False), "metrics": (180, "aggregate_then_delete", False), "llm_traces": (90, "secure_delete", True),
    "embeddings": (365, "recompute_without_source", False),
}


def with_retention(df: DataFrame, category, created: str, as_of: str) -> DataFrame:
    """Cutoff, expiry, method and archive flag per row; unknown categories never expire."""
    c = col(category)
    days = case_map(c, {k: v[0] for k, v in RETENTION.items()})
    now = F.lit(as_of).cast("date")
    return df.withColumns({"cutoff_date": F.date_sub(now, days), "is_expired": F.coalesce(F.col(created).cast("date") < F.date_sub(now, days), F.lit(False)),
                           "deletion_method": case_map(c, {k: v[1] for k, v in RETENTION.items()}),
                           "archive_first": case_map(c, {k: v[2] for k, v in RETENTION.items()})})


def retention_report(df: DataFrame, category: str, created: str, as_of: str) -> DataFrame:
    return (with_retention(df, category, created, as_of).groupBy(category, "cutoff_date", "deletion_method", "archive_first")
            .agg(F.count(F.lit(1)).alias("records"), F.count_if("is_expired").alias("expired")))


def without_expired(df: DataFrame, category: str, created: str, as_of: str) -> DataFrame:
    return with_retention(df, category, created, as_of).filter(~F.col("is_expired")).select(*df.columns)


def erase(df: DataFrame, subject: str, requests: DataFrame, request_key: str) -> DataFrame:
    """Table without the rows of the subjects to erase."""
    return df.join(requests.select(F.col(request_key).alias("_subject")).distinct(), F.col(subject) == F.col("_subject"), "left_anti")


def audit_checksum(*parts) -> Column:
    return F.substring(F.sha2(F.concat(*[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def compliance_counts(events: DataFrame, actor: str, oversight: Column, risk: str, by=()) -> DataFrame:
    ai = F.count_if(F.col(actor) == "ai")
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_events"), ai.alias("ai_decisions"), F.count_if(oversight).alias("human_oversights"),
        F.count_if(F.col(risk).isin("high", "critical")).alias("high_risk_events"),
        (F.count_if(oversight) / F.greatest(ai, F.lit(1))).alias("oversight_rate"))


# Prompt-injection patterns (matched without regard to case).
INJECTION = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)",
    r"disregard\s+(all\s+)?(previous|prior|above)",
    r"forget\s+(everything|all)\s+(you|that)",
    r"new\s+instructions?:",
    r"override\s+(system|previous)\s+prompt",
    r"you\s+are\s+(now|actually)\s+a",
    r"pretend\s+(to\s+be|you\s+are)",
    r"act\s+as\s+(if|though)",
    r"roleplay\s+as",
    r"switch\s+to\s+\w+\s+mode",
    r"do\s+anything\s+now",
    r"dan\s+mode",
    r"developer\s+mode\s+enabled",
    r"jailbreak",
    r"bypass\s+(safety|security|filters?)",
    r"(show|reveal|print|display|output)\s+(your|the)\s+(system\s+)?prompt",
    r"what\s+(is|are)\s+your\s+(instructions?|rules?|prompt)",
    r"repeat\s+(your|the)\s+(system\s+)?prompt",
    r"base64\s*:",
    r"decode\s+this:",
    r"hex\s*:",
]

# Command-injection patterns.
COMMANDS = [
    r";\s*(rm|wget|curl|nc|bash|sh|python|perl|cat|head|tail|less|more)",
    r"\|\s*(rm|wget|curl|nc|bash|sh|cat|head|tail|less|more|grep|awk|sed)",
    r"\$\([^)]+\)",
    r"`[^`]+`",
    r"&&\s*(rm|wget|curl|cat)",
    r"/etc/(passwd|shadow|hosts|sudoers)",
    r"--no-preserve-root",
]

# Personal data in screened input.
INPUT_PII = {
    "SSN": r"\b\d{3}[-.]?\d{2}[-.]?\d{4}\b", "credit_card": r"\b\d{16}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
}

# Harmful output, output formats, blocked and sensitive topics.
HARMFUL = [
    r"rm\s+-rf\s+/",
    r":\(\)\{ :\|:& \};:",
    r"mkfs\.",
    r"dd\s+if=.*of=/dev/",
    r"(password|api_key|secret|token)\s*[:=]\s*['\"][^'\"]+['\"]",
    r"chmod\s+777",
    r"sudo\s+su\s+-",
]
FORMATS = {"json": r"^\s*[\[{]", "script": r"^(#!/|#\s|echo|gcloud|kubectl|ansible)"}
BLOCKED = [
    r"\b(hack|exploit|attack)\b.*\b(other|external|customer)\b",
    r"\bddos\b",
    r"\bransomware\b",
    r"\bmalware\b.*\b(create|deploy|spread)\b",
]
SENSITIVE = [
    r"\bproduction\b.*\b(database|db)\b",
    r"\bdelete\b.*\ball\b",
    r"\bdrop\b.*\btable\b",
    r"\btruncate\b",
]


def _nocase(patterns):
    return ["(?i)" + p for p in patterns]


def screen_input(df: DataFrame, text: str = "text", context: str = "general", max_length: int = 10_000) -> DataFrame:
    """Score a text for injection: none 1, one .6, two .3, more .1; commands .3; passes from .5."""
    x = F.col(text)
    n = match_count(x, _nocase(INJECTION))
    long = F.when(F.length(x) > max_length, 0.8).otherwise(1.0)
    inj = F.when(F.col("injection_hits") == 0, 1.0).when(F.col("injection_hits") == 1, 0.6).when(F.col("injection_hits") == 2, 0.3).otherwise(0.1)
    cmd = any_of([x.rlike(p) for p in _nocase(COMMANDS)]) if context == "incident" else F.lit(False)
    found = F.array_compact(F.array(*[F.when(x.rlike(p), F.lit(k)) for k, p in INPUT_PII.items()]))
    return (df.withColumns({"injection_hits": n, "command_hit": cmd, "pii_found": found})
            .withColumn("score", F.least(long, inj, F.when(F.col("command_hit"), 0.3).otherwise(1.0)))
            .withColumn("passed", F.col("score") >= 0.5))


def screen_output(df: DataFrame, text: str = "text", expected: str | None = None, max_length: int = 50_000) -> DataFrame:
    """Score generated text: length, harmful patterns, expected format, JSON validity."""
    x = F.col(text)
    base = F.when(F.length(x) > max_length, 0.9).otherwise(1.0)
    harmful = any_of([x.rlike(p) for p in _nocase(HARMFUL)])
    score = F.least(base, F.when(F.col("harmful"), 0.2).otherwise(1.0))
    good = x.rlike(FORMATS[expected]) if expected in FORMATS else F.lit(True)
    valid = json_valid(x) if expected == "json" else F.lit(True)
    score = score - F.when(F.col("format_ok"), 0.0).otherwise(0.2) - F.when(F.col("json_ok"), 0.0).otherwise(0.3)
    return (df.withColumns({"harmful": harmful, "format_ok": good, "json_ok": valid})
            .withColumn("score", score).withColumn("passed", F.col("score") >= 0.5))


def moderate(df: DataFrame, text: str = "text") -> DataFrame:
    """0 for blocked topics, .7 for sensitive ones that need review, else 1."""
    x = F.col(text)
    blocked = any_of([x.rlike(p) for p in _nocase(BLOCKED)])
    sensitive = any_of([x.rlike(p) for p in _nocase(SENSITIVE)])
    return df.withColumn("moderation", F.when(blocked, 0.0).when(sensitive, 0.7).otherwise(1.0))
