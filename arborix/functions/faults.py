"""How classified faults end a command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exit status of each group of codes
EXITS = {
    2: ["invalid-input", "unsupported-version", "unsupported-source"],
    3: ["source-resolution", "stale-lock", "unsafe-path", "unsupported-file", "path-collision"],
    4: ["digest-mismatch", "invalid-artifact", "destination-exists", "limit-exceeded"],
    5: ["evidence-invalid", "policy-failed"],
    6: ["authentication", "authorization", "transport", "timeout"],
    7: ["semantics-failed"],
}
SUCCESS, INTERNAL, INTERRUPTED, CANCELED = 0, 10, 130, 6


def exit_code(code: Column, interrupted: bool = False) -> Column:
    """0 for null; a cancellation counts as an interruption only where a signal was seen; unknown codes are internal."""
    out = F.lit(INTERNAL)
    for status, codes in EXITS.items():
        out = F.when(code.isin(codes), status).otherwise(out)
    return F.when(code.isNull(), SUCCESS).when(code == "canceled", INTERRUPTED if interrupted else CANCELED).otherwise(out)


def worst_exits(findings: DataFrame) -> DataFrame:
    """(bundle_id, exit_code): the highest status among a bundle's findings."""
    return findings.groupBy("bundle_id").agg(F.max(exit_code(F.col("code"))).alias("exit_code"))


_NETWORK = r"(?i)timed? ?out|deadline exceeded|connection (?:refused|reset)|no such host|unreachable|unexpected EOF|handshake"


def registry_code(status: Column, message: Column) -> Column:
    """What a registry's failure is: wrong content first, as that never heals; then what isn't there, who asks, what they may; else transport. Null for none."""
    wrong = F.coalesce(message, F.lit("")).contains("digest mismatch")
    code = F.when(wrong, "digest-mismatch").when(status == 404, "invalid-artifact").when(status == 401, "authentication").when(status == 403, "authorization").otherwise("transport")
    return F.when(status.isNotNull() | message.isNotNull(), code)


def clone_code(message: Column) -> Column:
    """What a failure to fetch a repository is; null for none."""
    code = F.when(message.contains("authentication required") | message.contains("authorization failed"), "authentication").when(message.contains("repository not found"), "source-resolution").when(message.rlike(_NETWORK), "transport").otherwise("source-resolution")
    return F.when(message.isNotNull(), code)


def signing_code(message: Column) -> Column:
    """What a failure to sign or to verify is; null for none."""
    code = F.when(message.contains("no identity token") | message.contains("unauthorized") | message.contains("401"), "authentication").when(message.rlike(_NETWORK), "transport").otherwise("evidence-invalid")
    return F.when(message.isNotNull(), code)


def is_temporary(code: Column) -> Column:
    """Whether trying again may help: never with what was rejected or served wrongly."""
    return code.isin("transport", "timeout")
