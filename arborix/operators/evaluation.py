"""The whole trust evaluation over many subjects at once: findings by rule, and a report.

Subjects: (subject_digest, by_digest, format, n_files, total_size, tree_digest).
Evidence, one row an item: (subject_digest, digest, identities array of (key_id,
issuer, subject), log_verified, via_fallback, signed_at, statement struct of
(predicate_type, subject_digest, tree_digest, format, lock_digest, builder,
sources array of (name, type, url, tree_digest))). Rejected: (subject_digest,
digest, matching, reason). Rules of an item are one pass over the evidence; the
only shuffle is by subject.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import digests


@dataclass(frozen=True)
class Identity:
    """A trusted signer: by key id, or by issuer with an exact subject or a pattern (neither: any subject)."""

    key_id: str | None = None
    issuer: str | None = None
    subject: str | None = None
    subject_pattern: str | None = None


def authority(url: Column) -> Column:
    """Host with port, without user information; null where the url has none."""
    host = F.regexp_replace(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"\A.*@", "")
    return F.when(host != "", host)


@dataclass(frozen=True)
class Rules:
    """What a policy asks; empty lists and zeros ask nothing."""

    identities: list[Identity] = field(default_factory=list)
    threshold: int = 0
    require_log: bool = False
    max_age_seconds: float | None = None
    require_digest_reference: bool = False
    formats: list[str] = field(default_factory=list)
    max_files: int = 0
    max_bytes: int = 0
    provenance_required: bool = False
    predicate_types: list[str] = field(default_factory=list)
    require_lock_digest: bool = False
    builders: list[str] = field(default_factory=list)
    source_types: list[str] = field(default_factory=list)
    source_hosts: list[str] = field(default_factory=list)
    require_immutable: bool = False
    reject_invalid_matching: bool = False
    allow_fallback: bool = False

    def __post_init__(self) -> None:
        if min(self.threshold, self.max_files, self.max_bytes) < 0 or (self.max_age_seconds or 0) < 0:
            raise ValueError("bounds can't be negative")
        if self.threshold and self.threshold > len(self.identities):
            raise ValueError("threshold exceeds the number of identities")
        for i in self.identities:
            if bool(i.key_id) == bool(i.issuer or i.subject or i.subject_pattern):
                raise ValueError("an identity names a key or an issuer, and not both")
            if not i.key_id and not i.issuer:
                raise ValueError("an identity with a subject names its issuer")
            if i.subject and i.subject_pattern:
                raise ValueError("an identity has a subject or a pattern")

    @property
    def effective_threshold(self) -> int:
        return self.threshold or int(self.provenance_required)

    @property
    def asks_sources(self) -> bool:
        return bool(self.source_types or self.source_hosts or self.require_immutable)

    @property
    def asks_provenance(self) -> bool:
        return bool(self.provenance_required or self.predicate_types or self.require_lock_digest or self.builders or self.asks_sources)


def _fits(rule: Identity, i: Column) -> Column:
    if rule.key_id:
        fits = F.lower(i["key_id"]) == rule.key_id.lower()
    else:
        fits = i["issuer"] == rule.issuer
        if rule.subject_pattern:
            fits = fits & i["subject"].rlike(rf"\A(?:{rule.subject_pattern})\z")
        elif rule.subject:
            fits = fits & (i["subject"] == rule.subject)
    return F.coalesce(fits, F.lit(False))


def _matched(rules: Rules, i: Column) -> Column:
    """The first rule an identity fits; without rules the identity itself; null for none."""
    if not rules.identities:
        named = F.when(F.coalesce(i["key_id"], F.lit("")) != "", i["key_id"]).otherwise(F.concat_ws("|", i["issuer"], i["subject"]))
        return F.when(named != "", named)
    out = F.lit(None).cast("string")
    for n, rule in reversed(list(enumerate(rules.identities))):
        out = F.when(_fits(rule, i), F.lit(str(n))).otherwise(out)
    return out


def accepted(rules: Rules, evidence: DataFrame) -> DataFrame:
    """Evidence with the rules (or identities) its signers match, and whether it counts."""
    matched = F.array_distinct(F.filter(F.transform("identities", lambda i: _matched(rules, i)), lambda m: m.isNotNull()))
    return evidence.withColumn("matched", F.coalesce(matched, F.array().cast("array<string>"))).withColumn("accepted", F.size("matched") > 0)


def _finding(when: Column | bool, code: str, rule: str, severity: str = "error") -> Column:
    """A finding where the condition isn't false: what can't be told isn't a pass."""
    holds = F.lit(when) if isinstance(when, bool) else F.coalesce(when, F.lit(True))
    return F.when(holds, F.struct(F.lit(code).alias("code"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))


def _listed(df: DataFrame, found: list[Column], about: str) -> DataFrame:
    some = F.filter(F.array(*found), lambda f: f.isNotNull())
    return df.select("subject_digest", F.col(about).alias("about"), F.explode(some).alias("f")).select("subject_digest", "about", "f.*")


def subject_findings(rules: Rules, subjects: DataFrame) -> DataFrame:
    found = []
    if rules.require_digest_reference:
        found.append(_finding(~F.col("by_digest"), "digest-reference-required", "subject.requireDigestReference"))
    if rules.formats:
        found.append(_finding(~F.col("format").isin(rules.formats), "format-not-allowed", "subject.allowedFormats"))
    if rules.max_files:
        found.append(_finding(F.col("n_files") > rules.max_files, "resource-limit", "subject.maxFiles"))
    if rules.max_bytes:
        found.append(_finding(F.col("total_size") > rules.max_bytes, "resource-limit", "subject.maxExpandedBytes"))
    return _listed(subjects, found or [_finding(False, "", "")], "subject_digest")


def signer_counts(subjects: DataFrame, judged: DataFrame) -> DataFrame:
    """(subject_digest, n_items, n_accepted, n_matched): items, those that count, and different rules (or identities) met."""
    signers = judged.select("subject_digest", F.explode("matched").alias("m")).groupBy("subject_digest").agg(F.countDistinct("m").alias("n_matched"))
    items = judged.groupBy("subject_digest").agg(F.count("*").alias("n_items"), F.count_if("accepted").alias("n_accepted"))
    return subjects.select("subject_digest").join(items, "subject_digest", "left").join(signers, "subject_digest", "left").fillna(0, ["n_matched", "n_items", "n_accepted"])


def accepted_identities(judged: DataFrame) -> DataFrame:
    """(subject_digest, identities): the rules (or identities) met, each once, in the order of the items that first met them."""
    met = judged.select("subject_digest", "digest", F.posexplode("matched").alias("at", "m"))
    first = met.groupBy("subject_digest", "m").agg(F.min(F.struct("digest", "at")).alias("f"))
    listed = first.groupBy("subject_digest").agg(F.array_sort(F.collect_list(F.struct("f", "m"))).alias("l"))  # as many as there are rules
    return listed.select("subject_digest", F.transform("l", lambda x: x["m"]).alias("identities"))


def expired(evaluated_at: Column, max_age_seconds: float) -> Column:
    """Whether an item of column signed_at is too old, or has no authenticated time."""
    return F.coalesce(F.unix_micros(evaluated_at) - F.unix_micros("signed_at") > int(max_age_seconds * 1_000_000), F.lit(True))


def signature_findings(rules: Rules, subjects: DataFrame, judged: DataFrame) -> DataFrame:
    """Of each subject: too few rules met, no evidence, no log proof; and whether provenance that is required is there."""
    s = signer_counts(subjects, judged)
    found = []
    if rules.effective_threshold:
        if rules.identities:
            found.append(_finding(F.col("n_matched") < rules.effective_threshold, "signature-threshold", "signatures.threshold"))
        else:
            found.append(_finding(F.col("n_items") == 0, "signature-threshold", "provenance.required"))
        if rules.require_log:
            found.append(_finding(F.col("n_accepted") == 0, "transparency-proof", "signatures.requireTransparencyLog"))
    if rules.provenance_required:
        found.append(_finding(F.col("n_accepted") == 0, "provenance-required", "provenance.required"))
    return _listed(s, found or [_finding(False, "", "")], "subject_digest")


def item_findings(rules: Rules, subjects: DataFrame, judged: DataFrame, evaluated_at: Column) -> DataFrame:
    """Of each accepted item: log proof, age, and what its statement says; of every item: the way it was found."""
    own = subjects.select("subject_digest", F.col("tree_digest").alias("own_tree"), F.col("format").alias("own_format"))
    e = judged.join(own, "subject_digest")
    st = lambda c: F.coalesce(F.col(f"statement.{c}"), F.lit(""))
    found, statement = [], []
    if rules.effective_threshold and rules.require_log:
        found.append(_finding(F.col("accepted") & ~F.coalesce("log_verified", F.lit(False)), "transparency-proof", "signatures.requireTransparencyLog"))
    if rules.max_age_seconds is not None:
        found.append(_finding(F.col("accepted") & expired(evaluated_at, rules.max_age_seconds), "evidence-expired", "evidence.maxAge"))
    if not rules.allow_fallback:
        found.append(_finding(F.coalesce("via_fallback", F.lit(False)), "tag-fallback-not-allowed", "evidence.allowTagFallback"))
    if rules.asks_provenance:
        bound = st("subject_digest") == F.col("subject_digest")
        if rules.predicate_types:
            statement.append(_finding(~st("predicate_type").isin(rules.predicate_types), "predicate-not-allowed", "provenance.predicateTypes"))
        statement.append(_finding(~bound, "subject-mismatch", "provenance.subject"))
        differs = lambda claim, own: bound & (st(claim) != "") & (F.coalesce(own, F.lit("")) != "") & (st(claim) != F.col(own))
        statement.append(_finding(F.coalesce(differs("tree_digest", "own_tree"), F.lit(False)), "provenance-inconsistent", "provenance.treeDigest"))
        statement.append(_finding(F.coalesce(differs("format", "own_format"), F.lit(False)), "provenance-inconsistent", "provenance.formatVersion"))
        if rules.require_lock_digest:
            statement.append(_finding(bound & ~st("lock_digest").rlike(digests.DIGEST), "lock-digest-required", "provenance.requireLockDigest"))
        if rules.builders:
            statement.append(_finding(bound & ~st("builder").isin(rules.builders), "builder-not-allowed", "provenance.allowedBuilders"))
        if rules.asks_sources:
            statement.append(_finding(bound & (F.coalesce(F.size("statement.sources"), F.lit(0)) < 1), "provenance-inconsistent", "provenance.sources"))
    found += [F.when(F.col("accepted"), f) for f in statement]
    return _listed(e, found or [_finding(False, "", "")], "digest")


def source_findings(rules: Rules, judged: DataFrame) -> DataFrame:
    """Of each source that an accepted, rightly bound statement names: type, host, immutable resolution."""
    bound = F.col("accepted") & (F.col("statement.subject_digest") == F.col("subject_digest"))
    s = judged.where(bound).select("subject_digest", "digest", F.explode("statement.sources").alias("s"))
    found = []
    if rules.source_types:
        found.append(_finding(~F.col("s.type").isin(rules.source_types), "source-type-not-allowed", "provenance.sources.allowedTypes"))
    if rules.source_hosts:
        found.append(_finding(~authority(F.col("s.url")).isin(rules.source_hosts), "source-host-not-allowed", "provenance.sources.allowedHosts"))
    if rules.require_immutable:
        found.append(_finding(~F.coalesce("s.tree_digest", F.lit("")).rlike(digests.DIGEST), "immutable-resolution", "provenance.sources.requireImmutableResolution"))
    return _listed(s, found or [_finding(False, "", "")], "digest")


def rejected_findings(rules: Rules, rejected: DataFrame) -> DataFrame:
    """A warning for each rejected candidate; an error where it claims to be what is asked for and the policy says so."""
    hard = F.coalesce("matching", F.lit(False)) & F.lit(rules.reject_invalid_matching)
    return rejected.select("subject_digest", F.col("digest").alias("about"), F.when(hard, "matching-evidence-invalid").otherwise("ignored-evidence").alias("code"), F.lit("evidence.rejectInvalidMatchingEvidence").alias("rule"), F.when(hard, "error").otherwise("warning").alias("severity"))


def evaluate(rules: Rules, subjects: DataFrame, evidence: DataFrame, evaluated_at: Column, rejected: DataFrame | None = None) -> DataFrame:
    """(subject_digest, about, code, rule, severity) of everything that is wrong."""
    judged = accepted(rules, evidence)
    parts = [subject_findings(rules, subjects), signature_findings(rules, subjects, judged), item_findings(rules, subjects, judged, evaluated_at)]
    if rules.asks_sources:
        parts.append(source_findings(rules, judged))
    if rejected is not None:
        parts.append(rejected_findings(rules, rejected))
    return reduce(DataFrame.unionByName, parts)


def reports(subjects: DataFrame, findings: DataFrame, integrity: DataFrame | None = None, semantics: DataFrame | None = None) -> DataFrame:
    """(subject_digest, errors, warnings, trust, integrity, semantics, ok): three statuses that never stand in for each other.

    integrity: findings (subject_digest) of reading; semantics: (subject_digest, failed). What wasn't evaluated isn't a pass.
    """
    sums = findings.groupBy("subject_digest").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = subjects.select("subject_digest").join(sums, "subject_digest", "left").fillna(0, ["errors", "warnings"])
    out = out.withColumn("trust", F.when(F.col("errors") == 0, "pass").otherwise("fail"))
    unknown = F.lit("not-evaluated")
    if integrity is None:
        out = out.withColumn("integrity", unknown)
    else:
        bad = integrity.select("subject_digest").distinct().withColumn("integrity", F.lit("fail"))
        out = out.join(bad, "subject_digest", "left").withColumn("integrity", F.coalesce("integrity", F.lit("pass")))
    if semantics is None:
        out = out.withColumn("semantics", unknown)
    else:
        status = semantics.groupBy("subject_digest").agg(F.when(F.bool_or("failed"), "fail").otherwise("pass").alias("semantics"))
        out = out.join(status, "subject_digest", "left").withColumn("semantics", F.coalesce("semantics", unknown))
    return out.withColumn("ok", (F.col("trust") == "pass") & (F.col("integrity") == "pass") & (F.col("semantics") != "fail"))


def gated(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The rows (subject_digest, ...) of subjects whose report is ok: what may be written."""
    return rows.join(report.where("ok").select("subject_digest"), "subject_digest", "left_semi")
