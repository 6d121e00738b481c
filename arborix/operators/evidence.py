"""From attached candidates to verified evidence: each candidate is accepted or rejected for the first thing wrong with it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import references
from . import documents as docs

#: Tells whether a signature over the bytes is of the key: (key, signed bytes, signature).
Verify = Callable[[bytes, bytes, bytes], bool]

STATEMENT = "_type string, subject array<struct<name:string, digest:map<string,string>>>, predicateType string, predicate string"


def key_id(der: Column) -> Column:
    """Hex SHA-256 of a public key's DER form."""
    return F.sha2(der, 256)


def verified_keys(envelopes: DataFrame, keys: dict[str, bytes], verify: Verify) -> DataFrame:
    """(subject_digest, digest, key_ids) of envelopes (subject_digest, digest, payload_type, payload bytes, signatures array of bytes).

    A key counts once however often it signed. keys are the few that are trusted; they travel with the function.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            signers = [sorted({k for k, key in keys.items() for s in (sigs if sigs is not None else []) if _holds(verify, key, form, s)}) for form, sigs in zip(f["form"], f["signatures"], strict=True)]
            yield pd.DataFrame({"subject_digest": f["subject_digest"], "digest": f["digest"], "key_ids": signers})

    form = references.pre_authentication(F.col("payload_type"), F.col("payload"))
    return envelopes.select("subject_digest", "digest", form.alias("form"), "signatures").mapInPandas(run, "subject_digest string, digest string, key_ids array<string>")


def _holds(verify: Verify, key: bytes, form: bytes, signature: bytes) -> bool:
    """A verifier that can't read a signature hasn't verified it."""
    try:
        return verify(key, bytes(form), bytes(signature))
    except ValueError:
        return False


def judged(candidates: DataFrame, signers: DataFrame, predicate_types: list[str], required_type: str) -> DataFrame:
    """Candidates with reason (null: verified), matching (of the type asked for), the statement's parts and key_ids.

    candidates: (subject_digest, digest, artifact_type, envelope text).
    """
    e = F.from_json("envelope", docs.ENVELOPE)
    rows = candidates.join(signers, ["subject_digest", "digest"], "left").withColumn("e", e)
    rows = rows.withColumn("payload", F.try_to_binary("e.payload", F.lit("base64")))
    rows = rows.withColumn("st", F.from_json(F.when(F.is_valid_utf8(F.col("payload").cast("string")), F.col("payload").cast("string")), STATEMENT))
    bound = F.try_element_at(F.try_element_at("st.subject", F.lit(1))["digest"], F.lit("sha256"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    reason = (
        F.when(F.coalesce("artifact_type", F.lit("")) != required_type, "another type")
        .when(F.col("e").isNull() | F.col("payload").isNull(), "not an envelope")
        .when(size("e.signatures") < 1, "no signature")
        .when(size("key_ids") < 1, "no trusted signature")
        .when(F.coalesce(F.col("st._type"), F.lit("")) != docs.STATEMENT_TYPE, "not a statement")
        .when(size("st.subject") != 1, "number of subjects")
        .when(~F.coalesce("st.predicateType", F.lit("")).isin(predicate_types), "predicate type")
        .when(~F.concat(F.lit("sha256:"), bound).eqNullSafe(F.col("subject_digest")), "another subject")
    )
    out = rows.withColumns({"reason": reason, "matching": F.col("artifact_type").eqNullSafe(required_type)})
    return out.select("subject_digest", "digest", "reason", "matching", "key_ids", F.col("st.predicateType").alias("predicate_type"), F.col("st.predicate").alias("predicate"))
