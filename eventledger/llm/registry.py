"""Queries of the corpus operators and the SQL that some of them are checked against."""

from . import decontam, licenses, media, mixing, neardup, pii, secrets, sql, tokenfile, toxicity, urls

QUERIES = {
    "op1_media": media.op1_media,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pii": pii.op3_pii,
    "op4_decontam": decontam.op4_decontam,
    "op5_secrets": secrets.op5_secrets,
    "op6_licenses": licenses.op6_licenses,
    "op7_tokenfile": tokenfile.op7_tokenfile,
    "op8_urls": urls.op8_urls,
    "op9_neardup": neardup.op9_neardup,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES = {
    "op4_decontam": sql.DECONTAM,
    "op9_neardup": sql.NEARDUP,
    "op10_mixing": mixing.ORACLE,
}
